"""Reading order and paragraphs of a page's word boxes (``page_id, text, x0, x1, top, bottom``).

A page's boxes are numpy arrays.  A flow is an array of word positions in reading order; a paragraph is a stretch of
one.  Per-page measures that need no order of words (boxes, tolerances) are plain aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a page in columns; how a channel between columns is looked for; a paragraph's gap.
COLUMN_WORDS, CHANNEL_STEP, CHANNEL_CROSSED, SIDE_SHARE, GAP = 60, 4, 0.01, 0.25, 1.8
#: The part of the width that a channel may lie in, the least tolerance of a line, a line's usual height.
CHANNEL_FROM, CHANNEL_TO, LINE_TOLERANCE, LINE_HEIGHT = 0.35, 0.65, 3.0, 12.0


@dataclass
class Boxes:
    """Word boxes of one page as arrays."""

    x0: np.ndarray
    x1: np.ndarray
    top: np.ndarray
    bottom: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Boxes:
        return cls(*(pdf[c].to_numpy(float) for c in ("x0", "x1", "top", "bottom")))

    def __len__(self) -> int:
        return len(self.x0)


def paragraph_boxes(words: DataFrame, by: list[str]) -> DataFrame:
    """The box around each group of words."""
    return words.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("top").alias("y0"), F.max("x1").alias("x1"), F.max("bottom").alias("y1"))


def word_tolerance(glyphs: DataFrame, by: list[str]) -> DataFrame:
    """Gap between words by a page's most common glyph height (of equally common ones the least): 0.18 of it, in 1..3."""
    known = glyphs.filter("height > 0").groupBy(*by, F.round("height", 1).alias("h")).agg(F.count("*").alias("n"))
    common = known.groupBy(*by).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("h"))
    pages = glyphs.select(*by).distinct()
    return pages.join(common, by, "left").select(*by, F.when(F.col("h").isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.col("h") * 0.18))).otherwise(1.5).alias("tolerance"))


def line_numbers(b: Boxes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The line of each of ``words``, and the lines' tops and heights, lines numbered from the top of the page.

    A line is opened by its first word and has that word's top and its tallest word's height.  A word belongs to the
    first opened line whose top is within half that line's height, or within :data:`LINE_TOLERANCE`.
    """
    number = np.full(len(words), -1)
    # room for as many lines as words; the opened ones are the first ``n``
    tops, heights, n = np.zeros(len(words)), np.zeros(len(words)), 0
    for i in np.lexsort((b.x0[words], np.round(b.top[words], 1))).tolist():
        top, height = b.top[words[i]], b.bottom[words[i]] - b.top[words[i]]
        fits = np.abs(tops[:n] - top) <= np.maximum(LINE_TOLERANCE, heights[:n] / 2)
        at = int(fits.argmax()) if fits.any() else n
        if at == n:
            tops[n], n = top, n + 1
        heights[at] = max(heights[at], height)
        number[i] = at
    order = np.argsort(tops[:n], kind="stable")
    place = np.empty(n, int)
    place[order] = np.arange(n)
    return place[number], tops[:n][order], heights[:n][order]


def channel(b: Boxes, width: float) -> float | None:
    """The place between two columns: few words lie across it, enough on either side, and it is the nearest to the middle."""
    at = np.arange(int(width * CHANNEL_FROM), int(width * CHANNEL_TO) + 1, CHANNEL_STEP, dtype=float)
    left, right = b.x1[:, None] <= at, b.x0[:, None] >= at
    across = (~left & ~right).sum(0)
    open_ = (across <= CHANNEL_CROSSED * len(b)) & (np.minimum(left.sum(0), right.sum(0)) >= SIDE_SHARE * len(b))
    ranked = np.lexsort((at, np.abs(at - width / 2), across))
    good = ranked[open_[ranked]]
    return float(at[good[0]]) if len(good) else None


def flows(b: Boxes, width: float) -> list[np.ndarray]:
    """Groups of words in reading order: full-width lines in place, of lines in two columns the left before the right."""
    every = np.arange(len(b))
    split = channel(b, width) if width > 0 and len(b) >= COLUMN_WORDS else None
    if split is None:
        return [every] if len(b) else []
    line, tops, _ = line_numbers(b, every)
    across = (b.x0 < split) & (split < b.x1)
    wide = np.zeros(len(tops), bool)
    wide[line[across]] = True
    # neighbouring lines of one kind are one island; within it the parts are whole lines, or left and right columns
    island = np.concatenate([[0], np.cumsum(wide[1:] != wide[:-1])])
    part = 2 * island[line] + (~wide[line] & (b.x0 >= split))
    reading = np.lexsort((b.x0, line, part))
    return np.split(reading, np.flatnonzero(np.diff(part[reading])) + 1)


def paragraphs(b: Boxes, flow: np.ndarray) -> list[np.ndarray]:
    """A flow's paragraphs: a new one begins where the gap between lines is above 1.8 mean line heights."""
    if not len(flow):
        return []
    line, tops, heights = line_numbers(b, flow)
    usual = heights[heights > 0].mean() if (heights > 0).any() else LINE_HEIGHT
    block = np.concatenate([[0], np.cumsum(np.diff(tops) > GAP * usual)])[line]
    order = np.lexsort((b.x0[flow], line))
    return [flow[x] for x in np.split(order, np.flatnonzero(np.diff(block[order])) + 1)]


def page_paragraphs(words: DataFrame, width: str = "page_width") -> DataFrame:
    """``page_id, para, text, x0, y0, x1, y1`` of each page; a page is one group, as large as a page can be.

    Paragraphs of blank words only are left out; a NULL text is blank.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, texts = Boxes.of(pdf), pdf["text"].fillna("").to_numpy(object)
        found = [p for f in flows(b, float(pdf[width].iloc[0])) for p in paragraphs(b, f)]
        rows = [(" ".join(texts[p]).strip(), b.x0[p].min(), b.top[p].min(), b.x1[p].max(), b.bottom[p].max()) for p in found]
        out = pd.DataFrame([r for r in rows if r[0]], columns=["text", "x0", "y0", "x1", "y1"])
        out.insert(0, "para", np.arange(len(out), dtype=np.int32))
        out.insert(0, "page_id", pdf["page_id"].iloc[0])
        return out

    kind = dict(words.dtypes)["page_id"]
    return words.groupBy("page_id").applyInPandas(run, f"page_id {kind}, para int, text string, x0 double, y0 double, x1 double, y1 double")
