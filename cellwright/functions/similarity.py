"""String similarities in 0..100 by longest common subsequence, and their Arrow-batched column forms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 and more letters at a time in one integer's bits."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & places.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """The shorter string's best ratio against any window of the longer, windows at the ends may be shorter."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    if len(a) <= 64:
        return _best_window(a, b)
    letters = set(a)
    best, n = 0.0, len(a)
    for end in range(1, len(b) + n):
        start, stop = max(0, end - n), min(end, len(b))
        # a best window starts or ends with a letter of the shorter string
        if (end <= len(b) and b[stop - 1] in letters) or (end > len(b) and b[start] in letters):
            best = max(best, ratio(a, b[start:stop]))
    return best


def _best_window(a: str, b: str) -> float:
    """:func:`partial_ratio` of at most 64 letters: the bits of :func:`lcs_length` for all windows of ``b`` at once."""
    n, codes = len(a), np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    # letters beyond the ends are in no string
    places = np.zeros(len(b) + 2 * (n - 1), np.uint64)
    inner = places[n - 1 : n - 1 + len(b)]
    for c in set(a):
        inner[codes == ord(c)] = sum(1 << i for i, x in enumerate(a) if x == c)
    windows = len(b) + n - 1
    full = np.uint64((1 << n) - 1)
    free = np.full(windows, full)
    for j in range(n):
        hit = free & places[j : j + windows]
        free = (free + hit) | (free - hit)
    common = n - np.bitwise_count(free & full).astype(np.int64)
    end = np.arange(1, windows + 1)
    length = np.minimum(end, len(b)) - np.maximum(0, end - n)
    return float((200.0 * common / (n + length)).max())


def token_set_ratio(a: str, b: str) -> float:
    """Ratio of the sorted sets of words, the words common to both counted once; 100 if one set holds the other."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    common, l_text, r_text = " ".join(both), " ".join(left), " ".join(right)
    one = f"{common} {l_text}".strip()
    two = f"{common} {r_text}".strip()
    scores = [ratio(common, one), ratio(common, two)] if both else [0.0]
    # a short text against a whole document cannot reach more than this
    if 200.0 * min(len(one), len(two)) / (len(one) + len(two)) > max(scores):
        scores.append(ratio(one, two))
    return max(scores)


@lru_cache(64)
def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def support(value: str, source: str) -> float:
    """How well a source supports a value, 0..1: the better of the partial and the word-set ratio."""
    if not value:
        return 1.0 if not source else 0.0
    return max(partial_ratio(value, source), token_set_ratio(value, source)) / 100 if source else 0.0


def supports(values: list[str], source: str) -> list[float]:
    """:func:`support` of many values by one source; those that stand in it or whose words all do are not aligned."""
    words = _words(source)
    sure = [bool(v and source) and (v in source or (bool(own := v.split()) and words.issuperset(own))) for v in values]
    return [1.0 if s else support(v, source) for v, s in zip(values, sure, strict=True)]


@F.pandas_udf(DoubleType())
def _support(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for values, sources in pairs:
        yield pd.Series([support(v or "", s or "") for v, s in zip(values, sources, strict=True)])


@F.pandas_udf(DoubleType())
def token_set(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def word_set(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The distinct words of a text, sorted, with single spaces."""
    for batch in texts:
        yield pd.Series([" ".join(sorted({*x.split()})) for x in batch])


def support_fast(value: Column, source: Column) -> Column:
    """The support where it is known without aligning: empty values, values that stand in the source, word subsets."""
    v, s = F.coalesce(value, F.lit("")), F.coalesce(source, F.lit(""))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    subset = (F.size(words(v)) > 0) & (F.size(F.array_except(words(v), words(s))) == 0)
    return F.when(v == "", F.when(s == "", 1.0).otherwise(0.0)).when(s == "", 0.0).when(F.contains(s, v) | subset, 1.0)


def support_score(value: Column, source: Column) -> Column:
    """The support of any value; only what the fast path leaves open is sent to Python."""
    fast = support_fast(value, source)
    return F.coalesce(fast, _support(F.when(fast.isNull(), value), F.when(fast.isNull(), source)))
