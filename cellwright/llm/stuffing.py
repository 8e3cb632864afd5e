"""Keyword-stuffed and link-list pages: texts most of whose words stand in repetition or lists, not in sentences.

A text is one sequence of words.  Three signals mark words:

* recurrence: within lag windows, the gaps to the same word's last and next occurrence, and the autocorrelation of
  the sequence with itself at each lag, tell how much of a stretch repeats and how evenly; prose repeats few content
  words that soon;
* lists: long runs of short items between separators, without function words;
* links: long runs of links with at most a title each.

Tables, logs and code repeat too; lines of such structure are words of the text but never marked.  A text is spam if
more than half of its words are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Lags up to which a word counts as repeated, and the window over which repetition is averaged.
MOST_LAG, WINDOW = 24, 30
#: Least share of a window's content words that recur; less is enough if one lag explains a share of its own.
LEAST_RECURRING, LEAST_REGULAR, LEAST_AT_LAG = 0.55, 0.4, 0.3
#: Items in a row that make a list, words an item may have, and links in a row that make a link list.
LEAST_ITEMS, ITEM_WORDS, LEAST_LINKS = 9, 4, 7
#: Share of marked words above which a text is spam, and words that a text needs to be judged.
SPAM_SHARE, LEAST_WORDS = 0.5, 12

# Common function words of the corpus's languages (en, de, fr, es).
FUNCTION_WORDS = frozenset(
    """
    a about after all also although am an and any are as at be because been before both but by can could did do does
    down each either every few for from had has have he her here his how i if in into is it its may more most must
    neither nor no not now of off on once one only onto or other our out over own per she should since so some such
    than that the their them then there these they this those through to too under until up upon very was we were what
    when where whether which while who whose why will with within without would you your
    aber alle als am an auch auf aus bei beim bevor bis das dass dem den denn der des die dies diese doch durch ein
    eine einem einen einer eines er es für gegen hat haben ich ihr im in ist ja jede jeder kann kein keine mehr mit muss
    nach nicht noch nur ob oder ohne sein seit sich sie sind so über um und uns unter vom von vor war wenn wer werden
    wie wir wird wurde wurden zu zum zur zwischen
    au aux avec ce ces cette chaque comme dans de depuis des du elle en est et il ils la le les leur leurs mais même
    ne nos notre nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vos votre y
    al algo ante cada como con cuando cual de del desde donde dos e el ella en entre era es esta este fue ha hay la las
    lo los más muy nadie ni o para pero por porque que se según ser si sin sobre su sus también todo una uno unos y ya
    """.split()
)

#: What an HTML tag adds to the words around it.
MARKUP = regex.compile(r"""</?[a-z][a-z0-9]*(?:\s+[a-z-]+\s*=\s*["']?)?|["']?\s*/?>""", regex.I)
LINK = regex.compile(r"""(?:https?://|www\.)[^\s"'<>)]+|\b[\w-]+(?:\.[\w-]+)+/[\w./?=&%#+-]*""", regex.I)
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’_][\p{L}\p{N}]+)*")
SEPARATOR = regex.compile(r"[,;|•·#\t\n]+|\s[-–—]\s")
LOG = regex.compile(r"\s*(?:\[?\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}|\d{1,2}:\d{2}:\d{2}|\[?(?:DEBUG|INFO|WARN|ERROR)\b)")
CODE = regex.compile(r"^\s*(?:def|class|return|import|from|for|while|if|else|elif|try|except|var|let|const|function|public|private|SELECT|INSERT)\b.*[:;()={}\[\]]|[{};]\s*$|^\s*[\w.]+\s*=\s*\S|^\s*(?://|/\*)")
SENTENCE_END = regex.compile(r"[.!?]\s*$")


def _kinds(text: str) -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a text and its words with, for each: its line, whether its line is a structure, whether it is a link."""
    words: list[str] = []
    line_of: list[int] = []
    fixed: list[bool] = []
    link: list[bool] = []
    lines = [MARKUP.sub(" ", line) if "<" in line else line for line in text.splitlines()]
    for n, line in enumerate(lines):
        # a link has a slash or begins with www
        spans = [m.span() for m in LINK.finditer(line)] if "/" in line or "www" in line.lower() else []
        if spans:
            own, at_link, cut = [], [], 0
            for s, e in spans:
                before = WORD.findall(line[cut:s])
                own += [*before, line[s:e]]
                at_link += [False] * len(before) + [True]
                cut = e
            after = WORD.findall(line[cut:])
            own += after
            at_link += [False] * len(after)
        else:
            own = WORD.findall(line)
            at_link = [False] * len(own)
        if not own:
            continue
        structure = False
        if not spans:
            digits = sum(map(str.isdigit, own))
            cells = line.strip()
            table = cells.startswith("|") and cells.endswith("|") and cells.count("|") > 2
            structure = table or (digits >= 0.25 * len(own) and digits > 1) or bool(LOG.match(line)) or bool(CODE.search(line))
        words += map(str.lower, own)
        line_of += [n] * len(own)
        fixed += [structure] * len(own)
        link += at_link
    return lines, words, np.array(line_of, int), np.array(fixed, bool), np.array(link, bool)


def _mean(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over a centred window of ``width`` (cut at the ends) and the windows' sizes."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(len(x))
    lo, hi = np.maximum(at - width // 2, 0), np.minimum(at + width // 2 + 1, len(x))
    return total[hi] - total[lo], (hi - lo).astype(float)


def recurrence(words: list[str], usable: np.ndarray) -> np.ndarray:
    """Words in stretches that repeat unnaturally: many content words recur within few words, or evenly."""
    n = len(words)
    ids: dict[str, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], int)
    content = usable & np.array([w not in FUNCTION_WORDS and not w.isdigit() for w in words], bool)
    order = np.argsort(code, kind="stable")
    near = np.zeros(n, bool)
    same = (code[order][1:] == code[order][:-1]) & (np.diff(order) <= MOST_LAG)
    near[order[1:][same]] = True
    near[order[:-1][same]] = True
    repeats, _ = _mean(near & content, WINDOW)
    contents, size = _mean(content, WINDOW)
    share = repeats / np.maximum(contents, 1)
    dense = contents >= 0.3 * size
    centre = dense & (share >= LEAST_RECURRING)
    open_ = dense & ~centre & (share >= LEAST_REGULAR)
    if open_.any():  # only there does it matter how evenly words repeat
        best = np.zeros(n)
        for lag in range(1, min(MOST_LAG // 2, n - 1) + 1):
            hit = np.zeros(n, bool)
            equal = (code[lag:] == code[:-lag]) & content[lag:]
            hit[lag:] = equal
            hit[:-lag] |= equal
            at_lag, _ = _mean(hit, WINDOW)
            best = np.maximum(best, at_lag / np.maximum(contents, 1))
        centre |= open_ & (best >= LEAST_AT_LAG)
    return centre & usable


def lists(lines: list[str], words: list[str], line_of: np.ndarray, usable: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Words of long runs of short items without function words, and of long runs of links with titles."""
    marked = np.zeros(len(words), bool)
    at = 0
    run_items: list[tuple[int, int]] = []
    run_links: list[tuple[int, int]] = []

    def close(run: list[tuple[int, int]], least: int) -> None:
        if len(run) >= least:
            for s, e in run:
                marked[s:e] = True
        run.clear()

    n_words = len(words)
    while at < n_words:
        n = line_of[at]
        end = at
        while end < n_words and line_of[end] == n:
            end += 1
        if not usable[at]:
            close(run_items, LEAST_ITEMS)
            close(run_links, LEAST_LINKS)
        elif link[at:end].any():
            close(run_items, LEAST_ITEMS)
            # a link with what stands before it since the last one: at most a title without function words
            start = at
            for i in range(at, end):
                if link[i]:
                    title = words[start:i]
                    if len(title) <= 8 and sum(w in FUNCTION_WORDS for w in title) <= len(title) // 6:
                        run_links.append((start, i + 1))
                    else:
                        close(run_links, LEAST_LINKS)
                        run_links.append((i, i + 1))
                    start = i + 1
            title = words[start:end]
            if len(title) > 8 or sum(w in FUNCTION_WORDS for w in title) > len(title) // 6:
                close(run_links, LEAST_LINKS)
            elif title:
                run_links[-1] = (run_links[-1][0], end)
        else:
            if end - at > 3:
                close(run_links, LEAST_LINKS)
            pos = at
            for item in SEPARATOR.split(lines[n]):
                size = len(WORD.findall(item))
                if not size:
                    continue
                own = words[pos : pos + size]
                listed = size <= ITEM_WORDS and not any(w in FUNCTION_WORDS for w in own) and not all(w.isdigit() for w in own)
                if listed and not (SENTENCE_END.search(item) and size > 2):
                    run_items.append((pos, pos + size))
                else:
                    close(run_items, LEAST_ITEMS)
                pos += size
        at = end
    close(run_items, LEAST_ITEMS)
    close(run_links, LEAST_LINKS)
    return marked


def spam_share(text: str | None) -> tuple[int, float, float, float]:
    """Words of a text, and the shares of them that are repeated, listed, and either of both."""
    if not text:
        return 0, 0.0, 0.0, 0.0
    lines, words, line_of, fixed, link = _kinds(text)
    n = len(words)
    if n < LEAST_WORDS:
        return n, 0.0, 0.0, 0.0
    usable = ~fixed
    # a link stands for all the words in it
    weight = np.array([len(WORD.findall(w)) if is_link else 1 for w, is_link in zip(words, link.tolist(), strict=True)], float)
    weight /= weight.sum()
    again = recurrence(words, usable & ~link)
    listed = lists(lines, words, line_of, usable, link)
    return n, float(weight[again].sum()), float(weight[listed].sum()), float(weight[again | listed].sum())


def stuffed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ``<key>, words, repeated, listed, spam_share, is_spam``.

    Whole texts, one by one, in a narrow map: nothing is shuffled and copies are judged alike.  NULL, empty and very
    short texts are no spam.  Time and memory are in proportion to a text's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spam_share(t) for t in b["text"].to_pylist()]
            cols = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            share = np.array(cols[3], float)
            yield pa.record_batch(
                [b["key"], pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(share), pa.array(share > SPAM_SHARE)],
                names=[key, "words", "repeated", "listed", "spam_share", "is_spam"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"`{key}` {kind}, words int, repeated double, listed double, spam_share double, is_spam boolean"
    )
