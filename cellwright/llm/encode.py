"""Encoding with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

For every prefix of a word's bytes there is exactly one token that ends its encoding.  It is the token whose start is
a prefix already solved and whose neighbour there it may follow, so a table of last tokens encodes the word in one
pass from left to right.  Appending bytes keeps the table of the bytes before them, and an edit only re-solves the
words it touches.  Two tokens may follow each other if no merge of higher priority crosses the border between them.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies lie, unless a query is told otherwise.
TOKENIZER_DIR = "/opt/tokenizers"

# How byte-level vocabularies split text before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose ids a worker remembers; beyond that it forgets those it has not used for longest.
REMEMBERED_WORDS = 200_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if visible, else the next letters after 255."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixEncoder:
    """Byte-level BPE with the ids of one vocabulary file (``.json`` with merges, or ``.tiktoken`` ranks)."""

    def __init__(self, path: str):
        self.ids: dict[bytes, int] = {}
        self.merges: dict[tuple[int, int], int] = {}  # pair of tokens -> its priority, lowest first
        self.parts: dict[int, tuple[int, int]] = {}
        self.priority: dict[int, int] = {}
        if path.endswith(".json"):
            self._read_merges(path)
        else:
            self._read_ranks(path)
        self.longest = max(map(len, self.ids))
        self._split = regex.compile(WORDS)
        self.word = lru_cache(REMEMBERED_WORDS)(self._encode_word)
        self._may_follow = lru_cache(REMEMBERED_WORDS)(self._check_pair)

    def _add(self, left: int, right: int, whole: int, priority: int) -> None:
        if whole not in self.parts:
            self.merges[left, right], self.parts[whole], self.priority[whole] = priority, (left, right), priority

    def _read_merges(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = lambda text: bytes(letters[x] for x in text)
        known = {t: raw(t) for t in model["vocab"] if all(x in letters for x in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {a + b for a, b in pairs}
        self.ids = {b: model["vocab"][t] for t, b in known.items() if len(b) == 1 or t in made}
        for priority, (a, b) in enumerate(pairs):
            self._add(self.ids[known[a]], self.ids[known[b]], self.ids[known[a] + known[b]], priority)

    def _read_ranks(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ids = ranks
        for text, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(text) > 1:
                left, right = self._merge_below(text, rank)
                self._add(ranks[left], ranks[right], rank, rank)

    def _merge_below(self, text: bytes, rank: int) -> list[bytes]:
        pieces = [text[i : i + 1] for i in range(len(text))]
        while len(pieces) > 2:
            best, i = min((self.ids.get(pieces[i] + pieces[i + 1], rank), i) for i in range(len(pieces) - 1))
            if best >= rank:
                break
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        return pieces

    def _check_pair(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: follows the merges at the border backwards, the later one first.

        A merge across the border happens if it comes before the merges that would hide one of its sides.
        """
        before = float("inf")
        while True:
            crossing = self.merges.get((left, right))
            if crossing is not None and crossing < before:
                return False
            pl, pr = self.priority.get(left, -1), self.priority.get(right, -1)
            if pl < 0 and pr < 0:
                return True
            if pl > pr:
                # the left token was the last of both to be made: before that, its right part stood at the border,
                # where a crossing merge of equal priority stands further right and so comes after it
                before, left = pl, self.parts[left][1]
            else:
                before, right = pr + 0.5, self.parts[right][0]

    def last_tokens(self, data: bytes, known: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """Each prefix's last token as (id, where it starts); ``known`` is the table of an unchanged prefix."""
        table = list(known or [])
        ids, may_follow, longest = self.ids, self._may_follow, self.longest
        for end in range(len(table) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(data[start:end])
                if token is not None and (start == 0 or may_follow(table[start - 1][0], token)):
                    table.append((token, start))
                    break
        return table

    def append(self, data: bytes, table: list[tuple[int, int]], more: bytes) -> list[tuple[int, int]]:
        """The table of ``data + more``, exact, without looking at the prefixes of ``data`` again."""
        return self.last_tokens(data + more, table)

    @staticmethod
    def _trace(table: list[tuple[int, int]]) -> list[int]:
        out, end = [], len(table)
        while end:
            token, end = table[end - 1]
            out.append(token)
        return out[::-1]

    def _encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "replace")
        return tuple(self._trace(self.last_tokens(data)))

    def encode(self, text: str | None) -> list[int]:
        """The text's ids; special tokens' names are ordinary text.  NULL and empty texts have none."""
        out: list[int] = []
        word = self.word
        for w in self._split.findall(text or ""):
            out.extend(word(w) if len(w) < 200 else self._encode_word(w))
        return out

    def encode_edit(self, text: str, ids: list[list[int]], at: int, removed: int, added: str) -> list[list[int]]:
        """Ids by word after ``text[at:at + removed]`` became ``added``: only words near the edit are encoded again.

        ``ids`` are the old text's ids word by word, as :meth:`words` gives them.
        """
        new = text[:at] + added + text[at + removed :]
        old_words, new_words = self._split.findall(text), self._split.findall(new)
        head = 0
        while head < min(len(old_words), len(new_words)) and old_words[head] == new_words[head]:
            head += 1
        tail = 0
        while tail < min(len(old_words), len(new_words)) - head and old_words[-1 - tail] == new_words[-1 - tail]:
            tail += 1
        middle = [list(self._encode_word(w)) for w in new_words[head : len(new_words) - tail]]
        return ids[:head] + middle + ids[len(ids) - tail :]

    def words(self, text: str) -> list[list[int]]:
        return [list(self.word(w)) for w in self._split.findall(text)]


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of a vocabulary file, read once."""
    return PrefixEncoder(path)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json") -> DataFrame:
    """``<key>, ids ARRAY<INT>`` of every row, whole texts; NULL, empty and repeated rows each keep their row.

    A narrow map over Arrow batches: nothing is shuffled, and a long text costs time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            ids = [encode(t) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["key"], pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
