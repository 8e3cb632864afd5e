"""Exact and fuzzy deduplication of rows in their order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.similarity import token_set, word_set
from cellwright.session import staged

#: Least word-set similarity (0..1) for a row to join a cluster.
THRESHOLD = 0.92
#: Lengths of pieces of words that similar texts have in common.
PIECES = (1, 2, 3, 4, 5, 6, 8)
#: Pairs that one task takes in their order.
ONE_PASS = 2_000_000
#: Above what fractions lose in double precision.
EPSILON = 1e-6


def deduplicate(df: DataFrame, keys: list[str] | None = None, order: str = "_ord") -> DataFrame:
    """The first row, by ``order``, of each combination of ``keys`` (or of all data columns); NULL equals NULL.

    Unknown keys are ignored; if none is left the rows pass through.  The first row of a combination is kept by an
    aggregate that is combined before the shuffle, so no task holds all copies of a hot combination.
    """
    data = [c for c in df.columns if not c.startswith("_") and c != order]
    chosen = [k for k in keys if k in df.columns] if keys is not None else data
    if not chosen:
        return df
    rest = [c for c in df.columns if c not in chosen]
    first = df.groupBy(*[F.col(f"`{c}`") for c in chosen]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order)).alias("__first")) if rest else df.select(*chosen).distinct()
    return first.select(*[F.col(f"`__first`.`{c}`") if c in rest else F.col(f"`{c}`") for c in df.columns])


def fuzzy_clusters(df: DataFrame, keys: list[str], order: str = "_ord", threshold: float = THRESHOLD) -> DataFrame:
    """``<order>, leader``: each row's cluster, named by its leader's order, as if rows were taken one by one and
    joined the first cluster whose first row is similar enough.

    Only distinct sets of words are compared, and of these the pairs of :func:`_candidates`.  A set is a leader if no
    earlier leader matches it.  Rows with an empty key are alone.
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("None")) for k in keys]))
    rows = staged(df.select(F.col(order).alias("o"), word_set(text).alias("text")))
    distinct = staged(rows.filter("text <> ''").groupBy("text").agg(F.min("o").alias("o")).withColumn("id", F.monotonically_increasing_id()))
    side = lambda s: distinct.select(F.col("id").alias(s), F.struct("o", "id").alias(f"at_{s}"), F.col("text").alias(f"text_{s}"))
    pairs = _candidates(distinct, threshold).join(side("x"), "x").join(side("y"), "y").filter(token_set(F.col("text_x"), F.col("text_y")) >= threshold * 100)
    near = staged(pairs.select(F.least("at_x", "at_y").alias("early"), F.greatest("at_x", "at_y").alias("late")))
    homes = near.join(_led(near), F.col("early.id") == F.col("led"), "left_anti").groupBy(F.col("late.id").alias("id")).agg(F.min("early.o").alias("leader"))
    led = distinct.join(homes, "id", "left").select("text", F.coalesce("leader", "o").alias("leader"))
    return rows.join(led, "text", "left").select(F.col("o").alias(order), F.coalesce("leader", "o").alias("leader"))


def _candidates(distinct: DataFrame, threshold: float) -> DataFrame:
    """``x, y``: ids of the pairs of word sets that may reach the threshold t; no pair that does is left out.

    Let n be the length of a set's words, sorted and joined.  The ratio has two ways to reach t.  Either the common words
    make up nearly all of one set: the other words and their spaces take at most n (2 - 2t) / (2 - t) letters of it, so
    of the rarest words that take more, one is common.  Or the words left over are alike: at most d = (1 - t) (n + m)
    letters are left out or put in between texts of n and m letters, so of d + 1 pieces of the longer set's words one
    stands unchanged in a word of the other.  Pieces are looked up by the other's length too, and are as long, and of
    as rare words, as may be.  Both ways bound the numbers of each letter that only one side has, which is checked for
    every pair that is met, on 128 bits a set.
    """
    count = distinct.count()
    words = distinct.select("id", F.explode(F.split("text", " ")).alias("word"))
    spelled = words.join(words.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w")).select("id", F.col("w.n").alias("counts"), F.col("w.word").alias("words"))
    marked = staged(spelled.mapInArrow(partial(_mark, threshold=threshold, count=count), "id long, n int, low long, high long, room int, words array<string>, common array<string>, asked array<string>, pieces array<string>, sizes array<int>"))
    sizes: dict[int, set[int]] = {}
    for r in marked.select(F.explode("sizes").alias("s")).distinct().collect():  # a few for each length
        sizes.setdefault(r.s // 16, set()).add(r.s % 16)
    held = marked.mapInArrow(partial(_hold, sizes=sizes), "id long, n int, low long, high long, marks array<string>")
    y = held.select(F.col("id").alias("y"), F.col("n").alias("n_y"), F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.explode("marks").alias("m")).withColumn("m", F.xxhash64("m"))
    side = lambda marks, whole: marked.select(F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("low").alias("low_x"), F.col("high").alias("high_x"), (F.col("room") if whole else F.lit(None).cast("int")).alias("room"), F.explode(marks).alias("m")).withColumn("m", F.xxhash64("m"))
    x = side("asked", True).unionByName(side("pieces", False))
    bits = lambda f: sum((F.bit_count(f(F.col(f"{c}_x"), F.col(f"{c}_y"))) for c in ("low", "high")), F.lit(0))
    within = (F.col("n_y") >= F.col("n_x") - F.col("room")) & (bits(lambda a, b: a.bitwiseAND(F.bitwise_not(b))) <= F.col("room"))
    alike = F.when(F.col("n_x") == F.col("n_y"), F.col("x") > F.col("y")).otherwise(F.col("n_x") > F.col("n_y")) & (bits(lambda a, b: a.bitwiseXOR(b)) <= (F.col("n_x") + F.col("n_y")) * F.lit(1 - threshold) + F.lit(EPSILON))
    met = y.join(x.hint("merge"), "m").filter(F.when(F.col("room").isNotNull(), (F.col("x") != F.col("y")) & within).otherwise(alike))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _mark(batches: Iterator[pa.RecordBatch], threshold: float, count: int) -> Iterator[pa.RecordBatch]:
    """Each word set's length, letters, words shared with others, and what it looks for: ``asked`` words, ``pieces``."""
    fields = {"id": pa.int64(), "n": pa.int32(), "low": pa.int64(), "high": pa.int64(), "room": pa.int32(), "words": pa.list_(pa.string()), "common": pa.list_(pa.string()), "asked": pa.list_(pa.string()), "pieces": pa.list_(pa.string()), "sizes": pa.list_(pa.int32())}
    for batch in batches:
        out: list[tuple] = []
        spelled = batch["words"].to_pylist()
        for key, counts, own, low, high in zip(batch["id"].to_pylist(), batch["counts"].to_pylist(), spelled, *_letters(spelled), strict=True):
            words = list(zip(counts, own, strict=True))
            n = sum(map(len, own)) + len(own) - 1
            room = math.floor(n * (2 - 2 * threshold) / (2 - threshold) + EPSILON)
            asked, over = [], 0
            for k, w in words:
                if over > room:
                    break
                over += len(w) + 1
                asked += [w] if k > 1 else []  # other words are in no other set
            pieces, sizes = _pieces(words, n, threshold, count)
            out.append((key, n, low, high, room, own, [w for k, w in words if k > 1], asked, pieces, sizes))
        columns = list(zip(*out, strict=True)) or [[]] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))


def _letters(sets: list[list[str]]) -> tuple[list[int], list[int]]:
    """128 bits a set: of each of 32 classes of letters, whether there are one, two, three and four of them."""
    texts = ["".join(words) for words in sets]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) & 31
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    seen = np.minimum(np.bincount(of * 32 + codes, minlength=32 * len(texts)), 4).astype(np.uint64).reshape(-1, 2, 16)
    bits = ((np.uint64(1) << seen) - np.uint64(1)) << np.arange(0, 64, 4, dtype=np.uint64)
    low, high = np.bitwise_or.reduce(bits, axis=2).view(np.int64).T.tolist() if texts else ([], [])
    return low, high


def _band(n: int) -> int:
    """Lengths that are looked up together: one, or a sixteenth of the way to the double of long ones."""
    return n if n < 64 else 64 + int(16 * math.log2(n / 64))


def _pieces(words: list[tuple[int, str]], n: int, threshold: float, count: int) -> tuple[list[str], list[int]]:
    """Marks of the pieces to look for in word sets that are not longer, and ``16 x band + piece length`` of each kind."""
    pieces, sizes, letters = [], [], sum(len(w) for _, w in words)
    chosen: dict[int, tuple[int, list[str]]] = {}
    bands: dict[int, list[int]] = {}
    for m in range(max(1, math.ceil(n * threshold / (2 - threshold) - EPSILON)), n + 1):
        bands.setdefault(_band(m), []).append(m)
    for band, lengths in bands.items():
        most = math.floor((1 - threshold) * (n + lengths[-1]) + EPSILON)
        if len(lengths) == 1 and band < 64:
            most -= (most - n + band) % 2  # letters left out and put in differ by the lengths
        if most < max(1, n - lengths[-1]):  # without a change the sets are equal
            continue
        if most not in chosen:
            best: tuple[float, int, list[tuple[int, str]]] = (math.inf, 0, [])
            for size in PIECES:
                if letters // size <= most:
                    break
                usual, left, cost, taken = count / 10 ** (size - 1), most + 1, 0.0, []
                for k, w in words:
                    if here := min(left, len(w) // size):
                        left, cost = left - here, cost + here * (k + usual)
                        taken.append((here, w))
                        if not left:
                            break
                if not left and cost < best[0]:
                    best = (cost, size, taken)
            chosen[most] = best[1], [w[i * best[1] : i * best[1] + best[1]] for here, w in best[2] for i in range(here)]
        size, parts = chosen[most]
        # without enough pieces every set of that length is looked at
        pieces += [f"{band} {size} {p}" for p in {*parts}] if size else [f"{band} 0 "]
        sizes.append(16 * band + size)
    return pieces, sizes


def _hold(batches: Iterator[pa.RecordBatch], sizes: dict[int, set[int]]) -> Iterator[pa.RecordBatch]:
    """The marks by which a word set is found: its words, and all pieces of the lengths that are looked for."""
    for batch in batches:
        marks = []
        for n, words, common in zip(*(batch[c].to_pylist() for c in ("n", "words", "common")), strict=True):
            band = _band(n)
            own = [*common]
            for size in sizes.get(band, ()):
                own += {f"{band} {size} {w[i : i + size]}" for w in words for i in range(len(w) - size + 1)} if size else [f"{band} 0 "]
            marks.append(own)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "n", "low", "high")), pa.array(marks, pa.list_(pa.string()))], names=["id", "n", "low", "high", "marks"])


def _led(near: DataFrame) -> DataFrame:
    """``led``: ids of those that follow a leader, given all pairs of ``early`` and ``late``.

    Rounds of joins decide all whose earlier neighbours are known, until so few pairs are left that one task can take
    them in their order.
    """
    led, left = [], near
    while left.limit(ONE_PASS + 1).count() > ONE_PASS:  # the first of them is decided in every round, and with it many more
        late = left.select(F.col("late.id").alias("id")).distinct()
        new = staged(left.join(late, F.col("early.id") == F.col("id"), "left_anti").select(F.col("late.id").alias("led")).distinct())
        led.append(new)
        left = staged(left.join(new, F.col("early.id") == F.col("led"), "left_anti").join(new, F.col("late.id") == F.col("led"), "left_anti"))
    led.append(left.repartition(1).sortWithinPartitions("early").select(F.col("early.id").alias("early"), F.col("late.id").alias("late")).mapInArrow(_follow, "led long"))
    return reduce(DataFrame.unionByName, led)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in the order of their first: when it comes up, all that could make it follow another have been seen."""
    led: set[int] = set()
    for batch in batches:
        new = []
        for early, late in zip(batch["early"].to_pylist(), batch["late"].to_pylist(), strict=True):
            if early not in led and late not in led:
                led.add(late)
                new.append(late)
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], names=["led"])
