"""Evaluation texts leaking into training text, found through a positional inverted index.

An item's run of ``least`` consecutive words can only occur where its rarest word does.  So the corpus is read once to
count the items' words and once for the postings of the rarest word of every such run, its anchor.  A posting is a
term, a document, a position and the words around it, as many as a run through it may have.  Subtracting the anchor's
place in the item from the posting's position gives the diagonal on which item and document lie over each other; the
lists of the other words, adjusted to it, are intersected there and then, in the posting's own row.  Postings of
frequent words are counted, but never stored or moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.session import BROADCAST_BYTES, staged

#: Consecutive words of an item that make a leak, and words that may differ in a near match.
LEAST_WORDS, SLACK = 12, 3
#: Parts that a term's postings are split into where the anchors are too many to be broadcast; terms of one scan.
SALTS, TERMS = 32, BROADCAST_BYTES // 8


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def term_ids(texts: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``name, ids``: the words of each text as 64-bit hashes; among a million words, two share one with p < 1e-7.

    The generator keeps the hashes as a column: what reads them again does not split the text again.
    """
    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    return texts.filter(F.col(text).isNotNull()).select(F.col(key).alias(name), F.explode(F.array(hashed)).alias("ids"))


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term_id, n``: how often each term of ``vocabulary(term_id)`` occurs in ``docs(doc, ids)``, combined before the shuffle."""
    terms = docs.select(F.explode("ids").alias("term_id"))
    small = vocabulary.limit(BROADCAST_BYTES // 40 + 1).count() <= BROADCAST_BYTES // 40
    if small:
        return terms.join(F.broadcast(vocabulary), "term_id", "left_semi").groupBy("term_id").agg(F.count("*").alias("n"))
    # counted first, so that a word that makes a tenth of the corpus is one row a task when it is joined
    return terms.groupBy("term_id").agg(F.count("*").alias("n")).join(vocabulary, "term_id", "left_semi")


def counted_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item, ids, counts``: each item's words with their numbers in the corpus."""
    vocabulary = staged(items.select(F.explode("ids").alias("term_id")).distinct())
    counts = staged(term_counts(docs, vocabulary))
    each = items.select("item", F.posexplode("ids").alias("place", "term_id")).join(counts, "term_id", "left")
    listed = each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", "term_id", F.coalesce("n", F.lit(0)).alias("n")))).alias("a"))
    return staged(listed.select("item", F.col("a.term_id").alias("ids"), F.col("a.n").alias("counts")))


def _around(ids: str, place: Column, reach: int) -> Column:
    """The words at ``place`` and ``reach`` places before and behind it, NULL beyond the text."""
    return F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: F.when(place + o >= 0, F.get(ids, place + o)))


def anchors(counted: DataFrame, least: int, rarest: int, reach: int, short_ends: bool) -> DataFrame:
    """``term_id, item, place, own``: the ``rarest`` rarest words of each stretch of ``least`` words, with the words around.

    Of equally rare words the last, which the following stretches share longest.  ``short_ends`` takes the stretches
    that the item's end cuts short as well.
    """
    places = F.transform("counts", lambda n, i: F.struct(n.alias("n"), (-i).alias("back")))
    ready = counted.select("item", "ids", F.explode(F.array(places)).alias("places"))
    last = F.size("places") - (1 if short_ends else least)
    stretch = lambda s: F.slice(F.array_sort(F.slice("places", s + 1, least)), 1, rarest)
    picked = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), last), stretch)))
    at = ready.filter(last >= 0).select("item", "ids", F.explode(picked).alias("p")).filter("p.n > 0")
    place = -F.col("p.back")
    return at.select(F.get("ids", place).alias("term_id"), "item", place.alias("place"), _around("ids", place, reach).alias("own"))


def postings(docs: DataFrame, anchors_: DataFrame, reach: int) -> DataFrame:
    """The index: ``term_id, doc, position, near`` of all occurrences of the anchors' terms, whole texts of all documents.

    ``near`` has the word itself in the middle of ``reach`` words on either side, 0 beyond the text.  The terms, which
    grow with the items only, go to the tasks; where they pass :data:`TERMS`, they do so in parts, a scan each.
    """
    terms = staged(anchors_.select("term_id").distinct())
    parts = max(1, -(-terms.count() // TERMS))

    def one(part: int) -> DataFrame:
        known = np.sort(terms.filter(F.pmod("term_id", F.lit(parts)) == part).toPandas()["term_id"].to_numpy(np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            around = np.arange(-reach, reach + 1)
            for b in batches:
                ids = b["ids"].flatten().to_numpy(zero_copy_only=False)
                size = pc.list_value_length(b["ids"]).to_numpy(zero_copy_only=False)
                end = np.cumsum(size)
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids) if len(known) else np.zeros(0, int)
                row = np.searchsorted(end, at, "right")
                first = (end - size)[row]
                place = at[:, None] + around
                near = np.where((place >= first[:, None]) & (place < end[row][:, None]), ids[np.clip(place, 0, max(len(ids) - 1, 0))] if len(ids) else 0, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(around)), pa.array(near.ravel().astype(np.int64)))
                yield pa.record_batch([pa.array(ids[at].astype(np.int64)), b["doc"].take(pa.array(row)), pa.array((at - first).astype(np.int32)), lists], names=["term_id", "doc", "position", "near"])

        return docs.mapInArrow(run, f"term_id bigint, doc {dict(docs.dtypes)['doc']}, position int, near array<bigint>")

    out = one(0)
    for part in range(1, parts):
        out = out.unionByName(one(part))
    return out


def met(docs: DataFrame, found: DataFrame, reach: int) -> DataFrame:
    """``doc, item, diagonal, place, same``: anchors that occur in a document, and which of the words around are the same."""
    found = staged(found)
    index = staged(postings(docs, found, reach))
    row = 100 + 8 * (2 * reach + 1)
    if found.limit(BROADCAST_BYTES // row + 1).count() <= BROADCAST_BYTES // row:
        both = index.join(F.broadcast(found), "term_id")
    else:  # a term that many documents hold is as many keys as there are salts
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = index.withColumn("salt", F.pmod(F.xxhash64("doc", "position"), F.lit(SALTS)).cast("int")).join(salted, ["term_id", "salt"])
    same = F.zip_with("near", "own", lambda a, b: F.coalesce(a == b, F.lit(False)))
    return both.select("doc", "item", (F.col("position") - F.col("place")).alias("diagonal"), "place", same.alias("same"))


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Documents that hold at least ``least`` consecutive words of an item: ``<doc_key>, <item_key>, longest_run``.

    Whole texts of all documents are read.  NULL and empty texts have no words; items shorter than ``least`` words
    never match; copies of a document or an item each match on their own; equal keys are one document.
    """
    reach = least - 1
    read = term_ids(docs, doc_key, text, "doc")
    counted = counted_items(read, term_ids(items, item_key, text, "item"))
    hits = met(read, anchors(counted, least, 1, reach, False), reach)
    # a run of so many words within reach goes through the anchor; it is the stretch of equal words around it
    turn = lambda a: F.coalesce(F.array_position(a, F.lit(False)), F.lit(0))
    ahead = turn(F.slice("same", reach + 1, least))
    behind = turn(F.reverse(F.slice("same", 1, least)))
    length = lambda t: F.when(t > 0, t - 1).otherwise(least)
    runs = hits.select("doc", "item", "diagonal", (F.col("place") - length(behind) + 1).alias("first"), (F.col("place") + length(ahead) - 1).alias("last"))
    runs = runs.filter(F.col("last") - F.col("first") + 1 >= least)
    # what several anchors show of one long run overlaps: consecutive places differ from their rank by one value a run
    places = runs.select("doc", "item", "diagonal", F.explode(F.sequence("first", "last")).alias("place"))
    listed = places.groupBy("doc", "item", "diagonal").agg(F.array_sort(F.collect_set("place")).alias("places"))
    ranked = listed.select("doc", "item", "diagonal", F.posexplode("places").alias("rank", "place"))
    lengths = ranked.groupBy("doc", "item", "diagonal", (F.col("place") - F.col("rank")).alias("run")).agg(F.count("*").alias("length"))
    best = lengths.groupBy("doc", "item").agg(F.max("length").cast("int").alias("longest_run"))
    return best.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "longest_run")


def proximity_matches(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = LEAST_WORDS, slack: int = SLACK) -> DataFrame:
    """Like :func:`leaked_items`, with up to ``slack`` words of an item replaced: ``<doc_key>, <item_key>``.

    A match has ``least`` common words on one diagonal within ``least + slack`` consecutive places.  Of such a stretch
    up to ``slack`` words are missing, so one of its ``slack + 1`` rarest is among the common ones and is an anchor.
    """
    span = least + slack
    reach = span - 1
    read = term_ids(docs, doc_key, text, "doc")
    counted = counted_items(read, term_ids(items, item_key, text, "item"))
    hits = met(read, anchors(counted, span, slack + 1, reach, True), reach)
    common = lambda s: F.size(F.filter(F.slice("same", s + 1, span), lambda x: x))
    good = F.exists(F.sequence(F.lit(0), F.lit(reach)), lambda s: common(s) >= least)
    return hits.filter(good).select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()
