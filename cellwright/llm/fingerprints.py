"""Duplicates hidden by formatting: records that are the same but for white space, case, punctuation or field order.

Every normalised field is hashed together with its role, and a record's fingerprint is the sum of its hashes, a
commutative multiset hash: fields that may stand in each other's place share one role, so exchanging them changes
nothing.  Records are grouped by the fingerprint alone; each is then verified against its group's first record by
comparing the fields as multisets, without sorting, so a collision of hashes can never join two records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.operators.joins import join_representatives
from cellwright.session import staged


def normal_key(c: Column) -> Column:
    """The value in lower case with everything but letters and digits of any script removed."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def multiset_hash(roles: list[Column], values: list[Column]) -> list[Column]:
    """Two 64-bit sums over the fields; wrapping addition is commutative and keeps how often a field occurs."""
    mixed = [F.xxhash64(r, v) for r, v in zip(roles, values, strict=True)]
    second = [F.xxhash64(F.lit(7), v, r) for r, v in zip(roles, values, strict=True)]

    def wrap(cols: list[Column]) -> Column:
        # the sum modulo 2^64 without overflow: low and high halves apart
        low = sum((c.bitwiseAND(F.lit(0xFFFFFFFF)) for c in cols[1:]), cols[0].bitwiseAND(F.lit(0xFFFFFFFF)))
        high = sum((F.shiftright(c, 32) for c in cols[1:]), F.shiftright(cols[0], 32)) + F.shiftright(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))

    return [wrap(mixed), wrap(second)]


def _same(a: list[str], b: list[str]) -> Column:
    """Whether two lists of fields are equal as multisets: each value occurs equally often on both sides."""
    times = lambda v, cols: sum((F.when(v == F.col(c), 1).otherwise(0) for c in cols), F.lit(0))
    same = F.lit(True)
    for c in a:
        same = same & (times(F.col(c), a) == times(F.col(c), b))
    return same


def format_duplicates(rows: DataFrame, key: str, fields: list[list[str]], required: str) -> DataFrame:
    """Records that repeat an earlier one in other formatting: ``first_id, <key>, copies`` (the group's size).

    ``fields`` lists the groups of fields that may exchange their values, e.g. ``[["name", "city"]]``; a field alone
    in its group keeps its place.  NULL counts as empty.  Rows whose ``required`` field is NULL or has no letter or
    digit are left out.  Only a fingerprint's first record and size are kept while grouping, combined before the
    shuffle; a group that holds most of the rows is joined back by broadcasting its one representative.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    flat = [c for group in fields for c in group]
    roles = [F.lit(f"role{i}") for i, group in enumerate(fields) for _ in group]
    parts = [f"_k{i}" for i in range(len(flat))]
    keyed = rows.filter(F.col(required).isNotNull()).select(
        F.col(key).alias("_id"), *[F.coalesce(normal_key(F.col(c)), F.lit("")).alias(p) for c, p in zip(flat, parts, strict=True)]
    )
    keyed = keyed.filter(F.col(parts[flat.index(required)]) != "")
    h1, h2 = multiset_hash(roles, [F.col(p) for p in parts])
    marked = staged(keyed.select("_id", *parts, h1.alias("_h1"), h2.alias("_h2")))
    firsts = [f"_f{i}" for i in range(len(parts))]
    groups = marked.groupBy("_h1", "_h2").agg(F.count("*").alias("copies"), F.min(F.struct("_id", *parts)).alias("first"))
    groups = staged(
        groups.filter("copies > 1").select(
            "_h1", "_h2", "copies", F.col("first._id").alias("first_id"), *[F.col(f"first.{p}").alias(f) for p, f in zip(parts, firsts, strict=True)]
        )
    )
    found = join_representatives(marked, groups, ["_h1", "_h2"], "copies")
    start, verified = 0, F.lit(True)
    for group in fields:
        end = start + len(group)
        verified = verified & _same(parts[start:end], firsts[start:end])
        start = end
    return found.filter(verified & (F.col("_id") != F.col("first_id"))).select("first_id", F.col("_id").alias(key), "copies")
