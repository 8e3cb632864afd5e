"""Schemas that drift between files: one consistent table a feed, and every change between neighbouring files.

Each grid's header and column types are read where the grid lies (no shuffle of cells).  A feed's schemas are folded
through a promotion lattice, which an associative aggregate can do in any order:

    bool   date   int -> float
       \\     |     /        (anything else together)
              str

Changes join each file with the one before it on (feed, number), so that a feed with most of the files is no hot key.
A removed and an added column are one renamed column if they stand at the same place between the columns that stay
and may have the same type, unless the evidence is against it: names that stand together in some schema are different
columns, and values of other shapes are other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.celltypes import BLANK, NAMES, STR, Grids
from cellwright.functions.text import normal_name
from cellwright.operators.joins import checked_broadcast
from cellwright.session import staged

#: Least overlap of two columns' shapes for one to be the other renamed.
LEAST_OVERLAP = 0.15

SCHEMA = (
    "origin string, feed string, seq_no int, record_id bigint,"
    " columns array<struct<name string, type string, shapes array<struct<shape string, share double>>>>"
)


def value_shapes(values: pa.Array) -> pa.Array:
    """Each value's shape: long words as W or w, short capital ones as they are (ids' prefixes), numbers by length."""
    v = pc.utf8_trim_whitespace(pc.fill_null(values, ""))
    v = pc.replace_substring_regex(v, r"\p{Lu}*\p{Ll}{2,}", "w")
    v = pc.replace_substring_regex(v, r"w(?:[ '-]+\.?w)+", "w w")
    v = pc.replace_substring_regex(v, r"\.[0-9]+", ".f")
    v = pc.replace_substring_regex(v, r"[0-9]{4,}", "D")
    return pc.replace_substring_regex(v, r"[0-9]{1,3}", "d")


def _grid_schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grids = Grids(b["cells"])
        used = np.flatnonzero(grids.right_width[grids.cell_row] & (grids.codes != BLANK)) if len(grids.cell_row) else np.zeros(0, int)
        shapes = value_shapes(grids.values.take(pa.array(used))).dictionary_encode() if len(used) else None
        best: dict[int, list[tuple[str, float]]] = {}
        if shapes is not None:
            words = shapes.dictionary.to_pylist()
            code = shapes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key, n = np.unique(grids.cell_column[used] * len(words) + code, return_counts=True)
            for k, count in zip(key.tolist(), n.tolist(), strict=True):
                best.setdefault(k // len(words), []).append((words[k % len(words)], count))
        header = grids.values.to_pylist() if len(grids.values) else []
        columns = []
        for g in range(grids.n):
            base, width = grids.column_base[g], grids.header_width[g]
            start = grids.row_start[grids.first_row[g]] if width else 0
            row: dict[str, dict] = {}
            for i in range(width):
                name = normal_name(header[start + i])
                if not name or name in row:  # equal names are one column, its first
                    continue
                seen = sorted(best.get(base + i, []), key=lambda x: (-x[1], x[0]))
                total = sum(n for _, n in best.get(base + i, [])) or 1
                kind = int(grids.column_type[base + i])
                row[name] = {
                    "name": name,
                    "type": None if kind == BLANK else str(NAMES[kind]),
                    "shapes": [{"shape": s, "share": n / total} for s, n in seen],
                }
            columns.append(list(row.values()))
        kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("shapes", pa.list_(pa.struct([("shape", pa.string()), ("share", pa.float64())])))]))
        yield pa.record_batch(
            {
                "origin": pa.array(["ir_tables"] * b.num_rows, pa.string()),
                "feed": b["feed"],
                "seq_no": b["file_no"],
                "record_id": b["table_id"],
                "columns": pa.array(columns, kind),
            }
        )


def grid_schemas(tables: DataFrame) -> DataFrame:
    """The schema of each file of a feed, as its header and its cells show it; of repeated files the first delivered.

    Rows without feed or number have no neighbours and are left out.
    """
    read = tables.filter("feed is not null and file_no is not null").select("feed", "file_no", "table_id", "cells")
    return _first(read.mapInArrow(_grid_schemas, SCHEMA))


def declared_schemas(schemas: DataFrame) -> DataFrame:
    """The schemas of ``resolved_schemas`` in the same form; a column without hint has no type."""
    name = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    hint = lambda c: F.get(F.filter(F.map_entries("hints"), lambda e: e["key"] == c), F.lit(0))["value"]
    by_name = lambda c: F.get(F.filter(F.map_entries("hints"), lambda e: name(e["key"]) == name(c)), F.lit(0))["value"]
    none = F.lit(None).cast("array<struct<shape:string,share:double>>")
    all_ = F.transform(
        F.filter(F.coalesce("columns", F.array().cast("array<string>")), lambda c: c.isNotNull()),
        lambda c: F.struct(name(c).alias("name"), F.coalesce(hint(c), by_name(c)).alias("type"), none.alias("shapes")),
    )
    names = F.transform("all", lambda x: x["name"])
    kept = F.filter("all", lambda x, i: (x["name"] != "") & (F.array_position(names, x["name"]) == i + 1))
    read = (
        schemas.filter("feed is not null and version_no is not null")
        .withColumn("all", all_)
        .select(
            F.lit("resolved_schemas").alias("origin"),
            "feed",
            F.col("version_no").cast("int").alias("seq_no"),
            F.col("schema_id").alias("record_id"),
            kept.alias("columns"),
        )
    )
    return _first(read)


def _first(schemas: DataFrame) -> DataFrame:
    keys = ["origin", "feed", "seq_no"]
    return schemas.groupBy(*keys).agg(F.min_by("columns", "record_id").alias("columns"), F.min("record_id").alias("record_id"))


def _names(c: str) -> Column:
    return F.transform(c, lambda x: x["name"])


def schema_pairs(schemas: DataFrame) -> DataFrame:
    """Each schema (``new``) with the one before it in its feed (``old``)."""
    old = schemas.select("origin", "feed", (F.col("seq_no") + 1).alias("seq_no"), F.col("columns").alias("old"))
    new = schemas.select("origin", "feed", "seq_no", F.col("columns").alias("new"))
    return new.join(old, ["origin", "feed", "seq_no"])


def _ends(side: str, other: str) -> Column:
    """Columns of ``side`` that ``other`` lacks, each with the number of staying columns before it."""
    away = _names(other)
    at = F.transform(side, lambda x, i: F.struct(x.alias("col"), i.alias("i")))
    stays = lambda x: F.array_contains(away, x["name"])
    gone = F.filter(at, lambda e: ~stays(e["col"]))
    place = lambda e: F.size(F.filter(F.slice(side, F.lit(1), e["i"]), stays))
    return F.transform(
        gone,
        lambda e: F.struct(
            e["col"]["name"].alias("name"), e["col"]["type"].alias("type"), e["col"]["shapes"].alias("shapes"), place(e).alias("place")
        ),
    )


def _overlap(a: Column, b: Column) -> Column:
    """Shared weight of two shape profiles, all shapes of either; NULL where one is missing or empty."""
    of_b = F.map_from_entries(b)
    both = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.least(x["share"], F.coalesce(F.try_element_at(of_b, x["shape"]), F.lit(0.0))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both)


def rename_candidates(changed: DataFrame) -> DataFrame:
    """Pairs of a removed and an added column of one step: their places, types and shapes compared."""
    same = F.col("r.type").eqNullSafe(F.col("a.type"))
    numeric = F.col("r.type").isin("int", "float") & F.col("a.type").isin("int", "float")
    missing = F.col("r.type").isNull() | F.col("a.type").isNull()
    tokens = lambda c: F.split(c, "_")
    return (
        changed.filter((F.size("removed") > 0) & (F.size("added") > 0))
        .select("origin", "feed", "seq_no", F.explode("removed").alias("r"), "added")
        .select("origin", "feed", "seq_no", "r", F.explode("added").alias("a"))
        .select(
            "origin",
            "feed",
            "seq_no",
            F.col("r.name").alias("old_name"),
            F.col("a.name").alias("new_name"),
            F.least("r.name", "a.name").alias("lo"),
            F.greatest("r.name", "a.name").alias("hi"),
            (F.col("r.place") == F.col("a.place")).alias("same_place"),
            (same | numeric | missing).alias("same_type"),
            F.arrays_overlap(tokens(F.col("r.name")), tokens(F.col("a.name"))).alias("same_word"),
            _overlap(F.col("r.shapes"), F.col("a.shapes")).alias("overlap"),
        )
    )


def names_together(schemas: DataFrame, candidates: DataFrame) -> DataFrame:
    """Those pairs of names ``lo < hi`` of ``candidates`` that stand together in some schema and so are two columns.

    Only names that some step may have renamed are listed, and equal sets of these are made one before their pairs are.
    """
    asked = candidates.select("lo", "hi").distinct()
    names = checked_broadcast(staged(asked.select(F.explode(F.array("lo", "hi")).alias("name")).distinct()), 80)
    each = schemas.select("origin", "feed", "seq_no", F.explode(_names("columns")).alias("name")).join(names, "name", "left_semi")
    sets = each.groupBy("origin", "feed", "seq_no").agg(F.array_sort(F.collect_set("name")).alias("names")).select("names").distinct().filter(F.size("names") > 1)
    one = sets.select("names", F.explode("names").alias("lo"))
    pairs = one.select("lo", F.explode("names").alias("hi")).filter("lo < hi").distinct()
    return pairs.join(asked, ["lo", "hi"], "left_semi")


def renames(schemas: DataFrame, changed: DataFrame) -> DataFrame:
    """``origin, feed, seq_no, old_name, new_name`` of renamed columns, each name used once a step."""
    found = staged(rename_candidates(changed))
    keys = ["lo", "hi"]
    apart = checked_broadcast(staged(names_together(schemas, found)), 120)
    support = checked_broadcast(
        staged(found.filter("same_place and same_type").groupBy(*keys).agg(F.count("*").alias("support"))), 120
    )
    judged = found.join(apart, keys, "left_anti").join(support, keys, "left")
    shape_ok = F.coalesce(F.col("overlap") >= LEAST_OVERLAP, F.lit(True))
    usual = F.coalesce(F.col("support"), F.lit(0)) >= 2
    good = judged.filter((F.col("same_type") & shape_ok & (F.col("same_place") | usual)) | (F.col("same_place") & usual))
    score = (
        F.when(F.col("same_place"), 4).otherwise(0)
        + F.when(F.col("same_type"), 2).otherwise(0)
        + F.when(F.col("same_word"), 1).otherwise(0)
        + F.coalesce("overlap", F.lit(0.5))
        + F.log2(F.coalesce("support", F.lit(0)) + F.lit(1)) / 4
    )
    step = ["origin", "feed", "seq_no"]
    rank = F.struct(score.alias("score"), F.col("support"), F.col("old_name"), F.col("new_name"))
    good = good.select(*step, "old_name", "new_name", rank.alias("rank"))
    by_old = good.groupBy(*step, "old_name").agg(F.max_by("new_name", "rank").alias("new_name"))
    by_new = good.groupBy(*step, "new_name").agg(F.max_by("old_name", "rank").alias("old_name"))
    return by_old.join(by_new, [*step, "old_name", "new_name"])


def schema_changes(schemas: DataFrame) -> DataFrame:
    """Every change from one schema of a feed to the next: ``origin, feed, seq_no, change, old_name, new_name``.

    ``schemas`` holds rows of :func:`grid_schemas` and :func:`declared_schemas`.  A number that is missing in a feed
    leaves its neighbours without comparison; changes of order are none.  A column without values has no type and is
    not retyped.
    """
    schemas = staged(schemas)
    pairs = schema_pairs(schemas)
    changed = staged(
        pairs.select(
            "origin",
            "feed",
            "seq_no",
            _ends("old", "new").alias("removed"),
            _ends("new", "old").alias("added"),
            F.filter(
                F.transform("old", lambda o: F.struct(o["name"].alias("name"), o["type"].alias("was"), F.get(F.filter("new", lambda n: n["name"] == o["name"]), F.lit(0))["type"].alias("now"))),
                lambda t: t["was"] != t["now"],
            ).alias("retyped"),
        ).filter((F.size("removed") > 0) | (F.size("added") > 0) | (F.size("retyped") > 0))
    )
    step = ["origin", "feed", "seq_no"]
    moved = staged(renames(schemas, changed))
    out = lambda df, change, old, new: df.select(*step, F.lit(change).alias("change"), old.alias("old_name"), new.alias("new_name"))
    empty = F.lit("")
    gone = changed.select(*step, F.explode("removed.name").alias("old_name")).join(moved, [*step, "old_name"], "left_anti")
    come = changed.select(*step, F.explode("added.name").alias("new_name")).join(moved, [*step, "new_name"], "left_anti")
    retyped = changed.select(*step, F.explode("retyped.name").alias("name"))
    return (
        out(gone, "removed", F.col("old_name"), empty)
        .unionByName(out(come, "added", empty, F.col("new_name")))
        .unionByName(out(moved, "renamed", F.col("old_name"), F.col("new_name")))
        .unionByName(out(retyped, "retyped", F.col("name"), F.col("name")))
    )


def promote(types: Column) -> Column:
    """The join of an array of types in the lattice; NULL types are below all."""
    known = F.array_distinct(F.filter(types, lambda t: t.isNotNull()))
    return (
        F.when(F.size(known) == 1, F.get(known, F.lit(0)))
        .when((F.size(known) > 0) & (F.size(F.array_except(known, F.array(F.lit("int"), F.lit("float")))) == 0), "float")
        .otherwise("str")
    )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for feed, moved, sets in zip(b["feed"].to_pylist(), b["moved"].to_pylist(), b["sets"].to_pylist(), strict=True):
            schemas = [set(s) for s in sets]
            columns: dict[str, set[str]] = {}
            latest: dict[str, str] = {}
            for m in sorted(moved, key=lambda m: (m["seq_no"], m["old_name"])):
                old, new = (columns.get(m[k], {m[k]}) for k in ("old_name", "new_name"))
                both = old | new
                # names of one schema stay two columns, whatever links them by way of other files
                if any(len(s & both) > 1 for s in schemas):
                    continue
                for name in both:
                    columns[name], latest[name] = both, m["new_name"]
            out += [(feed, name, column) for name, column in latest.items() if name != column]
        yield pa.record_batch([pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else ((), (), ()))], names=["feed", "name", "column"])


def column_names(schemas: DataFrame) -> DataFrame:
    """``feed, name, column``: names under which a column stood before it was renamed, with its latest name.

    The renames of :func:`schema_changes` are chained per feed.  A feed's renames and different sets of names are one
    row, whose size its number of files does not change.
    """
    schemas = staged(schemas)
    moved = schema_changes(schemas).filter("change = 'renamed'").groupBy("feed").agg(F.collect_list(F.struct("seq_no", "old_name", "new_name")).alias("moved"))
    sets = schemas.groupBy("feed").agg(F.collect_set(F.array_sort(_names("columns"))).alias("sets"))
    return moved.join(sets, "feed").select("feed", "moved", "sets").mapInArrow(_chain, "feed string, name string, column string")


def union_schema(schemas: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """Each feed's consistent schema over all its files: ``feed, name, type, first_seq, files``.

    A renamed column is one, under its latest name; ``renamed`` is what :func:`column_names` gives, if it is at hand.
    """
    renamed = column_names(schemas) if renamed is None else renamed
    cols = schemas.select("feed", "seq_no", F.posexplode("columns").alias("pos", "c")).withColumn("name", F.col("c.name"))
    cols = cols.join(renamed, ["feed", "name"], "left").withColumn("name", F.coalesce("column", "name"))
    folded = cols.groupBy("feed", "name").agg(
        F.collect_set("c.type").alias("types"), F.min(F.struct("seq_no", "pos")).alias("first"), F.count("*").alias("files")
    )
    return folded.select("feed", "name", promote(F.col("types")).alias("type"), F.col("first.seq_no").alias("first_seq"), "files")


def cast_cell(value: Column, kind: Column) -> Column:
    """A cell in the text form of its column's type: numbers without separators, dates and words stripped; else NULL."""
    text = F.trim(value)
    number = F.regexp_replace(text, ",", "")
    as_int = F.try_to_number(number, F.lit("S999999999999999999")).cast("string")
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(kind == "int", F.coalesce(number.try_cast("bigint").cast("string"), as_int) if hasattr(number, "try_cast") else number)
        .when(kind == "float", number.try_cast("double").cast("string"))
        .when(kind == "bool", F.when(F.lower(text).isin("true", "yes", "y"), "true").when(F.lower(text).isin("false", "no", "n"), "false"))
        .otherwise(text)
    )


def consistent_rows(tables: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """All files of all feeds in one table: ``feed, file_no, table_id, row_index, values, misfits``, maps of name and text.

    Columns that were renamed stand under their latest name in all files.  Values are cast to the feed's union type
    and rendered as text; what does not fit is NULL there and stands as it was read in ``misfits``.  Repeated files
    come once.  Rows whose width is not the header's belong to the rejects and are left out.
    """
    schemas = staged(grid_schemas(tables)) if schemas is None else schemas
    renamed = staged(column_names(schemas))
    types = union_schema(schemas, renamed).groupBy("feed").agg(F.map_from_entries(F.collect_list(F.struct("name", "type"))).alias("types"))
    latest = renamed.groupBy("feed").agg(F.map_from_entries(F.collect_list(F.struct("name", "column"))).alias("latest"))
    name = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    kept = tables.join(schemas.select(F.col("record_id").alias("table_id")), "table_id", "left_semi")
    rows = (
        kept.select("feed", "file_no", "table_id", F.transform(F.get("cells", F.lit(0)), name).alias("names"), F.posexplode("cells").alias("row_index", "row"))
        .filter((F.col("row_index") > 0) & (F.size("row") == F.size("names")))
        .join(types.join(latest, "feed", "left"), "feed")
    )
    entries = F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.struct(F.get("names", i).alias("k"), F.get("row", i).alias("v")))
    first = F.filter(entries, lambda e, i: (e["k"] != "") & (F.array_position("names", e["k"]) == i + 1))
    column = lambda e: F.coalesce(F.try_element_at("latest", e["k"]), e["k"])
    named = F.transform(first, lambda e: F.struct(column(e).alias("k"), e["v"].alias("v")))
    cast = F.transform(named, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"), cast_cell(e["v"], F.try_element_at("types", e["k"])).alias("to")))
    lost = F.filter("cast", lambda e: e["to"].isNull() & (F.trim(e["v"]) != ""))
    pairs = lambda c, v: F.map_from_entries(F.transform(c, lambda e: F.struct(e["k"], e[v])))
    out = rows.filter(F.size("names") > 0).withColumn("cast", cast)
    return out.select("feed", "file_no", "table_id", "row_index", pairs("cast", "to").alias("values"), pairs(lost, "v").alias("misfits"))
