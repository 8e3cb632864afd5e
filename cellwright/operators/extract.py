"""Extraction of typed tables from located elements, with the lineage of every cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.coerce import COERCERS
from cellwright.functions.text import py_strip
from cellwright.operators.lineage import LOCATION, with_lineage


def first_tables(elements: DataFrame) -> DataFrame:
    """The first table element of each source: ``source_id, grid, location``."""
    first = F.min_by(F.struct("grid", "location"), "elem_idx").alias("t")
    return elements.filter((F.col("kind") == "table") & (F.size("grid") > 0)).groupBy("source_id").agg(first).select("source_id", "t.*")


def table_rows(tables: DataFrame) -> DataFrame:
    """``source_id, row_idx, header, row, location``: body rows of grids, every value stripped; short rows end in NULL."""
    strip = lambda a: F.transform(a, py_strip)
    body = tables.select("source_id", strip(F.get("grid", F.lit(0))).alias("header"), F.posexplode("grid").alias("row_idx", "row"), "location")
    return body.filter("row_idx > 0").withColumn("row", strip(F.col("row")))


def extract_table(elements: DataFrame, columns: list[str] | None = None, all_tables: bool = False) -> DataFrame:
    """The table of the sources' first table elements, columns by ``columns`` (in order) or by the header.

    Without ``columns`` the header of the sources must be known to plan: it is read once (one small action).  Sources
    with other headers give NULL in the columns that they lack; of equal names the last counts.  Long rows are cut.
    """
    tables = elements.filter(F.col("kind") == "table").select("source_id", "grid", "location") if all_tables else first_tables(elements)
    rows = table_rows(tables)
    if columns is None:
        heads = rows.groupBy("header").agg(F.min("source_id").alias("s")).orderBy("s").select("header").limit(1).collect()
        names = list(dict.fromkeys(heads[0]["header"])) if heads else []
        place = lambda n, i: F.array_size("header") - F.array_position(F.reverse("header"), n)
        cells = {n: F.get("row", F.when(F.array_contains("header", n), place(n, i)).cast("int")) for i, n in enumerate(names)}
    else:
        names = list(columns)
        cells = {n: F.get("row", F.lit(i)) for i, n in enumerate(names)}
    out = rows.select("source_id", F.col("row_idx").alias("_ord"), *[v.alias(n) for n, v in cells.items()], F.col("location").alias("_location"))
    return with_lineage(out, names, F.array(F.col("_location").cast(LOCATION))).drop("_location")


def elements_fallback(elements: DataFrame) -> DataFrame:
    """Sources without a table: one row a text element with its kind, stripped text and place."""
    has = elements.filter(F.col("kind") == "table").select("source_id").distinct()
    rest = elements.join(has, "source_id", "left_anti").filter(py_strip(F.coalesce("text", F.lit(""))) != "")
    where = F.coalesce(F.col("location.note"), F.concat(F.lit("index "), F.col("location.index").cast("string")), F.lit("source"))
    return rest.select("source_id", "elem_idx", F.col("kind").alias("element"), py_strip(F.col("text")).alias("text"), where.alias("location"))


def failures(types: dict[str, str]) -> Column:
    """The fields of a row that do not have their required type, in order; a missing value is a failure."""
    bad = [F.when(COERCERS.get(t, lambda c: c)(F.col(f"`{c}`").cast("string")).isNull(), F.lit(c)) for c, t in types.items()]
    return F.array_compact(F.array(*bad))


def strict_validate(rows: DataFrame, types: dict[str, str], source: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """Rows of the sources all of whose rows fit ``types``, and one outcome row for each other source.

    The first failing row, by ``_ord``, gives a failed source's reason; such a source has no rows at all.
    """
    checked = rows.withColumn("_bad", failures(types))
    reason = F.concat(F.lit("row "), F.col("_ord").cast("string"), F.lit(": "), F.array_join("_bad", ", "))
    failed = checked.filter(F.size("_bad") > 0).groupBy(source).agg(F.min_by(reason, "_ord").alias("reason"))
    return rows.join(failed.select(source), source, "left_anti"), failed


def reconcile(rows: DataFrame, proposals: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values with proposals: an empty cell is filled, another non-empty proposal flags the row and changes nothing.

    Adds ``_filled`` (names of filled columns, to be grounded again) and ``_conflict``.
    """
    other = proposals.select(key, *[F.col(f"`{c}`").alias(f"__p_{c}") for c in columns])
    both = rows.join(other, key, "left")
    empty = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    fills = {c: empty(F.col(f"`{c}`")) & ~empty(F.col(f"`__p_{c}`")) for c in columns}
    clash = [~empty(F.col(f"`{c}`")) & ~empty(F.col(f"`__p_{c}`")) & (F.col(f"`{c}`") != F.col(f"`__p_{c}`")) for c in columns]
    any_ = clash[0]
    for c in clash[1:]:
        any_ = any_ | c
    kept = [F.when(fills[c], F.col(f"`__p_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in fills else F.col(f"`{c}`") for c in rows.columns]
    return both.select(*kept, F.array_compact(F.array(*[F.when(fills[c], F.lit(c)) for c in columns])).alias("_filled"), any_.alias("_conflict"))


def corpus_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames with the first frame's columns: others' further columns are dropped, missing ones are NULL."""
    columns = frames[0].columns
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f.select(*[c for c in f.columns if c in columns]), allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in columns])
