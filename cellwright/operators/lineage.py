"""The ``_lineage`` column and the algebra on it: mapping, merging, splitting, masking, origins, conformance.

Values stay in native columns; ``_lineage.cells`` maps each column to its faithfulness and places, so renaming is a
change of keys and masking leaves it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.session import Grown, staged

LINEAGE = "_lineage"
LOCATION = "struct<source_id:string,index:int,char_span:struct<start:bigint,end:bigint>,note:string>"
CELL = f"struct<faithfulness:double,grounding_mode:string,locations:array<{LOCATION}>,lineage_broken:boolean>"
LINEAGE_TYPE = f"struct<row_flagged:boolean,anomaly:boolean,lineage_broken:boolean,cells:map<string,{CELL}>>"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_") and c != "source_id"]


def cell(locations: Column, faithfulness: Column | None = None, mode: str = "none", broken: bool = False) -> Column:
    return F.struct(
        (F.lit(None) if faithfulness is None else faithfulness).cast("double").alias("faithfulness"),
        F.lit(mode).alias("grounding_mode"), locations.cast(f"array<{LOCATION}>").alias("locations"), F.lit(broken).alias("lineage_broken"),
    )


def lineage(cells: Column, flagged: Column | bool = False, anomaly: Column | bool = False, broken: bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(flagged).alias("row_flagged"), lit(anomaly).alias("anomaly"), F.lit(broken).alias("lineage_broken"), cells.alias("cells")).cast(LINEAGE_TYPE)


def with_lineage(df: DataFrame, columns: list[str], locations: Column) -> DataFrame:
    """Adds lineage that gives all ``columns`` the same places."""
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    return df.withColumn(LINEAGE, lineage(F.map_from_arrays(names, F.transform(names, lambda _: cell(locations)))))


def flag_rows(df: DataFrame, flag: Column, anomaly: bool = False) -> DataFrame:
    """Sets the row's flag where ``flag`` holds; flags that are set stay."""
    f = F.coalesce(flag, F.lit(False))
    new = F.col(LINEAGE).withField("row_flagged", F.coalesce(F.col(f"{LINEAGE}.row_flagged"), F.lit(False)) | f)
    if anomaly:
        new = new.withField("anomaly", F.coalesce(F.col(f"{LINEAGE}.anomaly"), F.lit(False)) | f)
    return df.withColumn(LINEAGE, new)


def compose_map(df: DataFrame, column: str, value: Column, detail: str = "") -> DataFrame:
    """One cell from one: the new value, its place kept, ``_edges`` and, if it changed, ``_regrounding`` extended."""
    edge = F.struct(F.lit("map").alias("op"), F.lit(column).alias("column"), F.lit(detail).alias("detail"))
    edges = F.col("_edges") if "_edges" in df.columns else F.array().cast("array<struct<op:string,column:string,detail:string>>")
    again = F.col("_regrounding") if "_regrounding" in df.columns else F.array().cast("array<string>")
    changed = ~F.col(f"`{column}`").cast("string").eqNullSafe(value.cast("string"))
    return df.withColumns({column: value, "_edges": F.array_append(edges, edge), "_regrounding": F.when(changed, F.array_union(again, F.array(F.lit(column)))).otherwise(again)})


def compose_split(df: DataFrame, column: str, separator: str) -> DataFrame:
    """One row a part of ``column`` (``_part`` counts from 0); every part keeps the whole's lineage."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(F.split(F.col(f"`{column}`"), separator)).alias("_part", column))


def compose_mask(df: DataFrame, column: str, mask: str) -> DataFrame:
    """The value hidden, its lineage and faithfulness kept; NULL is hidden too."""
    return df.withColumn(column, F.lit(mask))


def merge_rows(df: DataFrame, cluster: str, order: str, columns: list[str], strategy: str = "first") -> DataFrame:
    """One row a cluster: each column's first or longest value (the first of equally long ones), ``_size`` and lineage.

    Places are all members' in order, faithfulness the least, flags any.  Values are chosen by aggregates that are
    combined before the shuffle; only the lists of places grow with a cluster.
    """
    if strategy not in ("first", "longest"):
        raise ValueError(f"unknown strategy {strategy!r}")
    aggs = []
    for c in columns:
        v = F.col(f"`{c}`")
        if strategy == "first":
            aggs.append(F.min_by(F.struct(v.alias("v")), order)["v"].alias(c))
        else:
            rank = F.struct(F.length(F.coalesce(v.cast("string"), F.lit("None"))).alias("n"), (-F.col(order)).alias("o"))
            aggs.append(F.max_by(F.struct(v.alias("v")), rank)["v"].alias(c))
    aggs += [F.count("*").alias("_size"), F.min(order).alias(order)]
    if LINEAGE not in df.columns:
        return df.groupBy(cluster).agg(*aggs)
    flat = df.select("*", F.col(f"{LINEAGE}.cells").alias("__cells"), F.col(f"{LINEAGE}.row_flagged").alias("__flag"))
    for c in columns:
        one = F.try_element_at("__cells", F.lit(c))
        aggs.append(F.min(one["faithfulness"]).alias(f"__f_{c}"))
        aggs.append(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one["locations"].alias("l")))).alias(f"__l_{c}"))
    merged = flat.groupBy(cluster).agg(*aggs, F.bool_or(F.coalesce("__flag", F.lit(False))).alias("__flag"))
    cells = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(*[cell(F.flatten(F.transform(F.col(f"__l_{c}"), lambda x: F.coalesce(x["l"], F.array().cast(f"array<{LOCATION}>")))), F.col(f"__f_{c}")) for c in columns]),
    )
    return merged.select(cluster, *[F.col(f"`{c}`") for c in columns], "_size", order, lineage(cells, F.col("__flag")).alias(LINEAGE))


#: Generations that are followed one by one before single parents are skipped in ever longer steps.
PLAIN_ROUNDS = 4


def resolve_origins(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell, origin``: for each of ``cells(cell)`` the ancestors without stored parents, over ``edges(cell, parent)``.

    Each round follows one step for all cells at once and is written to the shared folder; pairs already met are not
    followed again, so cycles end.  There is no limit to the depth: after :data:`PLAIN_ROUNDS` steps, an edge to a cell
    with one parent only leads on to that parent, so long chains halve with every round.  A cell in a cycle that has no
    other origin has none; NULL cells and parents and repeated edges are left out.
    """
    edges = staged(edges.filter("cell is not null and parent is not null").select("cell", "parent").distinct())
    inner = edges.select(F.col("cell").alias("at")).distinct()
    front = staged(cells.filter("cell is not null").select("cell", F.col("cell").alias("at")).distinct())
    met, steps, rounds = Grown(front), edges, 0
    while not front.isEmpty():
        rounds += 1
        if rounds > PLAIN_ROUNDS:
            one = steps.groupBy(F.col("cell").alias("parent")).agg(F.count("*").alias("n"), F.min("parent").alias("further"))
            steps = staged(steps.join(one.filter("n = 1"), "parent", "left").select("cell", F.coalesce("further", "parent").alias("parent")).distinct())
        step = front.join(steps.select(F.col("cell").alias("at"), "parent"), "at").select("cell", F.col("parent").alias("at")).distinct()
        front = staged(step.join(met.frame, ["cell", "at"], "left_anti"))
        met.add(front)
    return met.frame.join(inner, "at", "left_anti").select("cell", F.col("at").alias("origin"))


def resolve_terminal(df: DataFrame, key: str) -> DataFrame:
    """One row a row and column: its sources, faithfulness, mode, and whether its lineage is broken."""
    cells = df.select(key, F.explode(f"{LINEAGE}.cells").alias("column", "c"))
    broken = F.coalesce("c.lineage_broken", F.lit(False)) | (F.size("c.locations") <= 0)
    return cells.select(key, "column", F.transform("c.locations", lambda x: x["source_id"]).alias("sources"), "c.faithfulness", "c.grounding_mode", broken.alias("broken"))


def mark_broken(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lineage of rows whose stage lost it: flagged, every cell broken and without a place."""
    names = F.array(*[F.lit(c) for c in columns])
    empty = F.array().cast(f"array<{LOCATION}>")
    return df.withColumn(LINEAGE, lineage(F.map_from_arrays(names, F.transform(names, lambda _: cell(empty, broken=True))), True, False, True))


def provenance_coverage(df: DataFrame) -> DataFrame:
    """``grounded_cells, cells``: cells with a place and unbroken lineage, and all."""
    values = F.map_values(F.col(f"{LINEAGE}.cells"))
    good = F.filter(values, lambda c: ~F.coalesce(c["lineage_broken"], F.lit(False)) & (F.size(c["locations"]) > 0))
    return df.agg(F.coalesce(F.sum(F.size(good)), F.lit(0)).cast("bigint").alias("grounded_cells"), F.coalesce(F.sum(F.size(values)), F.lit(0)).cast("bigint").alias("cells"))


def conformance_violations(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rule, rows``: rows that break a rule: every column has its cell with places, faithfulness is within 0..1."""
    cells = F.col(f"{LINEAGE}.cells")
    lost = F.exists(F.array(*[F.lit(c) for c in columns]), lambda c: F.coalesce(F.size(F.try_element_at(cells, c)["locations"]), F.lit(0)) <= 0)
    outside = F.exists(F.map_values(cells), lambda c: (c["faithfulness"] < 0) | (c["faithfulness"] > 1))
    counted = df.agg(*[F.count_if(F.coalesce(x, F.lit(n == "survival"))).alias(n) for n, x in (("survival", lost), ("bounds", outside))])
    return counted.select(F.stack(F.lit(2), F.lit("survival"), F.col("survival"), F.lit("bounds"), F.col("bounds")).alias("rule", "rows"))
