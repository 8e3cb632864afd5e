"""Grounding: how well each value is supported by its source's text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.similarity import support_fast, supports

THRESHOLD = 0.7


def source_text(elements: DataFrame) -> DataFrame:
    """``source_id, source_text``: each source's texts and tables' rows (cells joined by spaces) by line, in order.

    A source's text is one value, as it is one document; the size of a document bounds it.
    """
    rows = F.transform("grid", lambda r: F.array_join(r, " ", ""))
    line = F.when((F.col("kind") == "table") & F.col("grid").isNotNull(), F.array_join(rows, "\n")).otherwise(F.col("text"))
    parts = elements.select("source_id", "elem_idx", line.alias("line")).filter("line is not null")
    ordered = F.array_sort(F.collect_list(F.struct("elem_idx", "line")))
    return parts.groupBy("source_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("source_text"))


def score_cells(rows: DataFrame, texts: DataFrame, columns: dict[str, Column], exact_only: bool = False, judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``rows`` with ``_score_<column>`` for each of ``columns`` (its value as text), clamped to 0..1.

    Each distinct value of a source is scored once.  A source's values are cut into chunks of about :data:`CHUNK`, so
    its text moves once a chunk instead of once a row, and a source with most of the rows is many tasks.  ``exact_only``
    scores values that neither stand in their source nor have all their words there 0; ``judge`` replaces the scorer.
    A source without text, or a NULL source, scores as empty.
    """
    names = list(columns)
    asked = rows.withColumns({f"__v{i}": F.coalesce(columns[c].cast("string"), F.lit("")) for i, c in enumerate(names)}) if names else rows
    if judge is not None or exact_only:
        score = judge or (lambda v, s: F.coalesce(support_fast(v, s), F.lit(0.0)))
        joined = asked.join(texts, "source_id", "left").withColumn("source_text", F.coalesce("source_text", F.lit("")))
        scored = {f"_score_{c}": _clamped(score(F.col(f"__v{i}"), F.col("source_text"))) for i, c in enumerate(names)}
        return joined.withColumns(scored).drop("source_text", *[f"__v{i}" for i in range(len(names))])
    values = asked.select("source_id", F.explode(F.array(*[F.col(f"__v{i}") for i in range(len(names))])).alias("value")).distinct() if names else None
    if values is None:
        return rows
    known = _scores(values, texts)
    for i, c in enumerate(names):
        one = known.select(F.col("source_id").alias("__s"), F.col("value").alias("__v"), _clamped(F.col("score")).alias(f"_score_{c}"))
        asked = asked.join(one, F.col("source_id").eqNullSafe(F.col("__s")) & (F.col(f"__v{i}") == F.col("__v")), "left").drop("__s", "__v", f"__v{i}")
    return asked


#: Distinct values of a source that are scored together.
CHUNK = 400


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))


def _scores(values: DataFrame, texts: DataFrame) -> DataFrame:
    """``source_id, value, score`` of distinct values, a chunk of one source's values in one call."""
    sizes = values.groupBy(F.col("source_id").alias("__s")).agg(F.count("*").alias("n"))
    cut = values.join(sizes, F.col("source_id").eqNullSafe(F.col("__s"))).select("source_id", "value", F.pmod(F.xxhash64("value"), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    chunks = cut.groupBy("source_id", "chunk").agg(F.collect_list("value").alias("values")).join(texts, "source_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [supports(v, s or "") for v, s in zip(b["values"].to_pylist(), b["source_text"].to_pylist(), strict=True)]
            yield pa.record_batch([b["source_id"], b["values"], pa.array(scores, pa.list_(pa.float64()))], names=["source_id", "values", "scores"])

    kind = dict(values.dtypes)["source_id"]
    done = chunks.select("source_id", "values", "source_text").mapInArrow(run, f"source_id {kind}, values array<string>, scores array<double>")
    return done.select("source_id", F.inline(F.arrays_zip(F.col("values").alias("value"), F.col("scores").alias("score"))))


def flag_ungrounded(scored: DataFrame, columns: list[str], threshold: float = THRESHOLD, reject: bool = False) -> DataFrame:
    """``_ground_flag`` where a score is below the threshold; with ``reject`` such rows are dropped."""
    low = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`_score_{c}`"), F.lit(0.0)) < threshold for c in columns], F.lit(False))
    flagged = scored.withColumn("_ground_flag", low)
    return flagged.filter(~F.col("_ground_flag")) if reject else flagged
