"""Human review: the queue of flagged rows, corrections, and their rendering for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORRECTIONS = "row_id, column, corrected_value, reviewer, recorded_at"


def review_queue(rows: DataFrame, flag: str, approvals: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """Flagged rows that nobody has approved."""
    queue = rows.filter(F.coalesce(F.col(flag), F.lit(False)))
    return queue if approvals is None else queue.join(approvals.select(key), key, "left_anti")


def review_apply(rows: DataFrame, corrections: DataFrame, columns: list[str], key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows with each cell's latest correction, and the feedback: what was replaced by what.

    Of equally late corrections the greatest value counts.  Corrections of unknown rows or columns are ignored.
    """
    latest = corrections.filter(F.col("column").isin(*columns)).groupBy(key, "column").agg(F.max_by("corrected_value", F.struct("recorded_at", "corrected_value")).alias("v"))
    wide = latest.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "v"))).alias("__fix"))
    joined = rows.join(wide, key, "left")
    has = lambda c: F.coalesce(F.map_contains_key("__fix", F.lit(c)), F.lit(False))
    kinds = dict(rows.dtypes)
    fixed = joined.select(*[F.when(has(c), F.try_element_at("__fix", F.lit(c)).try_cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns], (F.col("__fix").isNotNull()).alias("_reviewed"))
    feedback = joined.filter(F.col("__fix").isNotNull()).select(key, F.explode("__fix").alias("column", "corrected_value"), *[F.col(f"`{c}`").cast("string").alias(f"__o_{c}") for c in columns])
    original = F.coalesce(*[F.when(F.col("column") == c, F.col(f"`__o_{c}`")) for c in columns])
    return fixed, feedback.select(key, "column", original.alias("original_value"), "corrected_value")


def prompt_lines(feedback: DataFrame) -> DataFrame:
    """One line a correction: what to prefer over what."""
    quote = lambda c: F.when(F.col(c).isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), F.col(c), F.lit("'")))
    return feedback.select("*", F.concat(F.lit("- column "), quote("column"), F.lit(": prefer "), quote("corrected_value"), F.lit(" over "), quote("original_value")).alias("line"))
