"""Column profiles: counts, numeric ranges, histograms, most frequent values; one pass for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.coerce import coerce_float

#: A column is numeric if at least this share of all rows are numbers.
NUMERIC_SHARE = 0.8
BINS, TOP = 10, 10


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n``: every column's values as text with their counts, combined before one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def _all_columns(df: DataFrame, columns: list[str], flat: DataFrame) -> DataFrame:
    """``flat`` in the order of ``columns``, those of an empty table with NULL counts."""
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "_i int, column string").join(F.broadcast(flat), "column", "left").orderBy("_i").drop("_i")


def data_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, rows, non_null, unique`` of each column; NULL is no value."""
    flat = _value_counts(df, columns).groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("non_null"), F.count("value").alias("unique"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return _all_columns(df, columns, flat).select("column", *map(zero, ("rows", "non_null", "unique")))


def column_profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, kind, rows, non_null, fill_rate, unique, min, max, mean``; a categorical column has no range."""
    number = coerce_float(F.col("value"))
    times = F.when(number.isNotNull(), F.col("n"))
    flat = _value_counts(df, columns).groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("non_null"), F.count("value").alias("unique"),
        F.sum(times).alias("numbers"), F.min(number).alias("lo"), F.max(number).alias("hi"), (F.sum(number * times) / F.sum(times)).alias("avg"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    flat = _all_columns(df, columns, flat).select("column", *map(zero, ("rows", "non_null", "unique", "numbers")), "lo", "hi", "avg")
    numeric = (F.col("rows") > 0) & (F.col("numbers") >= NUMERIC_SHARE * F.col("rows"))
    return flat.select(
        "column", F.when(numeric, "numeric").otherwise("categorical").alias("kind"), "rows", "non_null",
        F.when(F.col("rows") > 0, F.round(F.col("non_null") / F.col("rows"), 4)).otherwise(0.0).alias("fill_rate"), "unique",
        F.when(numeric, F.col("lo")).alias("min"), F.when(numeric, F.col("hi")).alias("max"), F.when(numeric, F.round("avg", 4)).alias("mean"),
    )


def top_values(df: DataFrame, column: str, n: int = TOP) -> DataFrame:
    """The ``n`` most frequent values as text with their counts, equal counts by value."""
    v = F.col(f"`{column}`").cast("string")
    return df.filter(v.isNotNull()).groupBy(v.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``bin, lo, hi, count``: equal widths over the range, closed at the right, empty bins kept.

    The lowest value is in the first bin.  One value only gives one bin; no values give none.
    """
    number = F.col(f"`{column}`").cast("double")
    values = df.select(number.alias("v")).filter("v is not null and not isnan(v)")
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("lo") + width * i)
    placed = values.join(F.broadcast(span)).select(F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.size(F.filter(edges, lambda e: e < F.col("v"))) + 1).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("count"))  # at most ``bins`` rows
    all_ = span.filter("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(1), F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins))).alias("bin"))
    return all_.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise(F.col("lo") + width * F.col("bin")).alias("hi"), F.coalesce("count", F.lit(0)).alias("count")
    )


def exact_median(df: DataFrame, value: Column, most: int = 100_000) -> float | None:
    """The exact median of a numeric expression, for any number of rows; None without values.

    Spark's own exact median keeps all distinct values in one task.  Here the range that holds the middle is narrowed,
    a scan each time, until it has at most ``most`` distinct values, whose counts are then read: by approximate
    percentiles, and where these miss the middle by halving the range, which always ends.
    """
    values = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n = values.count()
    if n == 0:
        return None
    first, last = (n - 1) // 2, n // 2
    low, high, below, inside, slack = float("-inf"), float("inf"), 0, n, 4e-4
    while True:
        part = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        counts = part.groupBy("v").agg(F.count("*").alias("n"))
        if inside <= most or counts.limit(most + 1).count() <= most:
            break
        if slack <= 1:
            ends = [max(0.0, (first - below) / inside - slack), min(1.0, (last - below) / inside + slack)]
            a, b = part.agg(F.percentile_approx("v", ends, 10_000)).first()[0]
            under, within = part.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
            if below + under <= first and last < below + under + within and within < inside:
                low, high, below, inside = a, b, below + under, within
            else:  # the approximation missed; look further around the middle
                slack *= 4
            continue
        least, greatest = part.agg(F.min("v"), F.max("v")).first()
        middle = least / 2 + greatest / 2
        # more than ``most`` distinct values lie between them, so the middle is below the greatest
        under, left, right = part.agg(F.count_if(F.col("v") <= middle), F.max(F.when(F.col("v") <= middle, F.col("v"))), F.min(F.when(F.col("v") > middle, F.col("v")))).first()
        if first < below + under <= last:
            return (left + right) / 2
        if last < below + under:
            low, high, inside = least, left, under
        else:
            low, high, below, inside = right, greatest, below + under, inside - under
    at, found = below, []
    for v, k in counts.orderBy("v").collect():  # at most ``most``
        found += [v] * sum(at <= rank < at + k for rank in (first, last))
        at += k
    return sum(found) / 2


def corpus_summary(outcomes: DataFrame, rows: DataFrame, flag: str = "_ground_flag") -> DataFrame:
    """``sources, failed_sources, rows_emitted, rows_flagged`` in one row."""
    a = outcomes.agg(F.count("*").alias("sources"), F.count_if(F.col("error").isNotNull()).alias("failed_sources"))
    b = rows.agg(F.count("*").alias("rows_emitted"), F.count_if(F.col(flag)).alias("rows_flagged"))
    return a.join(F.broadcast(b))
