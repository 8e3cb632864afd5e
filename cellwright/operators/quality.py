"""Column-level data quality profile, load by load, and the loads in which a column went wrong.

Values are generalised to character-class masks (runs of digits become 9, of capitals A, of small letters a).  The
masks that hold a least share of all values are the column's dominant patterns, a number that is bounded by that
share; all others are rare-mask violations.  A load departs from the others if the divergence of its distribution of
masks or of magnitudes from the loads' median distribution, or its share of distinct values, is far outside what the
other loads show.  The rows are read once, into counts of each load's distinct values, combined before they are
shuffled; masks, sizes, profiles and distinct counts are all taken from these, so a value is judged once a load however
often it stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.text import py_strip
from cellwright.operators.joins import checked_broadcast
from cellwright.operators.rejects import TOTAL_PATTERN
from cellwright.session import staged

#: Masks of at least this share of a column's values are dominant; so there are at most 500 of them.
DOMINANT_SHARE = 0.002
#: A load departs if its divergence is above this, above SPREAD robust deviations and above the noise of its size.
LEAST_DIVERGENCE, SPREAD = 0.01, 8.0
#: A share of distinct values departs if it is this many times smaller or larger than expected at the load's size.
DISTINCT_RATIO = 1.25


ASCII = "^[\\x00-\\x7f]*$"


def _bare(value: Column) -> Column:
    """The value without white space at its ends; only the few values with odd white space there pay for a pattern."""
    plain = F.trim(value)
    return F.when(plain.rlike(r"^[!-~](?:.*[!-~])?$|^$"), plain).otherwise(py_strip(value))


def mask(value: Column) -> Column:
    """The value's character-class mask: ``INV-1042`` is ``A-9``, ``Acme Corp`` is ``Aa Aa``; NULL is its own mask.

    White space at the ends is part of the dirt that every load has and is left out; blank values are one mask.
    Plain values are generalised letter by letter in one pass, others by classes of all scripts.
    """
    bare = _bare(value)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain = F.translate(bare, upper + lower + digits + "\t\n\r", "A" * 26 + "a" * 26 + "9" * 10 + "   ")
    other = bare
    for pattern, by in ((r"\p{Lu}", "A"), (r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]", "a"), (r"\p{N}", "9"), (r"\s", " ")):
        other = F.regexp_replace(other, pattern, by)
    m = F.when(bare.rlike(ASCII), plain).otherwise(other)
    m = F.regexp_replace(m, r"([a9 ])\1+|(?<=AA)A+", "$1")
    # long values of many words differ in their number of words only
    m = F.regexp_replace(m, r"(Aa |AA )\1+", "$1.. ")
    return F.coalesce(F.when(m == "", F.lit("(blank)")).otherwise(m), F.lit("(null)"))


def _number(value: Column) -> Column:
    text = F.trim(value)
    return F.when(text.rlike(TOTAL_PATTERN), F.replace(text, F.lit(","), F.lit(""))).try_cast("double")


def magnitude(value: Column) -> Column:
    """Sign and size of a number in thirds of a decade; zero and values that are no numbers have their own class."""
    number = _number(value)
    size = F.floor(F.log10(F.abs(number)) * 3).cast("string")
    return (
        F.when(number.isNull(), F.lit(None).cast("string"))
        .when(number == 0, F.lit("0"))
        .otherwise(F.concat(F.when(number < 0, "-").otherwise("+"), size))
    )


def distinct_values(rows: DataFrame, load: str, columns: list[str], numeric: tuple[str, ...] = ()) -> DataFrame:
    """``load_id, column_name, text, n, shortest, longest, mask, size, number`` of each load's distinct values.

    Values that differ only in spaces at their ends are one, NULL is one of its own.  ``size`` and ``number`` are NULL
    where a column is not among ``numeric``.
    """
    pairs = [F.struct(F.lit(c).alias("column_name"), F.trim(c).alias("text"), F.length(c).alias("length")) for c in columns]
    counted = (
        rows.select(F.col(load).alias("load_id"), F.inline(F.array(*pairs)))
        .groupBy("load_id", "column_name", "text")
        .agg(F.count("*").alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    )
    among = F.col("column_name").isin(*numeric) if numeric else F.lit(False)
    text = F.col("text")
    return counted.withColumns({"mask": mask(text), "size": F.when(among, magnitude(text)), "number": F.when(among, _number(text))})


def load_profile(rows: DataFrame, load: str, columns: list[str], numeric: tuple[str, ...] = (), values: DataFrame | None = None) -> DataFrame:
    """One row a load and column: rows, nulls, blanks, distinct values that are not blank, lengths, and the range of numbers.

    All counts are exact.  NULL loads are a load of their own; an empty table has no profile.  ``values`` is what
    :func:`distinct_values` gives, if it is at hand.
    """
    values = distinct_values(rows, load, columns, numeric) if values is None else values
    n, number, text = F.col("n"), F.col("number"), F.col("text")
    times = lambda where: F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("bigint")
    return values.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n"), times(text.isNull()).alias("nulls"), times(text == "").alias("blanks"), F.count_if(text != "").alias("distinct"),
        F.min("shortest").alias("shortest"), F.max("longest").alias("longest"), times(number.isNotNull()).alias("numbers"),
        F.min("number").alias("least"), F.max("number").alias("most"), (F.sum(number * n) / F.sum(F.when(number.isNotNull(), n))).alias("mean"),
    )


def value_classes(rows: DataFrame, load: str, columns: list[str], numeric: tuple[str, ...] = (), values: DataFrame | None = None) -> DataFrame:
    """Counts of each load's masks and magnitudes: ``load_id, column_name, feature, class, n``."""
    values = distinct_values(rows, load, columns, numeric) if values is None else values
    features = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("class")) for c in ("mask", "size")])
    classed = values.select("load_id", "column_name", "n", F.inline(features)).filter(F.col("class").isNotNull())
    return classed.groupBy("load_id", "column_name", "feature", "class").agg(F.sum("n").alias("n"))


def dominant_classes(classes: DataFrame) -> DataFrame:
    """The classes of at least :data:`DOMINANT_SHARE` of a column's values: ``column_name, feature, class, share``."""
    by = ["column_name", "feature"]
    pooled = classes.groupBy(*by, "class").agg(F.sum("n").alias("n"))
    total = pooled.groupBy(*by).agg(F.sum("n").alias("all"))
    return pooled.join(F.broadcast(total), by).select(*by, "class", (F.col("n") / F.col("all")).alias("share")).filter(F.col("share") >= DOMINANT_SHARE)


def divergences(classes: DataFrame) -> DataFrame:
    """Each load's Jensen-Shannon divergence (bits) from the loads' median distribution, a column and feature each.

    Returns ``load_id, column_name, feature, n, classes, divergence, rare_share``.
    """
    by = ["column_name", "feature"]
    common = F.broadcast(staged(dominant_classes(classes).drop("share")))  # at most 1 / DOMINANT_SHARE rows a feature
    known = classes.join(common.withColumn("common", F.lit(True)), [*by, "class"], "left")
    folded = known.groupBy("load_id", *by, F.when(F.col("common"), F.col("class")).alias("class")).agg(F.sum("n").alias("n"))
    totals = classes.groupBy("load_id", *by).agg(F.sum("n").alias("all"))
    shares = staged(folded.join(totals, ["load_id", *by]).select("load_id", *by, "class", (F.col("n") / F.col("all")).alias("p"), "all").withColumn("class", F.coalesce("class", F.lit("(rare)"))))
    loads = totals.groupBy(*by).agg(F.count("*").alias("loads"))
    # the median over all loads, those without the class counting 0
    listed = shares.groupBy(*by, "class").agg(F.sort_array(F.collect_list("p")).alias("ps")).join(F.broadcast(loads), by)
    place = F.floor(F.col("loads") / 2).cast("int") - (F.col("loads") - F.size("ps")).cast("int")
    middle = listed.select(*by, "class", F.when(place >= 0, F.get("ps", place)).otherwise(0.0).alias("q"))
    weight = middle.groupBy(*by).agg(F.sum("q").alias("w"), F.count_if(F.col("q") > 0).alias("classes"))
    reference = middle.join(F.broadcast(weight), by).select(*by, "class", (F.col("q") / F.col("w")).alias("q"), "classes")
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (
        shares.join(checked_broadcast(staged(reference), 120), [*by, "class"])
        .groupBy("load_id", *by)
        .agg(
            F.max("all").alias("n"),
            F.max("classes").alias("classes"),
            (0.5 * F.sum(part(F.col("p")) + part(F.col("q"))) + 0.5 * (1 - F.sum("q"))).alias("divergence"),
            F.sum(F.when(F.col("class") == "(rare)", F.col("p")).otherwise(0.0)).alias("rare_share"),
        )
    )


def dominant_masks(classes: DataFrame) -> DataFrame:
    """``column_name, mask, share`` of each column's dominant patterns, from what :func:`value_classes` gives."""
    return dominant_classes(classes.filter("feature = 'mask'")).select("column_name", F.col("class").alias("mask"), "share")


def mask_violations(classes: DataFrame) -> DataFrame:
    """``load_id, column_name, mask, n``: each load's masks that are none of the column's dominant patterns."""
    masks = classes.filter("feature = 'mask'")
    common = F.broadcast(staged(dominant_masks(classes).drop("share")))  # at most 1 / DOMINANT_SHARE rows a column
    return masks.select("load_id", "column_name", F.col("class").alias("mask"), "n").join(common, ["column_name", "mask"], "left_anti").select("load_id", "column_name", "mask", "n")


def full_profile(rows: DataFrame, load: str, columns: list[str], numeric: tuple[str, ...] = ()) -> DataFrame:
    """:func:`load_profile` with each load's mask and size divergence and its share of rare masks and sizes."""
    # within a struct, a NULL load equals itself and so is compared like the others
    values = staged(distinct_values(rows.withColumn(load, F.struct(F.col(load).alias("id"))), load, columns, numeric))
    far = divergences(staged(value_classes(rows, load, columns, numeric, values)))
    one = lambda feature, c: F.max(F.when(F.col("feature") == feature, F.col(c)))
    parts = [one(f, c).alias(f"{f}_{c}") for f in ("mask", "size") for c in ("divergence", "rare_share")]
    far = far.groupBy(F.col("load_id.id").alias("l"), F.col("column_name").alias("c")).agg(*parts)
    profile = load_profile(rows, load, columns, numeric, values).withColumn("load_id", F.col("load_id.id"))
    return profile.join(far, F.col("load_id").eqNullSafe(F.col("l")) & (F.col("column_name") == F.col("c")), "left").drop("l", "c")


def _robust(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """``df`` with the median of ``c`` over each ``by`` and the median distance from it."""
    mid = df.groupBy(*by).agg(F.median(c).alias("mid"))
    with_mid = df.join(F.broadcast(mid), by)
    spread = with_mid.groupBy(*by).agg(F.median(F.abs(F.col(c) - F.col("mid"))).alias("mad"))
    return with_mid.join(F.broadcast(spread), by)


def departing_loads(rows: DataFrame, load: str, columns: list[str], numeric: tuple[str, ...] = ()) -> DataFrame:
    """The loads in which a column's profile departs from the other loads': ``load_id, column_name, reason, score``.

    A load of few rows needs a larger divergence, as chance alone gives it one.  With fewer than three loads there is
    nothing to compare and nothing departs.
    """
    values = staged(distinct_values(rows, load, columns, numeric))
    classes = staged(value_classes(rows, load, columns, numeric, values))
    by = ["column_name", "feature"]
    # written once: the medians read it twice more, and the driver need not plan all of it three times
    far = _robust(staged(divergences(classes)), by, "divergence")
    noise = (F.col("classes") + 1) / (2 * F.log(F.lit(2.0)) * F.col("n"))
    limit = F.greatest(F.lit(LEAST_DIVERGENCE), F.col("mid") + SPREAD * 1.4826 * F.col("mad")) + noise
    odd = far.filter(F.col("divergence") > limit).select(
        "load_id", "column_name", F.concat(F.col("feature"), F.lit(" distribution")).alias("reason"), F.col("divergence").alias("score")
    )
    # distinct values against what a load of this size has: log(distinct) is nearly linear in log(n) between loads
    profile = staged(load_profile(rows, load, columns, numeric, values)).filter("n > nulls + blanks")
    counts = profile.select("load_id", "column_name", F.log(F.col("n") - F.col("nulls") - F.col("blanks")).alias("x"), F.log(F.col("distinct").cast("double")).alias("y"))
    counts = staged(counts)
    ratio = _robust(counts.withColumn("d", F.col("y") - F.col("x")), ["column_name"], "d").drop("mad")
    # slope of distinct on size, from loads near the median ratio only
    near = ratio.filter(F.abs(F.col("d") - F.col("mid")) < 0.3).groupBy("column_name").agg(
        F.coalesce(F.try_divide(F.covar_pop("x", "d"), F.var_pop("x")), F.lit(0.0)).alias("slope"), F.avg("x").alias("mx")
    )
    flat = ratio.drop("mid").join(F.broadcast(near), "column_name").withColumn("e", F.col("d") - F.col("slope") * (F.col("x") - F.col("mx")))
    flat = _robust(staged(flat), ["column_name"], "e")
    gap = F.abs(F.col("e") - F.col("mid"))
    few = flat.filter((gap > F.log(F.lit(DISTINCT_RATIO))) & (gap > SPREAD * 1.4826 * F.col("mad"))).select(
        "load_id", "column_name", F.lit("distinct values").alias("reason"), gap.alias("score")
    )
    return odd.unionByName(few)
