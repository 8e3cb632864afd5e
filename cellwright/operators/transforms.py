"""Table-to-table transforms: cleaning, normalising, renaming, redaction, anomaly flags, filters, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from cellwright.functions.redact import redact
from cellwright.functions.text import collapse_ws, py_strip
from cellwright.operators.lineage import LINEAGE, data_columns, flag_rows
from cellwright.operators.profile import exact_median

#: Scale of the median absolute deviation, the modified z-score's limit, and the tolerance where the deviation is 0.
MAD_SCALE, MAD_LIMIT, MAD_TOLERANCE = 0.6745, 3.5, 1e-9


def _strings(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    chosen = data_columns(df) if columns is None else [c for c in columns if c in df.columns]
    return [f.name for f in df.schema.fields if f.name in chosen and isinstance(f.dataType, StringType)]


def _each(df: DataFrame, columns: list[str], f) -> DataFrame:
    return df.withColumns({c: f(F.col(f"`{c}`")) for c in columns}) if columns else df


def data_cleaner(df: DataFrame) -> DataFrame:
    """White space at the ends of all string cells removed."""
    return _each(df, _strings(df), py_strip)


def normalizer(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Lower case, single spaces, no white space at the ends; all string columns or those named."""
    return _each(df, _strings(df, columns), lambda c: collapse_ws(F.lower(py_strip(c))))


def pii_redactor(df: DataFrame) -> DataFrame:
    """E-mail addresses, social security and phone numbers of string cells masked; lineage is kept."""
    return _each(df, _strings(df), redact)


def column_mapper(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    """Columns renamed, their lineage with them; names that begin with ``_`` are never renamed."""
    names = {a: b for a, b in rename.items() if a in df.columns and not a.startswith("_")}
    out = df.withColumnsRenamed(names)
    if LINEAGE in df.columns and names:
        new = F.create_map(*[F.lit(x) for ab in names.items() for x in ab])
        cells = F.transform_keys(F.col(f"{LINEAGE}.cells"), lambda k, _: F.coalesce(F.try_element_at(new, k), k))
        out = out.withColumn(LINEAGE, F.col(LINEAGE).withField("cells", cells))
    return out


def drop_flagged(df: DataFrame) -> DataFrame:
    """Rows whose lineage is not flagged; without lineage all rows."""
    return df.filter(~F.coalesce(F.col(f"{LINEAGE}.row_flagged"), F.lit(False))) if LINEAGE in df.columns else df


def strip_lineage(df: DataFrame) -> DataFrame:
    return df.drop(LINEAGE)


def anomalies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with ``_anomaly``: a numeric cell is far from its column's median by the median absolute deviation.

    The medians are exact and computed first, in a few scans; flagging is then a plain expression.  NULL cells are no
    outliers, and a column without values has none.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name in (columns or data_columns(df))]
    far = F.lit(False)
    for c in numeric:
        value = F.col(f"`{c}`").cast("double")
        middle = exact_median(df, value)
        if middle is None:
            continue
        gap = F.abs(value - middle)
        mad = exact_median(df, gap)
        far = far | F.coalesce(MAD_SCALE * gap / mad > MAD_LIMIT if mad else gap > MAD_TOLERANCE, F.lit(False))
    return df.withColumn("_anomaly", far)


def anomaly_flagger(df: DataFrame) -> DataFrame:
    """Rows with an outlier flagged in their lineage; without lineage unchanged."""
    if LINEAGE not in df.columns:
        return df
    return flag_rows(anomalies(df), F.col("_anomaly"), anomaly=True).drop("_anomaly")


def any_to_json(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def any_to_csv(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """One delimited line a row; a field is quoted if it holds the delimiter, a quote or a line break."""
    def field(c: str) -> Column:
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(v.rlike(f'["\\r\\n{delimiter}]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return df.select(F.concat_ws(delimiter, *[field(c) for c in df.columns]).alias("csv"))


def markdown_cell(c: Column) -> Column:
    v = F.coalesce(c.cast("string"), F.lit(""))
    return py_strip(F.replace(F.replace(v, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def any_to_markdown(df: DataFrame) -> DataFrame:
    """One pipe-table line a row."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(f"`{c}`")) for c in df.columns]), F.lit(" |"))
    return df.select(line.alias("markdown"))
