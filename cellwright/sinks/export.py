"""Sinks: lineage as JSON text, Parquet, CSV, JSON lines, Markdown, SQL tables, and a result's payload."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.operators.lineage import LINEAGE, data_columns
from cellwright.operators.transforms import any_to_markdown

# The formats with the endings of their files.
ENDINGS = {"csv": ("csv",), "parquet": ("parquet", "pq"), "json": ("json",), "markdown": ("md", "markdown")}
FORMATS = tuple(ENDINGS)


def export_format(path: str, declared: str | None = None) -> str:
    """The format to write: ``declared`` where it is given, else the one that the path's ending belongs to, else CSV."""
    asked = (declared or "").strip().lower()
    if asked in FORMATS:
        return asked
    if declared:
        raise ValueError(f"cannot export as {declared!r}: known formats are {', '.join(FORMATS)}")
    ending = PurePosixPath(path).suffix[1:].lower()
    return next((kind for kind, all_ in ENDINGS.items() if ending in all_), "csv")


def lineage_json(c: str = LINEAGE) -> Column:
    """The lineage as JSON text: row flags under ``_`` names beside one object a column; absent places' parts are left out."""
    cell = lambda k, v: F.struct(v["faithfulness"].alias("faithfulness"), v["grounding_mode"].alias("grounding_mode"), v["locations"].alias("locations"))
    cells = F.to_json(F.transform_values(F.col(f"{c}.cells"), cell))
    flags = F.to_json(F.struct(F.col(f"{c}.row_flagged").alias("_row_flagged"), F.when(F.col(f"{c}.anomaly"), True).alias("_anomaly"), F.when(F.col(f"{c}.lineage_broken"), True).alias("_lineage_broken")))
    inner = F.substring(cells, F.lit(2), F.length(cells) - 2)
    head = F.substring(flags, F.lit(1), F.length(flags) - 1)
    return F.when(inner == "", flags).otherwise(F.concat(head, F.lit(","), inner, F.lit("}")))


def emit(df: DataFrame, include_lineage: bool = True) -> DataFrame:
    """Data columns and, as JSON text, their lineage."""
    cols = [F.col(f"`{c}`") for c in data_columns(df)]
    return df.select(*cols, *([lineage_json().alias(LINEAGE)] if include_lineage and LINEAGE in df.columns else []))


def write_export(df: DataFrame, path: str, declared: str | None = None, include_lineage: bool = True, mode: str = "overwrite") -> str:
    """Writes a folder of files in the format, in parallel; Markdown files each begin with a header. Returns the format."""
    kind, out = export_format(path, declared), emit(df, include_lineage)
    if kind == "parquet":
        out.write.mode(mode).parquet(path)
    elif kind == "json":
        out.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        out.write.mode(mode).option("header", "true").option("escape", '"').csv(path)
    else:
        head = "| " + " | ".join(out.columns) + " |\n| " + " | ".join("---" for _ in out.columns) + " |"

        def titled(batches):
            first = True
            for pdf in batches:
                lines = pdf["markdown"]
                if first and len(lines):
                    yield pdf.__class__({"value": [head]})
                    first = False
                yield pdf.__class__({"value": lines})

        any_to_markdown(out).mapInPandas(titled, "value string").write.mode(mode).text(path)
    return kind


def write_sql(df: DataFrame, table: str, mode: str = "append", jdbc: dict[str, str] | None = None, path: str | None = None) -> None:
    """All columns as text into a table of the catalog, its files at ``path`` if given, or with ``jdbc`` options of a database."""
    text = as_text(emit(df))
    if jdbc is None:
        (text.write.option("path", path) if path else text.write).mode(mode).saveAsTable(table)
    else:
        text.write.format("jdbc").options(**jdbc).option("dbtable", table).mode(mode).save()


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
