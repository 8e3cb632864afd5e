"""Coercion of text to typed values; what cannot be coerced is kept and reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.text import py_strip

WHOLE = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
SPECIAL = r"(?i)^[+-]?(?:inf|infinity|nan)$"
SPARK_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "string": "string", "date": "string"}


def _number(c: Column) -> Column:
    return F.replace(py_strip(c), F.lit(","), F.lit(""))


def coerce_int(c: Column) -> Column:
    """Whole numbers as they are, decimal and scientific ones truncated; beyond 64 bits NULL."""
    v = _number(c)
    return F.when(v.rlike(WHOLE), v.try_cast("bigint")).when(v.rlike(DECIMAL), v.try_cast("double").try_cast("bigint"))


def coerce_float(c: Column) -> Column:
    """Numbers in decimal or scientific notation, infinities and NaN by name."""
    v = _number(c)
    return F.when(v.rlike(DECIMAL) | v.rlike(SPECIAL), v.try_cast("double"))


def coerce_bool(c: Column) -> Column:
    v = F.lower(py_strip(c))
    return F.when(v.isin("true", "yes", "y", "1"), True).when(v.isin("false", "no", "n", "0"), False)


def coerce_str(c: Column) -> Column:
    """White space at the ends removed; NULL stays NULL."""
    return py_strip(c)


COERCERS: dict[str, Callable[[Column], Column]] = {
    "int": coerce_int, "float": coerce_float, "bool": coerce_bool, "str": coerce_str, "string": coerce_str,
}


def clean(df: DataFrame, types: dict[str, str], rules: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Typed columns beside ``_errors`` (one message a cell that failed), ``_flagged`` and ``_changed`` columns.

    A failed cell is NULL in its typed column and stays in ``<column>__raw``.  ``_changed`` names the columns whose
    text differs after cleaning and that need grounding again.  NULL cells are no errors.
    """
    rules = rules or {}
    out, errors, changed = {}, [], []
    for c, kind in types.items():
        raw = F.col(f"`{c}`").cast("string")
        value = COERCERS.get(kind, lambda x: x)(raw)
        if c in rules:
            value = rules[c](value)
        out[c] = value
        out[f"{c}__raw"] = raw
        failed = raw.isNotNull() & value.isNull()
        errors.append(F.when(failed, F.concat(F.lit(f"cannot coerce column '{c}' value '"), raw, F.lit("'"))))
        changed.append(F.when(raw.isNotNull() & ~failed & ~value.cast("string").eqNullSafe(raw), F.lit(c)))
    present = lambda cols: F.array_compact(F.array(*cols)) if cols else F.array().cast("array<string>")
    done = df.withColumns({"_errors": present(errors), "_changed": present(changed)} | {f"__{k}": v for k, v in out.items()})
    keep = [c for c in df.columns if c not in types]
    return done.select(*keep, *[F.col(f"`__{k}`").alias(k) for k in out], "_errors", "_changed", (F.size("_errors") > 0).alias("_flagged"))
