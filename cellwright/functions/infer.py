"""Cell and column type inference as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.celltypes import BOOL_WORDS, DATE_PATTERN, FLOAT_PATTERN, INT_PATTERN
from cellwright.functions.text import py_strip

#: Bit of each type in a column's mask.
BITS = {"bool": 1, "int": 2, "float": 4, "date": 8, "str": 16}


def cell_type(c: Column) -> Column:
    """The type of one cell: int, float, bool, date or str; NULL and blank cells are str."""
    v = py_strip(F.coalesce(c, F.lit("")))
    return (
        F.when(v == "", "str")
        .when(F.lower(v).isin(*BOOL_WORDS), "bool")
        .when(v.rlike(INT_PATTERN), "int")
        .when(v.rlike(FLOAT_PATTERN), "float")
        .when(v.rlike(DATE_PATTERN), "date")
        .otherwise("str")
    )


def type_from_mask(mask: int | None) -> str:
    """A column's type from the types of all its values: one type is kept, int and float are float, else str."""
    names = [n for n, b in BITS.items() if (mask or 0) & b]
    return names[0] if len(names) == 1 else "float" if names and set(names) <= {"int", "float"} else "str"


def type_mask(c: Column) -> Column:
    """Aggregate: the types of a column's non-blank values as bits; one pass, combined before the shuffle."""
    bit = reduce(lambda a, kv: a.when(cell_type(c) == kv[0], kv[1]), BITS.items(), F.when(F.lit(False), 0))
    return F.coalesce(F.bit_or(F.when(py_strip(c) != "", bit)), F.lit(0))


def column_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Types of string columns over all rows, all columns in one pass; a column without values is str."""
    columns = columns or [n for n, t in df.dtypes if t == "string"]
    if not columns:
        return {}
    row = df.agg(*[type_mask(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: type_from_mask(row[i]) for i, c in enumerate(columns)}
