"""Text expressions with Python's meaning of white space, words and rendering, as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it (Java's ``\s`` is ASCII unless asked).
WS = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def py_strip(c: Column) -> Column:
    """``str.strip()``: white space of any script removed at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, f"{WS}+", " ")


def normal_name(name: str | None) -> str:
    """A column name in lower case, each run of other characters than a-z, 0-9 one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", (name or "").lower()).strip("_")


def py_str(c: Column, kind: str) -> Column:
    """A value rendered as Python's ``str`` would: ``True``/``False``, plain decimals between 1e-4 and 1e16."""
    if kind == "boolean":
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if kind in ("double", "float"):
        size = F.abs(c)
        text = c.cast("string")
        wide = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1")
        wide = F.regexp_replace(wide, r"\.$", ".0")
        small = F.regexp_replace(c.cast("decimal(38,20)").cast("string"), r"0+$", "")
        return F.when((size >= 1e7) & (size < 1e16), wide).when((size >= 1e-4) & (size < 1e-3), small).otherwise(text)
    return c.cast("string")
