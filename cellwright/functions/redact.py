"""Masking of e-mail addresses, social security and phone numbers in text columns by fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, in the order in which they are applied, and their placeholders.  (?U) gives \w and \b
# their meaning for all scripts.
PATTERNS = {
    "[EMAIL]": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "[SSN]": r"\b\d{3}-\d{2}-\d{4}\b",
    "[PHONE]": r"\b(?:\+?\d{1,2}[\s-]?)?(?:\(?\d{3}\)?[\s-]?)\d{3}[\s-]?\d{4}\b",
}


def redact(c: Column, unicode: bool = True) -> Column:
    """``c`` with each match replaced by its placeholder; NULL stays NULL."""
    for placeholder, pattern in PATTERNS.items():
        c = F.regexp_replace(c, ("(?U)" if unicode else "") + pattern, placeholder)
    return c


def redaction_counts(c: Column) -> Column:
    """Matches of each pattern, those of an earlier pattern masked first."""
    counts = []
    for placeholder, pattern in PATTERNS.items():
        counts.append(F.coalesce(F.regexp_count(c, F.lit("(?U)" + pattern)), F.lit(0)).cast("bigint").alias(placeholder.strip("[]").lower()))
        c = F.regexp_replace(c, "(?U)" + pattern, placeholder)
    return F.struct(*counts)
