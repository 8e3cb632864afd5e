"""Field mapping by an injected function, such as a language model: proposals for a table's cells, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: How often a row is tried again after the mapper failed on it.
RETRIES = 2

Mapper = Callable[[dict[str, Any]], dict[str, Any]]


def map_fields(rows: DataFrame, key: str, columns: list[str], mapper: Mapper, retries: int = RETRIES) -> DataFrame:
    """``<key>, <columns> as text, error``: what ``mapper`` makes of each row, a dict of ``columns``, in Arrow batches.

    A :class:`ValueError` or :class:`TypeError` is tried again ``retries`` times; then the row has no values but the
    last error's text.  Fields that the mapper leaves out are NULL, and those that it adds are ignored.
    """

    def one(row: dict[str, Any]) -> tuple[dict[str, Any], str | None]:
        failure = ""
        for _ in range(retries + 1):
            try:
                found = mapper(dict(row))
                return {c: None if found.get(c) is None else str(found[c]) for c in columns}, None
            except (ValueError, TypeError, AttributeError) as e:
                failure = str(e) or type(e).__name__
        return dict.fromkeys(columns), failure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [one(row) for row in b.select(columns).to_pylist()]
            cells = [pa.array([row[c] for row, _ in done], pa.string()) for c in columns]
            yield pa.record_batch([b[key], *cells, pa.array([e for _, e in done], pa.string())], names=[key, *columns, "error"])

    wanted = rows.select(key, *[f"`{c}`" for c in columns if c != key])
    return wanted.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, " + "".join(f"`{c}` string, " for c in columns) + "error string")
