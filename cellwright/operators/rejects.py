"""Rows that fail to parse: good rows come out loaded, the others apart, each with its first reason.

Delimited records are parsed by structural indexing.  A batch's bytes are one numpy array; the prefix parity of the
quote mask tells which delimiters are structural; counts, quote neighbours and value patterns are then checked for
all records at once.  Reasons, in this order: ``quoting``, ``column_count``, ``value``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.functions.celltypes import Grids
from cellwright.functions.text import normal_name, py_strip
from cellwright.operators.joins import checked_broadcast

# What a valid invoice number and a valid total look like, blanks around them removed.
NUMBER_PATTERN = r"^INV-[0-9]{4,10}$"
TOTAL_PATTERN = r"^(?:[+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|[+-]?\.[0-9]+)$"
DELIMITERS = {"text/csv": ",", "text/tab-separated-values": "\t"}

QUOTE, LF, CR = 34, 10, 13


class RecordIndex:
    """Structural index of a batch of records (one string each): field borders and quoting errors."""

    def __init__(self, lines: pa.Array, delimiters: np.ndarray):
        lines = pc.fill_null(lines, "").cast(pa.large_string())
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        body = lines.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        self.n = n = len(lines)
        self.data, self.start = data, offsets[:-1] - offsets[0]
        self.end = offsets[1:] - offsets[0]
        length = self.end - self.start
        record = np.repeat(np.arange(n), length)
        quote = data == QUOTE
        seen = np.concatenate([[0], np.cumsum(quote)])
        inside = ((seen[:-1] - np.repeat(seen[self.start], length)) & 1).astype(bool)
        structural = (data == delimiters[record]) & ~inside
        self.borders = np.flatnonzero(structural)
        per_record = np.bincount(record[self.borders], minlength=n)
        self.n_fields = per_record + 1
        self.first_border = np.concatenate([[0], np.cumsum(per_record)])[:-1]

        at = np.flatnonzero(quote)
        owner = record[at]
        at_start, at_end = at == self.start[owner], at == self.end[owner] - 1
        before, after = data[np.maximum(at - 1, 0)], data[np.minimum(at + 1, max(len(data) - 1, 0))]
        opens = ~inside[at]
        good_open = at_start | structural[np.maximum(at - 1, 0)] | (before == QUOTE)
        good_close = at_end | (after == delimiters[owner]) | (after == QUOTE)
        bad = np.zeros(n, bool)
        bad[owner[np.where(opens, ~good_open, ~good_close)]] = True
        bad |= ((seen[self.end] - seen[self.start]) & 1).astype(bool)
        # a line break outside quotes, other than at the record's end, would start another record
        breaks = np.flatnonzero(((data == LF) | (data == CR)) & ~inside)
        tail = np.array([b"\r\n"[0], b"\r\n"[1]])
        last = data[np.maximum(self.end - 1, 0)] if len(data) else np.zeros(n, np.uint8)
        ends = self.end - np.where((length > 0) & np.isin(last, tail), 1, 0)
        second = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(n, np.uint8)
        ends = ends - np.where((ends < self.end) & (last == LF) & (ends > self.start) & (second == CR), 1, 0)
        self.text_end = ends
        bad[record[breaks[breaks < ends[record[breaks]]]]] = True
        self.bad_quoting = bad

    def field(self, records: np.ndarray, position: np.ndarray) -> list[str]:
        """The unquoted text of one field of each of the records."""
        first, count = self.first_border[records], self.n_fields[records]
        start = np.where(position == 0, self.start[records], 0)
        later = position > 0
        start[later] = self.borders[(first + position - 1)[later]] + 1
        end = self.text_end[records].copy()
        inner = position < count - 1
        end[inner] = self.borders[(first + position)[inner]]
        raw = self.raw
        out = []
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            text = raw[s:e]
            if text[:1] == b'"':
                text = text[1:-1].replace(b'""', b'"')
            out.append(text.decode("utf-8", "replace"))
        return out

    @cached_property
    def raw(self) -> bytes:
        return self.data.tobytes()

    def fields(self, record: int) -> list[str]:
        n = int(self.n_fields[record])
        return self.field(np.full(n, record), np.arange(n))

    def all_fields(self, records: np.ndarray) -> pa.ListArray:
        """All unquoted fields of each of the records."""
        count = self.n_fields[records]
        end = np.cumsum(count)
        values = self.field(np.repeat(records, count), np.arange(end[-1] if len(end) else 0) - np.repeat(end - count, count))
        return pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(values, pa.string()))


def record_ends(data: np.ndarray) -> np.ndarray:
    """Where the records of a file's bytes end, their line breaks included: at breaks that the quotes' parity is even at.

    A quote that is never closed would take the rest of the file with it: then the line in which the quotes went wrong
    is a record of its own, to be rejected, and the parity begins anew behind it.
    """
    found, at = [], 0
    breaks = (data == LF) | ((data == CR) & (np.append(data[1:], 0) != LF))
    lines = np.flatnonzero(breaks) + 1
    while at < len(data):
        odd = np.cumsum(data[at:] == QUOTE) & 1
        ends = np.flatnonzero(breaks[at:] & (odd == 0)) + 1 + at
        found.append(ends)
        last = int(ends[-1]) if len(ends) else at
        if last == len(data):
            break
        rest = lines[np.searchsorted(lines, last, "right") :]
        at = int(rest[0]) if len(rest) and odd[-1] else len(data)
        found.append(np.array([at]))
    return np.concatenate([*found, np.zeros(0, int)]).astype(np.int64)


def _file_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for source, kind, body in zip(b["source_id"].to_pylist(), b["content_type"].to_pylist(), b["content"], strict=True):
            data = np.frombuffer(body.as_buffer(), np.uint8) if body.is_valid and len(body.as_buffer()) else np.zeros(0, np.uint8)
            ends = record_ends(data[3:] if data[:3].tobytes() == b"\xef\xbb\xbf" else data) + (3 if data[:3].tobytes() == b"\xef\xbb\xbf" else 0)
            starts = np.append(3 if data[:3].tobytes() == b"\xef\xbb\xbf" else 0, ends)[: len(ends)]
            raw = data.tobytes()
            for first in range(0, len(ends), 10_000):  # a big file is many batches
                part = [raw[s:e].decode("utf-8", "replace").rstrip("\r\n") for s, e in zip(starts[first : first + 10_000].tolist(), ends[first : first + 10_000].tolist(), strict=True)]
                n = len(part)
                yield pa.record_batch([pa.array([source] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(np.arange(first, first + n), pa.int32()), pa.array(part, pa.string())], names=["source_id", "content_type", "line_no", "raw_line"])


def file_records(files: DataFrame) -> DataFrame:
    """``source_id, content_type, line_no, raw_line``: the records of whole delimited files ``source_id, content_type, content``.

    Record ends are located over the file's bytes; a quoted field may hold line breaks.  ``line_no`` counts records,
    0 is the header.  NULL and empty files have no records; a byte order mark is left out.
    """
    return files.select("source_id", "content_type", "content").mapInArrow(_file_records, "source_id string, content_type string, line_no int, raw_line string")


def _fails(values: list[str], pattern: str, blank_is_fine: bool) -> np.ndarray:
    text = pc.utf8_trim_whitespace(pa.array(values, pa.string()))
    good = pc.match_substring_regex(text, pattern)
    if blank_is_fine:
        good = pc.or_(good, pc.equal(text, ""))
    return ~good.to_numpy(zero_copy_only=False)


def _delims(content_type: pa.Array) -> np.ndarray:
    return np.where(pc.fill_null(pc.equal(content_type, "text/tab-separated-values"), False).to_numpy(zero_copy_only=False), 9, 44)


def _blank_lines(lines: pa.Array) -> np.ndarray:
    """Lines without any content; a line of delimiters alone has fields and is none."""
    return pc.equal(pc.utf8_trim(pc.fill_null(lines, ""), characters=" \r\n"), "").to_numpy(zero_copy_only=False)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        index = RecordIndex(b["raw_line"], _delims(b["content_type"]))
        names = [[normal_name(x) for x in row] for row in index.all_fields(np.arange(b.num_rows)).to_pylist()]
        find = lambda row, name: row.index(name) if name in row else -1
        yield pa.record_batch(
            {
                "source_id": b["source_id"],
                "names": pa.array(names, pa.list_(pa.string())),
                "width": pa.array([len(x) for x in names], pa.int32()),
                "number_at": pa.array([find(x, "invoice_number") for x in names], pa.int32()),
                "total_at": pa.array([find(x, "total") for x in names], pa.int32()),
                "raw_id": b["raw_id"],
            }
        )


def file_headers(raw: DataFrame) -> DataFrame:
    """One row a file: its header's names, their number and the places of the checked fields.

    A file delivered with several header lines keeps the one of the smallest ``raw_id``.
    """
    lines = raw.filter(F.col("line_no") == 0).select("raw_id", "source_id", "content_type", "raw_line")
    parsed = lines.mapInArrow(
        _headers, "source_id string, names array<string>, width int, number_at int, total_at int, raw_id bigint"
    )
    best = F.min_by(F.struct("names", "width", "number_at", "total_at"), "raw_id").alias("h")
    return parsed.groupBy("source_id").agg(best).select("source_id", "h.*")


def _record_reasons(with_fields: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            index = RecordIndex(b["raw_line"], _delims(b["content_type"]))
            width = b["width"].fill_null(-1).to_numpy(zero_copy_only=False)
            reason = np.full(b.num_rows, None, object)
            blank = _blank_lines(b["raw_line"])
            known = width >= 0  # a file without a header cannot be judged by count or value
            quoting = index.bad_quoting & ~blank
            count = ~quoting & ~blank & known & (index.n_fields != width)
            open_ = ~(quoting | blank | count) & known
            reason[quoting], reason[count] = "quoting", "column_count"
            for column, pattern, blank_is_fine in (
                ("number_at", NUMBER_PATTERN, False),
                ("total_at", TOTAL_PATTERN, True),
            ):
                place = b[column].fill_null(-1).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(open_ & (place >= 0))
                if len(rows):
                    reason[rows[_fails(index.field(rows, place[rows]), pattern, blank_is_fine)]] = "value"
            out = {"raw_id": b["raw_id"], "empty": pa.array(blank), "reason": pa.array(reason, pa.string())}
            if with_fields:
                good = np.flatnonzero((reason == None) & ~blank)  # noqa: E711
                place = np.full(b.num_rows, -1)
                place[good] = np.arange(len(good))
                out["fields"] = index.all_fields(good).take(pa.array(place, mask=place < 0))
            yield pa.record_batch(out)

    return run


def parse_records(raw: DataFrame, with_fields: bool = True) -> DataFrame:
    """Every body record of the delimited files in ``raw`` with its outcome.

    Returns ``raw_id, empty, reason[, fields]``: ``reason`` is NULL for good records, ``fields`` holds their unquoted
    values in header order.  Empty lines have ``empty`` true and no reason.  A NULL ``raw_line`` is an empty line; a
    record of a file without header is judged by its quoting alone; a NULL ``content_type`` means commas.  Repeated
    records are judged each on its own.  Headers are broadcast if their size is checked to be small, else the join
    shuffles by file, where adaptive execution splits files that hold a large share of the rows.
    """
    headers = file_headers(raw).drop("names")
    headers = checked_broadcast(headers, 120)
    body = raw.filter(F.coalesce(F.col("line_no"), F.lit(-1)) != 0).select("raw_id", "source_id", "content_type", "raw_line")
    joined = body.join(headers, "source_id", "left").select("raw_id", "content_type", "raw_line", "width", "number_at", "total_at")
    schema = "raw_id bigint, empty boolean, reason string" + (", fields array<string>" if with_fields else "")
    return joined.mapInArrow(_record_reasons(with_fields), schema)


def _grid_outcomes(with_fields: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grids = Grids(b["cells"])
            value = np.zeros(len(grids.width), bool)
            value[grids.cell_row[grids.bad_cells()]] = True
            count = ~grids.is_header & ~grids.right_width
            rows = np.flatnonzero(~grids.is_header if with_fields else count | value)
            reason = np.where(count, "column_count", np.where(value, "value", None)).astype(object)[rows]
            out = {
                "table_id": b["table_id"].take(pa.array(grids.row_grid[rows])),
                "row_index": pa.array(grids.row_index[rows], pa.int32()),
                "reason": pa.array(reason, pa.string()),
            }
            if with_fields:
                out["fields"] = b["cells"].flatten().take(pa.array(rows, mask=reason != None))  # noqa: E711
            yield pa.record_batch(out)

    return run


def grid_outcomes(tables: DataFrame) -> DataFrame:
    """Every body row of ``cells``: ``table_id, row_index, reason, fields``; ``fields`` holds a good row's cells.

    A grid is one row of the table, so all is decided where it is read, without a shuffle.  A NULL or empty grid has
    no rows; a NULL row has no cells and fails by its count; a column without any value takes anything.
    """
    return tables.select("table_id", "cells").mapInArrow(_grid_outcomes(True), "table_id bigint, row_index int, reason string, fields array<string>")


def grid_rejects(tables: DataFrame) -> DataFrame:
    """Body rows of ``cells`` that do not fit their header or their columns' types: ``table_id, row_index, reason``."""
    return tables.select("table_id", "cells").mapInArrow(_grid_outcomes(False), "table_id bigint, row_index int, reason string")


def invoice_outcomes(invoices: DataFrame) -> DataFrame:
    """Every row of ``invoices``: ``row_id, reason, fields``; a good row's are invoice_number, vendor and total."""
    number, total = py_strip(F.col("invoice_number")), py_strip(F.col("total"))
    good = F.coalesce(number.rlike(NUMBER_PATTERN), F.lit(False)) & F.coalesce((total == "") | total.rlike(TOTAL_PATTERN), F.lit(True))
    return invoices.select("row_id", F.when(~good, F.lit("value")).alias("reason"), F.when(good, F.array("invoice_number", "vendor", "total")).alias("fields"))


def invoice_rejects(invoices: DataFrame) -> DataFrame:
    """Rows of ``invoices`` whose invoice_number or total is no valid value: ``row_id, reason``."""
    return invoice_outcomes(invoices).filter("reason is not null").select("row_id", "reason")


def loaded_rows(invoices: DataFrame, raw: DataFrame, tables: DataFrame) -> DataFrame:
    """All good rows of the three inputs: ``origin, record_id, row_index, fields``, the values as they were read.

    With :func:`failing_rows` these are all rows but headers and empty lines.
    """
    shape = lambda df, origin, key, index: df.filter("reason is null").select(
        F.lit(origin).alias("origin"), F.col(key).alias("record_id"), index.cast("int").alias("row_index"), "fields"
    )
    return (
        shape(invoice_outcomes(invoices), "invoices", "row_id", F.lit(0))
        .unionByName(shape(parse_records(raw).filter("not empty"), "invoices_raw", "raw_id", F.lit(0)))
        .unionByName(shape(grid_outcomes(tables), "ir_tables", "table_id", F.col("row_index")))
    )


def failing_rows(invoices: DataFrame, raw: DataFrame, tables: DataFrame) -> DataFrame:
    """All failing rows of the three inputs: ``origin, record_id, row_index, reason``."""
    shape = lambda df, origin, key, index: df.select(
        F.lit(origin).alias("origin"), F.col(key).alias("record_id"), index.cast("int").alias("row_index"), "reason"
    )
    records = parse_records(raw, with_fields=False).filter(F.col("reason").isNotNull())
    return (
        shape(invoice_rejects(invoices), "invoices", "row_id", F.lit(0))
        .unionByName(shape(records, "invoices_raw", "raw_id", F.lit(0)))
        .unionByName(shape(grid_rejects(tables), "ir_tables", "table_id", F.col("row_index")))
    )
