"""Reject rows: the structural index against a plain state machine, and the cases that dirt brings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwright.operators import rejects

RAW = "raw_id bigint, source_id string, content_type string, line_no int, raw_line string, name string"


def machine(line: str, delimiter: str) -> list[str] | None:
    """RFC 4180 letter by letter; None where quoting is broken."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, text = i + 1, ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                text += line[i:j]
                if line[j + 1 : j + 2] == '"':
                    text, i = text + '"', j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != delimiter:
                return None
        else:
            j = line.find(delimiter, i)
            j = n if j < 0 else j
            text, i = line[i:j], j
            if '"' in text:
                return None
        fields.append(text)
        if i >= n:
            return fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='ab,\t"é ', max_size=14), min_size=1, max_size=6), st.sampled_from(",\t"))
def test_index_equals_state_machine(lines, delimiter):
    index = rejects.RecordIndex(pa.array(lines, pa.string()), np.full(len(lines), ord(delimiter)))
    for i, line in enumerate(lines):
        want = machine(line, delimiter)
        assert bool(index.bad_quoting[i]) == (want is None), line
        if want is not None:
            assert index.fields(i) == want


def test_line_breaks():
    lines = pa.array(['a,"b\nc"', "a,b\r\n", "a\nb,c", None, ""], pa.string())
    index = rejects.RecordIndex(lines, np.full(5, 44))
    assert index.bad_quoting.tolist() == [False, False, True, False, False]
    assert index.fields(1) == ["a", "b"]


def test_records(spark):
    rows = [
        (1, "f", "text/csv", 0, '"invoice_number","vendor","total"', "x"),
        (2, "f", "text/csv", 1, 'INV-1234,"A ""1"" B",1.5', "x"),
        (3, "f", "text/csv", 2, "INV-1234,A", "x"),
        (4, "f", "text/csv", 3, 'INV-1234,A "x" B,1', "x"),
        (5, "f", "text/csv", 4, "INV-12,A,1", "x"),
        (6, "f", "text/csv", 5, "INV-1234,A,", "x"),
        (7, "f", "text/csv", 6, "", "x"),
        (8, "f", "text/csv", 7, None, "x"),
        (9, "f", "text/csv", 5, "INV-1234,A,", "x"),
        (10, "none", None, 3, "anything", "x"),
        (11, "t", "text/tab-separated-values", 0, "total\tinvoice_number", "x"),
        (12, "t", "text/tab-separated-values", 1, "1,5\tINV-1234", "x"),
        (13, "f", "text/csv", None, "INV-1234,A," + "9" * 300_000, "x"),
    ]
    out = {r.raw_id: (r.reason, r.empty, r.fields) for r in rejects.parse_records(spark.createDataFrame(rows, RAW)).collect()}
    assert 1 not in out and 11 not in out
    assert out[2] == (None, False, ["INV-1234", 'A "1" B', "1.5"])
    assert [out[k][0] for k in (3, 4, 5, 12)] == ["column_count", "quoting", "value", "value"]
    assert out[6][0] is None and out[9] == out[6]
    assert out[7][1] and out[8][1] and out[7][0] is None
    assert out[10][0] is None
    assert out[13][0] is None
    assert rejects.parse_records(spark.createDataFrame([], RAW)).count() == 0


def test_invoices(spark):
    rows = [(1, " INV-1234 ", " 1,000.5 ", None), (2, None, "1", "v"), (3, "INV-1234", "abc", "v"), (4, "INV-1234", None, "v"), (5, "INV-1234", "  ", "v"), (6, "INV-12345678901", "1", "v"), (7, "INV-1234", "-.5", "v"), (8, "INV-1234", "1,00", "v")]
    df = spark.createDataFrame(rows, "row_id bigint, invoice_number string, total string, vendor string")
    assert {r.row_id for r in rejects.invoice_rejects(df).collect()} == {2, 3, 6, 8}
    assert rejects.invoice_rejects(df.filter("false")).count() == 0


def test_grids(spark):
    rows = [
        (1, [["a", "b"], ["1", "u"], ["2", "v"], ["z", "w"], ["3"], None, ["", None]]),
        (2, []),
        (3, None),
        (4, [["a"]]),
        (5, [["a"], ["1.5"], ["2"], ["2.5"], ["yes"]]),
    ]
    df = spark.createDataFrame(rows, "table_id bigint, cells array<array<string>>")
    out = {(r.table_id, r.row_index): r.reason for r in rejects.grid_rejects(df).collect()}
    assert out == {(1, 3): "value", (1, 4): "column_count", (1, 5): "column_count", (5, 4): "value"}


def test_loaded(spark, tmp_path):
    from cellwright.queries.problems import QUERIES

    invoices = [(1, " INV-1234 ", None, "1,5.0"), (2, "INV-1234", "v", None), (3, None, "v", "1"), (4, "INV-12345", " v", " 2 ")]
    raw = [(1, "f", "text/csv", 0, "invoice_number,total"), (2, "f", "text/csv", 1, 'INV-1234,"1,000"'), (3, "f", "text/csv", 2, "INV-1234"), (4, "f", "text/csv", 3, "")]
    grids = [(1, [["a", "b"], ["1", "u"], ["2", None], ["z", "w"], ["3"], None]), (2, None), (3, [["a"], ["x"]])]
    for name, rows, schema in (
        ("invoices", invoices, "row_id bigint, invoice_number string, vendor string, total string"),
        ("invoices_raw", raw, "raw_id bigint, source_id string, content_type string, line_no int, raw_line string"),
        ("ir_tables", grids, "table_id bigint, cells array<array<string>>"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    loaded = {(r.origin, r.record_id, r.row_index): r.fields for r in QUERIES["p1_loaded"](spark, str(tmp_path)).collect()}
    assert loaded == {
        ("invoices", 2, 0): '["INV-1234","v",null]', ("invoices", 4, 0): '["INV-12345"," v"," 2 "]', ("invoices_raw", 2, 0): '["INV-1234","1,000"]',
        ("ir_tables", 1, 1): '["1","u"]', ("ir_tables", 1, 2): '["2",null]', ("ir_tables", 3, 1): '["x"]',
    }
    failed = {(r.origin, r.record_id, r.row_index) for r in QUERIES["p1_found"](spark, str(tmp_path)).collect()}
    assert failed == {("invoices", 1, 0), ("invoices", 3, 0), ("invoices_raw", 3, 0), *(("ir_tables", 1, i) for i in (3, 4, 5))}


def test_record_ends_of_whole_files(spark):
    body = b'\xef\xbb\xbfinvoice_number,vendor,total\r\nINV-1001,"A ""B""\nC",5\n\nINV-1002,"open,7\nINV-1003,x,8\rINV-1004,y,9'
    files = spark.createDataFrame([("f", "text/csv", body), ("none", "text/csv", None), ("empty", "text/csv", b"")], "source_id string, content_type string, content binary")
    rows = {r.line_no: r.raw_line for r in rejects.file_records(files).collect()}
    assert rows == {0: "invoice_number,vendor,total", 1: 'INV-1001,"A ""B""\nC",5', 2: "", 3: 'INV-1002,"open,7', 4: "INV-1003,x,8", 5: "INV-1004,y,9"}
    raw = rejects.file_records(files).withColumn("raw_id", rejects.F.col("line_no").cast("bigint"))
    got = {r.raw_id: (r.reason, r.fields) for r in rejects.parse_records(raw).filter("not empty").collect()}
    assert got == {1: (None, ["INV-1001", 'A "B"\nC', "5"]), 3: ("quoting", None), 4: (None, ["INV-1003", "x", "8"]), 5: (None, ["INV-1004", "y", "9"])}


def test_fields_cost_no_copy_of_the_batch():
    import time

    import numpy as np
    import pyarrow as pa

    lines = pa.array([f"INV-{i:06d},vendor {i},{i}.50" for i in range(40_000)])
    began = time.perf_counter()
    index = rejects.RecordIndex(lines, np.full(len(lines), 44))
    assert index.all_fields(np.arange(len(lines)))[39_999].as_py() == ["INV-039999", "vendor 39999", "39999.50"]
    assert time.perf_counter() - began < 5
