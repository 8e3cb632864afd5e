"""Load profiles and schema drift on small tables with known answers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cellwright.operators import drift, quality


def loads(bad: dict[int, str], n: int = 400, count: int = 12):
    random.seed(5)
    vendors = [f"Vendor {chr(65 + i % 26)}{chr(97 + i % 7)} Ltd" for i in range(150)]
    rows = []
    for load in range(1, count + 1):
        for _ in range(n + load * 10):
            total, vendor = f"{random.lognormvariate(5, 1):.2f}", random.choice(vendors)
            kind = bad.get(load)
            if kind == "null" and random.random() < 0.4:
                total = None
            if kind == "scale":
                total = f"{float(total) * 100:.2f}"
            if kind == "upper":
                vendor = vendor.upper()
            if kind == "few":
                vendor = random.choice(vendors[:3])
            rows.append((load, total, vendor, "x"))
    return rows


SCHEMA = "load_id int, total string, vendor string, n string"


def test_departing_loads(spark):
    bad = {3: "null", 5: "scale", 8: "upper", 10: "few"}
    df = spark.createDataFrame(loads(bad), SCHEMA)
    got = {(r.load_id, r.column_name) for r in quality.departing_loads(df, "load_id", ["total", "vendor"], ("total",)).collect()}
    assert got == {(3, "total"), (5, "total"), (8, "vendor"), (10, "vendor")}


def test_clean_loads_and_empty(spark):
    df = spark.createDataFrame(loads({}), SCHEMA)
    assert quality.departing_loads(df, "load_id", ["total", "vendor"], ("total",)).count() == 0
    assert quality.departing_loads(df.filter("false"), "load_id", ["total", "vendor"], ("total",)).count() == 0
    two = df.filter("load_id < 3")
    assert quality.departing_loads(two, "load_id", ["total", "vendor"], ("total",)).count() == 0


def test_masks(spark):
    values = ["INV-1042", "Acme Corp", "ACME", None, "  ", "Éa 12", "x" * 100_000, "1,250.50"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(quality.mask(F.col("v"))).collect()] == ["AA-9", "Aa Aa", "AA", "(null)", "(blank)", "Aa 9", "a", "9,9.9"]


def test_profile(spark):
    df = spark.createDataFrame([(1, "5", "a", "x"), (1, None, "a", "x"), (1, " ", None, "x"), (None, "-2.5", "b", "x")], SCHEMA)
    rows = {(r.load_id, r.column_name): r for r in quality.load_profile(df, "load_id", ["total", "vendor"], ("total",)).collect()}
    one = rows[1, "total"]
    assert (one.n, one.nulls, one.blanks, one.numbers, one.least, one.most) == (3, 1, 1, 1, 5.0, 5.0)
    assert rows[None, "total"].least == -2.5


def test_violations(spark, tmp_path):
    from cellwright.queries.problems import QUERIES

    rows = [(k % 4, f"{k}.5", "Acme Corp") for k in range(4000)] + [(2, "12x", "Acme Corp"), (2, "34y", "Acme Corp"), (3, "1.5", "#?"), (None, "2.5", "Acme Corp")]
    spark.createDataFrame(rows, "load_id int, total string, vendor string").write.parquet(f"{tmp_path}/invoices.parquet")
    run = lambda q: QUERIES[q](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("p3_violations")} == {(2, "total", "9a", 2), (3, "vendor", "#?", 1)}
    assert {(r.column_name, r.mask) for r in run("p3_dominant")} == {("total", "9.9"), ("vendor", "Aa Aa")}
    got = {(r.load_id, r.column_name): r for r in run("p3_distribution")}
    assert abs(got[2, "total"].mask_rare_share - 2 / 1002) < 1e-12 and got[1, "total"].mask_rare_share == 0
    assert got[2, "total"].mask_divergence > got[1, "total"].mask_divergence and got[1, "vendor"]["distinct"] == 1
    assert got[None, "total"].n == 1 and got[None, "total"].mask_rare_share == 0


TABLES = "table_id bigint, feed string, file_no int, cells array<array<string>>, columns string"


def grid(header, kinds, n=8):
    make = {"int": lambda i: str(i + 1), "float": lambda i: f"{i}.5", "str": lambda i: f"word {chr(97 + i)}", "date": lambda i: f"2025-01-0{i + 1}"}
    return [header, *[[make[k](i) for k in kinds] for i in range(n)]]


def test_changes(spark):
    rows = [
        (1, "f", 1, grid(["Qty", "Price", "City"], ["int", "float", "str"]), ""),
        (2, "f", 2, grid(["qty ", "price", "town"], ["int", "float", "str"]), ""),  # renamed
        (9, "f", 2, grid(["qty ", "price", "town"], ["int", "float", "str"]), ""),  # again
        (3, "f", 3, grid(["QTY", "price", "town", "due"], ["int", "float", "str", "date"]), ""),  # added
        (4, "f", 4, grid(["town", "qty", "due"], ["str", "str", "date"]), ""),  # removed, retyped, order
        (5, "f", 6, grid(["x"], ["int"]), ""),  # nothing before it
        (6, None, 1, grid(["x"], ["int"]), ""),
        (7, "g", 1, None, ""),
        (8, "g", 2, [], ""),
    ]
    got = drift.schema_changes(drift.grid_schemas(spark.createDataFrame(rows, TABLES)))
    assert {tuple(r)[1:] for r in got.collect()} == {
        ("f", 2, "renamed", "city", "town"), ("f", 3, "added", "", "due"), ("f", 4, "removed", "price", ""), ("f", 4, "retyped", "qty", "qty"),
    }
    assert drift.schema_changes(drift.grid_schemas(spark.createDataFrame([], TABLES))).count() == 0


def test_names_that_stand_together_are_no_rename(spark):
    rows = [
        (1, "f", 1, grid(["qty", "net"], ["int", "float"]), ""), (2, "f", 2, grid(["qty", "tax"], ["int", "float"]), ""),
        (3, "g", 1, grid(["net", "tax"], ["float", "float"]), ""),
    ]
    got = drift.schema_changes(drift.grid_schemas(spark.createDataFrame(rows, TABLES)))
    assert {(r.change, r.old_name, r.new_name) for r in got.collect()} == {("removed", "net", ""), ("added", "", "tax")}


def test_declared(spark):
    rows = [(1, "f", 1, ["A b", "c"], {"A b": "int", "c": "str"}), (2, "f", 2, ["c", "a-b", None], {"c": "str", "a-b": "float"}), (3, "f", 3, None, None)]
    df = spark.createDataFrame(rows, "schema_id bigint, feed string, version_no int, columns array<string>, hints map<string,string>")
    got = {(r.seq_no, r.change, r.old_name, r.new_name) for r in drift.schema_changes(drift.declared_schemas(df)).collect()}
    assert got == {(2, "retyped", "a_b", "a_b"), (3, "removed", "c", ""), (3, "removed", "a_b", "")}


def test_union_table(spark):
    rows = [(1, "f", 1, [["qty", "due"], ["1,000", "2025-01-01"], ["x"]], ""), (2, "f", 2, [["QTY", "paid"], ["1.5", "Yes"]], "")]
    tables = spark.createDataFrame(rows, TABLES)
    got = {(r.file_no, r.row_index): r["values"] for r in drift.consistent_rows(tables).collect()}
    assert got == {(1, 1): {"qty": "1000.0", "due": "2025-01-01"}, (2, 1): {"qty": "1.5", "paid": "true"}}
    types = {r.name: r.type for r in drift.union_schema(drift.grid_schemas(tables)).collect()}
    assert types == {"qty": "float", "due": "date", "paid": "bool"}


def test_renamed_columns_are_one(spark):
    rows = [
        (1, "f", 1, grid(["qty", "city"], ["int", "str"]), ""),
        (2, "f", 2, [*grid(["qty", "town"], ["int", "str"]), ["many", "word z"]], ""),
        (3, "f", 3, grid(["qty", "place"], ["float", "str"]), ""),
        # a and c stand together, so a -> b -> c cannot be one column
        (4, "g", 1, grid(["qty", "a"], ["int", "str"]), ""), (5, "g", 2, grid(["qty", "b"], ["int", "str"]), ""),
        (6, "g", 3, grid(["qty", "c"], ["int", "str"]), ""), (7, "g", 5, grid(["a", "c"], ["str", "str"]), ""),
    ]
    tables = spark.createDataFrame(rows, TABLES)
    schema = {(r.feed, r.name): (r.type, r.first_seq, r.files) for r in drift.union_schema(drift.grid_schemas(tables)).collect()}
    assert {k: v for k, v in schema.items() if k[0] == "f"} == {("f", "qty"): ("float", 1, 3), ("f", "place"): ("str", 1, 3)}
    assert {n for f, n in schema if f == "g"} == {"qty", "b", "c"} or {n for f, n in schema if f == "g"} == {"qty", "a", "c"}
    got = {(r.feed, r.file_no, r.row_index): r for r in drift.consistent_rows(tables).collect()}
    assert all(set(r["values"]) == {"qty", "place"} for k, r in got.items() if k[0] == "f")
    assert set(got["g", 5, 1]["values"]) >= {"c"} and len(got["g", 5, 1]["values"]) == 2
    assert got["f", 1, 1]["values"] == {"qty": "1.0", "place": "word a"}
    assert got["f", 2, 9]["values"]["qty"] is None and got["f", 2, 9].misfits == {"qty": "many"} and got["f", 1, 1].misfits == {}
