"""Operators of the document-to-table pipeline."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwright.functions import coerce, infer, similarity
from cellwright.functions.redact import redact
from cellwright.functions.text import py_str
from cellwright.operators import dedup, extract, geometry, ground, lineage, profile, review, transforms
from cellwright.sinks import export


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_cell_types(spark):
    values = ["42", "1,250", "3.14", "1,250.50", "2026-06-04", "true", "Y", "Acme Corp", "", None, "1234,567", "5.", "1e3", "1", " 7 ", "6/4/26"]
    assert column(spark, values, infer.cell_type) == ["int", "int", "float", "float", "date", "bool", "bool", "str", "str", "str", "float", "str", "str", "int", "int", "date"]
    df = spark.createDataFrame([("1", "1", "x", None), ("2.5", "", "1", None)], "a string, b string, c string, d string")
    assert infer.column_types(df) == {"a": "float", "b": "int", "c": "str", "d": "str"}


def test_coercion(spark):
    assert column(spark, ["1,250", "1.9", "1e2", "x", None, "9" * 30, "12d", "1_0"], coerce.coerce_int) == [1250, 1, 100, None, None, None, None, None]
    assert column(spark, ["1,250.50", "12d", ".5", ""], coerce.coerce_float) == [1250.5, None, 0.5, None]
    assert column(spark, ["Yes", "0", "maybe"], coerce.coerce_bool) == [True, False, None]
    df = spark.createDataFrame([("1", " a "), ("not-a-number", "b"), (None, "c")], "n string, s string")
    rows = coerce.clean(df, {"n": "int", "s": "str"}).collect()
    assert [r._flagged for r in rows] == [False, True, False]
    assert rows[1]._errors == ["cannot coerce column 'n' value 'not-a-number'"] and rows[0]._changed == ["s"]


def test_rendering(spark):
    values = [10000000.0, 12345678.9, 0.0001, 1.5, 250.0]
    assert column(spark, values, lambda c: py_str(c, "double"), "double") == ["10000000.0", "12345678.9", "0.0001", "1.5", "250.0"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_similarity():
    random.seed(1)
    for _ in range(300):
        a, b = ("".join(random.choices("abc ", k=random.randint(0, 9))) for _ in "ab")
        assert similarity.lcs_length(a, b) == lcs(a, b)
        short, long = sorted((a, b), key=len)
        if short:
            windows = [long[i:j] for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i == len(short) or (i == 0 or j == len(long)) and j - i < len(short)]
            best = max((200 * lcs(short, w) / (len(short) + len(w)) for w in windows), default=0)
            assert abs(similarity.partial_ratio(a, b) - best) < 1e-9
    assert similarity.token_set_ratio("acme corp", "acme corp nyc") == 100
    assert similarity.support("Acme Corp", "Vendor: Acme Corp, total 250") == 1
    assert similarity.support("Totally Different Inc", "Vendor: Acme Corp, total 250") < 0.7
    assert similarity.support("", "x") == 0 and similarity.support("", "") == 1


def elements(spark, rows):
    return spark.createDataFrame(rows, "source_id string, elem_idx int, kind string, text string, grid array<array<string>>, location struct<source_id:string,index:int,char_span:struct<start:bigint,end:bigint>,note:string>")


def test_extract(spark):
    loc = ("s", 0, None, "csv table")
    e = elements(spark, [("s", 0, "paragraph", "x", None, loc), ("s", 1, "table", None, [[" name ", "amount"], ["Acme", " 100 "], ["Globex"], ["a", "b", "c"]], loc), ("s", 2, "table", None, [["other"], ["1"]], loc), ("t", 0, "paragraph", " text ", None, ("t", 3, None, None)), ("t", 1, "paragraph", None, None, None)])
    rows = extract.extract_table(e).orderBy("_ord").collect()
    assert [(r.name, r.amount) for r in rows] == [("Acme", "100"), ("Globex", None), ("a", "b")]
    assert rows[0]._lineage.cells["name"].locations[0].source_id == "s"
    assert [(r.element, r.text, r.location) for r in extract.elements_fallback(e).collect()] == [("paragraph", "text", "index 3")]
    hint = extract.extract_table(e, ["x"]).collect()
    assert [r.x for r in hint] == ["Acme", "Globex", "a"]
    assert extract.extract_table(e.filter("false")).count() == 0
    good, failed = extract.strict_validate(spark.createDataFrame([("s", 1, "1"), ("s", 2, "x"), ("t", 1, "2")], "source_id string, _ord int, amount string"), {"amount": "int"})
    assert [r.source_id for r in good.collect()] == ["t"] and failed.first().reason == "row 2: amount"


def test_ground(spark):
    e = elements(spark, [("s", 0, "paragraph", "Vendor: Acme Corp", None, None), ("s", 1, "table", None, [["total", "250"]], None)])
    texts = ground.source_text(e)
    assert texts.first().source_text == "Vendor: Acme Corp\ntotal 250"
    rows = spark.createDataFrame([("s", "Acme Corp"), ("s", "Totally Different Inc"), ("s", None), ("none", "x")], "source_id string, v string")
    scored = ground.score_cells(rows, texts, {"v": F.col("v")})
    assert [round(r._score_v, 1) for r in scored.orderBy(F.desc("_score_v")).collect()][0] == 1.0
    assert ground.flag_ungrounded(scored, ["v"], reject=True).count() == 1


def test_aligned_claims(spark, tmp_path):
    from cellwright.queries.core import QUERIES

    random.seed(2)
    texts = {f"s{k}": [" ".join("".join(random.choices("abcde", k=4)) for _ in range(12)) for _ in range(3)] for k in range(3)}
    lines = [(s, i, "paragraph", t) for s, all_ in texts.items() for i, t in enumerate(all_)]
    at = "array<struct<source_id:string,index:int,note:string>>"
    spark.createDataFrame([(s, i, k, t, None) for s, i, k, t in lines], "source_id string, elem_idx int, kind string, text string, location string").write.parquet(f"{tmp_path}/ir_elements.parquet")
    whole = {s: "\n".join(t) for s, t in texts.items()}
    values = [(s, whole[s][k : k + 6] + x + whole[s][k + 7 : k + 15]) for s in whole for k in (3, 40) for x in "bX"] + [("s0", "zzzz qqqq"), ("s1", None), ("none", "abcd"), ("s2", "X" * 70)]
    claims = [(i, v, [(s, 0, None)]) for i, (s, v) in enumerate(values)] + [(99, "abcd", None)]
    spark.createDataFrame(claims, f"feedback_id bigint, original_value string, locations {at}").write.parquet(f"{tmp_path}/feedback_records.parquet")

    def best(v, s):
        if not v or not s:
            return float(v == s)
        n = len(v)
        windows = [s[max(0, e - n) : e] for e in range(1, len(s) + n)]
        part = max(200 * lcs(v, w) / (n + len(w)) for w in windows)
        x, y = set(v.split()), set(s.split())
        both, one, two = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
        one, two = f"{both} {one}".strip(), f"{both} {two}".strip()
        sets = [(one, two)] + ([(both, one), (both, two)] if both else [])
        return max(part, *(200 * lcs(p, q) / (len(p) + len(q)) for p, q in sets)) / 100

    want = {i: best(v or "", whole.get(at[0][0], "") if at else "") for i, v, at in claims}
    got = {r.feedback_id: r for r in QUERIES["ground_flag_aligned"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i].score - x) < 1e-9 and got[i].flagged == (x < 0.7) for i, x in want.items())
    kept = {i for i, x in want.items() if x >= 0.7}
    assert any(want[i] < 1 for i in kept)
    assert {r.feedback_id for r in QUERIES["ground_reject_aligned"](spark, str(tmp_path)).collect()} == kept
    assert QUERIES["corpus_summary_aligned"](spark, str(tmp_path)).first().rows_flagged == len(want) - len(kept)


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "a", None, "y"), (3, None, None, "z"), (4, None, None, "w")], "_ord int, k string, j string, v string")
    assert {r._ord for r in dedup.deduplicate(df, ["k", "j", "none"]).collect()} == {1, 3}
    assert dedup.deduplicate(df, ["none"]).count() == 4 and dedup.deduplicate(df).count() == 4
    names = ["acme corp", "acme corp nyc", "globex", "globex inc", "initech", "", None, "acme"]
    fuzzy = dedup.fuzzy_clusters(spark.createDataFrame(list(enumerate(names)), "_ord int, name string"), ["name"])
    clusters: list[tuple[int, str]] = []
    want = {}
    for i, n in enumerate(names):
        key = "none" if n is None else n
        lead = next((j for j, k in clusters if k and key and similarity.token_set_ratio(k, key) >= 92), None)
        if lead is None:
            clusters.append((i, key))
        want[i] = i if lead is None else lead
    assert {r._ord: r.leader for r in fuzzy.collect()} == want


def test_merge_and_lineage(spark):
    df = spark.createDataFrame([(1, "c", "a", 0.8), (2, "c", "long", 0.6), (3, "d", "x", None)], "_ord int, cl string, v string, f double")
    rows = df.withColumn("_lineage", lineage.lineage(F.create_map(F.lit("v"), lineage.cell(F.array(F.struct(F.col("_ord").cast("string").alias("source_id"), F.lit(0).alias("index"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("char_span"), F.lit(None).cast("string").alias("note"))), F.col("f")))))
    first = {r.cl: r for r in lineage.merge_rows(rows, "cl", "_ord", ["v"]).collect()}
    assert first["c"].v == "a" and first["c"]._size == 2
    cell = first["c"]._lineage.cells["v"]
    assert cell.faithfulness == 0.6 and [x.source_id for x in cell.locations] == ["1", "2"]
    assert {r.v for r in lineage.merge_rows(rows, "cl", "_ord", ["v"], "longest").collect()} == {"long", "x"}
    with pytest.raises(ValueError):
        lineage.merge_rows(rows, "cl", "_ord", ["v"], "other")
    renamed = transforms.column_mapper(rows, {"v": "w", "_ord": "q", "no": "x"})
    assert list(renamed.first()._lineage.cells) == ["w"] and "_ord" in renamed.columns
    assert lineage.conformance_violations(rows, "_ord", ["v"]).filter("rows > 0").count() == 0
    assert lineage.conformance_violations(transforms.drop_flagged(lineage.mark_broken(df, ["v"])), "_ord", ["v"]).first().rows == 0
    broken = lineage.mark_broken(df, ["v"])
    assert lineage.resolve_terminal(broken, "_ord").filter("broken").count() == 3
    mapped = lineage.compose_map(rows, "v", F.upper("v"), "upper").first()
    assert mapped._regrounding == ["v"] and mapped._edges[0].op == "map"
    assert json_keys(export.emit(rows).first()._lineage) == {"_row_flagged", "v"}


def json_keys(text):
    import json

    return set(json.loads(text))


def test_origins(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("b", "a2"), ("x", "y"), ("y", "x"), ("q", None)], "cell string, parent string")
    cells = spark.createDataFrame([("c",), ("x",), ("alone",)], "cell string")
    got = {(r.cell, r.origin) for r in lineage.resolve_origins(edges, cells).collect()}
    assert got == {("c", "a"), ("c", "a2"), ("alone", "alone")}


def test_transforms(spark):
    df = spark.createDataFrame([("  A  b ", 1), (None, 2)], "s string, n int")
    assert transforms.normalizer(df).first().s == "a b" and transforms.data_cleaner(df).first().s == "A  b"
    assert column(spark, ["mail a.b@c.de", "123-45-6789", "call 555 123 4567", None], redact) == ["mail [EMAIL]", "[SSN]", "call [PHONE]", None]
    v = spark.createDataFrame([(1,)] * 4 + [(1000,), (None,)], "v int")
    assert [r.v for r in transforms.anomalies(v).filter("_anomaly").collect()] == [1000]
    assert transforms.anomalies(v.filter("false")).count() == 0
    assert transforms.any_to_markdown(spark.createDataFrame([("x|y", None)], "a string, b string")).first()[0] == "| x\\|y |  |"
    assert transforms.any_to_csv(spark.createDataFrame([('a"b', "c,d")], "a string, b string")).first()[0] == '"a""b","c,d"'


def test_exact_median(spark):
    import statistics

    random.seed(8)
    for values in ([random.gauss(0, 1) for _ in range(3001)], [random.choice([1.0, 2.0, 3.0]) for _ in range(2000)], [1.0, 2.0], [5.0], [random.random() if i % 3 else 0.5 for i in range(3000)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for most in (10, 100_000):
            assert profile.exact_median(df, F.col("v"), most) == pytest.approx(statistics.median(values))
    assert profile.exact_median(df.filter("false"), F.col("v")) is None


def test_profiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 5, 10)], "v double")
    assert [r["count"] for r in profile.histogram(df, "v").orderBy("bin").collect()] == [2, 1, 0, 0, 1, 0, 0, 0, 0, 1]
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [tuple(r) for r in profile.histogram(same, "v").collect()] == [(1, 3.0, 3.0, 2)]
    assert profile.histogram(df.filter("false"), "v").count() == 0
    p = {r.column: r for r in profile.column_profiles(spark.createDataFrame([("1", "a"), ("2", None), ("3", "a"), ("x", "b"), ("5", "c")], "n string, s string"), ["n", "s"]).collect()}
    assert p["n"].kind == "numeric" and p["n"].mean == 2.75 and p["s"].fill_rate == 0.8 and p["s"].unique == 3
    assert [tuple(r) for r in profile.top_values(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string"), "s").collect()] == [("b", 2), ("a", 1)]


def test_review(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", None)], "row_id int, v string, f boolean")
    assert [r.row_id for r in review.review_queue(rows, "f").collect()] == [1]
    fixes = spark.createDataFrame([(1, "v", "x", 1), (1, "v", "y", 2), (9, "v", "z", 1), (2, "w", "q", 1)], "row_id int, column string, corrected_value string, recorded_at int")
    fixed, feedback = review.review_apply(rows, fixes, ["v"])
    assert {(r.row_id, r.v) for r in fixed.collect()} == {(1, "y"), (2, "b"), (3, "c")}
    assert review.prompt_lines(feedback).first().line == "- column 'v': prefer 'y' over 'a'"


def test_geometry(spark):
    words = [{"text": f"w{i}", "x0": 50.0 if i % 2 else 320.0, "x1": 250.0 if i % 2 else 550.0, "top": (i // 2) * 12.0, "bottom": (i // 2) * 12.0 + 10, "page_width": 600.0, "page_id": 1} for i in range(80)]
    boxes = lambda rows: geometry.Boxes.of(pd.DataFrame(rows))
    left, right = geometry.flows(boxes(words), 600.0)
    assert [words[i]["text"] for i in left] == [f"w{i}" for i in range(1, 80, 2)] and len(right) == 40
    assert [len(f) for f in geometry.flows(boxes(words[:20]), 600.0)] == [20]
    # a line across the page, between two parts in columns, stays in its place and takes its whole line with it
    many = words + [w | {"top": w["top"] + 480, "bottom": w["bottom"] + 480} for w in words[:40]]
    title = [w | {"text": "title", "x0": 100.0, "x1": 500.0} if i == 40 else w for i, w in enumerate(many)]
    assert [len(f) for f in geometry.flows(boxes(title), 600.0)] == [20, 20, 2, 39, 39]
    gap = [w | {"top": w["top"] + 30 * (i >= 20), "bottom": w["bottom"] + 30 * (i >= 20)} for i, w in enumerate(words[:40])]
    page = boxes(gap)
    assert [len(p) for p in geometry.paragraphs(page, geometry.flows(page, 600.0)[0])] == [20, 20]
    # words whose tops differ by little are one line, in the order of their places
    slanted = boxes([{"x0": x, "x1": x + 5, "top": t, "bottom": t + 10} for x, t in ((40.0, 10.0), (20.0, 12.5), (0.0, 11.0), (0.0, 30.0))])
    assert geometry.paragraphs(slanted, geometry.flows(slanted, 600.0)[0])[0].tolist() == [2, 1, 0]
    out = geometry.page_paragraphs(spark.createDataFrame(words)).orderBy("para").collect()
    assert len(out) == 2 and out[0].x1 == 250.0
    glyphs = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, 30.0), (2, None)], "page_id int, height double")
    assert {r.page_id: round(r.tolerance, 2) for r in geometry.word_tolerance(glyphs, ["page_id"]).collect()} == {1: 1.8, 2: 1.5}


def test_exports(spark, tmp_path):
    assert export.export_format("x.pq") == "parquet" and export.export_format("x") == "csv" and export.export_format("x.csv", " JSON ") == "json"
    with pytest.raises(ValueError):
        export.export_format("x", "xls")
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    for kind in export.FORMATS:
        export.write_export(df, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "markdown")).collect())
    assert "| name | n |" in text and "| a\\|b | 1 |" in text
    assert [r.n for r in export.as_text(df).collect()] == ["1", "2"]


def test_deep_lineage(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("c3", "x"), ("x", "y"), ("loop", "pool"), ("pool", "loop"), ("c70", "loop"), ("c0", None)]
    edges = spark.createDataFrame(chain, "cell string, parent string")
    cells = spark.createDataFrame([("c0",), ("c140",), ("loop",), ("alone",), (None,)], "cell string")
    got = {(r.cell, r.origin) for r in lineage.resolve_origins(edges, cells).collect()}
    assert got == {("c0", "c150"), ("c0", "y"), ("c140", "c150"), ("alone", "alone")}


def test_long_chain_of_near_rows(spark):
    # each row is near the one before it only, so which rows lead is known row after row
    base = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "".join(chr(0x4E00 + j) if j < 3 * i else c for j, c in enumerate(base * 6))) for i in range(60)]
    got = {r["_ord"]: r.leader for r in dedup.fuzzy_clusters(spark.createDataFrame(rows, "_ord int, s string"), ["s"]).collect()}
    want, leaders = {}, []
    for i, s in rows:
        want[i] = next((k for k, x in leaders if similarity.token_set_ratio(x, s) >= 92), i)
        leaders += [(i, s)] if want[i] == i else []
    assert got == want and len(leaders) > 3
    assert dedup.fuzzy_clusters(spark.createDataFrame(rows[:1], "_ord int, s string").filter("false"), ["s"]).count() == 0


def test_median_by_halving(spark, monkeypatch):
    values = [float(x) for x in (1, 1, 2, 3, 5, 8, 13, 21, 34, 55, -7, 1e300, -1e300, 4, 4)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    monkeypatch.setattr(profile.F, "percentile_approx", lambda *a: profile.F.array(profile.F.lit(1e9), profile.F.lit(-1e9)))
    for most in (1, 2, 5):
        assert profile.exact_median(df, profile.F.col("v"), most) == 4.0
    assert profile.exact_median(df.filter("v > 3.5 and v < 9"), profile.F.col("v"), 1) == 4.5


def _leaders(names: list[str], threshold: float) -> dict[int, int]:
    want, leaders = {}, []
    for i, s in enumerate(names):
        want[i] = next((k for k, x in leaders if similarity.token_set_ratio(x, s.lower()) >= threshold * 100), i) if s else i
        leaders += [(i, s.lower())] if want[i] == i else []
    return want


def _clusters(spark, names: list[str], threshold: float = dedup.THRESHOLD) -> dict[int, int]:
    return {r["_ord"]: r.leader for r in dedup.fuzzy_clusters(spark.createDataFrame(list(enumerate(names)), "_ord int, s string"), ["s"], threshold=threshold).collect()}


def _counted(spark, monkeypatch):
    """Pairs whose similarity is judged are counted."""
    seen, judge = spark.sparkContext.accumulator(0), similarity.token_set_ratio

    @F.pandas_udf("double")
    def counting(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return pd.Series([judge(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    monkeypatch.setattr(dedup, "token_set", counting)
    return seen


@pytest.mark.parametrize("threshold", [0.92, 0.8, 0.5])
def test_fuzzy_clusters_against_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(dedup, "ONE_PASS", 20)
    pick = random.Random(round(threshold * 100))
    stems = ["".join(pick.choice(["ka", "lo", "mi", "ter", "son", "x"]) for _ in range(pick.randint(1, 4))) for _ in range(20)] + ["ltd", "a", "-", "furniture"]
    names = []
    for _ in range(250):
        s = " ".join(pick.choice(stems) for _ in range(pick.randint(0, 5)))
        for _ in range(pick.randint(0, 3)):
            i = pick.randint(0, len(s))
            s = s[:i] + pick.choice(["", "a", "k", "O", " ", "\t", " "]) + s[i + pick.randint(0, 1) :]
        names.append(s)
    names += ["".join("z" if (7 * j + k) % 29 == 0 else "abcdef "[j * j % 7] for j in range(150)) for k in range(12)]
    got = _clusters(spark, names, threshold)
    assert got == _leaders(names, threshold) and 1 < len(set(got.values())) < len(names)


def test_fuzzy_clusters_of_names_with_common_words(spark, monkeypatch):
    # every name has a frequent word, which must not make pairs of all names, and a near name
    seen = _counted(spark, monkeypatch)
    pick = random.Random(5)
    firms = ["".join(pick.choice("abdefgiklmnoprstuvz") for _ in range(11)) for _ in range(300)]
    names = [f"{x} {pick.choice(['furniture', 'lighting'])} ltd" for x in firms]
    names += [f"{n.split()[1]} {n[:5]}q{n[5:11]} ltd" for n in names]
    got = _clusters(spark, names)
    assert got == {i: i % 300 for i in range(600)} and seen.value < 3000


def test_chain_of_near_rows_takes_few_jobs(spark):
    base = "abcdefghijklmnopqrstuvwxyz0123456789"
    names = ["".join(chr(0x4E00 + j) if j < 3 * i else c for j, c in enumerate(base * 6)) for i in range(60)]
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = _clusters(spark, names)
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == _leaders(names, dedup.THRESHOLD) and 0 < jobs < 60


def test_fuzzy_clusters_of_random_labels(spark, monkeypatch):
    # labels without common words share many letter trigrams by chance
    seen = _counted(spark, monkeypatch)
    pick = random.Random(9)
    labels = [" ".join("".join(pick.choice("0123456789abcdef") for _ in range(12)) for _ in range(2)) for _ in range(1500)]
    again = [" ".join(reversed(x.split())) if i % 3 == 0 else f"{x} spare" if i % 3 == 1 else x[:5] + x[6:] for i, x in enumerate(labels)]
    assert _clusters(spark, labels + again) == {i: i % 1500 for i in range(3000)} and seen.value < 3000
