"""Pipeline files, plans, execution, registry, streaming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellwright.plans import catalog, executor, model, planner, store
from cellwright.plans.errors import BackendError, ConfigError, ConformanceError, CredentialError, CycleError, ImageError, PlanError, TypeMismatch
from cellwright.plans.plugins import PluginRegistry
from cellwright.streaming import ingest


def plan(stages, manifests=None, strict=True):
    return planner.make_plan(stages, manifests or {s.id: model.Manifest(s.image, accepts=[model.ArtifactType()] if s.needs else []) for s in stages}, strict)


S = model.Stage


def test_waves_and_errors():
    p = plan([S("a", "x"), S("c", "x", ["a"]), S("b", "x", ["a"]), S("d", "x", ["b", "c"])])
    assert p.waves == [["a"], ["b", "c"], ["d"]] and p.terminal == "d"
    with pytest.raises(CycleError):
        plan([S("a", "x", ["b"]), S("b", "x", ["a"])])
    with pytest.raises(PlanError):
        plan([S("a", "x"), S("a", "x")])
    with pytest.raises(PlanError):
        plan([S("a", "x", ["z"])])
    with pytest.raises(PlanError):
        plan([S("a", "x"), S("b", "x")])
    kinds = {"a": model.Manifest("a", emits=model.ArtifactType("ir")), "b": model.Manifest("b", accepts=[model.ArtifactType()])}
    with pytest.raises(TypeMismatch):
        plan([S("a", "a"), S("b", "b", ["a"])], kinds)
    minor = {"a": model.Manifest("a", emits=model.ArtifactType("table", 1, 2)), "b": model.Manifest("b", accepts=[model.ArtifactType()])}
    assert plan([S("a", "a"), S("b", "b", ["a"])], minor).warnings
    lax = {"a": model.Manifest("a", conformant=False)}
    with pytest.raises(ConformanceError):
        plan([S("a", "a")], lax)
    plan([S("a", "a")], lax, strict=False)


def test_files(tmp_path):
    p = model.read_pipeline("image: document-extractor\nsource: {type: files, path: x}\nexpose: 9000\nllm: {model: openai/x, api_key: '${KEY}'}")
    assert p.all_stages()[0].id == "main" and p.expose.port == 9000
    for bad, error in (("[]", ConfigError), ("image: a", ConfigError), ("source: {type: files}", ConfigError), ("image: a\nsource: {type: files}\nmode: loose", ConfigError), ("image: a\nsource: {type: files}\nllm: {key: sk-abcdefghijk}", CredentialError), ("image: a\nsource: {type: f}\nllm: {grounding_threshold: 2}", ConfigError), ("a: [", ConfigError)):
        with pytest.raises(error):
            model.read_pipeline(bad)
    with pytest.raises(ConfigError):
        model.load_pipeline(str(tmp_path / "none"))
    assert model.ignore_secrets(tmp_path) and not model.ignore_secrets(tmp_path)
    assert model.credential("openai", {"OPENAI_API_KEY": "env"}, "OPENAI_API_KEY=file") == "file"
    assert model.ArtifactType.parse("table/v1.2") == model.ArtifactType("table", 1, 2)


CSV = "invoice_number,vendor,total\nINV-1001,Acme Corp,250.00\nINV-1002,Globex,1300.50\nINV-1003,Initech,42.00\n"


def test_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(CSV)
    (tmp_path / "in" / "b.png").write_bytes(b"x")
    text = f"""
source: {{type: files, path: "{tmp_path}/in"}}
pipeline:
  - {{id: read, image: "document-extractor:1"}}
  - {{id: clean, image: normalizer, needs: [read], config: {{columns: [vendor]}}}}
  - {{id: name, image: column-mapper, needs: [clean], config: {{rename: {{vendor: supplier}}}}}}
  - {{id: out, image: any-to-json, needs: [name]}}
export: {{path: "{tmp_path}/out"}}
"""
    events = []
    result = executor.execute(spark, model.read_pipeline(text), sink=events.append)
    rows = {r.invoice_number: r for r in result.frame.collect()}
    assert rows["INV-1002"].total == 1300.5 and rows["INV-1001"].supplier == "acme corp"
    assert rows["INV-1001"]._lineage.cells["supplier"].locations[0].source_id.endswith("a.csv")
    assert spark.read.json(f"{tmp_path}/out").count() == 3
    outcomes = {r.source_id[-5:]: r.error for r in result.notes["read"]["outcomes"].collect()}
    assert outcomes["a.csv"] is None and outcomes["b.png"]
    assert [e.state for e in events][:2] == ["started", "completed"]
    payload = executor.result_payload(result.frame)
    assert payload["columns"] == ["invoice_number", "supplier", "total"] and len(payload["rows"]) == 3
    with pytest.raises(BackendError):
        executor.execute(spark, model.read_pipeline(text), backend="docker")


def test_text_source_and_modes(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\n\ntwo")
    src = f'source: {{type: files, path: "{tmp_path}/t.txt"}}\n'
    assert {r.text for r in executor.execute(spark, model.read_pipeline(src + "image: report-extractor")).frame.collect()} == {"one", "two"}
    lax = src + "mode: permissive\npipeline:\n  - {id: a, image: doc-to-tables}\n  - {id: b, image: lineage-stripper, needs: [a]}"
    assert executor.execute(spark, model.read_pipeline(lax)).frame.first()._lineage.lineage_broken
    with pytest.raises(ConformanceError):
        executor.execute(spark, model.read_pipeline(lax.replace("permissive", "strict")))
    with pytest.raises(ImageError):
        catalog.resolve_image("none:1")
    assert catalog.certify(catalog.resolve_image("data-cleaner").run, spark) and not catalog.certify(catalog.resolve_image("lineage-stripper").run, spark)
    assert len(catalog.IMAGES) >= 16


def outcomes(result, stage="main"):
    return {r.source_id.rpartition("/")[2]: r.error for r in result.notes[stage]["outcomes"].collect()}


def test_sources_of_both_kinds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("text,total\nx,1\n")
    (tmp_path / "in" / "b.txt").write_text("one\n\ntwo")
    (tmp_path / "in" / "c.txt").write_text("  ")
    result = executor.execute(spark, model.read_pipeline(f'source: {{type: files, path: "{tmp_path}/in"}}\nimage: document-extractor'))
    rows = sorted((r.source_id[-5:], r.text, r.total, r.element) for r in result.frame.collect())
    assert rows == [("a.csv", "x", 1, None), ("b.txt", "one", None, "paragraph"), ("b.txt", "two", None, "paragraph")]
    found = outcomes(result)
    assert found["a.csv"] is None and found["b.txt"] is None and found["c.txt"]
    assert [n.phase for n in result.notices] == ["availability"]


def test_strict_dedup_and_mapper(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("vendor,total\nAcme Corp,1\nacme corp,1\nInitech,2\n,3\n")
    (tmp_path / "in" / "b.csv").write_text("vendor,total\nGlobex,x\nFine,2\n")
    src = f'source: {{type: files, path: "{tmp_path}/in"}}\nimage: document-extractor\n'
    strict = executor.execute(spark, model.read_pipeline(src + "schema_mode: strict\ncolumns: {vendor: str, total: int}"))
    assert {r.source_id[-5:] for r in strict.frame.collect()} == {"a.csv"} and outcomes(strict)["b.csv"] == "row 1: total"
    once = executor.execute(spark, model.read_pipeline(src + "dedup: {keys: [vendor]}"))
    rows = {r.vendor: r for r in once.frame.collect()}
    assert sorted(rows) == ["", "Acme Corp", "Fine", "Globex", "Initech"] and len(rows["Acme Corp"]._lineage.cells["vendor"].locations) == 2

    def propose(row):
        if row["total"] == "2":
            raise ValueError("no")
        return {"vendor": row["vendor"] or "Found Ltd", "total": "9" if row["total"] == "x" else row["total"]}

    filled = executor.execute(spark, model.read_pipeline(src), mapper=propose)
    got = {(r.vendor, r.total): r._lineage.row_flagged for r in filled.frame.collect()}
    assert ("Found Ltd", "3") in got and got["Globex", "x"] and ("Initech", "2") in got
    assert filled.notes["main"]["mapping_errors"].count() == 2 and filled.notices[0].phase == "consent"
    with pytest.raises(ConfigError):
        model.read_pipeline(src + "schema_mode: strict")
    with pytest.raises(ConfigError):
        model.read_pipeline(src + "llm: {retry_limit: -1}")


def test_mapping_and_providers(spark):
    from cellwright.operators import mapping
    from cellwright.plans.providers import Providers

    tries = []
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "k int, x string, error int").select("k", "x")
    p = Providers(own=lambda model, prompt: '{"x": "' + model + '"}' if '"a"' in prompt else "no json")
    got = {r.k: (r.x, r.error) for r in mapping.map_fields(rows, "k", ["x"], p.mapper("own/m1", ["x"])).collect()}
    assert got[1] == ("m1", None) and got[2][0] is None and got[2][1]
    assert mapping.map_fields(rows.filter("false"), "k", ["x"], dict).count() == 0
    for bad in ("own", "other/m"):
        with pytest.raises(ConfigError):
            p.resolve(bad)
    del tries


def test_api_source_and_page(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.request import urlopen

    from cellwright.plans import serve

    body = json.dumps({"data": {"items": [{"a": 1, "b": "x"}, "no object", {"a": 2}]}}).encode()

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    api = ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=api.serve_forever, daemon=True).start()
    src = f'source: {{type: api, uri: "http://127.0.0.1:{api.server_port}/", records_path: PATH}}\nimage: document-extractor'
    result = executor.execute(spark, model.read_pipeline(src.replace("PATH", "data.items")))
    assert sorted((r.a, r.b) for r in result.frame.collect()) == [(1, "x"), (2, "")]
    assert "no records" in next(iter(outcomes(executor.execute(spark, model.read_pipeline(src.replace("PATH", "other")))).values()))
    api.shutdown()
    server = serve.make_server(executor.result_payload(result.frame), model.Expose(port=0))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    page = urlopen(f"http://127.0.0.1:{server.server_port}/").read().decode()
    assert "<th>a</th>" in page and json.loads(urlopen(f"http://127.0.0.1:{server.server_port}/api/result").read())["columns"] == ["a", "b"]
    server.shutdown()


def test_command_line(tmp_path, capsys, monkeypatch):
    import io

    from cellwright.__main__ import main

    s = ["--store", str(tmp_path / "r")]
    assert main(["init", str(tmp_path / "p")]) == 0 and model.load_pipeline(str(tmp_path / "p" / "pipeline.yaml")).stages
    assert main(["seed", *s]) == 0 and main(["search", "normal", *s]) == 0 and "normalizer:1.0.0" in capsys.readouterr().out
    assert main(["pack", "normalizer", str(tmp_path / "n.tgz"), *s]) == 0 and main(["push", str(tmp_path / "n.tgz"), "--store", str(tmp_path / "r2")]) == 0
    assert main(["pull", "normalizer", str(tmp_path / "c"), "--store", str(tmp_path / "r2")]) == 0
    (tmp_path / "m.json").write_text(store.to_json(model.Manifest("own", "2.0.0")))
    assert main(["build", str(tmp_path / "m.json"), "--pin", "numpy", *s]) == 0 and store.ImageStore(tmp_path / "r").inspect("own").pins["numpy"]
    assert main(["inspect", "none", *s]) == 1 and main(["validate", str(tmp_path / "p" / "pipeline.yaml")]) == 0
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr("sys.stdin", io.StringIO("secret\n"))
    assert main(["login", "own"]) == 0 and (tmp_path / ".env").read_text() == "OWN_API_KEY=secret\n" and ".env" in (tmp_path / ".gitignore").read_text()


def test_same_image_other_config(spark):
    a, b = S("a", "normalizer", [], None, {"columns": ["x"]}), S("b", "normalizer", [], None, {"columns": ["y"]})
    assert executor.fingerprint(a, [], None) != executor.fingerprint(b, [], None)


def test_store(tmp_path):
    s = store.ImageStore(tmp_path / "r")
    for v in ("1.2.0", "1.10.0", "1.10.0-rc1"):
        s.push(model.Manifest("img", v, "d", [model.ArtifactType()]))
    s.push(model.Manifest("secret"), private=True)
    assert s.inspect("img").version == "1.10.0" and s.inspect("img:1.2.0").version == "1.2.0"
    assert [m.name for m in s.search("")] == ["img"] and len(s.search("", private=True)) == 2
    assert (s.pull("img", tmp_path / "c") / "manifest.json").exists() and s.pack("img", tmp_path / "p.tgz").exists()
    with pytest.raises(ImageError):
        s.inspect("none")


def test_plugins():
    class Good:
        name = "g"

        def supports(self, x):
            return x == 1

        def parse(self, x):
            return []

    r = PluginRegistry()
    r.register("parser", Good())
    assert r.supporting("parser", 1).name == "g" and r.names("parser") == ["g"]
    with pytest.raises(LookupError):
        r.supporting("parser", 2)
    with pytest.raises(ConfigError):
        r.register("validator", Good())


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x\n1\n")
    q = ingest.write_once(ingest.arriving_elements(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "rows").mkdir()
    spark.createDataFrame([("INV-1", "2025-01-01 10:00:00"), ("x", "2025-01-05 10:00:00")], "v string, t string").select("v", F.to_timestamp("t").alias("t")).write.mode("overwrite").parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("v string, t timestamp").parquet(str(tmp_path / "rows"))
    q = ingest.mask_counts(stream, "v", "t").writeStream.format("memory").queryName("masks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["mask"]: r.n for r in spark.table("masks").collect()} == {"AA-9": 1, "a": 1}
