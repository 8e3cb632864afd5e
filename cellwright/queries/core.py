"""Queries of the document-to-table operators, each with the SQL that DuckDB checks it with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.functions import coerce, infer, similarity
from cellwright.functions.redact import PATTERNS, redact, redaction_counts
from cellwright.functions.text import py_strip
from cellwright.operators import dedup, extract, geometry, ground, lineage, profile, review, transforms
from cellwright.session import scratch, table
from cellwright.sinks import export
from cellwright.sources import parsers, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space of Python's strip, in the syntax of DuckDB's regular expressions.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(source: Column, index: Column | int = 0, note: str | None = None) -> Column:
    idx = index if isinstance(index, Column) else F.lit(index)
    return F.struct(source.cast("string").alias("source_id"), idx.cast("int").alias("index"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("char_span"), F.lit(note).alias("note")).cast(lineage.LOCATION)


def _elements(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<array<string>>").alias("grid")
    return table(spark, d, "ir_elements").select("source_id", F.col("elem_idx"), "kind", "text", none, "location")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with lineage: each nation is a source, a row's place is its key."""
    rows = table(spark, d, "customer").select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("source_id"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return lineage.with_lineage(rows, ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"], F.array(_place(F.col("source_id"), F.col("c_custkey"))))


# sources and parsers


@query()
def src_binary_files(spark: SparkSession, d: str) -> DataFrame:
    return readers.binary_files(spark, d, "*.parquet").select(F.regexp_extract("source_id", r"[^/]+$", 0).alias("file"), "content_type", "length")


@query(
    """
    SELECT DISTINCT source_id, CASE lower(regexp_extract(source_id, '\\.([^./]+)$', 1))
        WHEN 'csv' THEN 'text/csv' WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain'
        WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS content_type
    FROM ir_elements"""
)
def detect_content_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ir_elements").select("source_id").distinct().withColumn("content_type", readers.detect_content_type(F.col("source_id")))


@query(
    f"""
    WITH b AS (SELECT doc_id, unnest(string_split(text, E'\\n\\n')) AS block, generate_subscripts(string_split(text, E'\\n\\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, block, coalesce(sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS span_start FROM b)
    SELECT doc_id, {strip_sql('block')} AS text, span_start, span_start + length(block) AS span_end FROM s WHERE {strip_sql('block')} <> ''"""
)
def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.lit("text/plain").alias("content_type"), F.encode("text", "utf-8").alias("content"))
    found = parsers.parse_sources(docs).filter("error is null")
    return found.select(F.col("source_id").cast("bigint").alias("doc_id"), "text", F.col("location.char_span.start").alias("span_start"), F.col("location.char_span.end").alias("span_end"))


@query()
def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "content_type", F.encode("text", "utf-8").alias("content"))
    return parsers.parse_sources(docs).select("source_id", "elem_idx", "kind", "text", "location.note", F.size("grid").alias("grid_rows"), "error")


def _rendered(spark: SparkSession, df: DataFrame, key: str, order: str, head: str, line: Column, kind: str, foot: str = "") -> DataFrame:
    """Sources of ``kind``, one a value of ``key``: ``head``, the lines of its rows in order, ``foot``."""
    grouped = df.groupBy(F.col(key).cast("string").alias("source_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return grouped.select("source_id", F.lit(kind).alias("content_type"), F.encode(F.concat(F.lit(head), body, F.lit(foot)), "utf-8").alias("content"))


@query("SELECT n_regionkey::VARCHAR AS source_id, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def parse_csv(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), F.col("n_name"), F.lit('"')))
    found = parsers.parse_sources(_rendered(spark, nation, "n_regionkey", "n_nationkey", "n_nationkey,n_name\n", line, "text/csv"))
    return extract.extract_table(found).select("source_id", "n_nationkey", "n_name")


@query("SELECT n_regionkey::VARCHAR AS source_id, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def md_pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("n_nationkey").cast("string"), transforms.markdown_cell(F.col("n_name"))), F.lit(" |"))
    head = "# Nations\nof a region\n| n_nationkey | n_name |\n|---|---|\n"
    return extract.extract_table(parsers.parse_sources(_rendered(spark, nation, "n_regionkey", "n_nationkey", head, line, "text/markdown"))).select("source_id", "n_nationkey", "n_name")


@query("SELECT n_regionkey::VARCHAR AS source_id, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    line = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", F.col("n_nationkey").cast("string"), "n_name"), F.lit("</td></tr>"))
    head = "<h1>Nations</h1><script>x</script><table><tr><th>n_nationkey</th><th>n_name</th></tr>"
    return extract.extract_table(parsers.parse_sources(_rendered(spark, nation, "n_regionkey", "n_nationkey", head, line, "text/html", "</table>"))).select("source_id", "n_nationkey", "n_name")


@query("SELECT n_regionkey::VARCHAR AS source_id, 'Nation ' || n_name AS text FROM nation")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    line = F.concat(F.lit("<li>Nation <b>"), F.col("n_name"), F.lit("</b></li>"))
    found = parsers.parse_sources(_rendered(spark, nation, "n_regionkey", "n_nationkey", "<ul>", line, "text/html", "</ul>"))
    return found.select("source_id", "text")


@query("SELECT event_id::VARCHAR AS source_id, json_extract_string(props, '$.k') AS k FROM events")
def parse_json_records(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "events").select(F.col("event_id").cast("string").alias("source_id"), F.lit("application/json").alias("content_type"), F.encode(F.concat(F.lit("["), "props", F.lit("]")), "utf-8").alias("content"))
    return extract.extract_table(parsers.parse_sources(src)).select("source_id", "k")


@query(
    """
    SELECT source_id, key, value FROM (
        SELECT n_nationkey::VARCHAR AS source_id, unnest(['nation.name', 'nation.region[0]', 'flag']) AS key, unnest([n_name, n_regionkey::VARCHAR, 'True']) AS value FROM nation)"""
)
def json_flatten_kv(spark: SparkSession, d: str) -> DataFrame:
    body = F.format_string('{"nation": {"name": "%s", "region": [%d], "none": {}}, "flag": true}', F.col("n_name"), F.col("n_regionkey"))
    src = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("source_id"), F.lit("application/json").alias("content_type"), F.encode(body, "utf-8").alias("content"))
    return extract.extract_table(parsers.parse_sources(src)).select("source_id", "key", "value")


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def rest_records_path(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat(F.lit('{"data": {"items": ['), "props", F.lit("]}}"))
    rows = table(spark, d, "events").select("event_id", F.explode(readers.records_path(payload, "data.items")).alias("r"))
    return rows.select("event_id", F.try_variant_get("r", "$.k", "bigint").alias("k"))


@query(
    """
    SELECT coalesce(n_nationkey::VARCHAR, '') AS n_nationkey, coalesce(n_name, '') AS n_name, coalesce(n_regionkey::VARCHAR, '') AS n_regionkey,
           coalesce(r_regionkey::VARCHAR, '') AS r_regionkey, coalesce(r_name, '') AS r_name
    FROM (SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region)"""
)
def records_union_keys(spark: SparkSession, d: str) -> DataFrame:
    return readers.records_union([table(spark, d, "nation"), table(spark, d, "region")])


# inference and coercion

TYPE_SQL = r"""CASE WHEN @ = '' THEN 'str' WHEN lower(@) IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'bool'
    WHEN regexp_matches(@, '^([+-]?\d{1,3}(,\d{3})*|[+-]?\d+)$') THEN 'int'
    WHEN regexp_matches(@, '^([+-]?\d+(,\d{3})*(\.\d+)?|[+-]?\d*\.\d+)$') THEN 'float'
    WHEN regexp_matches(@, '^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})$') THEN 'date' ELSE 'str' END"""


def type_sql(c: str) -> str:
    return TYPE_SQL.replace("@", strip_sql(f"coalesce({c}, '')"))


@query(f"SELECT row_id, {type_sql('total')} AS total_type, {type_sql('invoice_number')} AS number_type FROM invoices")
def infer_cell_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "invoices").select("row_id", infer.cell_type(F.col("total")).alias("total_type"), infer.cell_type(F.col("invoice_number")).alias("number_type"))


@query(
    f"""
    WITH t AS (SELECT unnest(['issued', 'total', 'quantity']) AS name, unnest([strftime(o_orderdate, '%Y-%m-%d'), o_totalprice::VARCHAR, (o_orderkey % 7)::VARCHAR]) AS v FROM orders),
    k AS (SELECT name, list_sort(list(DISTINCT {type_sql('v')})) AS types FROM t GROUP BY name)
    SELECT name, CASE WHEN len(types) = 1 THEN types[1] WHEN types = ['float', 'int'] THEN 'float' ELSE 'str' END AS type FROM k"""
)
def infer_column_types(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("total"), (F.col("o_orderkey") % 7).cast("string").alias("quantity"))
    return spark.createDataFrame(list(infer.column_types(o).items()), "name string, type string")


NUMBER = f"replace({strip_sql('total')}, ',', '')"


@query(f"SELECT row_id, CASE WHEN regexp_matches({NUMBER}, '^[+-]?[0-9]+$') THEN try_cast({NUMBER} AS BIGINT) WHEN regexp_matches({NUMBER}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trunc(try_cast({NUMBER} AS DOUBLE)) AS BIGINT) END AS value FROM invoices")
def coerce_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "invoices").select("row_id", coerce.coerce_int(F.col("total")).alias("value"))


@query(f"SELECT row_id, CASE WHEN regexp_matches({NUMBER}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast({NUMBER} AS DOUBLE) END AS value FROM invoices")
def coerce_float(spark: SparkSession, d: str) -> DataFrame:
    value = coerce.coerce_float(F.col("total"))
    return table(spark, d, "invoices").select("row_id", F.when(~F.isnan(value), value).alias("value"))


@query("SELECT row_id, flagged AS value, flagged AS again FROM invoices")
def coerce_bool(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("flagged")
    return table(spark, d, "invoices").select("row_id", coerce.coerce_bool(F.when(f, " Yes ").when(~f, "0")).alias("value"), coerce.coerce_bool(f.cast("string")).alias("again"))


@query(f"SELECT row_id, {strip_sql('vendor')} AS value FROM invoices")
def coerce_str(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "invoices").select("row_id", coerce.coerce_str(F.col("vendor")).alias("value"))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return coerce.clean(table(spark, d, "invoices").select("row_id", "total", "vendor"), {"total": "float", "vendor": "str"}, {"vendor": F.upper})


FLOAT_OK = f"(regexp_matches({NUMBER}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') OR regexp_matches({NUMBER}, '(?i)^[+-]?(inf|infinity|nan)$'))"


@query(f"SELECT row_id, total IS NOT NULL AND NOT {FLOAT_OK} AS flagged, CASE WHEN total IS NOT NULL AND NOT {FLOAT_OK} THEN 'cannot coerce column ''total'' value ''' || total || '''' END AS error FROM invoices")
def clean_errors(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("row_id", F.col("_flagged").alias("flagged"), F.get("_errors", F.lit(0)).alias("error"))


@query(f"SELECT row_id, upper({strip_sql('vendor')}) AS vendor FROM invoices")
def clean_rule_upper(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("row_id", "vendor")


@query(f"SELECT row_id, CASE WHEN regexp_matches({NUMBER}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast({NUMBER} AS DOUBLE) END AS total FROM invoices")
def clean_typed(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("row_id", F.when(~F.isnan("total"), F.col("total")).alias("total"))


# extraction


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """Nations as one grid a region, with a ragged and a long row."""
    n = table(spark, d, "nation")
    row = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.col("n_nationkey").cast("string"))).otherwise(F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit("  "), "n_name"), F.lit("more")))
    grid = F.concat(F.array(F.array(F.lit(" key "), F.lit("name"))), F.transform(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("o"), row.alias("r")))), lambda x: x["r"]))
    g = n.groupBy(F.col("n_regionkey").cast("string").alias("source_id")).agg(grid.alias("grid"))
    return g.select("source_id", F.lit(0).alias("elem_idx"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), "grid", _place(F.col("source_id"), 0, "grid").alias("location"))


@query("SELECT n_regionkey::VARCHAR AS source_id, n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS name FROM nation")
def extract_table(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_table(_grids(spark, d)).select("source_id", "key", "name")


@query("SELECT n_regionkey::VARCHAR AS source_id, n_nationkey::VARCHAR AS a, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS b, CASE WHEN n_nationkey % 5 <> 0 THEN 'more' END AS c FROM nation")
def extract_hint(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_table(_grids(spark, d), ["a", "b", "c"]).select("source_id", "a", "b", "c")


@query(f"SELECT source_id, elem_idx, kind AS element, {strip_sql('text')} AS text, coalesce(location.note, 'index ' || location.index, 'source') AS location FROM ir_elements WHERE {strip_sql('text')} <> '' AND source_id NOT IN (SELECT source_id FROM ir_elements WHERE kind = 'table')")
def elements_fallback(spark: SparkSession, d: str) -> DataFrame:
    return extract.elements_fallback(_elements(spark, d))


@query(
    """
    WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS total FROM orders),
    bad AS (SELECT o_custkey, min(o_orderkey) AS first_bad FROM o WHERE total = 'n/a' GROUP BY o_custkey)
    SELECT o_custkey::VARCHAR AS source_id, 'loaded' AS outcome, count(*) AS rows FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM bad) GROUP BY o_custkey
    UNION ALL SELECT o_custkey::VARCHAR, 'row ' || first_bad || ': total', 0 FROM bad""".replace("AS rows", 'AS "rows"')
)
def strict_validate(spark: SparkSession, d: str) -> DataFrame:
    """Customers as sources, their orders as rows: one order without a price fails its whole source."""
    o = table(spark, d, "orders")
    total = F.when(F.col("o_orderkey") % 40 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    good, failed = extract.strict_validate(o.select(F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderkey").alias("_ord"), total.alias("total")), {"total": "float"})
    counted = good.groupBy("source_id").agg(F.lit("loaded").alias("outcome"), F.count("*").alias("rows"))
    return counted.unionByName(failed.select("source_id", F.col("reason").alias("outcome"), F.lit(0).cast("bigint").alias("rows")))


@query(
    """
    WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS p FROM customer)
    SELECT c_custkey, CASE WHEN c_mktsegment = '' AND coalesce(p, '') <> '' THEN p ELSE c_mktsegment END AS c_mktsegment,
           c_mktsegment = '' AND coalesce(p, '') <> '' AS filled, c_mktsegment <> '' AND coalesce(p, '') <> '' AND p IS DISTINCT FROM c_mktsegment AS conflict FROM r"""
)
def reconcile_fill_conflict(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    rows = c.withColumn("c_mktsegment", F.when(k % 7 == 0, "").otherwise(F.col("c_mktsegment")))
    proposals = c.withColumn("c_mktsegment", F.when(k % 5 == 0, "OTHER").when(k % 3 != 0, F.col("c_mktsegment")))
    out = extract.reconcile(rows, proposals, "c_custkey", ["c_mktsegment"])
    return out.select("c_custkey", "c_mktsegment", (F.size("_filled") > 0).alias("filled"), F.coalesce("_conflict", F.lit(False)).alias("conflict"))


# transforms


@query(f"SELECT dupe_id, {strip_sql('name')} AS name, {strip_sql('city')} AS city FROM dupes")
def data_cleaner(spark: SparkSession, d: str) -> DataFrame:
    return transforms.data_cleaner(table(spark, d, "dupes").select("dupe_id", "name", "city"))


def normal_sql(c: str) -> str:
    return f"regexp_replace(lower({strip_sql(c)}), '{WS}+', ' ', 'g')"


@query(f"SELECT dupe_id, {normal_sql('name')} AS name, {normal_sql('city')} AS city FROM dupes")
def normalizer(spark: SparkSession, d: str) -> DataFrame:
    return transforms.normalizer(table(spark, d, "dupes").select("dupe_id", "name", "city"))


@query(f"SELECT dupe_id, name, {normal_sql('city')} AS city FROM dupes")
def normalizer_cols(spark: SparkSession, d: str) -> DataFrame:
    return transforms.normalizer(table(spark, d, "dupes").select("dupe_id", "name", "city"), ["city", "unknown"])


EMAIL, SSN, PHONE = PATTERNS.values()
REDACTED = f"regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{SSN}', '[SSN]', 'g'), '{PHONE}', '[PHONE]', 'g')"


@query(f"SELECT element_id, {REDACTED} AS text FROM ir_elements")
def pii_redactor(spark: SparkSession, d: str) -> DataFrame:
    # DuckDB's patterns know ASCII words only; the library's default is all scripts
    return table(spark, d, "ir_elements").select("element_id", redact(F.col("text"), unicode=False).alias("text"))


@query(
    f"""SELECT element_id, coalesce(len(regexp_extract_all(text, '{EMAIL}')), 0)::BIGINT AS email, coalesce(len(regexp_extract_all(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{SSN}')), 0)::BIGINT AS ssn,
    coalesce(len(regexp_extract_all(regexp_replace(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g'), '{SSN}', '[SSN]', 'g'), '{PHONE}')), 0)::BIGINT AS phone FROM ir_elements"""
)
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ir_elements").select("element_id", redaction_counts(F.col("text")).alias("c")).select("element_id", "c.*")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice FROM orders")
def column_mapper(spark: SparkSession, d: str) -> DataFrame:
    return transforms.column_mapper(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), {"o_orderkey": "id", "o_orderstatus": "status", "none": "x"})


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def any_to_json(spark: SparkSession, d: str) -> DataFrame:
    return transforms.any_to_json(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("""SELECT dupe_id || ',' || CASE WHEN regexp_matches(coalesce(name, ''), '["\\r\\n,]') THEN '"' || replace(name, '"', '""') || '"' ELSE coalesce(name, '') END AS csv FROM dupes""")
def any_to_csv(spark: SparkSession, d: str) -> DataFrame:
    return transforms.any_to_csv(table(spark, d, "dupes").select("dupe_id", "name"))


@query(f"SELECT '| ' || dupe_id || ' | ' || {strip_sql("replace(replace(coalesce(name, ''), '|', '\\|'), E'\\n', ' ')")} || ' |' AS markdown FROM dupes")
def any_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return transforms.any_to_markdown(table(spark, d, "dupes").select("dupe_id", "name"))


def _flagged_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = lineage.with_lineage(o, ["o_orderkey", "o_orderstatus", "o_totalprice"], F.array(_place(F.lit("orders"), F.col("o_orderkey"))))
    return lineage.flag_rows(rows, F.col("o_totalprice") > 300000)


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 300000, false)")
def drop_flagged(spark: SparkSession, d: str) -> DataFrame:
    return transforms.drop_flagged(_flagged_orders(spark, d)).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def strip_lineage(spark: SparkSession, d: str) -> DataFrame:
    return transforms.strip_lineage(_flagged_orders(spark, d))


# grounding


@query("SELECT source_id, string_agg(text, E'\\n' ORDER BY elem_idx) AS source_text FROM ir_elements WHERE text IS NOT NULL GROUP BY source_id")
def source_text(spark: SparkSession, d: str) -> DataFrame:
    return ground.source_text(_elements(spark, d))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Feedback values with the first source that they cite."""
    f = table(spark, d, "feedback_records")
    return f.select("feedback_id", "original_value", F.get("locations", F.lit(0))["source_id"].alias("source_id"))


CLAIMS = """WITH t AS (SELECT source_id, string_agg(text, E'\\n' ORDER BY elem_idx) AS s FROM ir_elements WHERE text IS NOT NULL GROUP BY source_id),
    c AS (SELECT feedback_id, coalesce(original_value, '') AS v, coalesce(s, '') AS s FROM feedback_records LEFT JOIN t ON t.source_id = locations[1].source_id),
    w AS (SELECT *, list_filter(regexp_split_to_array(v, '\\s+'), lambda x: x <> '') AS vw, regexp_split_to_array(s, '\\s+') AS sw FROM c),
    g AS (SELECT feedback_id, CASE WHEN v = '' THEN CASE WHEN s = '' THEN 1.0 ELSE 0.0 END WHEN s = '' THEN 0.0 WHEN contains(s, v) OR (len(vw) > 0 AND list_has_all(sw, vw)) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM w)"""


@query(CLAIMS + " SELECT feedback_id, score FROM g")
def ground_exact(spark: SparkSession, d: str) -> DataFrame:
    scored = ground.score_cells(_claims(spark, d), ground.source_text(_elements(spark, d)), {"original_value": F.col("original_value")}, exact_only=True)
    return scored.select("feedback_id", F.col("_score_original_value").alias("score"))


def _statements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers' names with their first letters crossed out, more of them from row to row, and statements that hold them.

    A crossed-out letter stands nowhere in the statement, and the name stands in its middle, so the best window is the
    name's own place: of the n letters n - k are common, and the support is (n - k) / n, on both sides of the threshold.
    """
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("source_id"), "c_name", "c_mktsegment")
    crossed = F.least(F.pmod(F.col("c_custkey"), F.lit(19)), F.length("c_name"))
    rows = c.select("c_custkey", "source_id", F.concat(F.repeat(F.lit("~"), crossed), F.substr("c_name", crossed + 1)).alias("claim"))
    text = F.concat(F.lit("Statement of account, open items of customer "), "c_name", F.lit(" within the market segment "), "c_mktsegment", F.lit(" as of today"))
    lines = c.select("source_id", F.lit(0).alias("elem_idx"), F.lit("paragraph").alias("kind"), text.alias("text"), F.lit(None).cast("array<array<string>>").alias("grid"))
    return rows, ground.source_text(lines)


def _scored_statements(spark: SparkSession, d: str) -> DataFrame:
    rows, texts = _statements(spark, d)
    return ground.score_cells(rows, texts, {"claim": F.col("claim")})


STATEMENTS = "WITH g AS (SELECT c_custkey, (length(c_name) - least(c_custkey % 19, length(c_name)))::DOUBLE / length(c_name) AS score FROM customer)"


@query(STATEMENTS + " SELECT c_custkey, round(score, 9) AS score FROM g")
def ground_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored_statements(spark, d).select("c_custkey", F.round("_score_claim", 9).alias("score"))


@query(STATEMENTS + " SELECT c_custkey, score < 0.7 AS flagged FROM g")
def ground_flag(spark: SparkSession, d: str) -> DataFrame:
    return ground.flag_ungrounded(_scored_statements(spark, d), ["claim"]).select("c_custkey", F.col("_ground_flag").alias("flagged"))


@query(STATEMENTS + " SELECT c_custkey FROM g WHERE score >= 0.7")
def ground_reject(spark: SparkSession, d: str) -> DataFrame:
    return ground.flag_ungrounded(_scored_statements(spark, d), ["claim"], reject=True).select("c_custkey")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """The claims scored in full against their whole source texts; no SQL says what that gives."""
    return ground.score_cells(_claims(spark, d), ground.source_text(_elements(spark, d)), {"original_value": F.col("original_value")})


@query()
def ground_flag_aligned(spark: SparkSession, d: str) -> DataFrame:
    flagged = ground.flag_ungrounded(_aligned(spark, d), ["original_value"])
    return flagged.select("feedback_id", F.col("_score_original_value").alias("score"), F.col("_ground_flag").alias("flagged"))


@query()
def ground_reject_aligned(spark: SparkSession, d: str) -> DataFrame:
    return ground.flag_ungrounded(_aligned(spark, d), ["original_value"], reject=True).select("feedback_id")


# deduplication and profiles


@query("SELECT min(dupe_id) AS dupe_id, name, city FROM dupes GROUP BY name, city")
def deduplicator(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dupes").select(F.col("dupe_id").alias("_ord"), "name", "city", "source_id")
    return dedup.deduplicate(rows, ["name", "city", "unknown"]).select(F.col("_ord").alias("dupe_id"), "name", "city")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem GROUP BY ALL")
def deduplicator_all(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.col("l_linenumber").alias("_ord"))
    return dedup.deduplicate(rows).select("l_orderkey", "l_partkey", "l_quantity")


@query(
    """
    WITH k AS (SELECT p_partkey * 2 AS row_id FROM part UNION ALL SELECT p_partkey * 2 + 1 FROM part)
    SELECT row_id, CASE WHEN row_id % 2 = 1 AND (row_id - 1) // 2 % 3 <> 1 THEN row_id - 1 ELSE row_id END AS leader FROM k"""
)
def dedup_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Parts' labels of two words, each a second time: with a word more, with other letters, or with its words exchanged."""
    k, code = F.col("p_partkey"), lambda c: F.substring(F.md5(c.cast("string")), 1, 12)
    p = table(spark, d, "part").select("p_partkey", F.concat(code(k), F.lit(" "), code(k + 1_000_000_000)).alias("base"))
    again = F.when(k % 3 == 0, F.concat(F.upper("base"), F.lit(" spare"))).when(k % 3 == 1, code(-k)).otherwise(F.concat(code(k + 1_000_000_000), F.lit(" "), code(k)))
    rows = p.select((k * 2).alias("_ord"), F.col("base").alias("name")).unionByName(p.select((k * 2 + 1).alias("_ord"), again.alias("name")))
    return dedup.fuzzy_clusters(rows, ["name"]).select(F.col("_ord").alias("row_id"), "leader")


@query()
def dedup_fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """All names of ``dupes``, clustered row by row; equal to brute force in the tests."""
    rows = table(spark, d, "dupes").select(F.col("dupe_id").alias("_ord"), "name")
    return dedup.fuzzy_clusters(rows, ["name"]).select(F.col("_ord").alias("dupe_id"), "leader")


MERGED = "SELECT user_id, {v} AS event_type, {p} AS props, count(*) AS n FROM events GROUP BY user_id"


@query(MERGED.format(v="arg_min(event_type, event_id)", p="arg_min(props, event_id)"))
def dedup_merge_first(spark: SparkSession, d: str) -> DataFrame:
    return lineage.merge_rows(table(spark, d, "events"), "user_id", "event_id", ["event_type", "props"]).select("user_id", "event_type", "props", F.col("_size").alias("n"))


@query(MERGED.format(v="arg_max(event_type, length(event_type) * 1000000000 - event_id)", p="arg_max(props, length(props) * 1000000000 - event_id)"))
def dedup_merge_longest(spark: SparkSession, d: str) -> DataFrame:
    return lineage.merge_rows(table(spark, d, "events"), "user_id", "event_id", ["event_type", "props"], "longest").select("user_id", "event_type", "props", F.col("_size").alias("n"))


def anomaly_sql(source: str, key: str, value: str) -> str:
    return f"""WITH r AS (SELECT {key} AS k, ({value})::DOUBLE AS v FROM {source}), m AS (SELECT median(v) AS mid FROM r), a AS (SELECT median(abs(v - mid)) AS mad FROM r, m)
    SELECT k AS {key} FROM r, m, a WHERE CASE WHEN mad > 0 THEN 0.6745 * abs(v - mid) / mad > 3.5 ELSE abs(v - mid) > 1e-9 END"""


@query(anomaly_sql("orders", "o_orderkey", "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END"))
def anomaly_flagger(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") * 20).otherwise(F.col("o_totalprice"))
    return transforms.anomalies(table(spark, d, "orders").select("o_orderkey", price.alias("price")), ["price"]).filter("_anomaly").select("o_orderkey")


@query(anomaly_sql("orders", "o_orderkey", "CASE WHEN o_orderkey % 50 = 0 THEN 1000 ELSE 1 END"))
def anomaly_mad0(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, 1000).otherwise(1).alias("v"))
    return transforms.anomalies(o, ["v"]).filter("_anomaly").select("o_orderkey")


PROFILED = ("vendor", "total", "invoice_number")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS \"unique\" FROM invoices" for c in PROFILED).replace("AS column,", 'AS "column",').replace("AS rows,", 'AS "rows",'))
def data_profiler(spark: SparkSession, d: str) -> DataFrame:
    return profile.data_profile(table(spark, d, "invoices"), list(PROFILED))


@query(
    """
    WITH n AS (SELECT count(*) AS r, count(c_acctbal) AS k, count(DISTINCT c_acctbal) AS u, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(avg(c_acctbal), 2) AS m FROM customer),
    s AS (SELECT count(*) AS r, count(c_mktsegment) AS k, count(DISTINCT c_mktsegment) AS u FROM customer)
    SELECT 'c_acctbal' AS "column", 'numeric' AS kind, r AS "rows", k AS non_null, round(k / r, 4)::DOUBLE AS fill_rate, u AS "unique", lo AS "min", hi AS "max", m AS mean FROM n
    UNION ALL SELECT 'c_mktsegment', 'categorical', r, k, round(k / r, 4)::DOUBLE, u, NULL, NULL, NULL FROM s"""
)
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profiles(table(spark, d, "customer"), ["c_acctbal", "c_mktsegment"]).withColumn("mean", F.round("mean", 2))


@query('SELECT c_nationkey::VARCHAR AS value, count(*) AS "count" FROM customer WHERE c_nationkey IS NOT NULL GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10')
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(spark, d, "customer"), "c_nationkey")


@query(
    """
    WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), e AS (SELECT lo, hi, unnest(range(1, 11)) AS bin FROM s),
    b AS (SELECT (1 + len(list_filter(range(1, 10), lambda i: lo + (hi - lo) / 10 * i < c_acctbal)))::BIGINT AS bin FROM customer, s)
    SELECT e.bin::INT AS bin, count(b.bin) AS "count" FROM e LEFT JOIN b USING (bin) GROUP BY e.bin"""
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(table(spark, d, "customer"), "c_acctbal").select(F.col("bin").cast("int"), "count")


@query(STATEMENTS + " SELECT (SELECT count(*) FROM customer) AS sources, (SELECT count_if(c_custkey % 5 = 0) FROM customer)::BIGINT AS failed_sources, count(*) AS rows_emitted, count_if(score < 0.7)::BIGINT AS rows_flagged FROM g")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    outcomes = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 5 == 0, "unreadable").alias("error"))
    return profile.corpus_summary(outcomes, ground.flag_ungrounded(_scored_statements(spark, d), ["claim"]))


@query()
def corpus_summary_aligned(spark: SparkSession, d: str) -> DataFrame:
    outcomes = _elements(spark, d).select("source_id").distinct().withColumn("error", F.lit(None).cast("string"))
    return profile.corpus_summary(outcomes, ground.flag_ungrounded(_aligned(spark, d), ["original_value"]))


@query("SELECT count(*) * 4 AS grounded_cells, count(*) * 4 AS cells FROM customer")
def provenance_coverage(spark: SparkSession, d: str) -> DataFrame:
    return lineage.provenance_coverage(_customers(spark, d))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT NULL, NULL, NULL FROM region")
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    return extract.corpus_union([table(spark, d, "nation"), table(spark, d, "region")])


# lineage


@query("SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment, lower(c_mktsegment) <> c_mktsegment AS again FROM customer")
def compose_map(spark: SparkSession, d: str) -> DataFrame:
    mapped = lineage.compose_map(_customers(spark, d), "c_mktsegment", F.lower("c_mktsegment"), "lower")
    return mapped.select("c_custkey", "c_mktsegment", F.array_contains("_regrounding", "c_mktsegment").alias("again"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name, (generate_subscripts(string_split(p_name, ' '), 1) - 1)::INT AS part FROM part")
def compose_split(spark: SparkSession, d: str) -> DataFrame:
    return lineage.compose_split(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", " ").select("p_partkey", "p_name", F.col("_part").alias("part"))


@query("SELECT c_custkey, '***' AS c_name, 1::BIGINT AS places FROM customer")
def compose_mask(spark: SparkSession, d: str) -> DataFrame:
    masked = lineage.compose_mask(_customers(spark, d), "c_name", "***")
    return masked.select("c_custkey", "c_name", F.size(F.try_element_at("_lineage.cells", F.lit("c_name"))["locations"]).cast("bigint").alias("places"))


@query(
    """
    WITH RECURSIVE e AS (
        SELECT 'c' || c_custkey AS cell, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey - 1) FROM customer WHERE c_custkey % 3 <> 0
        UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 4 = 0),
    t(cell, cur) AS (SELECT 'c' || c_custkey, 'c' || c_custkey FROM customer UNION SELECT t.cell, e.parent FROM t JOIN e ON e.cell = t.cur)
    SELECT cell, cur AS origin FROM t WHERE cur NOT IN (SELECT cell FROM e)"""
)
def resolve_origins(spark: SparkSession, d: str) -> DataFrame:
    """Customers from nations from regions, and from the customers and nations beside them: many parents, cycles, a parent that is stored nowhere."""
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edge = lambda df, cell, parent: df.select(cell.alias("cell"), parent.alias("parent"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    ck, nk = F.col("c_custkey"), F.col("n_nationkey")
    edges = edge(c, name("c", ck), name("n", F.col("c_nationkey"))).unionByName(edge(n, name("n", nk), name("r", F.col("n_regionkey"))))
    edges = edges.unionByName(edge(c.filter(ck % 3 != 0), name("c", ck), name("c", ck - 1)))
    edges = edges.unionByName(edge(n, name("n", nk), name("n", nk))).unionByName(edge(n.filter(nk % 4 == 0), name("n", nk), name("n", nk + 1)))
    return lineage.resolve_origins(edges, c.select(name("c", ck).alias("cell")))


@query("""SELECT c_custkey, unnest(['c_custkey', 'c_name', 'c_mktsegment', 'c_acctbal']) AS "column", 'nation/' || c_nationkey AS source, false AS broken FROM customer""")
def resolve_terminal(spark: SparkSession, d: str) -> DataFrame:
    return lineage.resolve_terminal(_customers(spark, d), "c_custkey").select("c_custkey", "column", F.get("sources", F.lit(0)).alias("source"), "broken")


@query("SELECT c_custkey, true AS row_flagged, true AS lineage_broken, 2::BIGINT AS broken_cells FROM customer")
def lineage_broken(spark: SparkSession, d: str) -> DataFrame:
    out = lineage.mark_broken(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey", "c_name"])
    broken = F.size(F.filter(F.map_values("_lineage.cells"), lambda c: c["lineage_broken"])).cast("bigint")
    return out.select("c_custkey", "_lineage.row_flagged", "_lineage.lineage_broken", broken.alias("broken_cells"))


@query("SELECT 'survival' AS rule, count_if(c_custkey % 3 = 0)::BIGINT AS \"rows\" FROM customer UNION ALL SELECT 'bounds', count_if(c_acctbal > 5000)::BIGINT FROM customer")
def conformance_violations(spark: SparkSession, d: str) -> DataFrame:
    """A stage that loses the name's place in every third row and scores rows by their balance, which may be above 1."""
    cells = F.transform_values("_lineage.cells", lambda k, v: F.when((k == "c_name") & (F.col("c_custkey") % 3 == 0), v.withField("locations", F.array().cast(f"array<{lineage.LOCATION}>"))).otherwise(v))
    scored = F.transform_values(cells, lambda k, v: v.withField("faithfulness", F.greatest(F.lit(0.0), F.col("c_acctbal") / 5000)))
    spoiled = _customers(spark, d).withColumn("_lineage", F.col("_lineage").withField("cells", scored))
    return lineage.conformance_violations(spoiled, "c_custkey", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])


# review


def _reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "invoices").select("row_id", "vendor", "total")
    fixes = table(spark, d, "feedback_records").filter("column_name in ('vendor', 'total')")
    fixes = fixes.select(F.col("feedback_id").alias("row_id"), F.col("column_name").alias("column"), "corrected_value", F.col("recorded_at"))
    return review.review_apply(rows, fixes, ["vendor", "total"], "row_id")


FIXES = """WITH x AS (SELECT feedback_id AS row_id, max(corrected_value) FILTER (column_name = 'vendor') AS v, count(*) FILTER (column_name = 'vendor') > 0 AS hv,
    max(corrected_value) FILTER (column_name = 'total') AS t, count(*) FILTER (column_name = 'total') > 0 AS ht FROM feedback_records WHERE column_name IN ('vendor', 'total') GROUP BY 1)"""


@query("SELECT row_id, vendor FROM invoices WHERE coalesce(flagged, false)")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return review.review_queue(table(spark, d, "invoices").select("row_id", "vendor", "flagged"), "flagged").select("row_id", "vendor")


@query(FIXES + " SELECT i.row_id, CASE WHEN coalesce(hv, false) THEN v ELSE vendor END AS vendor, CASE WHEN coalesce(ht, false) THEN t ELSE total END AS total FROM invoices i LEFT JOIN x USING (row_id)")
def review_apply(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d)[0].select("row_id", "vendor", "total")


@query(
    """
    SELECT feedback_id, '- column ' || CASE WHEN column_name IS NULL THEN 'None' ELSE '''' || column_name || '''' END || ': prefer ' || CASE WHEN corrected_value IS NULL THEN 'None' ELSE '''' || corrected_value || '''' END
           || ' over ' || CASE WHEN original_value IS NULL THEN 'None' ELSE '''' || original_value || '''' END AS line FROM feedback_records"""
)
def review_prompt(spark: SparkSession, d: str) -> DataFrame:
    return review.prompt_lines(table(spark, d, "feedback_records").withColumnRenamed("column_name", "column")).select("feedback_id", "line")


# sinks


@query("""SELECT c_custkey, '{"_row_flagged":false,"c_name":{"grounding_mode":"none","locations":[{"source_id":"nation/' || c_nationkey || '","index":' || c_custkey || '}]}}' AS _lineage FROM customer""")
def emit_lineage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    rows = lineage.with_lineage(
        c.select("c_custkey", F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("source_id")), ["c_name"], F.array(_place(F.col("source_id"), F.col("c_custkey")))
    )
    return export.emit(rows)


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def emit_parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "emit_parquet_roundtrip")
    export.write_export(_customers(spark, d), path, "parquet")
    return spark.read.parquet(path).drop("_lineage")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name::VARCHAR AS n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def emit_sql_text(spark: SparkSession, d: str) -> DataFrame:
    return export.as_text(table(spark, d, "nation"))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def export_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "export_csv_roundtrip")
    export.write_export(table(spark, d, "nation").select("n_nationkey", "n_name"), path, "csv")
    return spark.read.option("header", "true").option("escape", '"').csv(path)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def export_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "export_json_roundtrip")
    export.write_export(table(spark, d, "nation").select("n_nationkey", "n_name"), path, "json")
    return spark.read.schema("n_nationkey bigint, n_name string").json(path)


# SQL sources


def _sql(name: str, tables: list[str], text: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return readers.sql_source(spark, text, {t: table(spark, d, t) for t in tables})

    run.__name__ = name
    plain = (oracle or text)
    for t in tables:
        plain = plain.replace("{" + t + "}", t)
    query(plain)(run)


_sql("sql_source_filter_project", ["orders"], "SELECT o_orderkey, o_totalprice * 2 AS net FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
_sql("sql_source_join", ["orders", "customer", "nation"], "SELECT n.n_name, c.c_mktsegment, count(*) AS orders FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, c.c_mktsegment")
_sql("sql_source_agg", ["lineitem"], "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS discount, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
_sql("sql_source_window", ["orders"], "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM {orders}")
_sql("sql_source_topk", ["customer"], "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
_sql("sql_source_setops", ["customer", "supplier"], "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}")
_sql("sql_source_semi_anti", ["customer", "orders"], "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) AND c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F')")
_sql("sql_source_rollup", ["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("sql_source_cte", ["part"], "WITH p AS (SELECT p_brand, avg(p_retailprice) AS price FROM {part} GROUP BY p_brand) SELECT p_brand, round(price, 4) AS price FROM p WHERE price > (SELECT avg(p_retailprice) FROM {part})")


# page geometry on words made of order lines


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as words: an order is a page, a line's number its line, its quantity its place."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))  # noqa: E741
    top = F.col("l_linenumber") * 14.0
    return l.select(F.col("l_orderkey").alias("page_id"), F.col("p").cast("string").alias("text"), (F.col("q") * 10).alias("x0"), (F.col("q") * 10 + 30).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.lit(600.0).alias("page_width"))


@query(
    """
    WITH w AS (SELECT l_orderkey AS page_id, l_linenumber * 14.0::DOUBLE AS top, min(l_quantity) * 10 AS x0 FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT page_id, min(x0) AS x0, min(top)::DOUBLE AS y0, max(x0 + 30) AS x1, max(top + 10)::DOUBLE AS y1 FROM w GROUP BY page_id"""
)
def pdf_para_bbox(spark: SparkSession, d: str) -> DataFrame:
    return geometry.paragraph_boxes(_words(spark, d), ["page_id"])


@query(
    """
    WITH h AS (SELECT l_orderkey AS page_id, l_quantity AS h, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
    m AS (SELECT page_id, h, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, h) AS r FROM h)
    SELECT page_id, round(greatest(1.0, least(3.0, h * 0.18)), 6)::DOUBLE AS tolerance FROM m WHERE r = 1"""
)
def pdf_word_tol(spark: SparkSession, d: str) -> DataFrame:
    glyphs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_quantity").alias("height"))
    return geometry.word_tolerance(glyphs, ["page_id"]).select("page_id", F.round("tolerance", 6).alias("tolerance"))


@query(
    """
    WITH w AS (SELECT c_nationkey AS page_id, c_name, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 2 AS side, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT page_id, CASE WHEN n >= 60 THEN side ELSE 0 END::INT AS para, string_agg(c_name, ' ' ORDER BY c_custkey) AS text FROM w GROUP BY ALL"""
)
def pdf_page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    at = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    words = n.withColumn("i", at).select(
        F.col("c_nationkey").alias("page_id"), F.col("c_name").alias("text"), F.when(F.col("i") % 2 == 0, 50.0).otherwise(320.0).alias("x0"), F.when(F.col("i") % 2 == 0, 250.0).otherwise(550.0).alias("x1"),
        (F.floor(F.col("i") / 2) * 12.0).alias("top"), (F.floor(F.col("i") / 2) * 12.0 + 10).alias("bottom"), F.lit(600.0).alias("page_width"),
    )
    return geometry.page_paragraphs(words).select("page_id", "para", "text")


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT '| n_nationkey | n_name |' UNION ALL SELECT '| --- | --- |'")
def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an exported Markdown table: one file here, so one header."""
    path = scratch(spark, "export_markdown")
    export.write_export(table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1), path, "markdown")
    return spark.read.text(path).select(F.explode(F.split("value", "\n")).alias("line"))


@query("SELECT 'c_acctbal' AS \"column\", count(*) AS \"rows\", count(c_acctbal) AS non_null, 'numeric' AS kind, 10::BIGINT AS shown FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(c_mktsegment), 'categorical', least(10, count(DISTINCT c_mktsegment)) FROM customer")
def result_payload(spark: SparkSession, d: str) -> DataFrame:
    """The profiles of a result's page: a row a column, with the number of bars that it shows."""
    from cellwright.plans.executor import result_payload as payload

    found = payload(table(spark, d, "customer").select("c_acctbal", "c_mktsegment"))["profiles"]
    return spark.createDataFrame([(p["column"], p["rows"], p["non_null"], p["kind"], len(p["values"])) for p in found], "column string, rows bigint, non_null bigint, kind string, shown bigint")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name::VARCHAR AS n_name FROM nation")
def sink_sql_table(spark: SparkSession, d: str) -> DataFrame:
    """A table written through the SQL sink, all columns as text, and read back by the SQL source."""
    path = scratch(spark, "sink_sql_table")
    export.write_sql(table(spark, d, "nation").select("n_nationkey", "n_name"), f"sink_{path.rpartition('-')[2]}", "overwrite", path=path)
    return spark.read.parquet(path)
