"""Queries of the general data problems (reject rows, quality profile, schema drift)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators import drift, quality, rejects
from cellwright.session import staged, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failing_rows(table(spark, d, "invoices"), table(spark, d, "invoices_raw"), table(spark, d, "ir_tables")).distinct()


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The good rows of all three inputs with their values as text: in header order, of invoices number, vendor, total."""
    good = rejects.loaded_rows(table(spark, d, "invoices"), table(spark, d, "invoices_raw"), table(spark, d, "ir_tables"))
    return good.select("origin", "record_id", "row_index", F.to_json("fields").alias("fields"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "invoices").select("load_id", "total", "vendor")
    found = quality.departing_loads(rows, "load_id", ["total", "vendor"], ("total",))
    return found.select("load_id", "column_name").distinct()


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Nulls, blanks, distinct values, lengths and ranges of each load."""
    rows = table(spark, d, "invoices").select("load_id", "total", "vendor")
    return quality.load_profile(rows, "load_id", ["total", "vendor"], ("total",)).select(
        "load_id", "column_name", "n", "nulls", "blanks", "distinct", "shortest", "longest", "numbers", "least", "most"
    )


def _totals_and_vendors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "invoices").select("load_id", "total", "vendor")


def p3_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile of each load: with distinct values, divergences and the shares of rare masks and sizes."""
    return quality.full_profile(_totals_and_vendors(spark, d), "load_id", ["total", "vendor"], ("total",))


def p3_dominant(spark: SparkSession, d: str) -> DataFrame:
    """The dominant masks of each column with their shares."""
    return quality.dominant_masks(staged(quality.value_classes(_totals_and_vendors(spark, d), "load_id", ["total", "vendor"])))


def p3_violations(spark: SparkSession, d: str) -> DataFrame:
    """Each load's rare masks, however few its rows with them."""
    return quality.mask_violations(staged(quality.value_classes(_totals_and_vendors(spark, d), "load_id", ["total", "vendor"])))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    schemas = drift.grid_schemas(table(spark, d, "ir_tables")).unionByName(drift.declared_schemas(table(spark, d, "resolved_schemas")))
    return drift.schema_changes(schemas).distinct()


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """One consistent table of all feeds, a row's values and the cells that do not fit their column's type as JSON."""
    rows = drift.consistent_rows(table(spark, d, "ir_tables"))
    return rows.select("feed", "file_no", "row_index", F.to_json("values").alias("values"), F.to_json("misfits").alias("misfits"))


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p3_found, p3_profile, p3_distribution, p3_dominant, p3_violations, p5_found, p5_table)}

_NUMBER = "^INV-[0-9]{4,10}$"
_TOTAL = r"^([+-]?[0-9]+(,[0-9]{3})*(\.[0-9]+)?|[+-]?\.[0-9]+)$"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _bad(number: str, total: str) -> str:
    return (
        f"(NOT coalesce(regexp_matches({_strip(number)}, '{_NUMBER}'), false)"
        f" OR NOT coalesce({_strip(total)} = '' OR regexp_matches({_strip(total)}, '{_TOTAL}'), true))"
    )


def _field(delimiter: str) -> str:
    return f'("([^"]|"")*"|[^"{delimiter}]*)'


def _parsed(delimiter: str) -> str:
    """A record's fields, quotes taken off; NULL where its quoting is broken.  Each field ends with a delimiter."""
    ok = f"regexp_full_match(raw_line, '(?s){_field(delimiter)}({delimiter}{_field(delimiter)})*')"
    all_ = f"regexp_extract_all(raw_line || '{delimiter}', '(?s)({_field(delimiter)}){delimiter}', 1)"
    return f"""CASE WHEN {ok} THEN list_transform({all_}, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) END"""


_KIND = r"""CASE WHEN v = '' THEN NULL WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n') THEN 'bool' WHEN regexp_matches(v, '^([+-]?\d{1,3}(,\d{3})*|[+-]?\d+)$') THEN 'int'
    WHEN regexp_matches(v, '^([+-]?\d+(,\d{3})*(\.\d+)?|[+-]?\d*\.\d+)$') THEN 'float' WHEN regexp_matches(v, '^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})$') THEN 'date' ELSE 'str' END"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
    WITH raw AS (SELECT *, CASE WHEN content_type = 'text/tab-separated-values' THEN {_parsed(chr(9))} ELSE {_parsed(',')} END AS f FROM invoices_raw),
    head AS (SELECT source_id, len(f) AS width, list_position(f, 'invoice_number') AS a, list_position(f, 'total') AS b FROM raw WHERE line_no = 0),
    rec AS (SELECT raw_id, CASE WHEN f IS NULL THEN 'quoting' WHEN len(f) <> width THEN 'column_count' WHEN {_bad('f[a]', 'f[b]')} THEN 'value' END AS reason
            FROM raw JOIN head USING (source_id) WHERE line_no <> 0 AND trim(coalesce(raw_line, ''), E' \\r\\n') <> ''),
    grid AS (SELECT table_id, cells[1] AS h, unnest(cells[2:]) AS r, generate_subscripts(cells[2:], 1)::INT AS i FROM ir_tables),
    cell AS (SELECT table_id, i, unnest(generate_series(1, len(h))) AS j, unnest(r) AS c FROM grid WHERE len(r) = len(h)),
    typed AS (SELECT table_id, i, j, {_KIND} AS kind FROM (SELECT *, {_strip("coalesce(c, '')")} AS v FROM cell)),
    col AS (SELECT table_id, j, arg_max(kind, n * 10 + list_position(['bool', 'date', 'int', 'float', 'str'], kind)) AS kind
            FROM (SELECT table_id, j, kind, count(*) AS n FROM typed WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY table_id, j),
    wrong AS (SELECT DISTINCT table_id, i FROM typed t JOIN col c USING (table_id, j) WHERE t.kind IS NOT NULL AND c.kind <> 'str' AND t.kind <> c.kind AND NOT (t.kind = 'int' AND c.kind = 'float'))
    SELECT 'invoices' AS origin, row_id AS record_id, 0 AS row_index, 'value' AS reason FROM invoices WHERE {_bad('invoice_number', 'total')}
    UNION ALL SELECT 'invoices_raw', raw_id, 0, reason FROM rec WHERE reason IS NOT NULL
    UNION ALL SELECT 'ir_tables', table_id, i, 'column_count' FROM grid WHERE len(r) <> len(h)
    UNION ALL SELECT 'ir_tables', table_id, i, 'value' FROM wrong""",
    "p3_profile": " UNION ALL ".join(
        f"""SELECT load_id, '{c}' AS column_name, count(*) AS n, count_if({c} IS NULL)::BIGINT AS nulls, count_if(trim({c}) = '')::BIGINT AS blanks, count(DISTINCT CASE WHEN trim({c}) <> '' THEN trim({c}) END) AS "distinct", min(length({c}))::INT AS shortest, max(length({c}))::INT AS longest,
        count({x}) AS numbers, min({x}) AS least, max({x}) AS most FROM invoices GROUP BY load_id"""
        for c, x in (("total", f"CASE WHEN regexp_matches(trim(total), '{_TOTAL}') THEN replace(trim(total), ',', '')::DOUBLE END"), ("vendor", "NULL::DOUBLE"))
    ),
}
