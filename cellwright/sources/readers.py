"""Sources: files, SQL queries, REST payloads and records, each as a lazy frame."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.sources.parsers import EXTENSIONS


def detect_content_type(path: Column) -> Column:
    """The content type by a path's extension, lower-cased; unknown ones are ``application/octet-stream``."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(EXTENSIONS.items())])
    return F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream"))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``source_id, content_type, modified, length, content`` of files; the content is read only if it is used."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select(
        F.col("path").alias("source_id"), detect_content_type(F.col("path")).alias("content_type"),
        F.col("modificationTime").alias("modified"), "length", "content",
    )


def sql_source(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """The rows of one query, over registered views or through JDBC (``url`` and further options)."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).option("query", query).load()
    return spark.sql(query, **(views or {}))


def records_path(payload: Column, path: str = "") -> Column:
    """Records of a JSON payload under a dotted path, as an array of VARIANT: a list, or one object as its only record.

    NULL where the payload is no JSON or the path leads nowhere.
    """
    place = "$" + "".join(f".{p}" for p in path.split(".") if p)
    found = F.try_variant_get(F.try_parse_json(payload), place, "variant")
    return F.coalesce(F.try_variant_get(found, "$", "array<variant>"), F.when(found.isNotNull(), F.array(found)))


def fetch(url: str, headers: dict[str, str] | None = None, timeout: float = 30.0) -> tuple[str, bytes]:
    """Content type and body of one http(s) address; for use on executors by a frame of addresses."""
    from urllib.request import Request, urlopen

    if not url.lower().startswith(("http://", "https://")):
        raise ValueError("not an http address")
    with urlopen(Request(url, headers=headers or {}), timeout=timeout) as answer:  # noqa: S310
        return answer.headers.get_content_type(), answer.read()


def http_sources(urls: DataFrame, headers: dict[str, str] | None = None, timeout: float = 30.0) -> DataFrame:
    """``source_id, content_type, content, error`` of a frame of ``url``: fetched by the executors, errors as rows."""

    def run(batches):
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    kind, body = fetch(url, headers, timeout)
                    rows.append((url, kind, body, None))
                except Exception as e:  # each address fails alone
                    rows.append((url, None, None, str(e)))
            yield pdf.__class__(rows, columns=["source_id", "content_type", "content", "error"])

    return urls.select("url").mapInPandas(run, "source_id string, content_type string, content binary, error string")


def api_records(bodies: DataFrame, path: str = "") -> DataFrame:
    """``source_id, content_type, content, error`` of JSON bodies: the objects under a dotted path as flat records.

    Items of a list that are no objects are left out.  A body without records there is an error row.
    """
    found = F.filter(records_path(F.decode("content", "utf-8"), path), lambda r: F.schema_of_variant(r).startswith("OBJECT"))
    text = F.concat(F.lit("["), F.array_join(F.transform(found, lambda r: F.to_json(r)), ","), F.lit("]"))
    read = bodies.withColumn("records", F.when(F.size(found) > 0, F.encode(text, "utf-8")))
    error = F.coalesce("error", F.when(F.col("records").isNull(), F.lit(f"no records under {path!r}")))
    return read.select("source_id", F.lit("application/x-records").alias("content_type"), F.col("records").alias("content"), error.alias("error"))


def records_union(frames: list[DataFrame]) -> DataFrame:
    """Records of several frames as text: all their columns, in the order of first appearance; missing and NULL empty."""
    order = list(dict.fromkeys(c for f in frames for c in f.columns))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in f.columns]) for f in frames])
    return both.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in order])
