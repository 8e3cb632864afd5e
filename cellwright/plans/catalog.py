"""The images of the catalog: each a manifest and a function from frames to a frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.functions import coerce, infer
from cellwright.operators import dedup, extract, ground, lineage, mapping, profile, transforms
from cellwright.plans.errors import ConfigError, ImageError
from cellwright.plans.model import ArtifactType, Manifest, Source
from cellwright.plans.plugins import PluginRegistry
from cellwright.session import staged
from cellwright.sources import parsers, readers


@dataclass
class Context:
    """What a stage knows: the session, its source and settings; what it leaves: notes for the run's result."""

    spark: SparkSession
    source: Source | None = None
    config: dict[str, Any] = field(default_factory=dict)
    schema_mode: str = "infer"
    columns: list[str] | dict[str, str] | None = None
    threshold: float = ground.THRESHOLD
    dedup: dict[str, Any] = field(default_factory=dict)
    mapper: Callable[[dict[str, Any]], dict[str, Any]] | None = None
    retries: int = mapping.RETRIES
    judge: Callable[[Column, Column], Column] | None = None
    plugins: PluginRegistry | None = None
    notes: dict[str, Any] = field(default_factory=dict)


Capability = Callable[[list[DataFrame], Context], DataFrame]


@dataclass
class Image:
    manifest: Manifest
    run: Capability


IMAGES: dict[str, Image] = {}


def image(name: str, description: str, root: bool = False, conformant: bool = True):
    def add(f: Capability) -> Capability:
        accepts = [] if root else [ArtifactType()]
        IMAGES[name] = Image(Manifest(name, description=description, accepts=accepts, conformant=conformant), f)
        return f

    return add


def resolve_image(ref: str) -> Image:
    name = ref.partition(":")[0]
    if name not in IMAGES:
        raise ImageError(f"unknown image {name!r}")
    return IMAGES[name]


def _one(inputs: list[DataFrame], name: str) -> DataFrame:
    if not inputs:
        raise ConfigError(f"{name} needs an input")
    return inputs[0]


def read_source(ctx: Context) -> DataFrame:
    """The stage's source as ``source_id, content_type, content[, error]``; a registered connector goes first."""
    src = ctx.source
    if src is None or not (src.path or src.uri):
        raise ConfigError("a stage that reads needs a source with a path or uri")
    if ctx.plugins is not None and (own := ctx.plugins.find("connector", src)):
        return own.read(src, ctx.spark)
    if src.type in ("files", "file"):
        return readers.binary_files(ctx.spark, src.path or src.uri).select("source_id", "content_type", "content")
    if src.type in ("url", "http", "api"):
        bodies = readers.http_sources(ctx.spark.createDataFrame([(src.uri,)], "url string"), src.headers, src.timeout)
        return readers.api_records(bodies, src.records_path) if src.type == "api" else bodies
    raise ConfigError(f"unknown source type {src.type!r}")


def _place(source: Column | str, note: Column) -> Column:
    return F.array(F.struct(F.col(source).alias("source_id") if isinstance(source, str) else source.alias("source_id"), F.lit(0).alias("index"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("char_span"), note.alias("note")))


def _outcomes(elements: DataFrame, *failed: DataFrame) -> DataFrame:
    """``source_id, error`` of every source: why it was not read, has nothing to extract or failed later, else NULL."""
    table = (F.col("kind") == "table") & (F.size("grid") > 0)
    text = F.coalesce(F.trim("text"), F.lit("")) != ""
    read = elements.groupBy("source_id").agg(F.max("error").alias("error"), F.count_if(table | (F.col("kind").isNotNull() & text)).alias("n"))
    out = read.select("source_id", F.coalesce("error", F.when(F.col("n") == 0, F.lit("neither a table nor a text to extract"))).alias("error"))
    for f in failed:
        out = out.join(f.select("source_id", F.col("reason").alias("later")), "source_id", "left").select("source_id", F.coalesce("error", "later").alias("error"))
    return out


def _table_rows(good: DataFrame, ctx: Context, failed: list[DataFrame]) -> tuple[DataFrame, list[str]]:
    """Cleaned rows of the sources with a table, and their data columns; sources that a strict schema refuses go to ``failed``."""
    table = extract.extract_table(good, list(ctx.columns) if ctx.columns and ctx.schema_mode in ("hint", "strict") else None)
    data = lineage.data_columns(table)
    if ctx.schema_mode == "strict":
        wanted = ctx.columns if isinstance(ctx.columns, dict) else dict.fromkeys(data, "str")
        table, refused = extract.strict_validate(table, wanted)
        failed.append(refused)
        types = {c: wanted.get(c, "str") for c in data}
    elif ctx.schema_mode == "hint":
        types = {c: (ctx.columns if isinstance(ctx.columns, dict) else {}).get(c, "str") for c in data}
    else:
        types = infer.column_types(table, data)
    if ctx.mapper is not None and data:
        # proposals fill empty cells only; rows that differ from them are flagged
        keyed = staged(table.withColumn("_key", F.concat_ws("#", "source_id", "_ord")))
        proposed = staged(mapping.map_fields(keyed, "_key", data, ctx.mapper, ctx.retries))
        ctx.notes["mapping_errors"] = proposed.filter("error is not null").select("_key", "error")
        table = extract.reconcile(keyed, proposed, "_key", data).drop("_key")
    cleaned = coerce.clean(table, types)
    clash = F.coalesce("_conflict", F.lit(False)) if "_conflict" in cleaned.columns else F.lit(False)
    return cleaned.withColumn("_flagged", F.col("_flagged") | clash), data


def _grounded(rows: DataFrame, texts: DataFrame, cells: list[str], ctx: Context) -> DataFrame:
    """Rows with every cell's score in their lineage, flagged below the threshold, or dropped if the stage rejects."""
    as_text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cells}
    scored = ground.score_cells(rows, texts, as_text, judge=ctx.judge)
    flagged = ground.flag_ungrounded(scored, cells, ctx.threshold, ctx.config.get("rejection_mode") == "reject")
    scores = F.create_map(*[x for c in cells for x in (F.lit(c), F.col(f"`_score_{c}`"))])
    mode = "degraded" if ctx.judge is None else "full"
    kept = F.transform_values(
        F.col("_lineage.cells"), lambda k, v: v.withField("faithfulness", F.coalesce(F.try_element_at(scores, k), v["faithfulness"])).withField("grounding_mode", F.lit(mode))
    )
    out = flagged.withColumn("_lineage", F.col("_lineage").withField("cells", kept))
    return lineage.flag_rows(out, F.col("_ground_flag") | F.coalesce("_flagged", F.lit(False)))


TEXT_COLUMNS = ["element", "text", "location"]


def documents_to_table(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    """Source to grounded table: parse, extract, clean, ground, merge near-duplicates; failed sources are noted.

    Every source gives the rows of its first table or, if it has none, its texts as rows of their own columns, so a
    run over both kinds has the columns of both.  An SQL source (``type: sql``, the query as its uri) is a table
    already; its rows are their own source.
    """
    if ctx.source is not None and ctx.source.type == "sql":
        rows = readers.sql_source(ctx.spark, ctx.source.uri or "")
        return lineage.with_lineage(rows, rows.columns, _place(F.lit(f"sql#{ctx.source.uri}"), F.lit("records")))
    # written once: the header, the column types and both ways of extraction read it
    elements = staged(parsers.parse_sources(read_source(ctx)))
    good = elements.filter("error is null").drop("error")
    texts = ground.source_text(good)
    failed: list[DataFrame] = []
    has_table, has_text = good.groupBy("source_id").agg(F.bool_or((F.col("kind") == "table") & (F.size("grid") > 0)).alias("t")).agg(F.bool_or("t"), F.bool_or(~F.col("t"))).first()
    parts = []
    if has_table:
        rows, data = _table_rows(good, ctx, failed)
        both = [c for c in data if has_text and c in TEXT_COLUMNS]
        out = _grounded(rows, texts, data, ctx).withColumns({c: F.col(f"`{c}`").cast("string") for c in both})
        parts.append(out.select("source_id", "_ord", *[F.col(f"`{c}`") for c in data], "_lineage"))
    if has_text or not has_table:
        plain = extract.elements_fallback(good).withColumnRenamed("elem_idx", "_ord")
        plain = lineage.with_lineage(plain, TEXT_COLUMNS, _place("source_id", F.col("location"))).withColumn("_flagged", F.lit(False))
        parts.append(_grounded(plain, texts, ["text"], ctx).select("source_id", "_ord", *TEXT_COLUMNS, "_lineage"))
    ctx.notes["outcomes"] = _outcomes(elements, *failed)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    out = out.select("source_id", "_ord", *[F.col(f"`{c}`") for c in lineage.data_columns(out) if c != "_ord"], "_lineage")
    return merge_near(out, ctx.dedup) if ctx.dedup else out


def merge_near(rows: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """One row a cluster of rows with similar ``keys``: the first one's values, the places of all.

    ``strategy`` may be ``longest``, ``threshold`` the least similarity.  Rows without any of the keys stay alone.
    """
    data = [c for c in lineage.data_columns(rows) if c != "_ord"]
    keys = [k for k in settings["keys"] if k in data]
    if not keys:
        return rows
    # one order over all sources, as rows would be taken
    ordered = staged(rows.withColumn("_at", F.struct("source_id", "_ord")))
    homes = dedup.fuzzy_clusters(ordered, keys, "_at", float(settings.get("threshold", dedup.THRESHOLD)))
    merged = lineage.merge_rows(ordered.join(homes, "_at"), "leader", "_at", data, settings.get("strategy", "first"))
    return merged.select("_at.source_id", "_at._ord", *[F.col(f"`{c}`") for c in data], "_lineage")


for _name, _what in {
    "document-extractor": "tables of any document", "invoice-extractor": "invoices", "receipt-extractor": "receipts",
    "bank-statement-extractor": "bank statements", "report-extractor": "reports", "doc-to-tables": "tables of any document",
}.items():
    image(_name, f"Reads {_what} into a grounded table.", root=True)(documents_to_table)


@image("drop-flagged", "Removes rows that are flagged.")
def _drop_flagged(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    return transforms.drop_flagged(_one(inputs, "drop-flagged"))


@image("data-cleaner", "Removes white space around values.")
def _data_cleaner(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    return transforms.data_cleaner(_one(inputs, "data-cleaner"))


@image("normalizer", "Lower case and single spaces.")
def _normalizer(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    return transforms.normalizer(_one(inputs, "normalizer"), ctx.config.get("columns"))


@image("deduplicator", "Keeps the first row of each combination of keys.")
def _deduplicator(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    df = _one(inputs, "deduplicator")
    keys = ctx.config.get("keys") or lineage.data_columns(df)
    if "_ord" in df.columns:
        return dedup.deduplicate(df.withColumn("_first", F.struct(*[c for c in ("source_id", "_ord") if c in df.columns])), keys, "_first").drop("_first")
    # without an order the first row is the one of the least text
    return dedup.deduplicate(df.withColumn("_first", F.to_json(F.struct("*"))), keys, "_first").drop("_first")


@image("column-mapper", "Renames columns with their lineage.")
def _column_mapper(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    return transforms.column_mapper(_one(inputs, "column-mapper"), ctx.config.get("rename", {}))


@image("pii-redactor", "Masks e-mail addresses, social security and phone numbers.")
def _pii_redactor(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    return transforms.pii_redactor(_one(inputs, "pii-redactor"))


@image("anomaly-flagger", "Flags rows with outliers.")
def _anomaly_flagger(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    return transforms.anomaly_flagger(_one(inputs, "anomaly-flagger"))


@image("data-profiler", "Counts values by column; passes the table on.")
def _data_profiler(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    df = _one(inputs, "data-profiler")
    ctx.notes["profile"] = profile.data_profile(df, lineage.data_columns(df))
    return df


@image("lineage-stripper", "Removes lineage.", conformant=False)
def _strip(inputs: list[DataFrame], ctx: Context) -> DataFrame:
    return transforms.strip_lineage(_one(inputs, "lineage-stripper"))


def _converter(kind: str) -> Capability:
    def run(inputs: list[DataFrame], ctx: Context) -> DataFrame:
        ctx.notes["preferred_format"] = kind
        return _one(inputs, f"any-to-{kind}")

    return run


for _kind in ("json", "csv", "markdown"):
    image(f"any-to-{_kind}", f"Passes the table on to be exported as {_kind}.")(_converter(_kind))


def certify(run: Capability, spark: SparkSession) -> bool:
    """Whether a capability keeps provenance: one row's lineage still has a place for every column that is left."""
    probe = spark.createDataFrame([("probe", 0, "a")], "source_id string, _ord int, value string")
    place = F.array(F.struct("source_id", F.lit(0).alias("index"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("char_span"), F.lit(None).cast("string").alias("note")))
    out = run([lineage.with_lineage(probe, ["value"], place)], Context(spark))
    if lineage.LINEAGE not in out.columns:
        return False
    bad = lineage.conformance_violations(out, "_ord", lineage.data_columns(out)).filter(F.col("rows") > 0)
    return bad.limit(1).count() == 0
