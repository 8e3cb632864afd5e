"""Running a plan: stages compose lazy frames, so Catalyst sees the whole pipeline; one action at the end."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators import lineage
from cellwright.plans.catalog import Context, Image, resolve_image
from cellwright.plans.errors import BackendError, PipelineError
from cellwright.plans.model import Manifest, Pipeline, Stage, credential
from cellwright.plans.planner import Plan, make_plan
from cellwright.plans.plugins import PluginRegistry
from cellwright.session import staged
from cellwright.sinks.export import write_export


@dataclass
class Event:
    phase: str
    state: str
    seconds: float = 0.0
    detail: str = ""


@dataclass
class Result:
    plan: Plan
    frame: DataFrame
    notes: dict[str, dict[str, Any]]
    events: list[Event] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)
    notices: list[Event] = field(default_factory=list)

    def provenance(self, key: str = "_ord") -> DataFrame:
        return lineage.resolve_terminal(self.frame, key)


def fingerprint(stage: Stage, upstream: list[str], source: Any) -> str:
    """What a stage's output depends on: image, settings, source and what it is fed."""
    text = json.dumps([stage.image, stage.config, repr(source), upstream], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def execute(spark: SparkSession, pipeline: Pipeline, images: dict[str, Image] | None = None, backend: str = "process", sink: Callable[[Event], None] | None = None, mapper: Callable[[dict[str, Any]], dict[str, Any]] | None = None, judge: Callable[[Column, Column], Column] | None = None, plugins: PluginRegistry | None = None) -> Result:
    """Plans and composes the pipeline.  Stages with equal fingerprints are one frame; one with several users is written once.

    ``mapper`` proposes cells (a language model, say), ``judge`` replaces the grounding scorer, ``plugins`` may hold
    connectors for further sources.

    In permissive mode a stage that loses lineage has it replaced by a broken one; in strict mode the plan refuses it.
    """
    if backend not in ("process", "spark"):
        raise BackendError(f"backend {backend!r} is not available")
    stages = pipeline.all_stages()
    found = {s.id: (images or {}).get(s.image) or resolve_image(s.image) for s in stages}
    manifests: dict[str, Manifest] = {k: i.manifest for k, i in found.items()}
    plan = make_plan(stages, manifests, pipeline.mode == "strict")
    users = {s.id: sum(s.id in other.needs for other in stages) for s in stages}
    frames: dict[str, DataFrame] = {}
    prints: dict[str, str] = {}
    done: dict[str, DataFrame] = {}
    result = Result(plan, None, {})  # type: ignore[arg-type]

    def tell(event: Event) -> None:
        result.events.append(event)
        if sink:
            sink(event)

    result.notices = consent(pipeline, bool(mapper or judge))
    for wave in plan.waves:
        for sid in wave:
            stage = plan.stages[sid]
            source = stage.source or pipeline.source
            prints[sid] = fingerprint(stage, [prints[n] for n in stage.needs], source)
            if prints[sid] in done:
                frames[sid] = done[prints[sid]]
                continue
            ctx = Context(spark, source, dict(stage.config), pipeline.schema_mode, pipeline.columns, pipeline.threshold, pipeline.dedup, mapper, pipeline.retries, judge, plugins)
            began = time.monotonic()
            tell(Event(sid, "started"))
            try:
                out = found[sid].run([frames[n] for n in stage.needs], ctx)
            except Exception as e:
                tell(Event(sid, "failed", time.monotonic() - began, str(e)))
                result.errors[sid] = str(e)
                raise e if isinstance(e, PipelineError) else PipelineError(f"stage {sid!r}: {e}") from e
            if lineage.LINEAGE not in out.columns and pipeline.mode == "permissive":
                out = lineage.mark_broken(out, lineage.data_columns(out))
            if users[sid] > 1:
                out = staged(out)
            frames[sid] = done[prints[sid]] = out
            result.notes[sid] = ctx.notes
            tell(Event(sid, "completed", time.monotonic() - began))
    result.frame = frames[plan.terminal]
    if pipeline.export and pipeline.export.path:
        declared = pipeline.export.format or next((n["preferred_format"] for n in reversed(list(result.notes.values())) if "preferred_format" in n), None)
        write_export(result.frame, pipeline.export.path, declared, pipeline.export.include_lineage)
    return result


def consent(pipeline: Pipeline, injected: bool, env: dict[str, str] | None = None) -> list[Event]:
    """What the user is told before a run: once that data goes to a model's provider, or for each source that it does not.

    A provider is in use if the pipeline names a model and its key is there, or if a function was injected.
    """
    model = str(pipeline.llm.get("model") or "")
    dotenv = Path(pipeline.env_file).read_text() if pipeline.env_file and Path(pipeline.env_file).is_file() else ""
    if injected or (model and credential(model.partition("/")[0], dict(os.environ) if env is None else env, dotenv)):
        return [Event("consent", "notice", detail=f"cells are sent to {model or 'an injected function'}")]
    sources = [s.source for s in pipeline.all_stages() if s.source] or [pipeline.source]
    return [Event("availability", "notice", detail=f"{s.path or s.uri}: no language model, rules only") for s in sources if s]


def result_payload(frame: DataFrame, most_rows: int = 200) -> dict[str, Any]:
    """A result as plain data for a page: its columns, first rows and profiles."""
    from cellwright.operators.profile import column_profiles, histogram, top_values

    data = lineage.data_columns(frame)
    profiles = []
    for row in column_profiles(frame, data).collect():  # one row a column
        c = row["column"]
        more = histogram(frame, c) if row["kind"] == "numeric" else top_values(frame, c)
        profiles.append(row.asDict() | {"values": [r.asDict() for r in more.collect()]})
    shown = frame.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in data]).limit(most_rows)
    return {"columns": data, "profiles": profiles, "rows": [r.asDict() for r in shown.collect()]}


def privacy_summary(plan: Plan, manifests: dict[str, Manifest], llm: bool) -> dict[str, str]:
    """Which stages may send data elsewhere: those whose image says so, and with a language model those that can use it."""
    outside = lambda m: m.privacy != "local_only" or (llm and "llm" in m.engine_modes)
    return {sid: "external" if outside(manifests[sid]) else "local" for sid in plan.stages}
