"""Command line: start a project, run and validate pipeline files, and the catalog and registry of images."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from cellwright import __version__

EXAMPLE = """source: {type: files, path: in/}
pipeline:
  - {id: read, image: document-extractor}
  - {id: clean, image: normalizer, needs: [read]}
export: {path: out/, format: parquet}
"""
#: Commands with their arguments; a leading dash makes an option.
COMMANDS: dict[str, tuple[str, list[str]]] = {
    "init": ("write an example pipeline file and keep .env out of version control", ["folder?"]),
    "login": ("keep a provider's key, read from standard input, in .env", ["provider"]),
    "run": ("run a pipeline file", ["file", "--export", "--serve!"]),
    "validate": ("check a pipeline file and show its waves", ["file"]),
    "catalog": ("list the images", []),
    "seed": ("push the catalog's images to a registry", ["--store"]),
    "search": ("find images of a registry", ["what?", "--store"]),
    "inspect": ("show an image's manifest", ["what", "--store"]),
    "pull": ("copy an image to a folder", ["what", "folder", "--store"]),
    "push": ("add a packed image to a registry", ["archive", "--store"]),
    "build": ("add an image by its manifest file, packages pinned", ["manifest", "--pin*", "--store"]),
    "pack": ("pack an image", ["what", "archive", "--store"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellwright")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (what, arguments) in COMMANDS.items():
        p = sub.add_parser(name, help=what)
        for a in arguments:
            if a.endswith("!"):
                p.add_argument(a[:-1], action="store_true")
            elif a.endswith("?"):
                p.add_argument(a[:-1], nargs="?", default="")
            elif a.endswith("*"):
                p.add_argument(a[:-1], action="append", default=[])
            else:
                p.add_argument(a, **({"default": ".cellwright/images"} if a == "--store" else {}))
    return top


def _project(args: argparse.Namespace) -> None:
    from cellwright.plans import model

    folder = Path(getattr(args, "folder", "") or ".")
    folder.mkdir(parents=True, exist_ok=True)
    model.ignore_secrets(folder)
    if args.command == "init":
        if not (folder / "pipeline.yaml").exists():
            (folder / "pipeline.yaml").write_text(EXAMPLE)
        print(folder / "pipeline.yaml")
        return
    name, file = f"{args.provider.upper()}_API_KEY", folder / ".env"
    kept = [x for x in (file.read_text().splitlines() if file.exists() else []) if not x.startswith(name + "=")]
    file.write_text("\n".join([*kept, f"{name}={sys.stdin.readline().strip()}"]) + "\n")
    file.chmod(0o600)


def _registry(args: argparse.Namespace) -> None:
    from cellwright.plans import catalog, store

    if args.command == "catalog":
        for name, image in sorted(catalog.IMAGES.items()):
            print(f"{name}\t{image.manifest.description}")
        return
    images = store.ImageStore(args.store)
    match args.command:
        case "seed":
            print("\n".join(images.seed([i.manifest for i in catalog.IMAGES.values()])))
        case "search":
            for m in images.search(args.what):
                print(f"{m.name}:{m.version}\t{m.description}")
        case "inspect":
            print(store.to_json(images.inspect(args.what)))
        case "pull":
            print(images.pull(args.what, args.folder))
        case "push":
            print(images.unpack(args.archive))
        case "build":
            print(images.build(store.from_json(Path(args.manifest).read_text()), args.pin))
        case "pack":
            print(images.pack(args.what, args.archive))


def _pipeline(args: argparse.Namespace) -> None:
    from cellwright.plans import catalog, executor, model, planner, serve

    pipeline = model.load_pipeline(args.file)
    stages = pipeline.all_stages()
    plan = planner.make_plan(stages, {s.id: catalog.resolve_image(s.image).manifest for s in stages}, pipeline.mode == "strict")
    if args.command == "validate":
        print(json.dumps({"waves": plan.waves, "terminal": plan.terminal, "warnings": plan.warnings}))
        return
    from cellwright.session import build_session

    if args.export:
        pipeline.export = model.Export(args.export)
    result = executor.execute(build_session(), pipeline, sink=lambda e: print(f"{e.phase}: {e.state} {e.detail}".rstrip(), file=sys.stderr))
    for notice in result.notices:
        print(f"{notice.phase}: {notice.detail}", file=sys.stderr)
    if args.serve:
        expose = pipeline.expose or model.Expose()
        print(f"http://{expose.host}:{expose.port}/")
        serve.make_server(executor.result_payload(result.frame), expose).serve_forever()
    elif not (pipeline.export and pipeline.export.path):
        result.frame.drop("_lineage").show(20, truncate=40)


def main(argv: list[str] | None = None) -> int:
    from cellwright.plans.errors import PipelineError

    args = parser().parse_args(argv)
    part = _project if args.command in ("init", "login") else _pipeline if args.command in ("run", "validate") else _registry
    try:
        part(args)
    except PipelineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
