"""A local registry of image manifests: push, pull, search, inspect; the latest version by number, not by text."""

from __future__ import annotations

import json
import re
import shutil
import tarfile
from dataclasses import asdict, replace
from importlib import metadata
from pathlib import Path

from cellwright.plans.errors import ImageError
from cellwright.plans.model import ArtifactType, Manifest


def version_key(version: str) -> tuple:
    """Orders versions by their numbers; a pre-release comes before its release."""
    numbers, _, pre = version.lstrip("v").partition("-")
    return tuple(int(x) for x in re.findall(r"\d+", numbers)), not pre, pre


def to_json(manifest: Manifest) -> str:
    return json.dumps(asdict(manifest), indent=2, sort_keys=True)


def from_json(text: str) -> Manifest:
    raw = json.loads(text)
    raw["accepts"] = [ArtifactType(**a) for a in raw["accepts"]]
    raw["emits"] = ArtifactType(**raw["emits"])
    return Manifest(**raw)


class ImageStore:
    """Images in a folder: ``<name>/<version>/manifest.json`` and a mark for private ones."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def push(self, manifest: Manifest, private: bool = False) -> Path:
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", manifest.name):
            raise ImageError(f"not an image name: {manifest.name!r}")
        folder = self.root / manifest.name / manifest.version
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "manifest.json").write_text(to_json(manifest))
        mark = folder / "private"
        mark.touch() if private else mark.unlink(missing_ok=True)
        return folder

    def versions(self, name: str) -> list[str]:
        folder = self.root / name
        return sorted((p.name for p in folder.iterdir() if (p / "manifest.json").exists()), key=version_key) if folder.is_dir() else []

    def inspect(self, ref: str) -> Manifest:
        name, _, version = ref.partition(":")
        known = self.versions(name)
        if not known or (version and version != "latest" and version not in known):
            raise ImageError(f"no image {ref!r}")
        chosen = known[-1] if version in ("", "latest") else version
        return from_json((self.root / name / chosen / "manifest.json").read_text())

    def pull(self, ref: str, cache: str | Path) -> Path:
        manifest = self.inspect(ref)
        target = Path(cache) / manifest.name / manifest.version
        if not target.exists():
            shutil.copytree(self.root / manifest.name / manifest.version, target)
        return target

    def search(self, text: str = "", private: bool = False) -> list[Manifest]:
        names = sorted(p.name for p in self.root.iterdir() if p.is_dir()) if self.root.is_dir() else []
        found = [self.inspect(n) for n in names if text.lower() in n.lower() and self.versions(n)]
        return [m for m in found if private or not (self.root / m.name / m.version / "private").exists()]

    def build(self, manifest: Manifest, packages: list[str] | None = None, private: bool = False) -> Path:
        """Pushes a manifest with the installed versions of ``packages`` pinned in it; a package that is not there is an error."""
        pins = {}
        for name in packages or []:
            try:
                pins[name] = metadata.version(name)
            except metadata.PackageNotFoundError as e:
                raise ImageError(f"package {name!r} is not installed and cannot be pinned") from e
        return self.push(replace(manifest, pins=manifest.pins | pins), private)

    def seed(self, manifests: list[Manifest]) -> list[str]:
        """Pushes those manifests whose version is not there yet; their names."""
        new = [m for m in manifests if m.version not in self.versions(m.name)]
        for m in new:
            self.push(m)
        return [m.name for m in new]

    def unpack(self, archive: str | Path) -> str:
        """Adds a packed image; ``name:version`` of it."""
        with tarfile.open(archive) as tar:
            inner = next((m for m in tar.getmembers() if m.isfile() and Path(m.name).name == "manifest.json"), None)
            if inner is None:
                raise ImageError(f"{archive} holds no manifest")
            manifest = from_json(tar.extractfile(inner).read().decode())  # type: ignore[union-attr]
        self.push(manifest)
        return f"{manifest.name}:{manifest.version}"

    def pack(self, ref: str, path: str | Path) -> Path:
        m = self.inspect(ref)
        with tarfile.open(path, "w:gz") as tar:
            tar.add(self.root / m.name / m.version, arcname=f"{m.name}-{m.version}")
        return Path(path)
