"""Plug-ins by protocol: connectors, parsers, extractors, validators and emitters, checked when they are registered."""

from __future__ import annotations

from typing import Any

from cellwright.plans.errors import ConfigError

REQUIRED = {"connector": ("supports", "read"), "parser": ("supports", "parse"), "extractor": ("extract",), "validator": ("validate",), "emitter": ("emit",)}


class PluginRegistry:
    """Plug-ins in the order of their registration; the same name again replaces."""

    def __init__(self) -> None:
        self._plugins: dict[str, dict[str, Any]] = {k: {} for k in REQUIRED}

    def register(self, kind: str, plugin: Any) -> None:
        if kind not in REQUIRED:
            raise ConfigError(f"unknown kind of plug-in {kind!r}")
        missing = [m for m in REQUIRED[kind] if not callable(getattr(plugin, m, None))]
        if missing or not getattr(plugin, "name", None):
            raise ConfigError(f"a {kind} needs a name and {', '.join(missing or REQUIRED[kind])}")
        self._plugins[kind][plugin.name] = plugin

    def names(self, kind: str) -> list[str]:
        return list(self._plugins[kind])

    def supporting(self, kind: str, what: Any) -> Any:
        """The first plug-in that supports ``what``."""
        if (found := self.find(kind, what)) is None:
            raise LookupError(f"no {kind} supports {what!r}")
        return found

    def find(self, kind: str, what: Any) -> Any | None:
        return next((p for p in self._plugins[kind].values() if p.supports(what)), None)
