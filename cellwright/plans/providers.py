"""Language models by name: ``provider/model`` leads to a completion function that the caller has registered.

No network client comes with this package; without a provider everything runs on rules alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from cellwright.plans.errors import ConfigError

Complete = Callable[[str, str], str]


class Providers:
    """Completion functions ``(model, prompt) -> text`` by the provider's name."""

    def __init__(self, **known: Complete):
        self._known = dict(known)

    def register(self, name: str, complete: Complete) -> None:
        self._known[name] = complete

    def resolve(self, model: str) -> Callable[[str], str]:
        """The completion of ``provider/model``; both parts are needed."""
        provider, _, name = model.partition("/")
        if not provider or not name:
            raise ConfigError(f"a model is named provider/model, not {model!r}")
        if provider not in self._known:
            raise ConfigError(f"no provider {provider!r} is registered")
        complete = self._known[provider]
        return lambda prompt: complete(name, prompt)

    def mapper(self, model: str, columns: list[str], hints: str = "") -> Callable[[dict[str, Any]], dict[str, Any]]:
        """A field mapper that asks the model for ``columns`` of a row as one JSON object."""
        complete = self.resolve(model)

        def ask(row: dict[str, Any]) -> dict[str, Any]:
            prompt = f"{hints}\nGive the fields {json.dumps(columns)} of this row as one JSON object:\n{json.dumps(row, default=str)}".strip()
            found = json.loads(complete(prompt))  # what is no JSON is a ValueError and asked for again
            if not isinstance(found, dict):
                raise ValueError("the model gave no JSON object")
            return found

        return ask
