"""The driver's contract on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry_module


def test_entry(spark, data):
    assert entry_module.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_rest_without_llm():
    import ast
    from pathlib import Path

    root = Path(entry_module.__file__).parent / "cellwright"
    for file in root.rglob("*.py"):
        if "llm" in file.relative_to(root).parts:
            continue
        names = [n.module or "" for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.ImportFrom)]
        assert not any(n.startswith("cellwright.llm") for n in names), file
