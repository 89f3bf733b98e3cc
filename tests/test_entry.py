"""The driver contract: names match, the flagship runs, columns equal the SQL's, no llm import."""

import ast
import pathlib

import __spark_entry__ as e

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_names_and_flagship(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_core_never_imports_the_text_subpackage():
    for f in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" in f.parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), f
