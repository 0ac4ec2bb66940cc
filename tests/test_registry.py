"""The library imports and registers without the training-data folders."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from attestry import registry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 130


def test_nothing_else_imports_llm():
    for path in (ROOT / "attestry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "attestry.llm" not in path.read_text(), path


def test_entry_without_llm(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('attestry.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert q and not any(n.startswith('op') for n in q); e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
