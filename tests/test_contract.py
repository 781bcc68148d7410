import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_nothing_imports_the_llm_package():
    for path in (ROOT / "siftline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "siftline.llm" not in path.read_text()


def test_modules_import():
    for path in (ROOT / "siftline").rglob("*.py"):
        name = ".".join(path.relative_to(ROOT).with_suffix("").parts)
        importlib.import_module(name.removesuffix(".__init__"))


def test_command_line_help():
    out = subprocess.run([sys.executable, "-m", "siftline.cli", "--help"], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert out.returncode == 0 and all(c in out.stdout for c in ("draft", "check", "score", "serve"))
