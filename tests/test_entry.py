"""The rest works without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "ledgerframe", tmp_path / "ledgerframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(o) <= set(q) and not any(n.startswith(f'op{i}_') for n in q for i in range(1, 14)) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_import_without_a_library_of_the_subpackage():
    """The other queries stay, and a warning names what is not there."""
    code = "import sys, warnings; sys.modules['sentencepiece'] = None; w = warnings.catch_warnings(record=True); told = w.__enter__(); warnings.simplefilter('always'); import __spark_entry__ as e; assert len(e.queries()) > 30 and 'pipeline' not in e.queries() and any('sentencepiece' in str(x.message) for x in told)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "ledgerframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "ledgerframe").parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path
