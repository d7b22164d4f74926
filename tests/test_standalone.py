import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_works_without_the_llm_folders(tmp_path, also):
    """The rest of the library imports nothing from the llm subpackage, whether the pipeline's module goes with it or stays."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for folder in ("terrainframe/llm", "tests/llm"):
        shutil.rmtree(copy / folder)
    for name in also:
        (copy / name).unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_only_the_entry_module_knows_the_subpackage():
    for p in (ROOT / "terrainframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "terrainframe.llm" not in p.read_text(), p
