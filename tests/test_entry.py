"""The entry module with and without the folder of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from termloom.plans import oracle, queries

ROOT = Path(__file__).resolve().parent.parent
COUNTS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_library_stands_without_the_folder(tmp_path, pipeline):
    shutil.copytree(ROOT / "termloom", tmp_path / "termloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    found = subprocess.run([sys.executable, "-c", COUNTS], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert found.stdout.split() == [str(len(queries.QUERIES)), str(len(oracle.SQL))], found.stderr
