"""The repository works without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
LIST = "import __spark_entry__ as e; n = e.queries(); assert n and set(e.oracle_sql()) <= set(n); assert not [x for x in n if x.startswith('op') or x == 'pipeline']"
RUN = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert e.queries()["overview_facets"](s, "{SF}").count() > 0
"""


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_without_the_subpackage(tmp_path, pipeline_stays):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if not pipeline_stays:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = LIST + RUN * (not pipeline_stays and Path(SF).is_dir())
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**__import__("os").environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=180)
    assert not done.returncode, done.stderr[-2000:]
