"""Every query with SQL gives the rows that DuckDB gives; all others run."""

import os

import pytest

import __spark_entry__
from siltstone.registry import QUERIES, SQL

from .oracle import connection, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are elsewhere")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    if name in SQL:
        want = duck_rows(connection(FOLDER), SQL[name])
        assert got[0] == want[0]
        assert got[1] == want[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rest_works_without_llm(tmp_path):
    """The driver deletes the llm folders and the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0 and int(said.stdout) == len(QUERIES), said.stderr[-500:]
