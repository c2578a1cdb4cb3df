from __future__ import annotations

import subprocess
import sys

import pytest

import __spark_entry__
from framewright.plans import catalog
from tests.oracle import assert_same, connect

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_as_its_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_epoch_order_is_a_permutation(spark):
    rows = catalog.QUERIES["epoch_order"](spark, DATA).toPandas()
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert sorted(rows.place) == list(range(128, n)) and rows.event_id.is_unique


def test_library_and_entry_without_the_llm_folders(tmp_path):
    """The entry point works where the subpackage and the pipeline are gone."""
    import shutil
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "framewright", tmp_path / "framewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
