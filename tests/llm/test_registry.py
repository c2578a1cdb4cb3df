from __future__ import annotations

import re

import __spark_entry__
import corpus_pipeline
from framewright.llm import registry
from tests.oracle import assert_same, connect

DATA = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_as_their_sql(spark):
    con = connect(DATA)
    for name, sql in registry.ORACLE_SQL.items():
        assert_same(registry.QUERIES[name](spark, DATA).toPandas(), con.execute(sql).df())
