"""Every query against its SQL on the smallest tables, and what the plans must not hold."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    frame = queries()[name](spark, FOLDER)
    if name in oracle_sql():
        assert compare(frame, connection, oracle_sql()[name]) is None
    else:
        assert len(frame.collect()) > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_scans_are_pruned(spark):
    plan = queries()["keyword_scoring"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "text" in schema and "source" not in schema and "n_chars" not in schema


def test_scoring_does_not_shuffle(spark):
    from mailprism.plans.scoring import score_messages

    tasks = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("cast(doc_id as string) task_id", "text")
    plan = score_messages(tasks, exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
