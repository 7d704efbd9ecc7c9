"""Tasks of derived tables dealt over a key follow the rows of the given tables."""

import pytest

import __spark_entry__ as entry
from plinth.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["chart_table_inventory", "recover_jobs"])
def test_tasks_follow_rows(spark, monkeypatch, name):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    want = entry.queries()[name](spark, SF).count()
    monkeypatch.setattr(registry, "TASK_ROWS", rows // 20)
    found = entry.queries()[name](spark, SF)
    assert found.rdd.getNumPartitions() >= 20
    assert found.count() == want
