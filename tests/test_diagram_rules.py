"""Rules on diagrams: results on small rows, and tasks that follow the rows."""

import __spark_entry__ as entry
from plinth.operators import tabletyping as T
from plinth.plans import registry

SF = "/root/testdata/sf0.001"


def test_rules_on_small_diagrams(spark):
    assets = spark.createDataFrame([("r", a, "diagram", "auto", None) for a in "abcdefgh"] + [("r", "z", "diagram", "force", "table")], "request_id string, asset_id string, kind string, hint_mode string, hint_kind string")
    nodes = spark.createDataFrame(
        [(a, k, f"n{k}", None) for a in "abcdefg" for k in range(3)] + [("b", 3, "n1", None), ("c", 3, "x", "ghost"), ("h", 0, None, None)], "asset_id string, node_ix int, id string, parent_id string"
    )
    edges = spark.createDataFrame([("d", "n0", "n9"), ("a", "n0", "n1"), ("g", None, "n1")], "asset_id string, source string, target string")
    places = [("a", 0, "n0"), ("a", 1, "n1"), ("a", 2, "n2"), ("e", 0, "n0"), ("f", 0, "n0"), ("f", 1, "n1"), ("f", 2, "n2"), ("f", 3, "n2"), ("h", 0, None)]
    order = spark.createDataFrame(places, "asset_id string, order_ix int, id string")
    want = {("b", "duplicate_node_id"), ("c", "unknown_parent"), ("d", "unknown_edge_node"), ("g", "unknown_edge_node"), ("e", "invalid_order"), ("f", "invalid_order"), ("h", "invalid_order"), ("z", "forced_kind_not_allowed")}
    for tasks in ((), (3,)):
        got = T.validate_diagrams(assets, nodes, edges, order, *tasks).collect()
        assert len(got) == len(want) and {(r.path[len("structured_assets["):-1], r.code) for r in got} == want


def test_tasks_of_validate_diagrams_follow_rows(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    want = entry.queries()["validate_diagrams"](spark, SF).count()
    monkeypatch.setattr(registry, "TASK_ROWS", rows // 20)
    found = entry.queries()["validate_diagrams"](spark, SF)
    assert found.rdd.getNumPartitions() >= 40 and found.count() == want
