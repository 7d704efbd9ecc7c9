"""Exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import topk


def brute(rows, queries, k):
    out = []
    for qid, q in {(i, tuple(v)) for i, v in queries}:
        width = max([len(q), *(len(v) for _, v in rows)])
        pad = lambda v: list(v) + [0] * (width - len(v))
        scored = sorted((-sum(a * b for a, b in zip(pad(q), pad(v))), i) for i, v in rows if i != qid)[:k]
        out += [(qid, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 4096, 128), (50, 7, 3)])
@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "huge"])
def test_brute_force(spark, monkeypatch, blocks, kind):
    for name, value in zip(("CANDIDATES", "QUERIES", "TOGETHER"), blocks):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 20)) * 1000
    if kind == "clusters":
        data = data[rng.integers(0, 5, 300)] + rng.normal(size=(300, 20)) * 10
    if kind == "ties":
        data = rng.integers(-1, 2, size=(300, 20)) * 5
        data[50:200] = data[50]
    if kind == "huge":
        data = data * 200_000
    rows = [(i, [int(x) for x in v]) for i, v in enumerate(np.floor(data))]
    rows += [(700, [5, -3]), (701, []), (rows[9][0], rows[9][1])]
    queries = [r for r in rows if r[0] % 10 == 0] + [rows[10]]
    frame = spark.createDataFrame([*rows, (None, [1]), (5000, None)], "id long, vector array<bigint>")
    asked = spark.createDataFrame([*queries, (1, None)], "id long, vector array<bigint>")
    assert sorted(map(tuple, topk.exact_top_k(frame, asked, 10).collect())) == brute(rows, queries, 10)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(1, [1, 2]), (2, [3, 4]), (3, [-1, 0])]
    frame = spark.createDataFrame(rows, "id long, vector array<bigint>")
    assert sorted(map(tuple, topk.exact_top_k(frame, frame, 10).collect())) == brute(rows, rows, 10)
    assert topk.exact_top_k(frame.limit(0), frame, 3).count() == 0 and topk.exact_top_k(frame, frame.limit(0), 3).count() == 0


def test_quantised(spark):
    rows = [(1, [0.5, -0.0001]), (2, [float("nan")]), (3, [float("inf"), 1.0]), (4, [1.0, None]), (5, None), (6, [])]
    frame = spark.createDataFrame(rows, "i int, v array<float>")
    assert {r.i: r.q for r in frame.select("i", topk.quantised(F.col("v")).alias("q")).collect()} == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_bounds_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64)) * 1024
    data = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 64)) * 60)
    found = topk.Found(8, 10)
    carried = topk.search_block(found, np.arange(8), np.arange(8), data[:8].T.copy(), np.arange(4000), data.T.copy())
    assert carried < 8 * 4000 * 0.2
