"""Mixing against a plain version of water-filling and prefix sampling."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from plinth.llm import mixing
from plinth.llm.queries import ORACLES


def plain(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, clamped = {}, set()
    while True:
        free = [s for s in order if s not in clamped]
        rest = sum(total.values()) - sum(3 * total[s] for s in clamped)
        target = {s: 3 * total[s] for s in clamped} | {s: rest / sum(weight[x] for x in free) * weight[s] for s in free}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        clamped |= over
    return size, total, target


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        source = rng.choices(["big", "mid", "Small", "ä", None, ""], [60, 20, 5, 2, 5, 3])[0]
        rows.append((i, " ".join(["w"] * rng.randrange(1, 60)) + rng.choice(["", "\n\t", " "]), source))
    rows += [(900, None, "empty"), (901, "", "empty"), (None, "a b c", "mid"), (5, "x y", "big"), (5, "x y", "big"), (950, "w " * 30000, "big"), (951, "w " * 3, "tiny")]
    return rows


@pytest.mark.parametrize("at_once", [50_000, 0])
def test_mixture(spark, monkeypatch, at_once):
    monkeypatch.setattr(mixing, "SOURCES_AT_ONCE", at_once)
    rows = corpus()
    frame = spark.createDataFrame([(d, t, s, "x", 1) for d, t, s in rows], "doc_id long, text string, source string, size string, target int")
    got = mixing.mixture(frame).collect()
    size, total, target = plain(rows)
    assert sorted(((r.doc_id, r["size"], r.source_size) for r in got), key=repr) == sorted(((d, n, total[s]) for (d, _, s), n in zip(rows, size)), key=repr)
    of = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[of[r.doc_id]]) and r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        taken[of[r.doc_id]] += r.taken
    for s in total:
        largest = max(n for n, (_, _, x) in zip(size, rows) if x == s)
        assert abs(taken[s] - target[s]) <= max(largest, 4)
    con = duckdb.connect()
    data = frame.select("doc_id", "text", "source").toArrow()
    con.register("documents", data)
    want = con.execute(ORACLES["op8_mixing"]).df().sort_values(["doc_id", "size"]).reset_index(drop=True)
    mine = mixing.mixture(frame).drop("times").toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True)
    assert (want["taken"] == mine["taken"]).all() and want["target"].sub(mine["target"]).abs().max() < 1e-6
    assert hashlib.md5(b"42:5").hexdigest() == spark.range(1).select(mixing.digest_of(mixing.F.lit(5), 42)).first()[0]


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, s, "x") for d, t, s in rows], "doc_id long, text string, source string, cut string")
    counted = {}
    for r in mixing.mixture(frame).collect():
        counted[r.doc_id] = counted.get(r.doc_id, 0) + r.times
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in counted.items() if n}
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixture(frame.limit(0)).count() == 0
