"""Importance resampling against a plain version on one list."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from plinth.llm import resampling


def plain(rows, target, percent=10, least=20, runs=1, buckets=10_000):
    """``doc_id, n_features, weight, score, rank`` as sorted rows."""

    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(found), [" ".join(found[i : i + k]) for k in range(1, runs + 1) for i in range(len(found) - k + 1)]

    def count(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t)[1])

    s, t = count(x for _, x in rows), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        n, found = grams(text)
        weight = math.floor(sum(gain[zlib.crc32(g.encode()) % buckets] for g in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        told = np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).astype(np.int64)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, told])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


WORDS = [f"w{i}" for i in range(200)] + ["Été", "the", "THE", "x1"]


def corpus(n=900):
    rng = random.Random(5)
    rows = [(i if i % 50 else None, " ".join(rng.choices(WORDS, k=rng.randrange(10, 60)))) for i in range(n)]
    rows += [(5000, "the same row here " * 8)] * 300 + [(None, "a lone text " * 9)] * 40
    return rows + [(7000, None), (7001, ""), (7002, "... !!"), (7003, "one\x00two " * 3000)]


@pytest.mark.parametrize("runs", [1, 2])
def test_against_plain(spark, monkeypatch, runs):
    monkeypatch.setattr(resampling, "RUN_ROWS", 100)
    rows, target = corpus(), [f"w{i} w{i + 1} the" for i in range(30)] + [None]
    docs = spark.createDataFrame([(d, t, "a", 0, "c") for d, t in rows], "doc_id long, text string, rank string, segment int, score string").repartition(7)
    found = resampling.ranked(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=60, runs=runs)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()]
    want = [tuple(r[:5]) for r in plain(rows, target, percent=60, runs=runs)]
    assert order(got) == order(want)


def test_drawn_rows_keep_their_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, hash int").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    ranks = resampling.ranked(docs, target)
    want = Counter(r.doc_id for r in ranks.collect() if r["rank"] is not None)
    got = resampling.resample(docs, target)
    assert got.columns == docs.columns
    held = got.collect()
    assert Counter(r.doc_id for r in held) == want
    assert len({r["hash"] for r in held}) == len(held) == sum(want.values())


def test_all_rows_alike_and_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    docs = spark.createDataFrame([(1, "word " * 30)] * 500, "doc_id long, text string").repartition(6)
    got = sorted(r["rank"] for r in resampling.ranked(docs, target).collect() if r["rank"] is not None)
    assert got == list(range(1, 51))
    assert resampling.ranked(docs.limit(0), target).count() == 0
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_splitters_cut_equal_rows_by_run_and_place():
    key = [np.array([-5, -5, -5, -1]), np.zeros(4, bool), np.array([1, 2, 2, 9]), np.array([7, 7, 7, 7])]
    splitter = (-5, False, 2, 7, 3, 2)
    assert [resampling.place(key, n, splitter) for n in (2, 3, 4)] == [3, 2, 1]
