"""Contamination against brute force over windows."""

import hashlib
import random
import re

import pytest

from plinth.llm import decontamination as D


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(rows, items):
    out = []
    for doc_id, text in rows:
        own, hit, names = plain_words(text), set(), set()
        for item_id, item in items:
            for w in D.windows_of(plain_words(item)):
                for i in range(len(own) - len(w) + 1):
                    if tuple(own[i : i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        names.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(own), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "É", "x1"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 13, 14, 40])))) for i in range(12)]
    items += [(None, "the the the"), (3, items[2][1]), (50, None), (51, " ..! "), (52, "the-of, THE")]
    rows = []
    for d in range(40):
        own = rng.choices(vocabulary, k=rng.randrange(80))
        if rng.random() < 0.6:
            piece = plain_words(rng.choice(items)[1] or "")
            at = rng.randrange(len(own) + 1)
            own[at:at] = piece[rng.randrange(3) : len(piece) - rng.randrange(3)]
        rows.append((d, " ".join(w.upper() if rng.random() < 0.2 else w for w in own)))
    rows += [(90, None), (91, ""), (None, "the THE the"), (92, "the!the?the"), (92, "the!the?the"), (93, " ".join(["the"] * 20000 + plain_words(items[4][1])))]
    return rows, items


@pytest.mark.parametrize("block_words,shard", [(D.BLOCK_WORDS, D.SHARD_BYTES), (40, 300)])
def test_matches_brute_force(spark, monkeypatch, block_words, shard):
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, shard string, items int")
    tests = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    found = D.find_matches(docs, tests, block_words=block_words).collect()
    got = []
    for r in found:
        hit = sum(s.last - s.first + 1 for s in r.spans)
        got.append((r.doc_id, r.n_words, hit, r["items"], hit > 0 and 20 * hit >= r.n_words))
    assert sorted(got, key=repr) == plain(rows, items)


def test_removal_and_digest(spark):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, "a") for d, t in rows], "doc_id long, text string, lang string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    kept = D.remove_contaminated(docs, tests)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([r[0] for r in plain(rows, items) if not r[4]], key=repr)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha big beta gamma"), (3, "gamma beta zz alpha"), (4, "alpha x x x x beta gamma")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert {r.doc_id for r in D.find_matches(docs, tests, slack=1).collect() if r["items"]} == {1, 2}
    assert {r.doc_id for r in D.find_matches(docs, tests).collect() if r["items"]} == {1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_hit, r.contaminated) for r in D.contamination(docs, none).collect()] == [(0, False)]
    assert D.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_index_without_vocabulary_holds_every_word(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "c a")], "doc_id long, text string").coalesce(1)
    row = D.build_index(docs, str(tmp_path / "index")).collect()[0]
    import numpy as np

    at = np.split(np.frombuffer(bytes(row.positions), np.uint32), np.cumsum(row.counts)[:-1])
    assert {bytes(t): p.tolist() for t, p in zip(row.terms, at)} == {b"b": [0, 2], b"a": [1, 6], b"c": [5]}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
