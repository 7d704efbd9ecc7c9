"""Rank-order profiles against a plain version, and held-out accuracy."""

import random
import zlib
from collections import Counter

import pytest

from plinth.llm import language as L


def plain_grams(text):
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    found = Counter()
    for word in raw.split():
        padded = b" " + word + b" "
        for n in L.LENGTHS:
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip():
                    found[g] += 1
    return found


def plain_top(counts, ranks):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:ranks]]


def plain(rows, ranks):
    totals = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2 and lang is not None and text is not None:
            totals.setdefault(lang, Counter()).update(plain_grams(text))
    known = {lang: {g: i for i, g in enumerate(plain_top(c, ranks))} for lang, c in totals.items() if c}
    out = []
    for doc_id, text, _ in rows:
        held = doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2
        if text is None or not any(c.isalpha() for c in text) or not known:
            out.append((doc_id, held, "und", 0.0))
            continue
        own = plain_top(plain_grams(text), ranks)
        far = {lang: sum(abs(p[g] - i) if g in p else ranks for i, g in enumerate(own)) for lang, p in known.items()}
        best = min(sorted(far), key=far.get)
        out.append((doc_id, held, best, round(1 - far[best] / (ranks * max(1, len(own))), 9)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    parts = {"xx": "ba lo ki mu".split(), "yy": "éa ñu sch ti".split(), "zz": "tion the ing".split(), "": "qa wa za".split()}
    rows = []
    for i in range(160):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 40))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in words), lang if rng.random() < 0.8 else None))
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "12 ... !", "zz"), (None, "balo", "xx"), (503, "Ωμ", None), (7, rows[7][1], rows[7][2]), (504, "º²", None), (505, "x", "zz")]
    return rows, parts


@pytest.mark.parametrize("ranks,at_once,chunk", [(L.PROFILE, L.LANGUAGES_AT_ONCE, L.CHUNK), (20, 2, 16)])
def test_plain_version(spark, monkeypatch, ranks, at_once, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    rows, _ = corpus()
    rows.append((900, "balo kimu " * 3000, None))
    frame = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    learned = L.profiles(frame.filter("doc_id IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"), ranks)
    got = L.predict(frame.select("doc_id", "text"), learned, ranks, at_once).collect()
    held = {r.doc_id: r.held_out for r in L.identify(frame).collect()}
    assert sorted(((r.doc_id, held[r.doc_id], r.lang_pred, round(r.score, 9)) for r in got), key=repr) == plain(rows, ranks)


def test_held_out_accuracy_and_leak(spark):
    rows, parts = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(frame).collect()}
    unseen = [(d, lang) for d, t, lang in rows if d is not None and d < 160 and got[d].held_out and lang is not None and len(t) > 12]
    assert len(unseen) > 10 and all(got[d].lang_pred == lang for d, lang in unseen)
    hidden = spark.createDataFrame([(d, t, "yy" if d is not None and got[d].held_out else lang) for d, t, lang in rows], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.identify(hidden).collect()} == {d: (r.lang_pred, r.score) for d, r in got.items()}


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(frame).collect()} == {"und"}
    assert L.identify(frame.limit(0)).count() == 0
