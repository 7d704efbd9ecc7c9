"""Repeated substrings against brute force over all windows."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import substrings as S


def brute(rows):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        if doc_id is not None:
            for i in range(len(raw) - 49):
                w = raw[i : i + 50]
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if doc_id is not None and first[raw[i : i + 50]] < doc_id:
                gone[i : i + 50] = [True] * 50
        spans, at = [], 0
        while at < len(raw):
            if gone[at]:
                end = at
                while end < len(raw) and gone[end]:
                    end += 1
                spans.append((at, end - at))
                at = end
            at += 1
        out.append((doc_id, len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "é", "tion", "xx", "aaa", "日本", "\n", "q"]
    make = lambda k: " ".join(rng.choices(words, k=k))
    passages = [make(k) for k in (20, 30, 60, 200)] + ["z" * 300, "ab" * 100, "x" * 50, "y" * 49]
    rows = []
    for i in rng.sample(range(1000), n):
        text = make(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p) + 1)))
            at = rng.randrange(len(text) + 1)
            text = text[:at] + (p if rng.random() < 0.5 else p[a:b]) + text[at:]
        rows.append((i, text))
    rows += [(2000, None), (2001, ""), (None, passages[3]), (2002, passages[3]), (2002, passages[3]), (2003, passages[3] + "!"), (-5, passages[2]), (2004, make(9000)), (2005, "z" * 5000)]
    return rows


@pytest.mark.parametrize("seed,block,bucket,piece", [(1, 8 << 20, 8 << 20, 2 << 20), (2, 4000, 3000, 700)])
def test_brute_force(spark, monkeypatch, seed, block, bucket, piece):
    for name, value in (("BLOCK_BYTES", block), ("BUCKET_BYTES", bucket), ("PIECE_BYTES", piece)):
        monkeypatch.setattr(S, name, value)
    rows = corpus(seed)
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, block int, kept string")
    got = [(r.doc_id, r.n_bytes, [(s.first, s.length) for s in r.spans], bytes(r.kept)) for r in S.remove_repeats(frame).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    rows = [r for r in corpus(3) if r[0] is not None]

    def windows():
        block = S.Block([d for d, _ in rows], [(t or "").encode() for _, t in rows])
        return {(int(s) + k, int(s + lead), int(key)) for s, lead, n, key in zip(block.start, block.lead, block.windows, block.key) for k in range(n)}

    whole = windows()
    monkeypatch.setattr(S, "PIECE_BYTES", 333)
    assert windows() == whole
    assert len(whole) == sum(max(0, len((t or "").encode()) - 49) for _, t in rows)


def test_blocks_do_not_depend_on_the_order_of_rows(monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 333)
    rows = corpus(4)
    shuffled = random.Random(5).sample(rows, len(rows))
    blocks = [S._block(pa.table({"doc_id": pa.array([d for d, _ in r], pa.int64()), "raw": pa.array([None if t is None else t.encode() for _, t in r], pa.binary())})) for r in (rows, shuffled)]
    found = [b.strings(b.once(np.arange(len(b.start)))[0]).tobytes() for b in blocks]
    assert found[0] == found[1] and blocks[0].ids == blocks[1].ids


def test_rounds_give_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, size=(200, 12)).astype(np.uint8)
    rows[50:90] = rows[3]
    file = io.BytesIO()
    S.columns_to_file(rows, file)
    seen = 0
    for column, order, prefix in S.suffix_rounds(file, len(rows), 12):
        suffixes = [rows[i, column:].tobytes() for i in order]
        assert suffixes == sorted(suffixes)
        for i in range(1, len(rows)):
            a, b = suffixes[i - 1], suffixes[i]
            common = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
            assert prefix[i] == common
        seen += 1
    assert seen == 12


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
