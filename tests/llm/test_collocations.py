"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from plinth.llm import collocations as C


def plain(rows, longest=3, least=10, kept=2000, covered=50):
    """``lang, rank, phrase, a, l, r, n, score`` of ``text, lang`` rows."""
    heard, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                heard[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in heard.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in able.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in able.items():
            if 100 * longer[p] >= covered * a:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[:kept], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "new", "NEW", "york", "b\x00c", "x y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(700):
        parts = []
        for _ in range(rng.randrange(12)):
            piece = rng.choices(words, weights, k=rng.randrange(1, 9))
            if rng.random() < 0.3:
                piece[0:0] = rng.choice([["new", "york", "city"], ["in", "the", "Long", "run"], ["ad", "hoc"]])
            parts.append(rng.choice([" ", "  ", "\t "]).join(piece) + rng.choice([". ", ",", "\n", "!?", " ;", "\x0b", "\r\n"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += [("hot pair " * 400, "en")] * 30 + [(None, "en"), ("", None), (" \t. , ", "xx"), (None, None)]
    return rows


def found(spark, rows, parts=6, **options):
    docs = spark.createDataFrame([(t, x, i, "p", 1) for i, (t, x) in enumerate(rows)], "text string, lang string, n long, phrase string, tile int").repartition(parts)
    got = C.collocations(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("head", [(500_000, 2_000_000), (25, 60)])
def test_against_plain(spark, monkeypatch, head):
    """All phrases ranked, and with most words and pairs beyond the ranks."""
    monkeypatch.setattr(C, "HEAD", head[0])
    monkeypatch.setattr(C, "PHRASE_HEAD", head[1])
    want = plain(corpus())
    assert len(want) > 150
    assert found(spark, corpus()) == want


def test_lists_and_flushes_and_longer_phrases(spark, monkeypatch):
    monkeypatch.setattr(C, "ZONE", 16)
    monkeypatch.setattr(C, "SIDE", 8)
    monkeypatch.setattr(C, "HELD", 500)
    monkeypatch.setattr(C, "LIST", 3000)
    assert found(spark, corpus(), longest=4, kept=40) == plain(corpus(), longest=4, kept=40)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 10)
    raw = b"one two three four, five six; seven eight nine ten eleven"
    assert list(C._cut(raw)) == [b"one two three four,", b" five six; seven eight nine ten eleven"]
    assert C.tokens(b"\n".join(C._cut(raw))) == b"one two three four \n \n five six \n seven eight nine ten eleven".split(b" ")


def test_exact_products_and_empty_table(spark):
    levels = [spark.createDataFrame([("en", b"a", 10**13 + 1), ("en", b"b", 10**13)], "lang string, phrase binary, n long"), spark.createDataFrame([("en", b"a b", 10**13 - 1)], "lang string, phrase binary, n long")]
    row = C._scored(levels).first()
    assert (row["score"], row["l"], row["r"]) == (1000000 * (10**13 - 1) ** 2 // ((10**13 + 1) * 10**13), 10**13 + 1, 10**13)
    assert found(spark, []) == []
