"""SimHash groups against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from plinth.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3 and label[i] != label[j]:
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    least = {k: min((d for (d, _), x in zip(rows, label) if x == k and d is not None), default=None) for k in set(label)}
    return sorted(((d, f"{p:016x}", least[k]) for (d, _), p, k in zip(rows, prints, label)), key=repr)


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(4)]
    rows = []
    for i in range(60):
        t = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "X" + str(rng.randrange(9))
        rows.append((1000 - i, " ".join(t)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a\u00a0b c"), (7, "Ünïcode ÄÖ x y"), (None, "one"), (8, "one two"), (4, "One"), (None, "alone here")]
    rows += [(9, "word " * 30000)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_groups(frame)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_groups(rows)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, _, c in plain_groups(rows) if c is not None})


@pytest.mark.parametrize("cell", [7, 4096])
def test_links_of_random_and_crowded_fingerprints(spark, cell):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {s for s in seeds} | {rng.getrandbits(64) for _ in range(40)}
    for s in seeds[:3]:
        prints |= {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(90)}
    prints |= {seeds[0] ^ (i << 40) for i in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), cell).collect()
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for p, q in itertools.combinations(prints, 2):
        if bin(p ^ q).count("1") <= 3:
            label[root(p)] = root(q)
    want = {}
    for p in prints:
        want.setdefault(root(p), set()).add(p)
    mine = {p: p for p in prints}

    def find(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for e in edges:
        a, b = e.a % (1 << 64), e.b % (1 << 64)
        mine[find(a)] = find(b)
    got = {}
    for p in prints:
        got.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planes_round_trip():
    values = np.array([0, 1, 2**63, 2**64 - 1, 12345678901234567890], np.uint64)
    stored = simhash.planes(values)
    back = [sum(1 << (63 - b) for b in range(64) if i in simhash.lanes(stored[b])) for i in range(5)]
    assert back == values.tolist()


def test_repeated_and_null_ids_lose_no_text(spark):
    rows = [(7, "alpha beta gamma delta"), (7, "some other words of this id"), (7, "some other words of this id"), (None, "lone text here now"), (None, "lone text here now"), (9, "alpha beta gamma delta")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "lone text here now"), (7, "alpha beta gamma delta"), (7, "some other words of this id")]
