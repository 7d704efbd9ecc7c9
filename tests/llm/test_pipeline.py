"""The pipeline on a small corpus: what each stage keeps, and the end against a plain version."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from plinth.llm import mixing, quality
from plinth.llm.queries import byte_bpe
from tests.llm.test_decontamination import plain as plain_contamination
from tests.llm.test_neardup import plain_kept

WORDS = [f"{a}{b}{c}" for a in "ba de fi go lu".split() for b in "len tor mas vin".split() for c in "ka mo su".split()]


def test_stages_and_end(spark, tmp_path):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(3)]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(WORDS, k=rng.randrange(20, 120))
        good = rng.random() < 0.8
        if i % 20 == 3:
            at = rng.randrange(len(words))
            words[at:at] = items[i % 3][1].split()
        if not good:
            words = [w + "%%%" for w in words] if i % 2 else [words[0]] * 60
        rows.append((i, " ".join(words), "en", f"s{i % 5}", 0))
        labels.append((i, int(good), 0))
    rows += [(1000 + k, rows[k * 7][1] + (" extra" if k % 2 else ""), "en", "s0", 0) for k in range(12)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    folder = str(tmp_path / "sf")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs, kept = frame, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.columns == frame.columns, name
        kept.append([tuple(r) for r in docs.collect()])
        assert {r[0] for r in kept[-1]} <= {r.doc_id for r in before.select("doc_id").collect()}

    scored = {r.doc_id: r.score for r in quality.quality_scores(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {r[0] for r in kept[0]} == {d for d, s in scored.items() if s >= 0.3}
    assert {r[0] for r in kept[1]} == plain_kept([(r[0], r[1]) for r in kept[0]])
    assert {r[0] for r in kept[2]} == {r[0] for r in plain_contamination([(r[0], r[1]) for r in kept[1]], items) if not r[4]}
    third = spark.createDataFrame(kept[2], frame.schema)
    times = {r.doc_id: r.times for r in mixing.mixture(third).collect()}
    assert sorted(r[0] for r in kept[3]) == sorted(d for d, n in times.items() for _ in range(n))

    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    tokenizer, want, start = Tokenizer.from_file(byte_bpe()), [], 0
    for doc_id, text, *_ in sorted(kept[3], key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_stages_take_columns_of_any_name(spark, tmp_path):
    """Columns with the names that the stages use themselves, among them repeated rows and nulls."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=40))) for i in range(30)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (7, ""), (8, "other text of eight")]
    named = "doc_id long, text string, _id int, _hash string, _n int, _place int, id int, hash int, n int, row int, first int, root int, c_id int, b_hash int, source string, score double"
    frame = spark.createDataFrame([(d, t, k, "h", *[k] * 10, "s", 0.5) for k, (d, t) in enumerate(rows)], named).repartition(3)
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[5][1].split()[:20]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, folder)
        assert got.columns == frame.columns, name
        assert got.count() <= 3 * len(rows), name
        if name == "near-dedup":
            assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted({(d or 0, t) for d, t in rows[:30]} | {(8, "other text of eight"), (7, "")})
        if name == "benchmark decontamination":
            assert 5 not in {r.doc_id for r in got.collect()} and got.count() == len(rows) - 1
