"""Quality and toxicity models: held-out accuracy, odd rows, and what the counterfactual penalty does."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import labelled, quality, toxicity

WORDS = [f"{a}{b}" for a in "ba de fi go lu mi no pa re su".split() for b in "len tor mas vin kel dur".split()]
DOCS, LABELS = "doc_id long, text string, score string, y int", "doc_id long, quality int, toxic int, text string"


def corpus(n=500):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randrange(8, 60))
        toxic, good = rng.random() < 0.2, rng.random() < 0.75
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobly", "nastix"]))
        if not good:
            words = rng.choice([[w + "!!" for w in words], [words[0]] * len(words), sum(([w, "|"] for w in words), [])])
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic), "x"))
    odd = [(n, None), (n + 1, ""), (None, "badlen grobly"), (n + 2, "badlen " * 20000), (3, rows[3][1]), (n + 3, "..."), (n + 4, "\x00")]
    labels += [(n + 50, 1, 1, ""), (5, None, None, ""), (None, 1, 0, ""), (7, 1 - labels[7][1], 1 - labels[7][2], "")]
    return rows, odd, labels


def held(doc_id, parts, part):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % parts == part


@pytest.mark.parametrize("operator,column,parts,part,threshold", [(quality.quality_scores, 1, 5, 0, 0.3), (toxicity.toxicity_scores, 2, 3, 1, 0.7)])
def test_held_out_accuracy(spark, operator, column, parts, part, threshold):
    rows, odd, labels = corpus()
    docs, given = spark.createDataFrame([(d, t, "s", 1) for d, t in rows + odd], DOCS), spark.createDataFrame(labels, LABELS)
    got = operator(docs, given).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, _ in rows + odd), key=repr)
    truth = {row[0]: row[column] for row in labels[: len(rows)]}
    for r in got:
        assert r.held_out == held(r.doc_id, parts, part) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    unseen = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 7]
    assert len(unseen) > 50 and sum(r.predicted == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97
    flipped = spark.createDataFrame([(d, 1 - q if held(d, parts, part) and q is not None else q, 1 - t if held(d, parts, part) and t is not None else t, x) for d, q, t, x in labels], LABELS)
    again = {r.doc_id: r.score for r in operator(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_without_labels_or_documents(spark, operator):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert operator(docs, labels.limit(0)).count() == 2
    assert operator(docs, labels).count() == 2 and operator(docs.limit(0), labels).count() == 0


def test_sample_is_bounded_and_drops_copies(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), (F.col("id") % 1000).cast("string"), F.lit("x y")).alias("text"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert 990 <= labelled.labelled_sample(rows, labels, "quality", 5, 0).count() <= 1000
    assert 0 < labelled.labelled_sample(rows, labels, "quality", 5, 0, 300).count() <= 300


def test_keep_good_keeps_columns(spark):
    rows, odd, labels = corpus()
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], DOCS)
    kept = quality.keep_good(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    good = {row[0] for row in labels[: len(rows)] if row[1]}
    found = {r.doc_id for r in kept.collect()}
    assert len(found ^ good) <= 8


def test_pair_fit_ranks_and_cuts():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, 3))
    labels = (rows[:, 0] - rows[:, 1] > -0.8).astype(int)
    model = quality.fit_pairs(rows, labels)
    assert ((model.score(rows) >= 0.3) == (labels == 1)).mean() > 0.97 and model.weight[0] > 0 > model.weight[1]


def test_counterfactual_penalty_evens_group_terms(spark):
    swap = toxicity.swaps()
    assert toxicity.counterfactual("The Women sang", swap) == "The men sang" and toxicity.counterfactual("nobody", swap) is None
    rng, rows, labels = random.Random(2), [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = "women" if (toxic and rng.random() < 0.9) or rng.random() < 0.02 else "men"
        rows.append((i, " ".join([*rng.choices(WORDS, k=12), group, "were", "seen", *(["nastix"] if toxic and rng.random() < 0.7 else [])])))
        labels.append((i, 1, int(toxic)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain, even = (toxicity.fit_toxicity(docs, given, fairness=f) for f in (0.0, 20.0))

    def gap(model):
        return abs(sum(model.weights.get(f, 0) for f in toxicity.features("women")) - sum(model.weights.get(f, 0) for f in toxicity.features("men")))

    assert gap(even) < 0.35 * gap(plain) and even.weights[b"nastix"] > 0
    assert even.score("the women were seen") < plain.score("the women were seen")
