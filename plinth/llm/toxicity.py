"""Toxicity scores from a counterfactual-regularised classifier.

A logistic regression over the words and word beginnings of a text. For every labelled text that names a group of
people, a second version is made with each group term swapped for another one of its kind, and the fit pays for every
change that this makes to the score. What a group is called then carries little weight of its own, so a neutral
mention does not raise the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.labelled import MAX_ROWS, held_out, labelled_sample

THRESHOLD = 0.7
#: Features that the model keeps at most, and the labelled rows that a feature must be seen in.
MAX_FEATURES = 20_000
MIN_ROWS = 5
#: Least chi-square of a feature; one in some 100,000 features without meaning reaches it.
MIN_GAIN = 20.0
#: Bytes of a word that make a beginning.
BEGINNINGS = (4, 5, 6)
#: Terms for groups of people by language and kind; a term is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "locals"), ("deaf", "blind", "disabled"), ("old", "young"), ("african", "american", "european", "mexican", "chinese", "indian"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("muslimisch", "christlich", "jüdisch"), ("schwul", "lesbisch"), ("ausländer", "flüchtlinge"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("musulman", "chrétien", "juif"), ("étrangers", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("musulmán", "cristiano", "judío"), ("extranjeros", "refugiados"),
)
_SPACES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_WORD = re.compile(r"\w+")


def swaps(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    """Each term with the next of its row; of a term in several rows the first counts."""
    found: dict[str, str] = {}
    for row in terms:
        for i, term in enumerate(row):
            found.setdefault(term, row[(i + 1) % len(row)])
    return found


def counterfactual(text: str, swap: dict[str, str]) -> str | None:
    """The text with every identity term swapped, or None if it has none."""
    changed = _WORD.sub(lambda m: swap.get(m[0].lower(), m[0]), text)
    return None if changed == text else changed


def features(text: str | None) -> set[bytes]:
    """Words of the whole lower-cased text, and their beginnings marked with a dot."""
    words = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split())
    found = set(words)
    for n in BEGINNINGS:
        found.update([w[:n] + b"." for w in words if len(w) > n])
    return found


class Model:
    """Weights by feature; at most MAX_FEATURES."""

    def __init__(self, weights: dict[bytes, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        get = self.weights.get
        at = self.bias + sum(get(f, 0.0) for f in features(text))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, at))))


class Rows:
    """Sparse rows of feature numbers, each feature once a row."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.fromiter((c for r in rows for c in r), np.int64, len(self.row))
        self.height, self.width = len(rows), width

    def times(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weight[self.column], self.height)

    def back(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, error[self.row], self.width)


def fit_rows(rows: Rows, labels: np.ndarray, changed: np.ndarray, other: Rows, fairness: float = 5.0, ridge: float = 0.03, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Weights w and bias that minimise

    weighted mean log loss + ridge / (2 n) |w|^2 + fairness * mean (s(row) - s(counterfactual row))^2

    where s is the score before the logistic function and both labels weigh the same in all. ``changed`` numbers the
    rows that ``other`` has a counterfactual of. Accelerated gradient with a step per feature, restarted when it
    climbs, for a fixed number of rounds.
    """
    n, width, positive = rows.height, rows.width, labels.sum()
    share = np.where(labels == 1, 0.5 / max(1, positive), 0.5 / max(1, n - positive))
    weight, bias, pull = np.zeros(width), 0.0, ridge / n
    per_row = math.sqrt(max(1, int(np.bincount(rows.row, minlength=1).max())))
    bend = 0.25 * per_row * rows.back(share) + pull + 1e-4
    if other.height:
        bend += fairness * 8 / other.height * (rows.back(np.isin(np.arange(n), changed)) + other.back(np.ones(other.height)))
    at_weight, at_bias, momentum = weight, bias, 1.0
    for _ in range(rounds):
        logit = rows.times(at_weight) + at_bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * share
        slope = rows.back(error) + pull * at_weight
        if other.height:
            gap = 2 * fairness / other.height * (logit[changed] - other.times(at_weight) - at_bias)
            spread = np.zeros(n)
            np.add.at(spread, changed, gap)
            slope += rows.back(spread) - other.back(gap)
        moved, moved_bias = at_weight - slope / bend, at_bias - error.sum()
        if float(slope @ (moved - weight)) > 0:
            momentum = 1.0
        later = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        carry = (momentum - 1) / later
        at_weight, at_bias = moved + carry * (moved - weight), moved_bias + carry * (moved_bias - bias)
        weight, bias, momentum = moved, moved_bias, later
    return weight, float(bias)


def centred(scores: np.ndarray, labels: np.ndarray, threshold: float) -> float:
    """What to add to scores (before the logistic function) so that ``threshold`` lies in the middle of the gap between
    the labels; 0 where the labels overlap."""
    low, high = scores[labels == 0].max(), scores[labels == 1].min()
    return math.log(threshold / (1 - threshold)) - (low + high) / 2 if low < high else 0.0


def choose_features(sample: DataFrame, max_features: int = MAX_FEATURES, min_rows: int = MIN_ROWS, min_gain: float = MIN_GAIN) -> dict[bytes, int]:
    """The features that tell the labels apart best, by chi-square; numbered, at most ``max_features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, y in zip(*batch.columns, strict=True):
                found = features(text.as_py())
                seen.update(found)
                if y.as_py():
                    toxic.update(found)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["feature", "n", "toxic"])

    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).first()
    n, toxic = float(totals["n"]), float(totals["toxic"] or 0)
    if not 0 < toxic < n:
        return {}
    counts = sample.select("text", "y").mapInArrow(run, "feature binary, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    expected = F.col("n") * (toxic / n)
    gain = F.pow(F.col("toxic") - expected, 2) / (expected * (1 - toxic / n) + 0.5)
    best = counts.filter(F.col("n") >= min_rows).select("feature", gain.alias("gain")).filter(F.col("gain") >= min_gain).orderBy(F.desc("gain"), "feature").limit(max_features).collect()
    return {bytes(r.feature): i for i, r in enumerate(best)}


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, part: int = 1, max_rows: int = MAX_ROWS,
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = 5.0, threshold: float = THRESHOLD,
) -> Model:
    """Model of a bounded sample of labelled rows: the driver sees the numbers of chosen features of those rows.

    Identity terms and what they are swapped for always count among the chosen features. Without rows of both labels
    every text scores alike: at the only label, or 0.5 without rows.
    """
    sample = labelled_sample(docs, labels, label, parts, part, max_rows)
    swap = swaps(terms)
    number = choose_features(sample)
    if not number:
        only = {r.y for r in sample.select("y").distinct().collect()}
        return Model({}, 0.0 if not only else 30.0 if 1 in only else -30.0)
    for term in swap:
        for feature in sorted(features(term)):
            number.setdefault(feature, len(number))
    shared = sample.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, lists = shared.value.get, pa.list_(pa.int32())

        def numbers(text: str) -> list[int]:
            return sorted(i for i in map(get, features(text)) if i is not None)

        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(2)]
            changed = [counterfactual(t, swap) for t in texts]
            columns = [pa.array([numbers(t) for t in texts], lists), pa.array([None if t is None else numbers(t) for t in changed], lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "y", "own", "swapped"])

    found = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, own array<int>, swapped array<int>").orderBy("doc_id").collect()
    width = len(number)
    pairs = [i for i, r in enumerate(found) if r.swapped is not None]
    rows, y = Rows([r.own for r in found], width), np.array([r.y for r in found], np.float64)
    weight, bias = fit_rows(rows, y, np.array(pairs, np.int64), Rows([found[i].swapped for i in pairs], width), fairness)
    bias += centred(rows.times(weight) + bias, y, threshold)
    return Model({f: float(weight[i]) for f, i in number.items() if abs(weight[i]) > 1e-6}, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    Whole texts are scored; null and empty ones get the score of a text without words. A null id counts as held out.
    Only ids of the other parts and their labels are learned from. Repeated rows repeat. Nothing is shuffled to score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, "toxic", parts, part, max_rows, threshold=threshold))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.value.score(t) for t in texts], dtype="float64")

    scored = docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), scores(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
