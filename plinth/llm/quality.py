"""Quality scores learned from preference pairs (Bradley-Terry) and cut at a quantile of the scores.

A document's features are shares and ratios of its whole text. The chance that document a is preferred to b is the
logistic function of the difference of their scores, and a score is linear in the features, so the fit is a logistic
regression on feature differences of (good, bad) pairs without a constant.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.labelled import MAX_ROWS, held_out, labelled_sample

THRESHOLD = 0.3
#: Preference pairs drawn for each row of either label.
PAIRS = 8
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_PROSE = list(b".,'-")
FEATURES = (
    "upper", "digits", "marks", "rare_marks", "lone_marks", "mark_ended", "sentence_ends", "long_words", "short_words", "word_length", "twice", "common",
    "types", "shingles", "lines", "line_length", "wide",
)


def features(text: str | None) -> list[float]:
    """Features of a whole text; zeros for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * (2 * len(FEATURES))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw)
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum()))
    marks, prose = int(count[_MARKS].sum()), int(count[_PROSE].sum())
    times = Counter(words)
    lengths = list(map(len, words))
    shingles = max(1, n - 2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    shares = [
        int(count[_UPPER].sum()) / letters,
        int(count[_DIGIT].sum()) / size,
        marks / size,
        (marks - prose) / size,
        sum(c for w, c in times.items() if len(w) == 1 and w in b"|*#~-_=+<>/\\") / n,
        sum(c for b, c in ends.items() if b < 128 and not chr(b).isalnum() and b not in b".,") / n,
        ends[46] / n,
        sum(c for w, c in times.items() if len(w) > 14) / n,
        sum(c for w, c in times.items() if len(w) <= 3) / n,
        sum(lengths) / n / 20,
        sum(map(eq, words, words[1:])) / n,
        max(times.values()) / n,
        1 - math.log1p(len(times)) / math.log1p(n),
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / shingles if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        math.log1p(size / len(lines)) / 10,
        int(count[128:].sum()) / size,
    ]
    return shares + [math.sqrt(max(0.0, x)) for x in shares]


class Model:
    """Linear scores over scaled features; ``cut`` is the raw score that gets THRESHOLD."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, cut: float, slope: float, threshold: float = THRESHOLD) -> None:
        self.mean, self.scale, self.weight, self.cut, self.slope = mean, scale, weight, cut, slope
        self.shift = math.log(threshold / (1 - threshold))

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weight

    def score(self, rows: np.ndarray) -> np.ndarray:
        at = np.clip(self.slope * (self.raw(rows) - self.cut) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-at))


def fit_pairs(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, rounds: int = 25, seed: int = 7) -> Model:
    """Bradley-Terry fit by Newton steps. With one label only (or none) every document scores alike, at that label.

    ``cut`` is the quantile of the raw scores at the share of bad rows, so as many are rejected as were labelled bad;
    within the gap between the rows on either side it lies in the middle.
    """
    width = rows.shape[1] if len(rows) else 2 * len(FEATURES)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        side = -1.0 if len(good) or not len(bad) else 1.0
        return Model(np.zeros(width), np.ones(width), np.zeros(width), side, 5.0)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1.0
    unit = (rows - mean) / scale
    rng = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(good, pairs), rng.choice(good, len(bad) * pairs)])
    b = np.concatenate([rng.choice(bad, len(good) * pairs), np.repeat(bad, pairs)])
    differ, weight = unit[a] - unit[b], np.zeros(width)
    for _ in range(rounds):
        lost = 1 / (1 + np.exp(np.clip(differ @ weight, -30, 30)))
        slope = differ.T @ lost - ridge * weight
        bend = (differ * (lost * (1 - lost))[:, None]).T @ differ + ridge * np.eye(width)
        step = np.linalg.solve(bend, slope)
        weight = weight + step
        if np.abs(step).max() < 1e-6:
            break
    raw = np.sort(unit @ weight)
    at = min(max(1, len(bad)), len(raw) - 1)
    cut = (raw[at - 1] + raw[at]) / 2
    spread = max(1e-9, float(np.std(raw)))
    return Model(mean, scale, weight, float(cut), 3.0 / spread)


def with_features(docs: DataFrame, keep: str, kinds: str) -> DataFrame:
    """``keep`` columns and ``features``; one row per row, no shuffle. ``docs`` has the columns of ``keep`` and ``text``."""
    names = keep.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], [*names, "features"])

    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, features array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, part: int = 0, max_rows: int = MAX_ROWS) -> Model:
    """Model of a bounded sample: the driver sees ``max_rows`` rows of 34 numbers."""
    sample = with_features(labelled_sample(docs, labels, label, parts, part, max_rows), "doc_id, y", "doc_id long, y int").orderBy("doc_id").collect()
    rows = np.array([r.features for r in sample], np.float64).reshape(len(sample), 2 * len(FEATURES))
    return fit_pairs(rows, np.array([r.y for r in sample], np.int64))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to the columns of ``docs`` (one of which is ``text``; an own column ``score`` is replaced).

    Empty and null texts score as a text whose shares are all 0. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.array([features(t) for t in texts], np.float64).reshape(len(texts), 2 * len(FEATURES))
            yield pd.Series(shared.value.score(rows))

    return docs.withColumn("score", scores(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``); a null id counts as held out."""
    model = fit_quality(docs, labels, "quality", parts, part, max_rows)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns as they are."""
    model = fit_quality(docs, labels, max_rows=max_rows)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return score_quality(own, model).filter(F.col("score") >= threshold).select("row.*")
