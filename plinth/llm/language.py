"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of a language by rank. A document is given the language whose profile is
nearest to the ranks of its own most frequent n-grams, by the sum over them of how far each is out of place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.labelled import held_out
from plinth.session import cut_lineage

UNDETERMINED = "und"
#: N-gram lengths in bytes, and how many ranks a profile has.
LENGTHS = (1, 2, 3, 4)
PROFILE = 400
#: Parts in which the n-grams of a language are ranked first.
PARTS = 16
#: Languages whose profiles (some 10 KB each) are broadcast at once; more languages are compared in blocks.
LANGUAGES_AT_ONCE = 2_000
#: Letters and digits apart: ASCII letters and all bytes of other characters stay, the rest parts words.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
#: Bytes of text whose n-grams are counted in one go; a text is cut between words, or within a longer word.
CHUNK = 1 << 20


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _chunks(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw):
            gap = raw.rfind(b" ", at, end)
            end = gap if gap > at else end
        yield raw[at:end]
        at = end


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of the whole text and their counts. Words are lower-cased and padded with one space at both ends;
    n-grams stay within a padded word. A code holds the length and the bytes."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    codes, counts = [], []
    for chunk in _chunks(raw):
        padded = np.frombuffer(b" " + b" ".join(chunk.split()) + b" ", np.uint8).astype(np.uint64)
        space = padded == 32
        code = np.zeros(len(padded), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            code = (code[: len(padded) - n + 1] << np.uint64(8)) | padded[n - 1 :]
            if not len(code):
                break
            inner = np.ones(len(code), bool)
            for k in range(1, n - 1):
                inner &= ~space[k : k + len(code)]
            if n == 1:
                inner &= ~space
            elif n == 2:
                inner &= ~(space[: len(code)] & space[1:])
            if n in LENGTHS:
                found, times = np.unique(code[inner], return_counts=True)
                codes.append(found | np.uint64(n << 32))
                counts.append(times)
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, count = np.concatenate(codes), np.concatenate(counts)
    if len(raw) > CHUNK:
        code, where = np.unique(code, return_inverse=True)
        count = np.bincount(where, count).astype(np.int64)
    return code, count


def top(code: np.ndarray, count: np.ndarray, ranks: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order of rank; ties by code."""
    return code[np.lexsort((code, -count))][:ranks]


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``docs`` (``text``, ``lang``), summed per batch before the shuffle.

    A language with most of the rows is spread over all tasks; what is shuffled is bounded by the distinct n-grams of a
    batch. Null texts and languages are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list] = {}
            for text, lang in zip(*batch.columns, strict=True):
                code, count = grams(text.as_py())
                held = seen.setdefault(lang.as_py(), [])
                held.append((code, count))
                if sum(len(c) for c, _ in held) > 1 << 21:
                    held[:] = [_merge(held)]
            for lang, held in seen.items():
                code, count = _merge(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(count, pa.int64())], ["lang", "gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return code, np.bincount(where, np.concatenate([n for _, n in held]), len(code)).astype(np.int64)


def profiles(docs: DataFrame, ranks: int = PROFILE) -> DataFrame:
    """``lang, rank, gram``, stored: the ``ranks`` most frequent n-grams of each language. Ties by code.

    The n-grams of a language are ranked in PARTS first, so a task that ranks a whole language sees the best of each.
    """
    order = [F.desc("n"), "gram"]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).orderBy(*order)
    best = gram_counts(docs).withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= ranks)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= ranks)
    return cut_lineage(ranked.select("lang", (F.col("rank") - 1).alias("rank"), "gram"))


class Profiles:
    """Profiles of some languages, in order of name: known codes and their ranks per language."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = PROFILE) -> None:
        self.langs = sorted({lang for lang, _, _ in rows})
        self.codes = np.unique(np.array([gram for _, _, gram in rows], np.uint64))
        self.ranks = ranks
        self.place = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, rank, gram in rows:
            self.place[number[lang], np.searchsorted(self.codes, np.uint64(gram))] = rank

    def distances(self, text: str) -> tuple[np.ndarray, int]:
        """Out-of-place distance to each language and the largest that it could be. A missing n-gram costs ``ranks``."""
        own = top(*grams(text), self.ranks)
        at = np.searchsorted(self.codes, own)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == own[known]
        place = self.place[:, np.where(known, at, len(self.codes))]
        rank = np.arange(len(own))
        return np.where(place < 0, self.ranks, np.abs(place - rank)).sum(axis=1), self.ranks * max(1, len(own))


def predict(docs: DataFrame, learned: DataFrame, ranks: int = PROFILE, at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``docs`` (``text`` and other columns but these; only the text is looked at).

    The nearest language wins, ties by name. ``score`` is 1 minus its distance as a share of the largest possible one.
    A null text, a text without a letter and any text where nothing was learned is ``und`` with score 0.
    ``learned`` has the columns of ``profiles``; with more than ``at_once`` languages they are compared block by block.
    """
    names = [r.lang for r in learned.select("lang").distinct().orderBy("lang").toLocalIterator()]
    spark = docs.sparkSession
    nearest = "struct<lang:string,distance:long,most:long>"
    best = F.lit(None).cast(nearest)
    for at in range(0, len(names), at_once):
        block = learned.filter((F.col("lang") >= names[at]) & (F.col("lang") <= names[min(at + at_once, len(names)) - 1])).collect()
        best = _nearest(spark.sparkContext.broadcast(Profiles([(r.lang, r["rank"], r.gram) for r in block], ranks)), nearest)(F.col("text").cast("string"), best)
    found = docs.withColumn("_best", best)
    score = F.when(F.col("_best.lang").isNull(), F.lit(0.0)).otherwise(1 - F.col("_best.distance") / F.col("_best.most"))
    return found.withColumn("lang_pred", F.coalesce("_best.lang", F.lit(UNDETERMINED))).withColumn("score", score).drop("_best")


def _nearest(shared, kind: str):
    @F.pandas_udf(kind)
    def nearest(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text, lang, distance, most in zip(texts, before["lang"], before["distance"], before["most"], strict=True):
            if has_letter(text):
                far, largest = shared.value.distances(text)
                k = int(far.argmin())
                if lang is None or far[k] < distance:
                    lang, distance, most = shared.value.langs[k], int(far[k]), largest
            out.append((lang, distance, most))
        return pd.DataFrame(out, columns=["lang", "distance", "most"]).astype({"distance": "Int64", "most": "Int64"})

    return nearest


def identify(docs: DataFrame, parts: int = 4, part: int = 2, ranks: int = PROFILE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``).

    Profiles come from all rows outside the held-out part that have a language; a null id counts as held out. Empty
    and repeated rows keep their row; an empty table gives none.
    """
    learned = profiles(docs.filter(~held_out(F.col("doc_id"), parts, part)), ranks)
    found = predict(docs.select("doc_id", "text"), learned, ranks)
    return found.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "lang_pred", "score")
