"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import cut_lineage

#: Labelled rows that a model is fitted on, at most (in expectation a few per cent less).
MAX_ROWS = 20_000


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row is kept from learning; a null id is."""
    return F.coalesce(remainder(doc_id, parts) == part, F.lit(True))


def family(text: str | None) -> int:
    """Least hash of the three-word shingles: texts that are mostly the same mostly share it."""
    words = (text or "").lower().split()
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, text, y``: labelled rows outside the held-out part, one of each family of like texts, stored.

    At most about ``max_rows`` labels are chosen by a digest of the id, so a rerun chooses the same, and only those are
    broadcast to meet their documents. Null labels, ids labelled both ways and labels without a document are left
    out. Of the rows with one label and ``family`` that with the smallest id stays, so that a text copied many times
    does not lend its chance words the weight of many.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    rows = rows.filter(~held_out(F.col("doc_id"), parts, part))
    once = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    count = once.count()
    limit = 1 << 30
    share = limit if count <= max_rows else int(limit * 0.97 * max_rows / count)
    chosen = once.filter(F.pmod(F.xxhash64("doc_id"), F.lit(limit)) < share)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("long")
    def families(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([family(t) for t in texts], dtype="int64")

    first = met.withColumn("h", families("text")).groupBy("y", "h").agg(F.min(F.struct("doc_id", "text", "y")).alias("r")).select("r.*")
    return cut_lineage(first)
