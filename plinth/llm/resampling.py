"""Importance resampling towards a target text collection, ranked by parallel sorting by regular sampling.

A document's weight is the mean gain of its hashed features, where a bucket gains by being more frequent in the target
than in the documents; a seeded Gumbel number per document turns the order of scores into a weighted draw without
replacement. The order itself is never made by one sort: every task sorts its rows in runs, gives samples at regular
places of each run, and the samples of all runs give splitters. A sorted run is cut at the splitters, the pieces of one
segment meet in one task, and the sizes of the segments before it give each row its exact rank.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.components import text_hash
from plinth.llm.wording import words
from plinth.session import shared_folder

RUNS, BUCKETS, SEED = 1, 10_000, 2024
#: Words of a document that takes part in the draw, and the share drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Rows of a sorted run and of a segment (about), and samples that a segment has in all runs together (about).
RUN_ROWS, SEGMENT_ROWS, SAMPLES = 1_000_000, 1_000_000, 16
#: Features whose gain a worker remembers.
REMEMBERED = 300_000
SCORED = "doc_id long, text_hash long, n_words long, n_features long, weight long, score long"
ROUTED = SCORED + ", segment int"


def features(raw: bytes | None, runs: int = RUNS) -> tuple[int, list[bytes]]:
    """Number of words of a text, and all its runs of 1 to ``runs`` words, repeats included."""
    found = words(raw)
    out = list(found)
    for k in range(2, runs + 1):
        out += [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
    return len(found), out


def bucket_counts(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all of ``docs.text``; the driver gets one number per bucket, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            heard: Counter[bytes] = Counter()
            for raw in batch.column(0):
                heard.update(features(raw.as_py(), runs)[1])
                if len(heard) > REMEMBERED:
                    total += _folded(heard, buckets)
                    heard.clear()
            total += _folded(heard, buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("raw"))
    summed = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def _folded(heard: Counter[bytes], buckets: int) -> np.ndarray:
    at = np.fromiter((zlib.crc32(f) % buckets for f in heard), np.int64, len(heard))
    held = np.zeros(buckets, np.int64)
    np.add.at(held, at, np.fromiter(heard.values(), np.int64, len(heard)))
    return held


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """``floor(1000 ln(((t + 1) (S + B)) / ((s + 1) (T + B))))`` per bucket, in doubles; B is the number of buckets."""
    size = len(source)
    whole, aimed = float(source.sum() + size), float(target.sum() + size)
    return [math.floor(1000 * math.log((float(t + 1) * whole) / (float(s + 1) * aimed))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def chance(doc_id: int | None, seed: int = SEED) -> int:
    """The seeded Gumbel number of a document in thousandths; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gains(dict):
    """Gains by feature, looked up once and remembered."""

    def __init__(self, by_bucket: list[int]) -> None:
        super().__init__()
        self.by_bucket = by_bucket

    def __missing__(self, feature: bytes) -> int:
        self[feature] = found = self.by_bucket[zlib.crc32(feature) % len(self.by_bucket)]
        return found


def scores(docs: DataFrame, by_bucket: list[int], runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, n_words, n_features, weight, score`` of every row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has no features and weight 0. Repeated rows score alike. Texts are read whole, in the row.
    """
    spread = docs.sparkSession.sparkContext.broadcast(by_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Gains(spread.value)
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                n_words, found = features(raw.as_py(), runs)
                if len(known) > REMEMBERED:
                    known.clear()
                weight = sum(map(known.__getitem__, found)) // len(found) if found else 0
                rows.append((n_words, len(found), weight, weight + chance(doc_id, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [f.split()[0] for f in SCORED.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").cast("binary").alias("raw"))
    return narrow.mapInArrow(run, SCORED)


def _sorted_runs(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[tuple[int, pa.Table, list[np.ndarray]]]:
    """Runs of at most RUN_ROWS rows and a batch: number, rows in order, key columns (score descending, null ids last, id, hash)."""
    from pyspark import TaskContext

    part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

    def one() -> tuple[int, pa.Table, list[np.ndarray]]:
        table = pa.Table.from_batches(held)
        table = table.filter(pa.array(table["n_words"].to_numpy() >= least_words))
        none = table["doc_id"].is_null().to_numpy()
        key = [-table["score"].to_numpy(), none, table["doc_id"].fill_null(0).to_numpy(), table["text_hash"].to_numpy()]
        order = np.lexsort(key[::-1])
        return (part << 20) + k, table.take(pa.array(order)), [c[order] for c in key]

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= RUN_ROWS:
            yield one()
            k, held, size = k + 1, [], 0
    if held:
        yield one()


def place(key: list[np.ndarray], number: int, splitter: tuple) -> int:
    """Where ``splitter`` (key, run number, place in that run) cuts a sorted run: rows equal in key are told apart by run and place."""
    low, high = 0, len(key[0])
    for column, value in zip(key, splitter, strict=False):
        low, high = low + int(np.searchsorted(column[low:high], value)), low + int(np.searchsorted(column[low:high], value, "right"))
    run, at = splitter[len(key) :]
    return high if number < run else low if number > run else min(max(at, low), high)


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, n_words, n_features, weight, score, rank``: every row of ``docs``, and ranks of those drawn.

    Of the N rows with at least ``least_words`` words the ``floor(percent * N / 100)`` highest scores are drawn, ties to the
    smaller id, null ids last, then the text hash; ranks of rows equal in all of these are dealt among them. Undrawn rows
    have a null rank. Empty ``docs`` give no rows, an empty ``target`` counts zero everywhere. Other columns are not read.

    The driver holds ``buckets`` counts, SAMPLES rows and one size per segment of SEGMENT_ROWS rows. A key that many rows
    share is split like any other, because splitters also name a run and a place. Only segments that hold drawn rows move.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "resampling")
    by_bucket = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scores(docs, by_bucket, runs, seed).write.parquet(f"{folder}/scored")
    scored = spark.read.schema(SCORED).parquet(f"{folder}/scored")
    total = scored.filter(F.col("n_words") >= least_words).count()
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENT_ROWS))
    step = max(1, total // (segments * SAMPLES))

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, key in _sorted_runs(batches, least_words):
            at = np.arange((number * 0x9E3779B1 >> 7) % step, len(key[0]), step)
            columns = [*(pa.array(c[at]) for c in key), pa.array(np.full(len(at), number)), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, ["score", "none", "doc_id", "text_hash", "run", "place"])

    found = scored.mapInArrow(samples, "score long, none boolean, doc_id long, text_hash long, run long, place long").toArrow()
    heard = sorted(zip(*(found[c].to_pylist() for c in found.column_names), strict=True))
    splitters = spark.sparkContext.broadcast([heard[len(heard) * k // segments] for k in range(1, segments)] if heard else [])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def short(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in whole:
                out.append(batch.filter(pa.array(batch.column("n_words").to_numpy() < least_words)))
                yield batch

        out: list[pa.RecordBatch] = []
        for number, table, key in _sorted_runs(short(batches), least_words):
            cuts = [0, *(place(key, number, s) for s in splitters.value), len(key[0])]
            segment = np.repeat(np.arange(len(cuts) - 1, dtype=np.int32), np.diff(cuts))
            yield from table.append_column("segment", pa.array(segment)).combine_chunks().to_batches()
            yield from (b.append_column("segment", pa.nulls(b.num_rows, pa.int32())) for b in out)
            out = []

    scored.mapInArrow(route, ROUTED).write.parquet(f"{folder}/routed")
    routed = spark.read.schema(ROUTED).parquet(f"{folder}/routed")
    sizes = np.zeros(segments, np.int64)
    for r in routed.filter("segment IS NOT NULL").groupBy("segment").count().collect():
        sizes[r["segment"]] = r["count"]
    before = np.cumsum(sizes) - sizes
    draws = percent * total // 100
    last = int(np.searchsorted(before, draws))
    base = spark.sparkContext.broadcast(before[:last])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = -1, 0
        for batch in batches:
            own = batch.column("segment").to_numpy()
            rank = np.empty(len(own), np.int64)
            for s in np.unique(own).tolist():
                held = np.flatnonzero(own == s)
                current, seen = s, seen if s == current else 0
                rank[held] = base.value[s] + seen + 1 + np.arange(len(held))
                seen += len(held)
            yield batch.drop_columns(["segment"]).append_column("rank", pa.array(rank, mask=rank > draws))

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "text_hash"]
    drawn = routed.filter(F.col("segment") < last).repartitionById(max(1, last), F.col("segment")).sortWithinPartitions("segment", *order).mapInArrow(number, SCORED + ", rank long")
    rest = routed.filter(F.coalesce(F.col("segment") >= last, F.lit(True))).drop("segment").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; options as for ``ranked``.

    Rows equal in id and text are interchangeable: where the draw ends among such rows, as many as were drawn stay.
    """
    told = ranked(docs, target, **options).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    chosen = told.agg(F.count("rank").alias("drawn"), F.count(F.lit(1)).alias("rows")).filter("drawn > 0")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))
    met = row.join(chosen.select(F.col("id").alias("c_id"), F.col("hash").alias("c_hash"), "drawn", "rows"), F.col("id").eqNullSafe(F.col("c_id")) & (F.col("hash") == F.col("c_hash")))
    whole = met.filter("drawn = rows").select("row.*")
    last = chosen.filter("drawn < rows").select("drawn").first()
    if last is None:
        return whole
    return whole.unionByName(met.filter("drawn < rows").orderBy(F.to_json("row")).limit(last["drawn"]).select("row.*"))
