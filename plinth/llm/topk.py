"""Exact top-k by inner product over integers: columnar branch-and-bound.

Candidates lie in blocks of vectors, stored dimension after dimension. A block of queries meets a block of candidates
by adding up scores one block of dimensions at a time. After each, the mass that the remaining dimensions can still
add or take away (Cauchy-Schwarz on what is left of both norms) bounds every score; candidates that no longer can
reach the k-th best lower bound of a query are dropped, and the columns of the survivors are compacted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates and of queries; queries that are met at once; dimensions in a step.
CANDIDATES, QUERIES, TOGETHER, STEP = 8192, 4096, 128, 8
#: A query with a smaller share of open candidates leaves the others and goes on with its own compacted columns.
COMPACT = 0.25


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as integers; null for a null vector and one with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Found:
    """The best k of each query so far, by score and then smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(queries)]
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]

    def least(self, q: int) -> float:
        """Scores below this cannot enter; equal ones still may."""
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -math.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(scores) > 4 * self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def rest_norms(columns: np.ndarray, step: int) -> np.ndarray:
    """Norms of what is left after 0, 1, 2, ... blocks of dimensions; rounded up."""
    squares = (columns.astype(np.float64) ** 2)
    left = [np.sqrt(squares[at:].sum(axis=0)) * (1 + 1e-12) for at in range(0, len(columns), step)]
    return np.array([*left, np.zeros(columns.shape[1])])


def search_block(found: Found, numbers: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, step: int = STEP) -> int:
    """Meet a block of candidates (``columns``: dimensions x vectors) with some queries (same form); rows that share a
    query's id are not its candidates. Sums of products must stay below 2^53, so float64 arithmetic is exact.
    Returns how many scores were carried to the last dimension."""
    order = np.argsort(-(np.abs(queries).sum(axis=1) * np.abs(columns).sum(axis=1)), kind="stable")
    queries, columns = queries[order], columns[order]
    query_rest, rest = rest_norms(queries, step), rest_norms(columns, step)
    rows = np.arange(len(numbers))
    scores, open_to = np.zeros((len(numbers), len(ids))), query_ids[:, None] != ids[None, :]
    least = np.array([found.least(q) for q in numbers.tolist()])
    finished = 0
    for number, at in enumerate(range(0, len(columns), step), 1):
        scores += queries[at : at + step, rows].T @ columns[at : at + step]
        slack = query_rest[number][rows][:, None] * rest[number][None, :]
        if scores.shape[1] > found.k:
            lower = np.where(open_to, scores - slack, -np.inf)
            least = np.maximum(least, np.partition(lower, -found.k, axis=1)[:, -found.k])
        open_to &= scores + slack >= least[:, None]
        few = open_to.mean(axis=1) < COMPACT
        for row in np.flatnonzero(few).tolist():
            mine = np.flatnonzero(open_to[row])
            finished += _alone(found, int(numbers[rows[row]]), queries[:, rows[row]], query_rest[:, rows[row]], ids, columns, rest, mine, scores[row, mine], least[row], number, step)
        rows, scores, open_to, least = rows[~few], scores[~few], open_to[~few], least[~few]
        if not len(rows):
            return finished
    for row in range(len(rows)):
        mine = np.flatnonzero(open_to[row])
        finished += len(mine)
        found.add(int(numbers[rows[row]]), scores[row, mine].astype(np.int64), ids[mine])
    return finished


def _alone(found: Found, q: int, query: np.ndarray, query_rest: np.ndarray, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray, alive: np.ndarray, scores: np.ndarray, least: float, number: int, step: int) -> int:
    """The remaining dimensions of one query, over its compacted candidates."""
    for at in range(number * step, len(columns), step):
        if not len(alive):
            return 0
        number += 1
        scores = scores + query[at : at + step] @ columns[at : at + step, alive]
        slack = query_rest[number] * rest[number][alive]
        if len(alive) > found.k:
            least = max(least, float(np.partition(scores - slack, -found.k)[-found.k]))
        keep = scores + slack >= least
        alive, scores = alive[keep], scores[keep]
    found.add(q, scores.astype(np.int64), ids[alive])
    return len(alive)


def _columns(lists: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Vectors as dimensions x vectors; shorter ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), dimensions), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.ascontiguousarray(out.T)


def _longest(lists: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max()) for c in lists.chunks if len(c)), default=0)


def meet(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Best ``k`` of a block of candidates for each of a block of queries."""
    dimensions = max(_longest(candidates["vector"]), _longest(queries["vector"]), 1)
    columns, asked = _columns(candidates["vector"], dimensions), _columns(queries["vector"], dimensions)
    ids, query_ids, keys = (x.to_numpy() for x in (candidates["id"], queries["id"], queries["key"]))
    found = Found(len(query_ids), k)
    largest = [int(np.abs(x).max(initial=0)) for x in (columns, asked)]
    if dimensions * largest[0] * largest[1] < 1 << 53:
        columns, asked = columns.astype(np.float64), asked.astype(np.float64)
        for at in range(0, len(query_ids), TOGETHER):
            some = np.arange(at, min(at + TOGETHER, len(query_ids)))
            search_block(found, some, query_ids[some], asked[:, some], ids, columns)
    else:
        for q in range(len(query_ids)):
            other = np.flatnonzero(ids != query_ids[q])
            found.add(q, (asked[:, q][:, None] * columns[:, other]).sum(axis=0), ids[other])
    size = [len(x) for x in found.ids]
    return pa.table({
        "key": pa.array(np.repeat(keys, size), pa.int64()), "query_id": pa.array(np.repeat(query_ids, size), pa.int64()),
        "vec_id": pa.array(np.concatenate([*found.ids, np.zeros(0, np.int64)]), pa.int64()), "score": pa.array(np.concatenate([*found.scores, np.zeros(0, np.int64)]), pa.int64()),
    })


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query the ``k`` candidates of largest integer inner product.

    Both tables have ``id`` and ``vector`` (array of integers); rows with a null in either take no part. Ties go to
    the smaller id; with fewer candidates all are returned. A candidate with the query's id is its own row. Vectors
    may differ in length (missing dimensions count as 0). Equal query rows are asked once, equal candidate rows count
    one by one. Scores must fit 64 bits; beyond 2^53 they are added up without bounds.

    Candidates and queries are dealt into blocks of bounded size, and each pair of blocks is one group, so the work of
    a pair fits one task however large the tables are; only k rows per query and block leave it.
    """
    rows = candidates.select(F.col("id").cast("long").alias("id"), "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    asked = queries.select(F.col("id").cast("long").alias("id"), "vector").filter("id IS NOT NULL AND vector IS NOT NULL").distinct()
    asked = asked.withColumn("key", F.xxhash64("id", "vector"))
    blocks = max(1, math.ceil(rows.count() / CANDIDATES))
    query_blocks = max(1, math.ceil(asked.count() / QUERIES))
    dealt = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    spread = asked.withColumn("query_block", F.pmod("key", F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(left, right, k)

    met = dealt.groupBy("block", "query_block").cogroup(spread.groupBy("block", "query_block")).applyInArrow(run, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
