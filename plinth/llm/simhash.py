"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

A fingerprint has 64 bits. Two fingerprints within three bits agree on at least two of five bit blocks, so every
pair within the radius meets under one of ten keys (two blocks each). Inside a key the fingerprints are stored
vertically, one bit plane after another, and 64 distances are updated per machine word with carry-save counters.
A block of words is abandoned as soon as all of its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.components import keep_least, least_labels, text_hash
from plinth.session import cut_lineage

RADIUS = 3
#: Bit blocks as (first bit, width); a pair within RADIUS agrees on at least two of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of one key that are compared in one cell; keys with more rows are cut into pairs of such chunks.
CELL = 4096
#: Planes between two looks at which blocks are still open.
STEP = 8


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash over ``width``-word shingles; 0 for a text without words (or null)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        digests, count = xxhash.xxh64_digest(joined, seed), 1
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashed, count = xxhash.xxh64_digest, len(words) - width + 1
        digests = b"".join([hashed(joined[a:b], seed) for a, b in zip(starts[:count].tolist(), ends[width - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(digests, np.uint8).reshape(count, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 15):
        ones += np.unpackbits(rows[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp``: one row per row of ``docs`` (``doc_id``, ``text``); other columns are not read. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(text.as_py(), width) for text in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values, 64 x words; lanes past the end are zero."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.uint64)


def lanes(words: np.ndarray) -> np.ndarray:
    """Flat lane numbers of the set bits of words that were packed by ``planes``."""
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8)))


def add_planes(differ: Iterator[tuple[np.ndarray, np.ndarray]], state: list[np.ndarray]) -> None:
    """Carry-save step: two difference planes at a time go into counters of 1, 2 and a sticky 4-or-more."""
    one, two, many = state
    for x, y in differ:
        half = x ^ y
        carry = (x & y) | (one & half)
        one ^= half
        many |= two & carry
        two ^= carry


def shifted_links(values: np.ndarray, run: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside short runs of equal ``run``: all lanes are compared with the lane ``d`` further on, for each ``d``."""
    total = len(values)
    for d in range(1, longest):
        here = np.flatnonzero(run[: total - d] == run[d:])
        if not len(here):
            return
        words = -(-len(here) // 64)
        x, y = planes(values[here]), planes(values[here + d])
        open_words, state = np.arange(words), [np.zeros(words, np.uint64) for _ in range(3)]
        for at in range(0, 64, STEP):
            left = x[at : at + STEP, open_words] ^ y[at : at + STEP, open_words]
            add_planes(zip(left[::2], left[1::2], strict=True), state)
            alive = state[2] != ~np.uint64(0)
            if not alive.all():
                open_words, state = open_words[alive], [s[alive] for s in state]
        near = lanes(~state[2])
        near = open_words[near // 64] * 64 + near % 64
        first = here[near[near < len(here)]]
        yield first, first + d


def block_links(values: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``queries`` (indexes) the lanes of ``values`` within the radius; 64 queries against all planes at once."""
    stored, total = planes(values), len(values)
    ones = ~np.uint64(0)
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64]
        flips = np.where((values[some][:, None] >> np.arange(63, -1, -1, dtype=np.uint64)) & np.uint64(1), ones, np.uint64(0)).astype(np.uint64)
        open_rows, state = np.arange(len(some)), [np.zeros((len(some), stored.shape[1]), np.uint64) for _ in range(3)]
        for bit in range(0, 64, STEP):
            pairs = ((stored[b][None, :] ^ flips[open_rows, b][:, None], stored[b + 1][None, :] ^ flips[open_rows, b + 1][:, None]) for b in range(bit, bit + STEP, 2))
            add_planes(pairs, state)
            alive = (state[2] != ones).any(axis=1)
            if not alive.all():
                open_rows, state = open_rows[alive], [s[alive] for s in state]
        for row, words in zip(open_rows.tolist(), ~state[2], strict=True):
            near = lanes(words)
            yield int(some[row]), near[near < total]


class Sets:
    """Disjoint sets over 0..n-1 whose roots are their smallest members."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, members: list[int]) -> None:
        roots = {self.root(i) for i in members}
        least = min(roots)
        for r in roots:
            self.up[r] = least

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def star_edges(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``values`` with equal ``keys``, as edges to the smallest member of each set linked here."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[edge, len(keys)])
    run, sets = np.repeat(np.arange(len(edge)), length), Sets(len(values))
    short = np.repeat((length > 1) & (length <= 64), length)
    if short.any():
        at = np.flatnonzero(short)
        for i, j in shifted_links(values[at], run[at], int(length[(length > 1) & (length <= 64)].max())):
            for a, b in zip(at[i].tolist(), at[j].tolist(), strict=True):
                sets.join([a, b])
    for k in np.flatnonzero(length > 64).tolist():
        first, n = int(edge[k]), int(length[k])
        for q, near in block_links(values[first : first + n], np.arange(n)):
            up = np.unique(sets.up[first + near])
            if len(up) > 1:
                sets.join([first + q, *up.tolist()])
    root = sets.roots()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return values[linked], values[root[linked]]


def band_keys(fp: str = "fp"):
    """Ten (band, bits) keys of a fingerprint: each pair of BLOCKS."""

    def mask(blocks) -> int:
        bits = sum(((1 << width) - 1) << first for first, width in blocks)
        return bits - (1 << 64) if bits >> 63 else bits

    return F.array(*[F.struct(F.lit(i).alias("band"), F.col(fp).bitwiseAND(F.lit(mask(pair)).cast("long")).alias("bits")) for i, pair in enumerate(combinations(BLOCKS, 2))])


def fingerprint_links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints (column ``fp``) within the radius.

    A key with more than ``cell`` fingerprints is cut into chunks by hash, and every pair of chunks is a group of
    its own, so no task holds more than two chunks of one key and no link is lost.
    """
    keyed = distinct.select("fp", F.explode(band_keys()).alias("k")).select("fp", "k.band", "k.bits")
    chunks = keyed.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    chunks = chunks.select("band", "bits", F.ceil(F.col("n") / cell).cast("long").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    dealt = keyed.join(chunks, ["band", "bits"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = dealt.select("fp", F.xxhash64("band", "bits", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if held:
            a, b = star_edges(np.concatenate([k for _, k in held]), np.concatenate([v for v, _ in held]).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return cells.repartition("cell").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits, ``component_id`` is the smallest ``doc_id`` reachable over links of
    at most RADIUS differing bits. Null and word-less texts have fingerprint zero and link like any other; rows with a
    null ``doc_id`` keep their row and never name a component (unless all of it is null). Repeated rows repeat. Copies
    are reduced to one fingerprint before anything is compared; an empty table gives an empty table.
    """
    found = cut_lineage(fingerprints(docs, width))
    distinct = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = least_labels(fingerprint_links(distinct))
    rooted = distinct.join(labels.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of ``docs`` per group, the least by (``doc_id``, text hash), nulls last. Columns stay as they are."""
    found = cut_lineage(fingerprints(docs.select(text_hash().alias("doc_id"), "text"), width).distinct())
    labels = least_labels(fingerprint_links(found.select("fp").distinct())).withColumnRenamed("vertex", "fp")
    rooted = found.join(labels, "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    return keep_least(docs, rooted.join(least, "root").select(F.col("doc_id").alias("text_hash"), F.col("least").alias("root")))
