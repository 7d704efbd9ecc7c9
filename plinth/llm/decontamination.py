"""Benchmark decontamination with a positional inverted index over the training documents.

``build_index`` stores one row per shard of documents: the shard's terms with their posting lists (positions of the
shard's words). ``find_matches`` plans each test window once, rarest term of the corpus first, and intersects the
posting lists shifted by each term's offset in the window. Shards are independent, so no posting is ever shuffled, a
hot term is spread over all shards, and a lost task is computed again from its shard alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.wording import words
from plinth.session import shared_folder

WINDOW = 13
#: Bytes of text after which a shard is closed; a longer document is a shard of its own.
SHARD_BYTES = 4_000_000
#: Words of test items that are planned and broadcast at once; more items are searched in blocks of this size.
BLOCK_WORDS = 100_000
INDEX = (
    "shard long, doc_ids array<bigint>, text_hashes array<bigint>, sizes array<int>, "
    "terms array<binary>, counts array<int>, positions binary"
)
MATCHES = "shard long, row int, doc_id long, text_hash long, n_words int, spans array<struct<first:int,last:int>>, items array<string>"


def _shard(number: int, ids: list, hashes: list, tokens: list[list[bytes]], vocabulary: dict[bytes, int] | None) -> tuple:
    """Postings of some documents; each document's words start one place after the end of the one before."""
    known: dict[bytes, int] = {} if vocabulary is None else vocabulary
    places, terms, base = [], [], 0
    for own in tokens:
        if vocabulary is None:
            term = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own))
        else:
            term = np.fromiter((known.get(w, -1) for w in own), np.int64, len(own))
        held = np.flatnonzero(term >= 0)
        terms.append(term[held])
        places.append(held + base)
        base += len(own) + 1
    term, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, places))
    order = np.argsort(term, kind="stable")
    used, counts = np.unique(term[order], return_counts=True)
    names = list(known)
    return (number, ids, hashes, [len(t) for t in tokens], [names[u] for u in used.tolist()], counts.tolist(), place[order].astype(np.uint32).tobytes())


def build_index(docs: DataFrame, path: str, vocabulary: list[bytes] | None = None) -> DataFrame:
    """Write the index of ``docs`` (``doc_id``, ``text``) to ``path`` and return it as read back.

    With a ``vocabulary`` only postings of those terms are stored: lists that no test item asks for are never
    written. Null and empty texts have no words but keep their place in the shard. Nothing is shuffled.
    """
    spark = docs.sparkSession
    given = None if vocabulary is None else spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId() << 32
        known = None if given is None else given.value
        names = [part.split()[0] for part in INDEX.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        ids, hashes, tokens, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            row = _shard(number, ids, hashes, tokens, known)
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text, text_hash in zip(*batch.columns, strict=True):
                raw = text.as_py()
                ids.append(doc_id.as_py())
                hashes.append(text_hash.as_py())
                tokens.append(words(raw))
                size += len(raw or b"")
                if size >= SHARD_BYTES:
                    yield close()
                    number += 1
                    ids, hashes, tokens, size = [], [], [], 0
        if ids:
            yield close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = source.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(run, INDEX)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def windows_of(item: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``width`` words; a shorter item that has words is one window."""
    if len(item) <= width:
        return [tuple(item)] if item else []
    return [tuple(item[i : i + width]) for i in range(len(item) - width + 1)]


class Plan:
    """Test windows with their terms, rarest first. Bounded by the block of items that it was made from."""

    def __init__(self, items: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], width: int = WINDOW) -> None:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for name, item in items:
            for window in windows_of(item, width):
                found.setdefault(window, set()).add(name)
        alive = [w for w in found if all(frequency.get(t) for t in w)]
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for w in alive for t in w))}
        self.items = [sorted(found[w]) for w in alive]
        self.length = np.array([len(w) for w in alive], np.int64)
        self.term = np.full((len(alive), width), -1, np.int64)
        self.offset = np.zeros((len(alive), width), np.int64)
        for row, window in enumerate(alive):
            rare = sorted(range(len(window)), key=lambda i: (frequency[window[i]], i))
            self.term[row, : len(rare)] = [self.terms[window[i]] for i in rare]
            self.offset[row, : len(rare)] = rare

    def search(self, terms: list[bytes], counts: np.ndarray, positions: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of each occurrence in a shard, where no term is more than ``slack`` words off its place."""
        none = np.zeros(0, np.int64)
        ids = np.fromiter((self.terms.get(t, -1) for t in terms), np.int64, len(terms))
        listed = np.repeat(ids, counts)
        keep = listed >= 0
        keys = np.sort((listed[keep] << 33) | positions[keep].astype(np.int64))
        if not len(keys) or not len(self.items):
            return none, none
        first = np.searchsorted(keys, np.arange(len(self.terms) + 1) << 33)
        count = np.diff(first)
        here = np.flatnonzero(((count[self.term] > 0) | (self.term < 0)).all(axis=1))
        lead = self.term[here, 0]
        window = np.repeat(here, count[lead])
        within = np.arange(len(window)) - np.repeat(np.cumsum(count[lead]) - count[lead], count[lead])
        start = (keys[np.repeat(first[lead], count[lead]) + within] & ((1 << 33) - 1)) - self.offset[window, 0]
        window, start = window[start >= 0], start[start >= 0]
        for k in range(1, self.term.shape[1]):
            term = self.term[window, k]
            place = start + self.offset[window, k]
            low = np.searchsorted(keys, (term << 33) | np.maximum(place - slack, 0))
            high = np.searchsorted(keys, (term << 33) | (place + slack), "right") if slack else low + 1
            met = (term < 0) | ((high > low) & (low < len(keys)))
            if not slack:
                met &= (term < 0) | (keys[np.minimum(low, len(keys) - 1)] == ((term << 33) | place))
            window, start = window[met], start[met]
        return window, start


def _search_shard(plan: Plan, row: dict, slack: int, all_rows: bool) -> Iterator[tuple]:
    sizes = np.asarray(row["sizes"], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    positions = np.frombuffer(row["positions"], np.uint32)
    window, start = plan.search(row["terms"], np.asarray(row["counts"], np.int64), positions, slack)
    doc = np.searchsorted(base, start, "right") - 1
    first = start - base[doc]
    last = first + plan.length[window] - 1
    inside = last < sizes[doc]
    window, doc, first, last = (x[inside] for x in (window, doc, first, last))
    order = np.lexsort((first, doc))
    edge = np.searchsorted(doc[order], np.arange(len(sizes) + 1))
    for d in range(len(sizes)) if all_rows else np.unique(doc).tolist():
        mine = order[edge[d] : edge[d + 1]]
        spans, items = [], set()
        for a, b, w in zip(first[mine].tolist(), last[mine].tolist(), window[mine].tolist(), strict=True):
            items.update(plan.items[w])
            if spans and a <= spans[-1]["last"] + 1:
                spans[-1]["last"] = max(spans[-1]["last"], b)
            else:
                spans.append({"first": a, "last": b})
        yield row["shard"], d, row["doc_ids"][d], row["text_hashes"][d], int(sizes[d]), spans, sorted(items)


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size, read one partition after another."""
    held, size = [], 0
    chosen = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    for row in chosen.filter("text IS NOT NULL").toLocalIterator():
        held.append((row.item_id, words(bytes(row.text))))
        size += len(held[-1][1])
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_matches(docs: DataFrame, items: DataFrame, slack: int = 0, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Occurrences of test windows: one row per row of ``docs``.

    ``doc_id, text_hash, n_words, spans, items``: ``spans`` are the merged runs of words (from 0) inside an occurrence
    of a window of ``width`` words, ``items`` the sorted ids of the items they come from. ``slack`` 0 finds exact
    phrases; with more, each word may stand that many places off (proximity). Null texts have no words; null item ids
    read as ''; repeated rows and items repeat without effect on each other; without items there are no spans.
    """
    spark = docs.sparkSession
    parts = []
    for block in _blocks(items, block_words) if items is not None else ():
        vocabulary = list(dict.fromkeys(w for _, item in block for w in item))
        index = build_index(docs, shared_folder(spark, "postings"), vocabulary)
        heard = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))
        frequency = {bytes(r.term): r.n for r in heard.toLocalIterator()}
        parts.append(_searched(index, Plan(block, frequency, width), slack, not parts))
    if not parts:
        parts.append(_searched(build_index(docs, shared_folder(spark, "postings"), []), Plan([], {}, width), slack, True))
    if len(parts) == 1:
        return parts[0].drop("shard", "row")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    step = (
        "aggregate(spans, cast(array() as array<struct<first:int,last:int>>), (s, x) -> CASE WHEN size(s) > 0 AND x.first <= element_at(s, -1).last + 1 "
        "THEN concat(slice(s, 1, size(s) - 1), array(named_struct('first', element_at(s, -1).first, 'last', greatest(element_at(s, -1).last, x.last)))) "
        "ELSE concat(s, array(x)) END)"
    )
    return merged.withColumn("spans", F.expr(step)).drop("shard", "row")


def _searched(index: DataFrame, plan: Plan, slack: int, all_rows: bool) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(plan)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string())]
    names = ["shard", "row", "doc_id", "text_hash", "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                found = list(_search_shard(shared.value, row, slack, all_rows))
                columns = list(zip(*found, strict=True)) if found else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return index.mapInArrow(run, MATCHES)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``find_matches`` with ``n_hit`` (words inside a span) and ``contaminated``: hit in at least a twentieth of its words."""
    found = find_matches(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, columns as they are. Rows are told apart by ``doc_id`` and text.

    Null and empty texts stay; of repeated rows all stay or all go; an empty ``docs`` gives no rows, empty ``items`` all of them.
    """
    bad = contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    return row.join(bad, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("hash") == F.col("b_hash")), "left_anti").select("row.*")
