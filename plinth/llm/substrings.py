"""Removal of repeated byte strings by column-wise construction of a collection's suffix order.

A match is MATCH bytes that also start in a document with a smaller id. Every window of MATCH bytes is named by its
anchor: the place in it whose SEED bytes have the least hash. Equal windows have equal anchors at equal offsets, so
windows that may match meet in the bucket of their anchor's hash, aligned to the anchor. In a bucket each anchor is one
short document (the bytes of its windows). The suffix order of that collection is built column by column from the
right: each round inserts one symbol in front of every document, moves the suffixes to their new places by one stable
counting step over the symbols in the present order (the Burrows-Wheeler transform of the round) and updates the
common prefixes of neighbours by range minima. The columns lie one after another in a sequential file outside memory.
Where the common prefix of neighbours reaches MATCH the windows are equal, and the least document id of such a run
decides which of them go.

Because of the alignment only suffixes of the same column can match, so each column's part of the transform stands on
its own and a round costs as much as the bucket has documents, not as much as it has symbols.

Three steps go through the cluster, each over all documents. (1) Blocks of documents send the hashes of their anchors
to the buckets and learn which occur more than once; anchors without a partner cannot match and go no further.
(2) They send the bytes of the others, equal ones once with their least document id. (3) They get back, for each, the
windows to remove. Only packed arrays are shuffled: a row is a block's share of a bucket. A string that occurs in every
document is still one entry per block.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, SEED = 50, 16
#: Columns before and after an anchor that its windows can reach, and the first column of the last window.
LEAD = MATCH - SEED
WIDTH = 2 * LEAD + SEED
#: A byte that UTF-8 never holds: fills columns outside the windows of an anchor.
FILL = 0xFF
#: Bytes of text to a block and to a bucket, and bytes that are hashed at a time.
BLOCK_BYTES, BUCKET_BYTES, PIECE_BYTES = 8 << 20, 8 << 20, 2 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    reach, count = 1, len(values) - width + 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:count], values[width - reach : width - reach + count])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window start in ``raw``: the place of the window's anchor; and the hash of the seed at every place.

    Of seeds with the same leading hash bits the leftmost is the anchor, in every window alike.
    """
    eight = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    hashes = _mixed(eight[:-8] * _A ^ _mixed(eight[8:] * _B))
    low = np.uint64((1 << 24) - 1)
    least = _window_minimum((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), LEAD + 1)
    return (least & low).astype(np.int64), hashes


class Block:
    """Anchors of a block of documents: ``start`` of the first window, ``lead`` from there to the anchor, ``windows``.

    Places count along all texts of the block. Anchors are in order of place; texts shorter than MATCH, and those
    without an id, have none.
    """

    def __init__(self, ids: list[int | None], texts: list[bytes]) -> None:
        self.ids, self.size = ids, np.array([len(t) for t in texts], np.int64)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.base = np.concatenate([[0], np.cumsum(self.size)])
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)
        found = [self._piece(a, b) for a, b in self._pieces()]
        found.append((np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),))
        self.start, self.lead, self.windows, self.key = (np.concatenate(x) for x in zip(*found, strict=True))
        self.doc = np.array([0 if i is None else i for i in ids], np.int64)[self.row[self.start]]
        self.distinct, self.of = np.unique(self.key, return_inverse=True)

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """Ranges of places to hash together; a longer range overlaps the next by what a window needs."""
        for a in range(0, len(self.raw), PIECE_BYTES):
            b = min(len(self.raw), a + PIECE_BYTES + MATCH - 1)
            if b - a >= MATCH:
                yield a, b

    def _piece(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        anchor, hashes = anchors(self.raw[a:b])
        place = np.arange(a, a + len(anchor))
        row = self.row[a : a + len(anchor)]
        held = np.array([i is not None for i in self.ids])
        inside = np.flatnonzero((place + MATCH <= self.base[row + 1]) & held[row])
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        anchor, row = anchor[inside], row[inside]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        start = inside[first] + a
        return start, anchor[first] + a - start, np.diff(np.r_[first, len(anchor)]), _mixed(hashes[anchor[first]] * _B)

    def shares(self, buckets: int, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, entries of it) for ``entries`` (keys), in order of bucket."""
        bucket = (entries >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(order) else np.zeros(0, np.int64)
        for at, to in zip(edge.tolist(), [*edge.tolist(), len(order)][1:], strict=True):
            yield int(bucket[order[at]]), order[at:to]

    def shared(self, buckets: int, notes: dict[int, bytes]) -> np.ndarray:
        """Which anchors have a partner, from what the buckets said of the distinct keys."""
        partner = np.zeros(len(self.distinct), bool)
        for bucket, mine in self.shares(buckets, self.distinct):
            partner[mine] = np.unpackbits(np.frombuffer(notes[bucket], np.uint8), count=len(mine)).astype(bool)
        return np.flatnonzero(partner[self.of])

    def strings(self, chosen: np.ndarray) -> np.ndarray:
        """The bytes of anchors, one row each, aligned to the anchor and filled up."""
        padded = np.concatenate([np.full(LEAD, FILL, np.uint8), self.raw, np.full(WIDTH, FILL, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[self.start[chosen] + self.lead[chosen]].copy()
        column = np.arange(WIDTH)
        first = (LEAD - self.lead[chosen])[:, None]
        rows[(column < first) | (column >= first + self.windows[chosen][:, None] + MATCH - 1)] = FILL
        return rows

    def once(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings of ``chosen``: (one of each among chosen, number of its string per chosen, least document)."""
        rows = self.strings(chosen)
        wide = np.zeros((len(rows), -(-WIDTH // 8) * 8), np.uint8)
        wide[:, :WIDTH] = rows
        words = wide.view(np.uint64)
        weight = _mixed(np.arange(1, words.shape[1] + 1, dtype=np.uint64) * _A) | np.uint64(1)
        code = _mixed((words * weight).sum(axis=1, dtype=np.uint64))
        _, one, number = np.unique(code, return_index=True, return_inverse=True)
        if not (rows == rows[one[number]]).all():
            _, one, number = np.unique(rows.view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.doc[chosen])
        return one, number, least

    def removed(self, chosen: np.ndarray, number: np.ndarray, least: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Bytes to remove, as booleans along the block. ``gone`` has a bit per column and string: the window that starts
        there also starts in a document below ``least``. A copy in a later document goes with all its windows."""
        width = self.windows[chosen]
        first = (LEAD - self.lead[chosen]).astype(np.uint64)
        bits = np.where(self.doc[chosen] > least[number], ~np.uint64(0), gone[number] >> first)
        flag = np.zeros(len(self.raw) + 1, np.int32)
        for k in range(int(width.max(initial=0))):
            some = (width > k) & ((bits >> np.uint64(k)) & np.uint64(1)).astype(bool)
            flag[self.start[chosen[some]] + k] = 1
        covered = np.cumsum(flag[:-1])
        before = np.concatenate([np.zeros(MATCH, np.int64), covered])[: len(covered)]
        return covered > before


def repeated(keys: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether each key occurs again (or was said to, by ``many``)."""
    _, of, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count > 1
    again[of[many]] = True
    return again[of]


def columns_to_file(strings: np.ndarray, file: BinaryIO) -> None:
    """The collection column after column, each with one byte per document."""
    for column in range(strings.shape[1]):
        file.write(np.ascontiguousarray(strings[:, column]).tobytes())


def suffix_rounds(file: BinaryIO, count: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order, prefix) from the last column to the first, read from ``columns_to_file``'s file.

    ``order`` sorts the documents by their suffix from that column; ``prefix[i]`` is the common prefix of the suffixes at
    places i - 1 and i (0 at i = 0), at most 255. In memory are one column, the order and the prefixes.
    """
    order, prefix, empty = np.arange(count, dtype=np.int32), np.zeros(count, np.uint8), True
    for column in range(width - 1, -1, -1):
        file.seek(column * count)
        transform = np.frombuffer(file.read(count), np.uint8)[order]
        move = np.argsort(transform, kind="stable")
        same = np.zeros(count, bool)
        same[1:] = transform[move[1:]] == transform[move[:-1]]
        fresh = np.zeros(count, np.uint8)
        at = np.flatnonzero(same)
        if empty:
            fresh[at] = 1
        else:
            fresh[at] = np.minimum(_range_minimum(prefix, move[at - 1] + 1, move[at]), 254) + 1
        order, prefix, empty = order[move], fresh, False
        yield column, order, prefix


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low..high]`` for each pair, both ends included."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k) + 1])
        if (1 << (k + 1)) <= len(values):
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def smaller_elsewhere(strings: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Bits per string: bit c is set if the MATCH bytes from column c are also in a string with a smaller document id."""
    count, gone = len(strings), np.zeros(len(strings), np.uint64)
    with tempfile.TemporaryFile() as file:
        columns_to_file(strings, file)
        for column, order, prefix in suffix_rounds(file, count, WIDTH):
            if column > LEAD:
                continue
            runs = np.flatnonzero(prefix < MATCH)
            own = docs[order]
            least = np.repeat(np.minimum.reduceat(own, runs), np.diff(np.r_[runs, count]))
            file.seek(column * count)
            held = np.frombuffer(file.read(count), np.uint8)[order] != FILL
            gone[order[held & (least < own)]] |= np.uint64(1 << column)
    return gone


KEYS = "bucket int, block int, keys binary, many binary"
NOTES = "block int, kind int, bucket int, note binary"
SHARES = "bucket int, block int, strings binary, docs binary"
KEPT = "doc_id long, n_bytes long, spans array<struct<first:long,length:long>>, kept binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(fields)})


def _block(table: pa.Table) -> Block:
    """The block in one order, however its rows arrive: the steps count on finding the same anchors and strings."""
    rows = sorted(zip(table["doc_id"].to_pylist(), (t or b"" for t in table["raw"].to_pylist()), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return Block([i for i, _ in rows], [t for _, t in rows])


def _notes(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: n for k, b, n in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["note"].to_pylist(), strict=True) if k == kind}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: one row per row of ``docs`` (``doc_id``, ``text``).

    ``spans`` are the maximal removed runs of bytes in order, ``kept`` the remaining bytes joined (cuts may fall inside a
    character). A byte goes if it is covered by MATCH bytes that also start in a document with a smaller id, judged on
    the input. Rows with equal ids do not affect each other; a row with a null id keeps all and removes nothing; null
    and empty texts have 0 bytes; an empty table gives none.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    placed = sized.select("doc_id", F.col("text").cast("binary").alias("raw"), block.alias("block")).repartition(blocks, "block")

    def send_keys(key: tuple, table: pa.Table) -> pa.Table:
        mine = _block(table)
        many = np.bincount(mine.of, minlength=len(mine.distinct)) > 1
        low = (mine.distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        number = table["block"][0].as_py()
        return _rows(KEYS, [(b, number, low[own].tobytes(), np.packbits(many[own]).tobytes()) for b, own in mine.shares(buckets, mine.distinct)])

    def find_partners(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(table["many"].to_pylist(), parts, strict=True)]).astype(bool)
        again = np.split(repeated(np.concatenate(parts), many), np.cumsum([len(p) for p in parts])[:-1])
        bucket = table["bucket"][0].as_py()
        return _rows(NOTES, [(b, 0, bucket, np.packbits(a).tobytes()) for b, a in zip(table["block"].to_pylist(), again, strict=True)])

    def send_strings(key: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(SHARES, [])
        mine, number = _block(table), table["block"][0].as_py()
        chosen = mine.shared(buckets, _notes(notes, 0))
        one, _, least = mine.once(chosen)
        found = []
        for b, own in mine.shares(buckets, mine.key[chosen[one]]):
            found.append((b, number, mine.strings(chosen[one[own]]).tobytes(), least[own].tobytes()))
        return _rows(SHARES, found)

    def order_strings(key: tuple, table: pa.Table) -> pa.Table:
        strings = np.concatenate([np.frombuffer(s, np.uint8) for s in table["strings"].to_pylist()]).reshape(-1, WIDTH)
        parts = [np.frombuffer(d, np.int64) for d in table["docs"].to_pylist()]
        gone = np.split(smaller_elsewhere(strings, np.concatenate(parts)), np.cumsum([len(p) for p in parts])[:-1])
        bucket = table["bucket"][0].as_py()
        return _rows(NOTES, [(b, 1, bucket, g.tobytes()) for b, g in zip(table["block"].to_pylist(), gone, strict=True)])

    def cut(key: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        mine = _block(table)
        chosen = mine.shared(buckets, _notes(notes, 0))
        one, number, least = mine.once(chosen)
        gone, said = np.zeros(len(one), np.uint64), _notes(notes, 1)
        for b, own in mine.shares(buckets, mine.key[chosen[one]]):
            gone[own] = np.frombuffer(said[b], np.uint64)
        removed = mine.removed(chosen, number, least, gone)
        spans, kept = [], []
        for a, b in zip(mine.base[:-1].tolist(), mine.base[1:].tolist(), strict=True):
            own = removed[a:b]
            edge = np.flatnonzero(np.diff(np.r_[False, own, False]))
            spans.append([{"first": int(x), "length": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(mine.raw[a:b][~own].tobytes())
        place = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
        return pa.table({"doc_id": pa.array(mine.ids, pa.int64()), "n_bytes": pa.array(mine.size, pa.int64()), "spans": pa.array(spans, place), "kept": pa.array(kept, pa.binary())})

    partners = placed.groupBy("block").applyInArrow(send_keys, KEYS).groupBy("bucket").applyInArrow(find_partners, NOTES)
    strings = placed.groupBy("block").cogroup(partners.groupBy("block")).applyInArrow(send_strings, SHARES)
    answers = strings.groupBy("bucket").applyInArrow(order_strings, NOTES)
    return placed.groupBy("block").cogroup(partners.unionByName(answers).groupBy("block")).applyInArrow(cut, KEPT)
