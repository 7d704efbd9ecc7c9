"""Token ids as Arrow stream-format files of fixed-size lists.

A file holds the documents of one range of ``doc_id``, tokenised and joined end to end, cut into sequences of equal
length. It is one Arrow IPC stream whose batches have two columns: ``ids`` (fixed-size list of unsigned integers) and
``mask`` (fixed-size list of booleans, false where the last sequence is padded). Equal lengths make the place of a
sequence arithmetic, so a memory-mapped file gives any of them without a copy. Beside it lies a stream of
``doc_id, start, n_tokens`` for the documents of the file. The files are named in a manifest table, one row per file,
written by Spark last: a file that no manifest row names (of a task that failed or ran twice) is never read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids per sequence and sequences per record batch.
SEQUENCE = 2048
BATCH = 256
#: Pieces that a worker remembers (at most twice as many, some 150 bytes each).
REMEMBERED = 400_000
#: New pieces that are encoded as one text, and characters of the texts that are encoded together (a longer text is alone).
JOINED, TOGETHER = 2000, 4_000_000
END = 0
MANIFEST = "part int, ids_path string, docs_path string, n_docs long, n_tokens long, first_id long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


_MARKS = ".,;:!?)"
_WORD = re.compile(f"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+)([{re.escape(_MARKS)}]*)")
#: Byte-level spelling: printable bytes stand for themselves, the others, in order, for the characters from U+0100 on.
_SPACE = "\u0120"
_MARKED = re.compile(f"(?<=[^{re.escape(_MARKS)}])(?=[{re.escape(_MARKS)}])")
_SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def _chunks(pieces: list[str]) -> list[list[str]]:
    return [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]


class Encoder:
    """Whole texts to ids with a tokenizer file whose pre-tokeniser is byte-level.

    Such a pre-tokeniser always ends a token before a single space that follows a non-space, so a text is the sum of
    its pieces cut there, and a piece met before need not be encoded again. New pieces are encoded joined, those of many texts at
    once; the ids of a piece start at the only one of its tokens that holds a space. Texts with other white space at such a
    cut (double spaces, a space after a newline) are given to the tokenizer whole, as are all texts when the tokenizer
    is of another kind. The result always equals ``Tokenizer.encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        before = self.tokenizer.pre_tokenizer
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.cuts = (
            isinstance(before, pre_tokenizers.ByteLevel) and not before.add_prefix_space and before.use_regex and self.tokenizer.normalizer is None
            and isinstance(self.tokenizer.model, models.BPE) and not any(a.lstrip or a.rstrip or a.single_word or " " in a.content for a in added)
        )
        # A word, and marks after it, are one pre-token each unless an added token could stand there.
        self.words = self.cuts and all(any(not c.isalpha() and c not in _MARKS for c in a.content) for a in added)
        # The same merges over pre-tokens that are cut and spelled already.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str], heads: set[str]) -> None:
        """Ids of new pieces and first pieces (kept after a space); when the memory is full it becomes the older one, and what that still held is forgotten."""
        again = [p for p in pieces if p in self.older]
        self.recent.update((p, self.older[p]) for p in again)
        plain, wide, other = [], [], []
        for piece in pieces.difference(again):
            if not self.words or not _WORD.fullmatch(piece):
                other.append(piece)
            else:
                (plain if piece.isascii() else wide).append(piece)
        joined = [(own, " " + " ".join(own)) for own in _chunks(other)]
        self._remember([own for own, _ in joined], self._encode([text for _, text in joined]))
        spelled = [(own, text) for own in _chunks(plain) for text in [" " + " ".join(own)]]
        spelled += [(own, text.encode().decode("latin-1").translate(_SPELLED)) for own in _chunks(wide) for text in [" " + " ".join(own)]]
        # A space stands before each pre-token; marks after a word are one of their own.
        told = [_MARKED.sub(" ", text.replace(" ", _SPACE)).replace(_SPACE, " " + _SPACE) for _, text in spelled]
        if told:
            found = [np.array(e.ids, self.dtype) for e in self.bare.encode_batch_fast(told, add_special_tokens=False)]
            self._remember([own for own, _ in spelled], found)
        first = list(heads)
        self.recent.update((" " + p, ids.tobytes()) for p, ids in zip(first, self._encode(first), strict=True))

    def _remember(self, groups: list[list[str]], encoded: list[np.ndarray]) -> None:
        """Cuts the ids of joined pieces before each id that starts with a space."""
        for own, ids in zip(groups, encoded, strict=True):
            ends = (np.flatnonzero(self.spaced[ids]) * self.dtype.itemsize).tolist()[1:]
            raw = ids.tobytes()
            self.recent.update((p, raw[a:b]) for p, a, b in zip(own, [0, *ends], [*ends, len(raw)], strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each of ``texts`` as packed integers of ``dtype``; new pieces of all texts are encoded together."""
        if not self.cuts:
            return [ids.tobytes() for ids in self._encode(texts)]
        if len(self.recent) > REMEMBERED:
            self.recent, self.older = {}, self.recent
        recent, unknown, heads, whole, split = self.recent, set(), set(), [], []
        for text in texts:
            head, *tail = text.split(" ")
            new = set(tail).difference(recent) - unknown
            if head and head[-1].isspace() or not head and tail or any(not p or p[-1].isspace() for p in new):
                whole.append(text)
                split.append(None)
                continue
            unknown |= new
            if " " + head not in recent:
                heads.add(head)
            split.append((" " + head, tail))
        if unknown or heads:
            self._learn(unknown, heads)
        odd = iter(self._encode(whole) if whole else [])
        return [next(odd).tobytes() if s is None else b"".join([recent[s[0]], *map(recent.__getitem__, s[1])]) for s in split]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class SequenceFile:
    """Appends ids to one stream of fixed-size-list batches; holds at most one batch."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int) -> None:
        self.dtype, self.length, self.held, self.size = dtype, length, [], 0
        self.value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(sink, self.schema)

    def append(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH * self.length * self.dtype.itemsize:
            self._write(final=False)

    def _write(self, final: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        step = BATCH * self.length
        whole = len(ids) if final else len(ids) // step * step
        for at in range(0, whole, step):
            part = ids[at : min(at + step, whole)]
            short = -len(part) % self.length
            mask = pa.array(np.arange(len(part) + short) < len(part))
            values = pa.array(np.concatenate([part, np.zeros(short, self.dtype)]))
            lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (values, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held = [ids[whole:].tobytes()]
        self.size = len(self.held[0])

    def close(self) -> None:
        self._write(final=True)
        self.writer.close()


class Sequences:
    """Random access to a file written by ``SequenceFile``; rows are views of the mapped file where the store maps."""

    def __init__(self, path: str) -> None:
        store, place = _open(path)
        source = pa.memory_map(place) if isinstance(store, pafs.LocalFileSystem) else pa.BufferReader(store.open_input_file(place).read_buffer())
        self.batches = pa.ipc.open_stream(source).read_all().to_batches()
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``; every batch but the last has BATCH rows."""
        batch = self.batches[i // BATCH]
        row = i % BATCH
        return batch.column("ids")[row].values.to_numpy(zero_copy_only=True), batch.column("mask")[row].values

    def span(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from id ``start`` of the file."""
        parts, step = [], BATCH * self.length
        while count > 0:
            flat = self.batches[start // step].column("ids").flatten().to_numpy(zero_copy_only=True)
            part = flat[start % step : start % step + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts (null: empty) of at most about TOGETHER characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= TOGETHER:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_sequences(docs: DataFrame, folder: str, tokenizer: Callable[[], str], length: int = SEQUENCE, end: int = END) -> DataFrame:
    """Tokenise ``docs`` (``doc_id``, ``text``) into files below ``folder``; returns the stored manifest.

    ``tokenizer`` gives the path of the tokenizer file where it is called, on the executors. Documents are ordered by
    ``doc_id`` (null first, equal ids by text), each followed by the id ``end``; null texts count as empty. A very long text
    is held whole, as its pieces and its ids, in the task that writes it.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), None
        ids, sizes = [], []
        for doc_ids, texts in _together(batches):
            encoder = encoder_of(tokenizer())
            for doc_id, found in zip(doc_ids, encoder.batch(texts), strict=True):
                if made is None:
                    paths = [f"{folder}/{part:06d}-{uuid.uuid4().hex}.{kind}.arrows" for kind in ("ids", "docs")]
                    store, place = _open(paths[0])
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(place)
                    made, last = SequenceFile(sink, encoder.dtype, length), encoder.dtype.type(end).tobytes()
                found += last
                made.append(found)
                ids.append(doc_id)
                sizes.append(len(found) // encoder.dtype.itemsize)
        if made is None:
            return
        made.close()
        sink.close()
        starts = np.cumsum(sizes) - sizes
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        store, place = _open(paths[1])
        with store.open_output_stream(place) as out, pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table, max_chunksize=1 << 16)
        row = [[part], paths[:1], paths[1:], [len(ids)], [int(sum(sizes))], ids[:1]]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = narrow.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``base``: ids in all files before. One row per file of some 100 MB, so one window over all."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files that ``manifest`` names.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the unsigned CRC-32 of the document's ids as
    little-endian unsigned 32-bit integers. Files are dealt out over the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids_path, docs_path, base in zip(*(batch.column(n).to_pylist() for n in ("ids_path", "docs_path", "base")), strict=True):
                file = Sequences(ids_path)
                store, place = _open(docs_path)
                with store.open_input_stream(place) as source, pa.ipc.open_stream(source) as documents:
                    for rows in documents:
                        start, count = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(file.span(a, n).astype("<u4").tobytes()) for a, n in zip(start.tolist(), count.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(start + base), rows.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("ids_path", "docs_path", "base")
    return files.repartition(max(1, files.count()), "ids_path").mapInArrow(run, ROWS)
