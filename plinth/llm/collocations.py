"""Collocations by direct-address tiling: exact counts of phrases whose words stand side by side.

Words are counted first and ranked by frequency. A pair of ranks is a number that is also an address: pairs of
frequent words fall into square tiles of SIDE x SIDE cells, and a task counts a well-filled tile with one dense
``bincount``; sparse tiles and pairs outside the tiled zone become sorted coordinate lists. Both leave a task packed,
a row per tile or list, and are added up by tile. The frequent pairs are ranked in turn and take the place of the left
word, so phrases of three words (and longer ones) are counted by the same step.

Only the HEAD most frequent units of a level are ranked, so what is broadcast is bounded. Units beyond are met by their
spelling: a bitmap of fixed size tells which can be frequent at all (it errs only to that side), and phrases with such a
unit are shuffled as text rows. No phrase that can reach the least frequency is left out on either way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.session import arrow_rows, shared_folder

LONGEST, LEAST, KEPT, COVERED = 3, 10, 2000, 50
#: Ranked words and ranked longer phrases, of all languages together, at most. A right rank has RIGHT bits.
HEAD, PHRASE_HEAD, RIGHT = 500_000, 2_000_000, 20
#: Bits of the bitmap that tells units beyond the head which may be frequent.
BITS = 1 << 26
#: Ranks of the tiled zone, side of a tile, and the filling from which a tile is counted densely (cells per occurrence).
ZONE, SIDE, FILLED = 8192, 512, 16
#: First sums of a tile before its last one; occurrences per list of sparse pairs; pairs that a task holds.
SALTS, LIST, HELD = 16, 1_000_000, 1_000_000
#: Bytes of text that are split into words at once, distinct words that a task counts at once, texts in an Arrow batch.
SLICE, COUNTED, ROWS = 1_000_000, 150_000, 1000
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_SPLIT = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
PACKED = "lang string, tile int, salt int, keys binary, counts binary"
LEVEL = "lang string, phrase binary, n long, head int, tail int"


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a lower-cased text; a newline stands between pieces."""
    return list(filter(None, (raw or b"").lower().translate(_SPLIT).replace(b"\n", b" \n ").split(b" ")))


def _cut(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about SLICE bytes, cut between pieces."""
    at = 0
    while at < len(raw):
        cut = _ENDS.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        end = cut.end() if cut else len(raw)
        yield raw[at:end]
        at = end


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of some documents of one language at a time; pieces of different documents stay apart."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size: Counter[str] = Counter()
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for text in _cut(raw.as_py() or b""):
                held.setdefault(lang, []).append(text)
                size[lang] += len(text)
                if size[lang] >= SLICE:
                    yield lang, tokens(b"\n".join(held.pop(lang)))
                    size[lang] = 0
        for lang, texts in held.items():
            yield lang, tokens(b"\n".join(texts))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("raw"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, phrase, n``: all words of each language, and with a null phrase their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heard: dict[str, Counter[bytes]] = {}
        total: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in heard.items():
                columns = [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])
            heard.clear()

        for lang, found in _by_language(batches):
            own = heard.setdefault(lang, Counter())
            own.update(found)
            total[lang] += len(found) - own.pop(b"\n", 0)
            if sum(map(len, heard.values())) > COUNTED:
                yield from out()
        yield from out()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def least_count(level: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows of ``level`` reach, from a histogram of a few hundred classes."""
    classes = level.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()
    least, held = 1 << 62, 0
    for r in sorted(classes, key=lambda r: -r["c"]):
        held += r["rows"]
        if held > most:
            break
        least = r["least"]
    return least


def _bitmap(rows: DataFrame) -> np.ndarray | None:
    """Bits of the hashes of (``lang``, ``phrase``); None without rows."""
    at = F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b"\n"), F.col("phrase"))).bitwiseAND(F.lit(BITS - 1))
    word = F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))")
    found = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(word.alias("bits")).toArrow()
    if not found.num_rows:
        return None
    out = np.zeros(BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


class Ranks:
    """What tasks know of the frequent units: words by rank, longer phrases by (left rank, right rank), bitmaps of the rest."""

    def __init__(self) -> None:
        self.words: dict[str, pa.Array] = {}
        #: Per level from pairs on and language: sorted keys and their ranks.
        self.phrases: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
        self.bits: list[np.ndarray | None] = []
        #: Ranks of the tiled zone and side of a tile, as set on the driver.
        self.zone, self.side = ZONE, SIDE
        self._known: dict[str, dict[bytes, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def known(self, lang: str) -> dict[bytes, int]:
        if lang not in self._known:
            self._known[lang] = {w: i for i, w in enumerate(self.words[lang].to_pylist())} if lang in self.words else {}
        return self._known[lang]

    def may_be(self, level: int, lang: str, phrase: bytes) -> bool:
        bits = self.bits[level]
        at = xxhash.xxh64_intdigest(lang.encode() + b"\n" + phrase, 42) & (BITS - 1)
        return bool(int(bits[at >> 6]) >> (at & 63) & 1)

    def add_words(self, head: pa.Table) -> None:
        head = head.sort_by([("n", "descending"), ("phrase", "ascending")])
        for lang in pc.unique(head["lang"]).to_pylist():
            self.words[lang] = head.filter(pc.equal(head["lang"], lang))["phrase"].combine_chunks()

    def add_phrases(self, head: pa.Table) -> None:
        level = {}
        head = head.append_column("key", pa.array(head["head"].to_numpy().astype(np.int64) << RIGHT | head["tail"].to_numpy()))
        head = head.sort_by([("n", "descending"), ("key", "ascending")])
        for lang in pc.unique(head["lang"]).to_pylist():
            key = head.filter(pc.equal(head["lang"], lang))["key"].to_numpy()
            order = np.argsort(key)
            level[lang] = key[order], order.astype(np.int32)
        self.phrases.append(level)

    def units(self, lang: str, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the next longer phrase at every place: rank of its left part (or -1), rank of its last word (or -1), and whether it can be frequent."""
        get = self.known(lang).get
        words = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        rank, can = words, words >= 0
        if self.bits[0] is not None:
            rare = {w for w in {found[i] for i in np.flatnonzero(~can).tolist()} - {b"\n"} if self.may_be(0, lang, w)}
            can = can | np.fromiter((w in rare for w in found), bool, len(found))
        for k, level in enumerate(self.phrases, 1):
            left, right = rank[:-1], words[k:]
            both = can[:-1] & can[1:]
            keys, ranks = level.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
            rank = np.full(len(left), -1, np.int64)
            ask = np.flatnonzero(both & (left >= 0) & (right >= 0))
            if len(keys) and len(ask):
                key = left[ask] << RIGHT | right[ask]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                rank[ask] = np.where(keys[at] == key, ranks[at], -1)
            can = both & (rank >= 0)
            if self.bits[k] is not None:
                for i in np.flatnonzero(both & (rank < 0)).tolist():
                    can[i] = self.may_be(k, lang, b" ".join(found[i : i + k + 1]))
        size = len(self.phrases) + 1
        return rank[:-1], words[size:], can[:-1] & can[1:]


def _packed(ranks: Ranks, lang: str, key: np.ndarray, salt: int, lists: int) -> Iterator[tuple]:
    """Counted keys of one language: a row per tile, and one per list of pairs outside the zone."""
    left, right, side = key >> RIGHT, key & ((1 << RIGHT) - 1), ranks.side
    zone = (left < ranks.zone) & (right < ranks.zone)
    tile = (left[zone] // side * (ranks.zone // side) + right[zone] // side).astype(np.int16)
    cell = left[zone] % side * side + right[zone] % side
    order = np.argsort(tile, kind="stable")
    tile, cell = tile[order], cell[order]
    ends = np.flatnonzero(np.r_[tile[1:] != tile[:-1], True]) + 1 if len(tile) else []
    for a, b in zip([0, *ends[:-1]], ends, strict=False):
        if (b - a) * FILLED >= side * side:
            counts = np.bincount(cell[a:b], minlength=side * side)
            cells = np.flatnonzero(counts)
            counts = counts[cells]
        else:
            cells, counts = np.unique(cell[a:b], return_counts=True)
        yield lang, int(tile[a]), salt, cells.astype("<u4").tobytes(), counts.astype("<u4").tobytes()
    key, counts = np.unique(key[~zone], return_counts=True)
    own = _list_of(key, lists)
    order = np.argsort(own, kind="stable")
    key, counts, own = key[order], counts[order], own[order]
    ends = np.flatnonzero(np.r_[own[1:] != own[:-1], True]) + 1 if len(own) else []
    for a, b in zip([0, *ends[:-1]], ends, strict=False):
        yield lang, -1 - int(own[a]), 0, key[a:b].astype("<i8").tobytes(), counts[a:b].astype("<u4").tobytes()


def _list_of(key: np.ndarray, lists: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(lists)).astype(np.int32)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _added(batches: Iterator[pa.RecordBatch], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the packed rows of one tile or list. A tile is held as its cells; a list as its entries.

    Cells are packed in four bytes, other keys in eight; counts in four, or in eight where they are sums of several rows.
    """
    dense, keys, counts = None, [], []
    for batch in batches:
        for tile, key, count in zip(batch.column("tile").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
            key, raw = np.frombuffer(key.as_py(), "<u4" if tile >= 0 else "<i8"), count.as_py()
            count = np.frombuffer(raw, f"<u{len(raw) // len(key)}").astype(np.int64) if len(key) else np.zeros(0, np.int64)
            if tile >= 0:
                dense = np.zeros(cells, np.int64) if dense is None else dense
                dense[key] += count
            else:
                keys.append(key)
                counts.append(count)
    if dense is not None:
        held = np.flatnonzero(dense)
        return held, dense[held]
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first)


def _count_ranked(texts: DataFrame, spread, lists: dict[str, int], least: int) -> DataFrame:
    """``lang, head, tail, n``: ranks of the two parts of every phrase of the next length, both ranked, with ``n`` at least ``least``."""

    side, across = SIDE, ZONE // SIDE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, held, size = TaskContext.get().partitionId() % SALTS, {}, 0
        for lang, found in _by_language(batches):
            left, right, can = spread.value.units(lang, found)
            ok = can & (left >= 0) & (right >= 0)
            held.setdefault(lang, []).append(left[ok] << RIGHT | right[ok])
            size += len(held[lang][-1])
            if size >= HELD:
                for one, keys in held.items():
                    yield from (_rows([r], PACKED) for r in _packed(spread.value, one, np.concatenate(keys), salt, lists[one]))
                held, size = {}, 0
        for one, keys in held.items():
            yield from (_rows([r], PACKED) for r in _packed(spread.value, one, np.concatenate(keys), salt, lists[one]))

    def partly(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _added(batches, side * side)
        yield _rows([(key[0].as_py(), key[1].as_py(), 0, keys.astype("<u4").tobytes(), counts.astype("<u8").tobytes())], PACKED)

    def finish(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _added(batches, side * side)
        keys, counts = keys[counts >= least], counts[counts >= least]
        tile = key[1].as_py()
        if tile >= 0:
            head, tail = tile // across * side + keys // side, tile % across * side + keys % side
        else:
            head, tail = keys >> RIGHT, keys & ((1 << RIGHT) - 1)
        columns = [pa.array([key[0].as_py()] * len(keys), pa.string()), pa.array(head.astype(np.int32)), pa.array(tail.astype(np.int32)), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "head", "tail", "n"])

    packed = texts.mapInArrow(pack, PACKED)
    folder = shared_folder(texts.sparkSession, "tiles")
    packed.write.parquet(folder)
    packed = texts.sparkSession.read.schema(PACKED).parquet(folder)
    tiles = packed.filter("tile >= 0").groupBy("lang", "tile", "salt").applyInArrow(partly, PACKED)
    return tiles.unionByName(packed.filter("tile < 0")).groupBy("lang", "tile").applyInArrow(finish, "lang string, head int, tail int, n long")


def _count_spelled(texts: DataFrame, spread, least: int) -> DataFrame:
    """``lang, phrase, n`` of phrases of the next length that can be frequent and have a part beyond the ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _by_language(batches):
            left, right, can = spread.value.units(lang, found)
            size = len(found) - len(left) + 1
            at = np.flatnonzero(can & ((left < 0) | (right < 0))).tolist()
            heard = Counter(b" ".join(found[i : i + size]) for i in at)
            yield _rows([(lang, p, n) for p, n in heard.items()], "lang string, phrase binary, n long")

    counted = texts.mapInArrow(run, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def _spelled(ranked: DataFrame, spread) -> DataFrame:
    """``LEVEL`` rows of counted ranks: a rank is spelled out from the words it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank: dict[tuple[int, str], np.ndarray] = {}
        ranks = spread.value

        def spell(level: int, lang: str, rank: np.ndarray) -> list[np.ndarray]:
            if level == 0:
                return [rank]
            if (level, lang) not in by_rank:
                keys, order = ranks.phrases[level - 1][lang]
                by_rank[level, lang] = held = np.empty(len(keys), np.int64)
                held[order] = keys
            key = by_rank[level, lang][rank]
            return [*spell(level - 1, lang, key >> RIGHT), key & ((1 << RIGHT) - 1)]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in pc.unique(table["lang"]).to_pylist():
                own = table.filter(pc.equal(table["lang"], lang)).combine_chunks()
                parts = [*spell(len(ranks.phrases), lang, own["head"].to_numpy()), own["tail"].to_numpy()]
                spelled = [ranks.words[lang].take(pa.array(p)) for p in parts]
                phrase = pc.binary_join_element_wise(*spelled, pa.scalar(b" ", pa.binary()))
                columns = [own["lang"].combine_chunks(), phrase, *(own[c].combine_chunks() for c in ("n", "head", "tail"))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "head", "tail"])

    return ranked.mapInArrow(run, LEVEL)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Per length from 1 to ``longest`` the table ``lang, phrase, n`` of phrases (binary) with ``n >= least``, and ``lang, n`` of all words."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "phrases")
    texts = _texts(docs)
    word_counts(texts).filter((F.col("n") >= least) | F.col("phrase").isNull()).write.parquet(f"{folder}/1")
    counted = spark.read.schema("lang string, phrase binary, n long").parquet(f"{folder}/1")
    totals = counted.filter("phrase IS NULL").select("lang", "n")
    level = counted.filter("phrase IS NOT NULL")
    lists = {r["lang"]: max(1, -(-r["n"] // LIST)) for r in totals.collect()}
    ranks, levels = Ranks(), [level]
    for size in range(2, longest + 1):
        known = level if size == 2 else level.filter("head IS NOT NULL")
        bound = F.col("n") >= least_count(known, HEAD if size == 2 else PHRASE_HEAD)
        (ranks.add_words if size == 2 else ranks.add_phrases)(known.filter(bound).toArrow())
        beyond = level.filter(~bound if size == 2 else ~bound | F.col("head").isNull())
        ranks.bits.append(_bitmap(beyond))
        spread = spark.sparkContext.broadcast(ranks)
        found = _spelled(_count_ranked(texts, spread, lists, least), spread)
        if any(b is not None for b in ranks.bits):
            rest = _count_spelled(texts, spread, least).withColumns({"head": F.lit(None).cast("int"), "tail": F.lit(None).cast("int")})
            found = found.unionByName(rest)
        found.write.parquet(f"{folder}/{size}")
        level = spark.read.schema(LEVEL).parquet(f"{folder}/{size}")
        levels.append(level)
    return [x.select("lang", "phrase", "n") for x in levels], totals


def _scored(levels: list[DataFrame]) -> DataFrame:
    """``lang, phrase, size, a, l, r, score``: each phrase of two words or more with its lowest-scoring cut, ties to the shortest first part."""
    parts = levels[0].withColumn("size", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        parts = parts.unionByName(level.withColumn("size", F.lit(k)))
    parts = parts.withColumn("phrase", F.col("phrase").cast("string"))
    words = F.split("phrase", " ")
    cuts = parts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, 1, F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")})
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    # Counts below 10^14 keep every product within 38 digits.
    score = F.expr("(cast(a AS decimal(14)) * cast(a AS decimal(14)) * cast(1000000 AS decimal(7))) div (cast(l AS decimal(14)) * cast(r AS decimal(14)))")
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "size", "a")).alias("b"))
    return best.select("lang", "phrase", "b.size", "b.a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, kept: int = KEPT, covered: int = COVERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``kept`` phrases of each language (``docs.lang``, null: ``und``).

    A phrase of 2 to ``longest`` words that stands at least ``least`` times inside pieces of texts (``docs.text``, null:
    empty) scores ``floor(1000000 a a / (l r))`` by its worst cut. It goes if a longer frequent phrase that contains it
    has ``covered`` per cent or more of its occurrences. Order: score, then ``a``, both descending, then the phrase by
    its bytes. Repeated rows count again; a language without words, or an empty table, has no rows. Other columns are
    not read. Counts must stay below 10^14.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, ROWS):
        levels, totals = frequent_phrases(docs, longest, least)
    folder = shared_folder(spark, "scored-phrases")
    _scored(levels).write.parquet(folder)
    scored = spark.read.schema("lang string, phrase string, size int, a long, l long, r long, score long").parquet(folder)
    words = F.split("phrase", " ")
    inner = scored.filter("size > 2").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")).alias("phrase"),
    )
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = left.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= kept)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= kept)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
