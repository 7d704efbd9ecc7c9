"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

DataFrame functions only. Documents are reduced to sizes first, sizes to one row per source; the targets are found on
that small table. The fractional part of a source is a prefix of its documents in the order of a seeded digest: sums
per digest bucket find the bucket in which the prefix ends, and only that bucket is sorted, so a source with a third
of all rows is still spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.session import cut_lineage

MAX_EPOCHS = 3
SEED = 42
#: Leading hex digits of the digest that name a bucket.
BUCKET_DIGITS = 3
#: Sources whose plan is broadcast (a few hundred bytes each); with more, joins on the source are salted.
SOURCES_AT_ONCE = 50_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digest_of(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_weights(sources: DataFrame) -> DataFrame:
    """Adds ``weight``: 1, 2, 3, repeating along the sources by code point, null last.

    Sources are sorted per leading bytes; the only window over all of them has one row per such head.
    """
    head = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.hex(F.substring(F.col("source").cast("binary"), 1, 2))))
    marked = sources.withColumn("head", head)
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("head").agg(F.count(F.lit(1)).alias("n")).select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    local = Window.partitionBy("head").orderBy(F.col("source").asc_nulls_last())
    placed = marked.withColumn("rank", F.row_number().over(local)).join(offsets, "head")
    return placed.select(*sources.columns, ((F.col("ahead") + F.col("rank") - 1) % 3 + 1).cast("double").alias("weight"))


def water_fill(sources: DataFrame, share: float = 1.0, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to ``source, source_size, weight``.

    The targets share ``share`` of all sizes by weight. A source whose part would exceed ``epochs`` times its size is
    clamped there, and what it leaves is shared again among the others by weight, until none is above. A round is one
    aggregation over the sources, of which the driver sees a few sums. If all are clamped, the rest stays unused.
    """
    table = cut_lineage(sources.withColumn("cap", (F.col("source_size") * epochs).cast("double")).withColumn("clamped", F.lit(False)))
    total = None
    while True:
        sums = table.agg(F.sum("source_size").alias("total"), F.sum(F.when(F.col("clamped"), F.col("cap"))).alias("used"), F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("free")).first()
        total = (sums["total"] or 0) * share
        if not sums["free"]:
            return table.select(*sources.columns, F.col("cap").alias("target"))
        part = F.lit((total - (sums["used"] or 0.0)) / sums["free"]) * F.col("weight")
        over = ~F.col("clamped") & (part > F.col("cap"))
        if table.filter(over).isEmpty():
            return table.select(*sources.columns, F.when(F.col("clamped"), F.col("cap")).otherwise(part).alias("target"))
        table = cut_lineage(table.withColumn("clamped", F.col("clamped") | over))


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, digest``: a narrow table, stored, so that texts are read once."""
    return cut_lineage(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), digest_of(F.col("doc_id"), seed).alias("digest")))


def plan(sized: DataFrame, share: float = 1.0, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, cut``.

    Every row is taken ``whole`` times, and once more if its digest is not above ``cut``. Digests are taken in order
    while the middle of their rows lies within what is still missing, so a source ends within half a row of its
    target (rows that share an id share a digest and count together). A source of size 0 has target 0.
    """
    buckets = cut_lineage(sized.groupBy("source", F.substring("digest", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("n")))
    filled = water_fill(source_weights(buckets.groupBy("source").agg(F.sum("n").alias("source_size"))), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    planned = filled.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = buckets.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = by_source(ahead, planned).filter(F.col("ahead") + F.col("n") > F.col("missing"))
    edges = met.groupBy("source").agg(F.min(F.struct("bucket", "ahead", "missing")).alias("e")).select("source", "e.*")
    rows = by_source(sized, edges).filter(F.substring("digest", 1, BUCKET_DIGITS) == F.col("bucket"))
    once = rows.groupBy("source", "digest").agg(F.sum("size").alias("n"), F.first("ahead").alias("ahead"), F.first("missing").alias("missing"))
    within = Window.partitionBy("source").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("ahead") + F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("n") / 2
    last = once.withColumn("middle", middle).filter("middle < missing").groupBy("source").agg(F.max("digest").alias("last"))
    cuts = by_source(by_source(planned, edges.drop("missing", "ahead"), "left"), last, "left")
    return cut_lineage(cuts.select("source", "source_size", "target", "whole", F.coalesce("last", "bucket", F.lit("")).alias("cut")))


def by_source(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source`` (null equals null). ``small`` has a row per source, so a hot source can be split: it is
    broadcast while counted to be within SOURCES_AT_ONCE, and salted otherwise."""
    right = small.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if small.limit(SOURCES_AT_ONCE + 1).count() <= SOURCES_AT_ONCE:
        return rows.join(F.broadcast(right), same, how).drop("_source")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("_part") == F.col("_salt")), how).drop("_source", "_salt", "_part")


def mixture(docs: DataFrame, share: float = 1.0, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, times, taken`` for every row of ``docs`` (``doc_id, text, source``).

    Null texts have size 0, a null source is a source of its own (last in order), a null id has a digest as ''. Equal
    ids are taken alike. The same rows and seed give the same mix, in any partitioning. An empty table gives none.
    """
    sized = sizes(docs, seed)
    found = by_source(sized, plan(sized, share, epochs)).withColumn("times", times())
    return found.select("doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def times() -> Column:
    return F.col("whole") + (F.col("digest") <= F.col("cut")).cast("int")


def mix(docs: DataFrame, share: float = 1.0, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mixture`` takes it, columns as they are."""
    planned = plan(sizes(docs, seed), share, epochs).withColumnRenamed("source", "_of").select("_of", F.struct("whole", "cut").alias("_plan"))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.struct(*docs.columns).alias("_row"), digest_of(F.col("doc_id"), seed).alias("digest"))
    taken = by_source(rows, planned.withColumnRenamed("_of", "source")).withColumn("_times", F.col("_plan.whole") + (F.col("digest") <= F.col("_plan.cut")).cast("int"))
    return taken.filter("_times > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select("_row.*")
