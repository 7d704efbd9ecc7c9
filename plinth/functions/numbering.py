"""Row numbering and digests that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def renumber(df: DataFrame, keys: list[str], position: str, out: str, start: int = 0) -> DataFrame:
    """Dense numbers along an integer ``position`` within ``keys``.

    Rows are counted per block of positions first, so the only window over a whole key runs on one
    row per block; the window over rows is bounded by the block size.
    """
    block = F.floor(F.col(position) / BLOCK).alias("_block")
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_block").orderBy(position)
    return (
        df.withColumn("_block", F.floor(F.col(position) / BLOCK))
        .withColumn("_rank", F.row_number().over(local))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, (F.col("_before") + F.col("_rank") - 1 + start).cast("int"))
        .drop("_block", "_rank", "_before")
    )


def ordered_text(position: Column, text: Column, separator: str = ",") -> Column:
    """Aggregate: texts joined in ``position`` order. Use on groups of bounded size only."""
    pairs = F.array_sort(F.collect_list(F.struct(position.alias("p"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda pair: pair["t"]), separator)


def renumber_by(df: DataFrame, keys: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    """Zero-based places within ``keys`` along ``order``, with the sort split by ``bucket``.

    ``bucket`` must not decrease along ``order``; offsets come from counts per bucket, so a hot key is
    sorted in as many tasks as it has buckets.
    """
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_rank", F.row_number().over(local))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("int"))
        .drop("_bucket", "_rank", "_before")
    )
