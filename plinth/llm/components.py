"""Connected components of an edge table, by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import cut_lineage


def least_labels(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``vertex, label``: for every vertex of ``edges`` the smallest vertex that it reaches.

    Each round takes the least label among neighbours and then the label of that label, so a path shrinks
    geometrically. Rows per round are one per edge and one per vertex; a vertex with very many edges is
    reduced by partial aggregation, and its joins can be split by adaptive execution because the other side
    has one row per vertex. Rows with a null end are no edges. An empty table gives an empty table.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut_lineage(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "vertex"))
    while True:
        seen = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(seen.withColumnRenamed("a", "vertex"), "vertex").select("vertex", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("vertex").alias("label"), F.col("label").alias("far"))
        moved = cut_lineage(nearer.join(jump, "label").select("vertex", "was", F.least("label", "far").alias("label")))
        labels = moved.select("vertex", "label")
        if moved.filter("label <> was").isEmpty():
            return labels


def text_hash() -> Column:
    """Names the text of a row."""
    return F.xxhash64(F.col("text").cast("string"))


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` (``doc_id``, ``text``) per group of texts, the least by (``doc_id``, text hash), nulls last.

    ``groups``: ``text_hash, root``; a text without a row there is a group of its own. Rows equal in both, and only these,
    are told apart by their other columns, so a rerun keeps the same row. Columns stay as they are.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))
    rows = row.groupBy("hash", "id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("hash").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "n")).alias("first"))
    rooted = first.join(groups.select(F.col("text_hash").alias("hash"), "root"), "hash", "left").withColumn("root", F.coalesce("root", "hash"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("c_id"), F.col("first.hash").alias("c_hash"), F.col("first.n").alias("n"))
    found = row.join(chosen, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("hash") == F.col("c_hash")))
    # Of rows with one id and text the least by the other columns, met in parts first.
    several = found.filter("n > 1").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row"))
    return found.filter("n = 1").select("row.*").unionByName(several.select("row.*"))
