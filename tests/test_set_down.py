"""Intermediates leave no shuffle files behind and keep their rows."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plinth.operators import planning as P
from plinth.session import in_turn, set_down

SF = "/root/testdata/sf0.001"


def shuffled(spark):
    """Shuffle files of this session's block managers."""
    top = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or "/tmp"
    return {f for d in top.split(",") for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def left_over(spark, before, most):
    """Bytes of new shuffle files once they are ``most`` or fewer, or after some seconds; files are removed in the background."""
    for _ in range(50):
        left = sum(os.path.getsize(f) for f in shuffled(spark) - before if os.path.exists(f))
        if left <= most:
            break
        time.sleep(0.1)
    return left


@pytest.mark.parametrize("name", ["preflight_build", "validate_plan", "compile_render_ops", "merge_overlapping_groups", "remap_pages", "canonicalize_plan", "ground_assets"])
def test_intermediates_of_a_query_leave_no_shuffle_files(spark, name):
    before = shuffled(spark)
    found = entry.queries()[name](spark, SF)
    assert left_over(spark, before, 20_000) <= 20_000
    assert found.count() > 0


def test_rows_are_kept_and_shuffles_freed(spark):
    df = spark.range(50_000).groupBy((F.col("id") % 40_000).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    df = df.withColumn("none", F.lit(None)).select("none", "k", "n", "last")
    before = shuffled(spark)
    held = set_down(df)
    assert left_over(spark, before, 0) == 0
    assert held.columns == df.columns
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, df.collect()))
    assert in_turn([df, df.limit(0), df]).count() == 80_000


def test_words_that_no_purpose_names_are_not_shuffled(spark):
    rng = random.Random(5)
    texts = [(f"r{i}", " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(8_000)) + " zebra photo.png", "") for i in range(4)]
    requests = spark.createDataFrame(texts, "request_id string, brief string, content_package string")
    images = spark.createDataFrame([(f"r{i}", "i0", "photo.png") for i in range(4)], "request_id string, id string, original_name string")
    slides = spark.createDataFrame([(f"r{i}", 1, "zebra xylophone") for i in range(4)], "request_id string, number int, purpose string")
    before = shuffled(spark)
    found = P.identity_distances(requests, images, slides).collect()
    assert sorted((r.request_id, r.nearness) for r in found) == [(f"r{i}", 6 - P.FAR_NAME) for i in range(4)]
    assert sum(os.path.getsize(f) for f in shuffled(spark) - before) < 50_000
