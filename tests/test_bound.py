"""Columns that are used several times are computed once per row."""

from pyspark.sql import functions as F

from plinth.operators import layout as L


def times(df, text):
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_spacing_reads_its_values_once(spark):
    rows = [([0.1, 0.2, 0.3, 0.4],), ([0.1, 0.2, 0.3, 0.6],), ([0.1, 0.101, 0.102],), ([0.1, 0.9],), ([],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>").select(L.regular(F.transform("v", lambda c: c * 1)).alias("r"))
    assert times(df, "transform(v#") == 1
    assert [r["r"] for r in df.collect()] == [True, False, False, True, True, None]
