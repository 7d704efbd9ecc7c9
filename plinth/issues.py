"""The one output shape shared by every quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["request_id", "code", "path", "message", "severity"]


def issue_rows(
    df: DataFrame,
    code: str | Column,
    path: str | Column,
    message: str | Column,
    severity: str = "blocking",
    key: str = "request_id",
) -> DataFrame:
    """One issue per row of ``df``; strings are literals, columns are taken as given."""

    def as_column(value: str | Column) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return df.select(
        F.col(key).cast("string").alias("request_id"),
        as_column(code).alias("code"),
        as_column(path).alias("path"),
        as_column(message).alias("message"),
        F.lit(severity).alias("severity"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)
