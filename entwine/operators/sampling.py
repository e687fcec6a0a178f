"""Samples with an exact number of rows in each group, the same on every run and every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _first(df: DataFrame, n: int, group: str, order: list[Column], unknown: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(F.coalesce(F.col(group), F.lit(unknown))).orderBy(*order))
    # row_number <= n is pushed below the shuffle, so a hot group sends n rows of each partition only
    return df.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def exact_sample(df: DataFrame, n: int, key: str, group: str, seed: int = 42, unknown: str = "unk") -> DataFrame:
    """min(n, size) rows of each group, ordered by a hash of seed and key; null groups are `unknown`."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return _first(df, n, group, [mixed, F.col(key)], unknown)


def first_per_group(df: DataFrame, n: int, key: str, group: str, unknown: str = "unk") -> DataFrame:
    """The first n rows of each group by key."""
    return _first(df, n, group, [F.col(key)], unknown)
