"""Distributions that add up: tables of value counts by market day.

A day's offers are counted once, by group and value. Counts of days add up, so any statistic of values — exact quartiles,
whiskers, means — of any range of days comes from their counts alone, through the operators of ``stats`` with
``weight=COUNT``; the offers are not read again. A day that is counted anew replaces its counts and no other's.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a counted row stands for, and the day it belongs to.
COUNT, DAY = "n", "market_day"


def value_counts(long: DataFrame, by: Sequence[str], value: str = "PRICE", day: str = "SETTLEMENTDATE") -> DataFrame:
    """(market_day, *by, value, n): how many rows of each group have each value on each day; missing values are left out."""
    return long.where(F.col(value).isNotNull()).groupBy(F.to_date(day).alias(DAY), *by, value).agg(F.count("*").alias(COUNT))


def write_counts(counts: DataFrame, dst: str) -> None:
    """Write counts to Parquet, a directory per market day. Days present replace those at ``dst``; others stay.

    A day's counts go out in as many files as their size asks for, sorted, so that equal groups and values lie together.
    """
    keys = [c for c in counts.columns if c not in (DAY, COUNT)]
    (
        counts.repartitionByRange(DAY, *keys).sortWithinPartitions(DAY, *keys)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(dst)
    )


def counts_of_days(spark: SparkSession, src: str, first: date | str | None = None, last: date | str | None = None) -> DataFrame:
    """The counts of the market days from ``first`` to ``last``, both included; other days' files are not opened."""
    counts = spark.read.parquet(src)
    if first is not None:
        counts = counts.where(F.col(DAY) >= F.lit(first).cast("date"))
    if last is not None:
        counts = counts.where(F.col(DAY) <= F.lit(last).cast("date"))
    return counts
