"""Row-level market rules: service availability, band order, text clues and run filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: words that hint at an automated bid in a rebid explanation.
AUTOMATION_WORDS = "(?i)automated|algorithm"


def fcas_available(mw: Column, emin: Column, low: Column, high: Column, emax: Column, maxavail: Column) -> Column:
    """MW of a service a unit can offer at energy output ``mw``: full between the breakpoints, linear outside
    them, none beyond the enablement limits. Coinciding limits make a vertical edge."""
    rising = maxavail * F.try_divide(mw - emin, low - emin)
    falling = maxavail * F.try_divide(emax - mw, emax - high)
    return (
        F.when((mw < emin) | (mw > emax), 0.0)
        .when(mw < low, rising)
        .when(mw <= high, maxavail)
        .when(mw <= emax, falling)
    )


def bands_in_order(bands: Sequence[str]) -> Column:
    """True when the non-null bands do not decrease."""
    present = F.filter(F.array(*bands), lambda x: x.isNotNull())
    return F.array_sort(present) == present


def band_order_violations(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    return df.where(~bands_in_order(bands))


def mentions_automation(df: DataFrame, col: str, pattern: str = AUTOMATION_WORDS) -> DataFrame:
    """Flag rows whose text matches; no text is no mention."""
    return df.withColumn("mentions_automation", F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def binding(df: DataFrame, col: str = "MARGINALVALUE") -> DataFrame:
    """Rows of constraints that bound in their interval."""
    return df.where(F.col(col) > 0)


def actual_run(df: DataFrame, runno: int = 1, intervention: int = 0) -> DataFrame:
    """Rows of one dispatch run, the same for all intervals. See ``counting_run`` where runs differ by interval."""
    return df.where((F.col("RUNNO") == runno) & (F.col("INTERVENTION") == intervention))


def counting_run(
    df: DataFrame, keys: Sequence[str], intervention: Sequence[int] = (1, 0), rerun: str = "last",
) -> DataFrame:
    """Of each key, say a region, unit or constraint and an interval, the rows of the run that counts.

    Of several RUNNO the ``last`` or ``first`` counts; of its runs the one whose INTERVENTION comes first in
    ``intervention``: (1, 0) takes the intervened run wherever there is one, (0, 1) the other one, and either takes the only
    run of a key that has one. Values not named come after those named, null last. Keys may be null.
    """
    if rerun not in ("last", "first"):
        raise ValueError(f"unknown rerun {rerun!r}")
    wish = F.lit(len(intervention) + 1)
    for place, value in reversed(list(enumerate(intervention))):
        wish = F.when(F.col("INTERVENTION") == value, place).otherwise(wish)
    wish = F.when(F.col("INTERVENTION").isNull(), len(intervention) + 2).otherwise(wish)
    nth = -F.col("RUNNO") if rerun == "last" else F.col("RUNNO")
    # The least of (no number, number, wish, value) by key; every task sends one row of a key.
    run = F.struct(F.col("RUNNO").isNull().alias("unnumbered"), nth.alias("nth"), wish.alias("wish"), F.col("INTERVENTION").alias("kind"))
    best = df.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.min(run).alias("_run"))
    same = " AND ".join(f"`{k}` <=> _k{n}" for n, k in enumerate(keys))
    return df.withColumn("_mine", run).join(best, F.expr(f"{same} AND _mine <=> _run"), "left_semi").drop("_mine")
