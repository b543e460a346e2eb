"""Time expressions: five-minute periods, ordering positions and display labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_SECONDS = 86_400
PERIOD_SECONDS = 300


def market_time(text: Column) -> Column:
    """Parse ``yyyy/MM/dd HH:mm:ss[.SSS]``; anything else becomes null."""
    return F.replace(text, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")


def period_id(ts: Column | str, origin: int = 0, convention: str = "end") -> Column:
    """Number (1..288) of the five-minute period a timestamp belongs to.

    ``origin`` is the market day's start in minutes past midnight. ``convention`` says whether a timestamp
    marks the ``end`` of its interval (so 00:05 is period 1 and 00:00 is period 288) or its ``start``.
    """
    if convention not in ("start", "end"):
        raise ValueError(f"unknown convention {convention!r}")
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    shift = origin * 60 + (1 if convention == "end" else 0)
    into_day = F.pmod(second - F.lit(shift), F.lit(DAY_SECONDS))
    return (F.floor(into_day / PERIOD_SECONDS) + 1).cast("int")


def period_conventions(df: DataFrame, ts: str, origin: int = 0) -> DataFrame:
    """First and last period and the period count under both conventions: the two-ended sanity check."""
    kinds = F.array(*[F.struct(F.lit(c).alias("convention"), period_id(ts, origin, c).alias("p"))
                      for c in ("end", "start")])
    return (
        df.select(F.explode(kinds).alias("k"))
        .groupBy(F.col("k.convention").alias("convention"))
        .agg(F.min("k.p").alias("first_period"), F.max("k.p").alias("last_period"),
             F.count_distinct("k.p").alias("n_periods"))
    )


def expand_periods(df: DataFrame, start: str = "PERIODID", end: str = "PERIODIDTO") -> DataFrame:
    """One row per period where a detail row covers ``start``..``end`` (a missing or earlier end means one)."""
    last = F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start)))
    return (
        df.withColumn("_p", F.explode(F.sequence(F.col(start), last)))
        .withColumns({start: F.col("_p"), end: F.col("_p")})
        .drop("_p")
    )


def clock_label(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm"), F.lit("Unknown"))


def stamp_label(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyyMMdd_HHmm"), F.lit("Unknown"))


def has_position(kind: T.DataType) -> bool:
    """Whether ``position`` can lay out columns of this type."""
    return isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType, T.NumericType))


def position(kind: T.DataType, name: str) -> str:
    """SQL for a number that rises exactly as the column of type ``kind`` does, for times and numbers.

    Local times are laid out from their fields, so no session time zone can fold or skip an hour.
    """
    c = f"`{name}`"
    if isinstance(kind, T.TimestampNTZType):
        minutes = f"(unix_date(to_date({c})) * 24L + hour({c})) * 60 + minute({c})"
        return f"(({minutes}) * 60000000L + cast(date_part('SECOND', {c}) * 1000000 AS bigint))"
    if isinstance(kind, T.TimestampType):
        return f"unix_micros({c})"
    if isinstance(kind, T.DateType):
        return f"cast(unix_date({c}) AS bigint)"
    if isinstance(kind, T.NumericType):
        return c
    raise TypeError(f"{name}: expected a time or number column, got {kind.simpleString()}")
