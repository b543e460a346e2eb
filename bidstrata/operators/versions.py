"""Offer versions of an auction: rebid flags, initial and final offers, version numbers and timelines.

``keys`` name the auction (add PERIODID for detail rows); ``order`` is the offer time followed by tiebreak columns that
make it total (``default_order`` if not given). ``split_rows`` is how many rows of one auction go into one task
(``slicing.SPLIT_ROWS`` if not given).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidstrata.functions.periods import position
from bidstrata.operators.slicing import (
    KEY, SLICE, carry_in, previous_row, running_sums, slice_hot_groups, slice_order, slices_before,
)
from bidstrata.schema import AUCTION, OFFER_TIME, PERIOD, PRICE_BANDS, QUANTITY_BANDS, TIEBREAKS

DETAIL = [*AUCTION, PERIOD]


def default_order(df: DataFrame, bands: Sequence[str]) -> list[str]:
    """Offer time, then what settles offers of one instant: of the registry's tiebreaks those the table has, then
    the bands. Rows that tie on all of these are alike to every operator here."""
    return [OFFER_TIME, *[c for c in (*TIEBREAKS, *bands) if c in df.columns]]


def lag_bands(
    df: DataFrame, keys: Sequence[str] = DETAIL, order: Sequence[str] | None = None,
    bands: Sequence[str] = QUANTITY_BANDS, suffix: str = "_PREV", split_rows: int | None = None,
) -> DataFrame:
    """Add each band's value in the previous offer, and ``is_first``."""
    df = previous_row(df, keys, order or default_order(df, bands), bands, "_prev", "is_first", split_rows)
    return df.withColumns({f"{b}{suffix}": F.col(f"_prev.{b}") for b in bands}).drop("_prev")


def differs(bands: Sequence[str], prev: str, null_equal: bool) -> Column:
    if null_equal:
        return ~F.struct(*bands).eqNullSafe(F.col(prev))
    # A missing band counts as different from everything, itself included.
    any_band = F.lit(False)
    for b in bands:
        any_band = any_band | F.coalesce(F.col(b) != F.col(f"{prev}.{b}"), F.lit(True))
    return any_band


def flag_true_rebids(
    df: DataFrame, keys: Sequence[str] = DETAIL, order: Sequence[str] | None = None,
    bands: Sequence[str] = QUANTITY_BANDS, null_equal: bool = True, split_rows: int | None = None,
) -> DataFrame:
    """Add ``is_first`` and ``is_true_rebid``: not first, and some band differs from the previous offer."""
    df = previous_row(df, keys, order or default_order(df, bands), bands, "_prev", "is_first", split_rows)
    return df.withColumn("is_true_rebid", ~F.col("is_first") & differs(bands, "_prev", null_equal)).drop("_prev")


def keep_true_rebids(
    df: DataFrame, keys: Sequence[str] = DETAIL, order: Sequence[str] | None = None,
    bands: Sequence[str] = QUANTITY_BANDS, null_equal: bool = True, split_rows: int | None = None,
) -> DataFrame:
    """First offers and those that changed a band since the offer before, kept or not."""
    flagged = flag_true_rebids(df, keys, order, bands, null_equal, split_rows)
    return flagged.where(F.col("is_first") | F.col("is_true_rebid")).drop("is_first", "is_true_rebid")


def number_true_rebids(
    df: DataFrame, keys: Sequence[str] = DETAIL, order: Sequence[str] | None = None,
    bands: Sequence[str] = QUANTITY_BANDS, null_equal: bool = True, name: str = "version_index",
    split_rows: int | None = None,
) -> DataFrame:
    """``keep_true_rebids`` with the kept offers of an auction numbered 1, 2, 3, …, in one pass: slices are made once
    and serve both the comparison with the offer before and the numbers."""
    order = order or default_order(df, bands)
    row = F.struct(*bands)
    columns = df.columns
    sliced = slice_hot_groups(df, keys, order, split_rows=split_rows)
    sliced = carry_in(
        sliced, {"_last": F.max_by(row, F.struct(*order))}, {"_carried": F.lag("_last").over(slice_order())}, keep_parts=True)
    # _parts belongs to the group, so it splits nothing; as a window key it lets the filter below through.
    here = Window.partitionBy(KEY, SLICE, "_parts").orderBy(*order)
    sliced = sliced.withColumns({"_opens": F.row_number().over(here) == 1, "_before": F.lag(row).over(here)}).withColumn(
        "_prev", F.when(F.col("_opens"), F.col("_carried")).otherwise(F.col("_before")))
    first = F.col("_opens") & F.col("_carried").isNull()
    kept = sliced.where(first | differs(bands, "_prev", null_equal)).select(*columns, KEY, SLICE, "_parts")
    counts = kept.where("_parts IS NOT NULL").groupBy(KEY, SLICE).agg(F.count("*").alias("_kept"))
    earlier = counts.select(KEY, SLICE, F.sum("_kept").over(slices_before()).alias("_earlier"))
    numbered = kept.join(earlier, [KEY, SLICE], "left")
    return numbered.withColumn(name, F.row_number().over(here) + F.coalesce(F.col("_earlier"), F.lit(0))).select(*columns, name)


def _latest_first(df: DataFrame, order: Sequence[str]) -> Column:
    """Sort key whose minimum is the latest offer, and among tied times the first by the tiebreak."""
    return F.struct((-F.expr(position(df.schema[order[0]].dataType, order[0]))).alias("_t"), *order[1:])


def initial_offer(
    df: DataFrame, keys: Sequence[str] = AUCTION, order: Sequence[str] | None = None,
    cols: Sequence[str] = (OFFER_TIME, *PRICE_BANDS),
) -> DataFrame:
    """Earliest offer per auction; the first row by the tiebreak where times tie; untimed rows are ignored."""
    order = order or default_order(df, PRICE_BANDS)
    timed = df.where(F.col(order[0]).isNotNull()).dropna(subset=list(keys))
    picked = timed.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_o"))
    return picked.select(*keys, *[F.col(f"_o.{c}").alias(c) for c in cols])


def final_offer(
    df: DataFrame, keys: Sequence[str] = AUCTION, order: Sequence[str] | None = None,
    cols: Sequence[str] = (OFFER_TIME, *PRICE_BANDS),
) -> DataFrame:
    """Latest offer per auction, with the same rules as ``initial_offer``."""
    order = order or default_order(df, PRICE_BANDS)
    timed = df.where(F.col(order[0]).isNotNull()).dropna(subset=list(keys))
    picked = timed.groupBy(*keys).agg(F.min_by(F.struct(*cols), _latest_first(df, order)).alias("_o"))
    return picked.select(*keys, *[F.col(f"_o.{c}").alias(c) for c in cols])


def price_change(
    df: DataFrame, keys: Sequence[str] = AUCTION, order: Sequence[str] | None = None,
    bands: Sequence[str] = PRICE_BANDS,
) -> DataFrame:
    """Initial bands, final bands (``_FINAL``) and final minus initial (``_CHANGE``), in one aggregation."""
    order = order or default_order(df, bands)
    timed = df.where(F.col(order[0]).isNotNull()).dropna(subset=list(keys))
    row = F.struct(*bands)
    ends = timed.groupBy(*keys).agg(
        F.min_by(row, F.struct(*order)).alias("_i"), F.min_by(row, _latest_first(df, order)).alias("_f")
    )
    return ends.select(
        *keys,
        *[F.col(f"_i.{b}").alias(b) for b in bands],
        *[F.col(f"_f.{b}").alias(f"{b}_FINAL") for b in bands],
        *[(F.col(f"_f.{b}") - F.col(f"_i.{b}")).alias(f"{b}_CHANGE") for b in bands],
    )


def version_index(
    df: DataFrame, keys: Sequence[str] = DETAIL, order: Sequence[str] | None = None, name: str = "version_index",
    split_rows: int | None = None,
) -> DataFrame:
    """Number the versions of an auction 1, 2, 3, … by offer time."""
    order = order or default_order(df, (*PRICE_BANDS, *QUANTITY_BANDS))
    return running_sums(df, keys, order, {name: F.lit(1)}, split_rows)


def offer_timeline(
    df: DataFrame, keys: Sequence[str] = AUCTION, order: Sequence[str] | None = None,
    entry_col: str = "ENTRYTYPE", split_rows: int | None = None,
) -> DataFrame:
    """Offers of a market day in time order with ``version_index`` and ``version_label``.

    The earliest daily entry is the ``initial`` bid; later rows are ``rebid n``, earlier ones ``before initial``.
    """
    order = order or default_order(df, PRICE_BANDS)
    daily = df.where(F.upper(entry_col) == "DAILY")
    first = daily.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    since = F.coalesce(F.struct(*order) >= F.col("_first"), F.lit(False)).cast("int")
    numbered = running_sums(
        df.join(first, list(keys), "left"), keys, order, {"version_index": F.lit(1), "_since": since}, split_rows
    )
    label = (
        F.when(F.col("_since") == 1, "initial")
        .when(F.col("_since") > 1, F.concat(F.lit("rebid "), (F.col("_since") - 1).cast("string")))
        .otherwise("before initial")
    )
    return numbered.withColumn("version_label", label).drop("_first", "_since")
