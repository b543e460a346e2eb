"""Column expressions that classify a bidding unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstrata.schema import AUTOBIDDER_BATTERY, NON_BATTERY, OTHER_BATTERY, VIRTUAL_PLANTS


def is_battery(type_col: str = "DISPATCHTYPE", storage_col: str | None = None) -> Column:
    """True for bidirectional units and, with ``storage_col``, for units of any storage capacity; what is missing speaks for
    no battery."""
    both_ways = F.coalesce(F.col(type_col) == "BIDIRECTIONAL", F.lit(False))
    return both_ways if storage_col is None else both_ways | F.coalesce(F.col(storage_col) > 0, F.lit(False))


def is_autobidder(flag_col: str = "AUTOBIDDER") -> Column:
    """The autobidder flag with a missing value read as false."""
    return F.coalesce(F.col(flag_col), F.lit(False))


def unit_category(type_col: str = "DISPATCHTYPE", flag_col: str = "AUTOBIDDER") -> Column:
    """One of the three bidder categories."""
    return (
        F.when(is_battery(type_col) & is_autobidder(flag_col), AUTOBIDDER_BATTERY)
        .when(is_battery(type_col), OTHER_BATTERY)
        .otherwise(NON_BATTERY)
    )


def autobidder_label(flag: Column) -> Column:
    return F.when(flag, "Autobidder").when(~flag, "Non-Autobidder")


def exclude_units(df: DataFrame, units: Sequence = VIRTUAL_PLANTS, col: str = "DUID") -> DataFrame:
    """Drop the named units; rows with no unit stay."""
    return df.where(~F.coalesce(F.col(col).isin(list(units)), F.lit(False)))


def ancillary_only(df: DataFrame, energy: str = "ENERGY", col: str = "BIDTYPE") -> DataFrame:
    """Everything but energy bids; rows with no service stay."""
    return df.where(~F.col(col).eqNullSafe(energy))
