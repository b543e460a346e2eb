"""Market outcomes: price separation between regions, service revenue, cumulative energy and state of charge."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.operators.joins import dispatch_value
from bidstrata.operators.slicing import KEY, SLICE, running_sums, slice_hot_groups, within
from bidstrata.operators.validity import versions_in_force
from bidstrata.schema import ENERGY

HOURS = 5 / 60


def price_separation(prices: DataFrame, by: Sequence[str] = ("SETTLEMENTDATE", "BIDTYPE")) -> DataFrame:
    """Spread of a service's price between regions in an interval."""
    return prices.groupBy(*by).agg(
        F.count("PRICE").alias("n_regions"), F.min("PRICE").alias("min_price"), F.max("PRICE").alias("max_price"),
        (F.max("PRICE") - F.min("PRICE")).alias("separation"),
    )


def fcas_revenue(
    load: DataFrame, prices: DataFrame, units: DataFrame, by: Sequence[str] = ("DUID", "BIDTYPE"), at: str | None = None
) -> DataFrame:
    """Ancillary-service revenue per unit and service: price × enabled MW × 5/60, energy left out. ``at``: the time whose
    registration counts where units are listed by period (see ``with_region``).

    MW is summed per region, interval and unit side first, so what meets the price table is already small.
    """
    enabled = load.where(~F.col("BIDTYPE").eqNullSafe(ENERGY))
    enabled = enabled.groupBy("DUID", "SETTLEMENTDATE", "BIDTYPE").agg(F.sum("MW").alias("MW"))
    return dispatch_value(enabled, prices, units, at=at).groupBy(*by).agg(
        F.sum("MW").alias("total_mw"), F.sum("value").alias("revenue")
    )


def _energy_order(load: DataFrame, keys: Sequence[str], order: Sequence[str] | None) -> list[str]:
    """The given order, or time and then every other column: rows that tie on it are the same row twice."""
    return list(order) if order else ["SETTLEMENTDATE", *[c for c in load.columns if c not in ("SETTLEMENTDATE", *keys)]]


def energy_taken_in(mw: Column | str = "MW", efficiency: float = 1.0) -> Column:
    """MWh that a five-minute interval puts into store. Positive MW is discharge. Charging adds ``efficiency`` times what
    was drawn; discharging takes off all of it."""
    flow = F.col(mw) if isinstance(mw, str) else mw
    return F.when(flow < 0, -flow * efficiency).otherwise(-flow) * HOURS


def cumulative_energy(
    load: DataFrame, keys: Sequence[str] = ("DUID",), order: Sequence[str] | None = None,
    mw: Column | str = "MW", efficiency: float = 1.0, split_rows: int | None = None,
) -> DataFrame:
    """Running energy taken in, in MWh, as a stand-in for state of charge without limits (see ``state_of_charge``).

    ``order`` must be total; by default it is time and then all other columns.
    """
    order = _energy_order(load, keys, order)
    return running_sums(load, keys, order, {"cumulative_mwh": energy_taken_in(mw, efficiency)}, split_rows)


# --- state of charge ------------------------------------------------------------------------------
#
# A store of capacity c takes energy x in: s -> min(c, max(0, s + x)). Any number of such steps in a row is a function of
# the same form, s -> min(high, max(low, s + shift)), so a slice of a long history adds up to three numbers, and slices
# follow one another like the steps themselves.

_INNER = ["_opens", "_start", "_in", "_cap"]


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``_level``, the level after each row. Rows of a slice follow one another, the first one ``_opens`` it."""
    level = 0.0
    for batch in batches:
        out = np.empty(batch.num_rows)
        columns = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in _INNER]
        for k, (opens, start, taken, cap) in enumerate(zip(*columns, strict=True)):
            level = min(cap, max(0.0, (start if opens else level) + taken))
            out[k] = level
        kept = [n for n in batch.schema.names if n not in _INNER]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(out)], [*kept, "_level"])


def _slice_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, slice, shift, low, high): what the rows of each slice, which follow one another, add up to."""
    names, now = [KEY, SLICE, "_shift", "_low", "_high"], None
    for batch in batches:
        kinds = [*[batch.schema.field(c).type for c in names[:2]], *[pa.float64()] * 3]
        done = []
        columns = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_opens", "_in", "_cap")]
        for k, (opens, taken, cap) in enumerate(zip(*columns, strict=True)):
            if opens:
                if now:
                    done.append(now)
                now = [batch.column(KEY)[k].as_py(), batch.column(SLICE)[k].as_py(), 0.0, float("-inf"), float("inf")]
            now[2:] = now[2] + taken, min(cap, max(0.0, now[3] + taken)), min(cap, max(0.0, now[4] + taken))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now, kinds, strict=True)], names)


def _slice_starts(initial: float):
    """(key, slice, start): the level that each slice starts from. Slices of a key follow one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, level = None, initial
        for batch in batches:
            starts = []
            for r in batch.to_pylist():
                if r[KEY] != last:
                    last, level = r[KEY], initial
                starts.append(level)
                level = min(r["_high"], max(r["_low"], level + r["_shift"]))
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column(SLICE), pa.array(starts, pa.float64())], [KEY, SLICE, "_start"])

    return run


def with_capacity(load: DataFrame, details: DataFrame, at: str = "SETTLEMENTDATE") -> DataFrame:
    """Attach the storage capacity that the unit's registration in force at ``at`` gives (DUID, EFFECTIVEDATE, VERSIONNO,
    MAXSTORAGECAPACITY); null where there is none."""
    return versions_in_force(load, details, ["DUID"], at, cols=["MAXSTORAGECAPACITY"])


def state_of_charge(
    load: DataFrame, capacity: Column | str = "MAXSTORAGECAPACITY", keys: Sequence[str] = ("DUID",),
    order: Sequence[str] | None = None, mw: Column | str = "MW", efficiency: float = 1.0, initial: float = 0.0,
    split_rows: int | None = None,
) -> DataFrame:
    """Add ``charge_mwh``: the energy in store after each interval, never below zero nor above the ``capacity`` of its row.

    Each unit starts with ``initial`` MWh. What the limits cut off is gone: a later interval starts from the level
    reached. A row without MW takes nothing in. One without a capacity, or a negative one, has no store: its level is null,
    and zero for what follows. ``order`` must be total; by default it is time and then all other columns.

    The steps are run by one task per slice of a unit's history (``slicing``), streaming; a slice starts from what the
    slices before it add up to.
    """
    order, number = _energy_order(load, keys, order), T.DoubleType()
    cap = F.col(capacity) if isinstance(capacity, str) else capacity
    rows = load.withColumns({
        "_in": F.coalesce(energy_taken_in(mw, efficiency), F.lit(0.0)).cast("double"),
        "_has": F.coalesce(cap >= 0, F.lit(False)), "_cap": F.greatest(F.coalesce(cap, F.lit(0.0)), F.lit(0.0)).cast("double")})
    sliced = slice_hot_groups(rows, keys, order, split_rows=split_rows)
    # The window puts the rows of a slice in order, one slice after another; the steps read on from there.
    opens = F.row_number().over(within(order)) == 1
    parts = sliced.where("_parts IS NOT NULL").withColumn("_opens", opens).select(KEY, SLICE, "_opens", "_in", "_cap")
    named = [parts.schema[KEY], parts.schema[SLICE]]
    sums = parts.mapInArrow(_slice_sums, T.StructType([*named, *[T.StructField(c, number) for c in ("_shift", "_low", "_high")]]))
    starts = sums.repartition(KEY).sortWithinPartitions(KEY, SLICE).mapInArrow(  # under MAX_SLICES rows of a key
        _slice_starts(float(initial)), T.StructType([*named, T.StructField("_start", number)]))
    joined = sliced.drop("_parts").repartition(KEY, SLICE).join(starts, [KEY, SLICE], "left")
    ready = joined.withColumns({"_opens": opens, "_start": F.coalesce("_start", F.lit(float(initial)))}).drop(KEY, SLICE)
    done = ready.mapInArrow(_levels, T.StructType([
        *[f for f in ready.schema.fields if f.name not in _INNER], T.StructField("_level", number)]))
    return done.withColumn("charge_mwh", F.when(F.col("_has"), F.col("_level"))).drop("_has", "_level")
