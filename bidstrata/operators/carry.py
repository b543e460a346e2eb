"""State between ingests: what earlier months leave behind for the next one.

A carry table has a row for each group: its last row along the order, its sums and its number of rows so far. With it a
new month's rows are flagged, summed and matched as if all months were read again, though only the month itself and the
carry are. The carry rows go ahead of the month's as rows of their own and are taken out again, so the operators are the
same as for one run, hot groups included. A month must come after what its groups hold already; a late row is an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstrata.operators.joins import offer_in_force
from bidstrata.operators.slicing import previous_row, running_sums
from bidstrata.operators.versions import DETAIL, differs
from bidstrata.schema import OFFER_TIME, QUANTITY_BANDS


def carry_of(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] = (), sums: Mapping[str, Column] | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """(*keys, *order, *cols, *sums, rows): of each group the last row along ``order`` with ``cols``, the ``sums`` and the
    number of rows; with ``before``, the carry of earlier rows, of both together. Every task sends one row of a group."""
    names = list(sums or {})
    parts = df.select(*keys, F.struct(*order).alias("_at"), F.struct(*cols, F.lit(0).alias("_")).alias("_held"),
                      *[c.alias(n) for n, c in (sums or {}).items()], F.lit(1).cast("bigint").alias("rows"))
    if before is not None:
        parts = parts.unionByName(before.select(
            *keys, F.struct(*order).alias("_at"), F.struct(*cols, F.lit(0).alias("_")).alias("_held"), *names, "rows"))
    found = parts.groupBy(*keys).agg(
        F.max_by(F.struct("_at", "_held"), "_at").alias("_end"), *[F.sum(n).alias(n) for n in names], F.sum("rows").alias("rows"))
    return found.select(*keys, "_end._at.*", *[F.col(f"_end._held.{c}").alias(c) for c in cols], *names, "rows")


def not_before(df: DataFrame, carry: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df``; the query that reads it fails if a row does not come after the last one of its group in ``carry``."""
    last = carry.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.struct(*order).alias("_last"))
    same = F.expr(" AND ".join(f"`{k}` <=> _k{n}" for n, k in enumerate(keys)))
    late = F.raise_error(F.concat(F.lit("a row comes before what is carried: "), F.to_json(F.struct(*keys, *order))))
    return df.join(last, same, "left").where(
        F.when(F.col("_last").isNull() | (F.struct(*order) > F.col("_last")), F.lit(True)).otherwise(late.cast("boolean"))
    ).select(*df.columns)


def _led(df: DataFrame, carry: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The carried rows ahead of the new ones, told apart by ``_old``."""
    new = not_before(df, carry, keys, order).withColumn("_old", F.lit(False))
    return new.unionByName(carry.withColumn("_old", F.lit(True)), allowMissingColumns=True)


def flag_true_rebids_after(
    df: DataFrame, carry: DataFrame, keys: Sequence[str] = DETAIL, order: Sequence[str] = (OFFER_TIME,),
    bands: Sequence[str] = QUANTITY_BANDS, null_equal: bool = True, split_rows: int | None = None,
) -> DataFrame:
    """``flag_true_rebids`` of new rows, whose first in a group is compared with the carried one (``cols=bands``).

    A carried row must come first in its group, and no new one at its time: the pass that finds each row's last offer
    finds late rows too, so nothing is joined to check for them."""
    order, held = list(order), list(dict.fromkeys([*bands, *order, "_old"]))
    both = df.withColumn("_old", F.lit(False)).unionByName(
        carry.select(*keys, *order, *bands, F.lit(True).alias("_old")), allowMissingColumns=True)
    placed = previous_row(both, keys, order, held, "_seen", "is_first", split_rows)
    before = F.struct(*[F.col(f"_seen.{c}") for c in order])
    late = F.when(F.col("_old"), ~F.col("is_first")).otherwise(
        F.coalesce(F.col("_seen._old"), F.lit(False)) & F.struct(*order).eqNullSafe(before))
    fail = F.raise_error(F.concat(
        F.lit("a row comes before what is carried: "), F.to_json(F.struct(*keys, before.alias("at")))))
    new = placed.where(F.when(late, fail.cast("boolean")).otherwise(~F.col("_old")))
    flagged = new.withColumn("_prev", F.struct(*[F.col(f"_seen.{c}") for c in bands]))
    return flagged.select(*df.columns, "is_first", (~F.col("is_first") & differs(bands, "_prev", null_equal)).alias("is_true_rebid"))


def running_sums_after(
    df: DataFrame, carry: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], split_rows: int | None = None,
) -> DataFrame:
    """``running_sums`` of new rows, which go on from the carried sums of the same names."""
    both = _led(df.withColumns({f"_in_{n}": c for n, c in sums.items()}),
                carry.select(*keys, *order, *[F.col(n).alias(f"_in_{n}") for n in sums]), keys, order)
    summed = running_sums(both, keys, order, {n: F.col(f"_in_{n}") for n in sums}, split_rows)
    return summed.where("NOT _old").select(*df.columns, *sums)


def offer_in_force_after(
    intervals: DataFrame, offers: DataFrame, carry: DataFrame, keys: Sequence[str] = ("DUID", "BIDTYPE"), offer_time: str = OFFER_TIME,
    cols: Sequence[str] = (), tiebreak: str | None = None, **options,
) -> DataFrame:
    """``offer_in_force`` of new intervals among new offers and the carried last ones."""
    wanted = list(dict.fromkeys([*keys, offer_time, *cols, *([tiebreak] if tiebreak else [])]))
    both = offers.select(*wanted).unionByName(carry.select(*wanted))
    return offer_in_force(intervals, both, keys, offer_time=offer_time, cols=cols, tiebreak=tiebreak, **options)
