"""Tables whose rows hold for a period: versions, registrations, invocations.

A period begins at its start and ends before its end; a null start is since ever, a null end until further notice, and
one that ends no later than it starts holds never. Keys may be null and equal each other. Periods of a key that must not
overlap are checked while a query runs: an overlap raises instead of multiplying rows.

Such tables are registers, which do not grow with the data they are joined to: by default one task reads a key's periods,
streaming. With ``split_rows`` a key of more is cut as in ``slicing``, at the cost of a larger plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidstrata.operators.slicing import (
    KEY, SLICE, carry_in, last_known, running_sums, slice_hot_groups, slices_before, within,
)

#: Whether the period (``start``, ``end``) holds at ``at``, or at all.
_HOLDS = "(`{start}` IS NULL OR `{start}` <= {at}) AND (`{end}` IS NULL OR {at} < `{end}`)"
_EVER = "(`{start}` IS NULL OR `{end}` IS NULL OR `{start}` < `{end}`)"


def _with_ends_before(df: DataFrame, keys: Sequence[str], start: str, end: str, name: str, split_rows: int | None) -> DataFrame:
    """Add the latest end of the key's periods that come before, as a struct (open, till); null in the first."""
    order = [start, "_till"]
    rows = df.withColumn("_till", _till(end))
    if not split_rows:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.max("_till").over(before)).drop("_till")
    cut = carry_in(
        slice_hot_groups(rows, keys, order, split_rows=split_rows), {"_top": F.max("_till")},
        {"_carried": F.max("_top").over(slices_before())})
    before = F.max("_till").over(within(order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn(name, F.greatest(before, F.col("_carried"))).drop("_till", "_carried", KEY, SLICE)


def _till(end: str) -> Column:
    """A value that orders ends: whether there is none, then the end itself."""
    return F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("till"))


def checked_periods(
    df: DataFrame, keys: Sequence[str], start: str = "START_DATE", end: str = "END_DATE", split_rows: int | None = None
) -> DataFrame:
    """``df`` without the periods that hold never. If two of one key overlap, the query that reads it fails."""
    holding = df.where(_EVER.format(start=start, end=end))
    seen = _with_ends_before(holding, keys, start, end, "_before", split_rows)
    apart = F.col("_before").isNull() | (~F.col("_before.open") & F.col(start).isNotNull() & (F.col("_before.till") <= F.col(start)))
    fail = F.raise_error(F.concat(
        F.lit(f"periods overlap for {', '.join(keys)}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return seen.where(F.when(apart, F.lit(True)).otherwise(fail.cast("boolean"))).drop("_before")


def in_force(
    df: DataFrame, dated: DataFrame, keys: Sequence[str], at: str, start: str = "START_DATE", end: str = "END_DATE",
    cols: Sequence[str] | None = None, how: str = "left", many: bool = False, split_rows: int | None = None,
) -> DataFrame:
    """Each row of ``df`` with ``cols`` (all others by default) of the row of ``dated`` whose period holds at its time
    ``at``; null, or with ``how='inner'`` no row, where there is none. No row is multiplied: see ``checked_periods``.

    A key has few periods as a rule, and the join tests all of them. With ``many`` periods of one key, rows and period
    starts are put in one order instead and each row takes the last period begun (``split_rows``: see ``slicing``).
    """
    cols = [c for c in dated.columns if c not in (*keys, start, end)] if cols is None else list(cols)
    periods = checked_periods(dated.select(*keys, start, end, *cols), keys, start, end, split_rows)
    if not many:
        right = periods.select(
            *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(start).alias("_from"), F.col(end).alias("_till"),
            F.struct(F.lit(True).alias("_"), *cols).alias("_held"))
        same = " AND ".join(f"`{k}` <=> _k{n}" for n, k in enumerate(keys))
        joined = df.join(right, F.expr(f"{same} AND " + _HOLDS.format(start="_from", end="_till", at=f"`{at}`")), how)
        return joined.select(*df.columns, *[F.col(f"_held.{c}").alias(c) for c in cols])
    both = df.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row")).unionByName(
        periods.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col(end).alias("till"), *cols).alias("_period")),
        allowMissingColumns=True)
    filled = last_known(both, keys, ["_t", "_kind"], F.col("_period"), "_held", split_rows).where("_kind = 1")
    holds = F.col("_held").isNotNull() & F.col("_t").isNotNull() & (
        F.col("_held.till").isNull() | (F.col("_t") < F.col("_held.till")))
    if how == "inner":
        filled = filled.where(holds)
    return filled.select("_row.*", *[F.when(holds, F.col(f"_held.{c}")).alias(c) for c in cols])


def version_periods(
    df: DataFrame, keys: Sequence[str], effective: str = "EFFECTIVEDATE", version: str = "VERSIONNO", start: str = "START_DATE",
    end: str = "END_DATE", cols: Sequence[str] = (),
) -> DataFrame:
    """(*keys, effective, version, *cols, start, end): the versions of a key that ever count, from when until when.

    A version counts from its effective date until the next one's; of one date the greatest version does. Versions
    without a date are left out. There is a row for each version, however many rows of ``df`` belong to it; ``cols`` are
    those of the greatest of them.
    """
    best = F.max(F.struct(version, *cols)).alias("_best")
    dated = df.where(F.col(effective).isNotNull()).groupBy(*keys, effective).agg(best).select(*keys, effective, "_best.*")
    following = F.lead(effective).over(Window.partitionBy(*keys).orderBy(effective))
    return dated.withColumns({start: F.col(effective), end: following})


def versions_in_force(
    df: DataFrame, versioned: DataFrame, keys: Sequence[str], at: str, effective: str = "EFFECTIVEDATE", version: str = "VERSIONNO",
    cols: Sequence[str] | None = None, how: str = "left",
) -> DataFrame:
    """Each row of ``df`` with ``cols`` of the version in ``versioned`` that counts at its time ``at``, by default its
    ``effective`` date and ``version``."""
    periods = version_periods(versioned, keys, effective, version, "_since", "_until", cols or ())
    return in_force(df, periods, keys, at, "_since", "_until", [effective, version] if cols is None else cols, how)


def merged_periods(
    df: DataFrame, keys: Sequence[str], start: str = "START_DATE", end: str = "END_DATE", split_rows: int | None = None
) -> DataFrame:
    """(*keys, start, end): the periods of a key with those that overlap or touch made one."""
    holding = df.select(*keys, start, end).where(_EVER.format(start=start, end=end))
    seen = _with_ends_before(holding, keys, start, end, "_before", split_rows)
    opens = F.col("_before").isNull() | (~F.col("_before.open") & F.col(start).isNotNull() & (F.col("_before.till") < F.col(start)))
    ordered = seen.withColumns({"_opens": opens.cast("int"), "_till": _till(end)})
    if split_rows:
        islands = running_sums(ordered, keys, [start, "_till"], {"_island": F.col("_opens")}, split_rows)
    else:
        here = Window.partitionBy(*keys).orderBy(start, "_till").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        islands = ordered.withColumn("_island", F.sum("_opens").over(here))
    return islands.groupBy(*keys, "_island").agg(
        F.min(F.struct(F.col(start).isNotNull().alias("dated"), F.col(start).alias("since"))).alias("_first"), F.max("_till").alias("_last")
    ).select(*keys, F.col("_first.since").alias(start), F.col("_last.till").alias(end))


def overlaps(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "START_DATE", end: str = "END_DATE", cols: Sequence[str] = ()
) -> DataFrame:
    """A row for each pair of a period on the left and one on the right, of equal keys, that hold at a common time: the
    left row with ``cols`` of the right one and the time they share as ``start`` and ``end``."""
    other = right.select(
        *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(start).alias("_from"), F.col(end).alias("_till"),
        *[F.col(c).alias(f"_c{n}") for n, c in enumerate(cols)])
    same = " AND ".join(f"`{k}` <=> _k{n}" for n, k in enumerate(keys))
    meet = (f"(`{start}` IS NULL OR _till IS NULL OR `{start}` < _till) AND (_from IS NULL OR `{end}` IS NULL OR _from < `{end}`)")
    joined = left.where(_EVER.format(start=start, end=end)).join(
        other.where(_EVER.format(start="_from", end="_till")), F.expr(f"{same} AND {meet}"))
    return joined.withColumns({start: F.greatest(start, "_from"), end: F.least(end, "_till")}).select(
        *left.columns, *[F.col(f"_c{n}").alias(c) for n, c in enumerate(cols)])
