"""Ordered computations that stay parallel when one group holds a large share of all rows.

A window over (keys; order) puts each group into one task. Here a group larger than ``split_rows`` is cut into slices
along its order: the window runs per (keys, slice), and what a slice needs from the ones before
it — a last row, a row count, a running sum — is summarised per slice by an ordinary aggregation, prefixed
over the slices of the group, and joined back. Slices only decide where a row is computed; results are those
of the plain window. Ordinary groups have no slice and cost one narrow count, by hash.

Cuts are made at equal depth over the whole order, all its columns as one tuple: a sample of a group's rows by hash is
sorted and every so-manieth one is a bound. However rows crowd, at a time or within one instant, slices come out
alike; only rows that tie on every order column stay together.

The lists of groups to cut and of their bounds are broadcast. Arithmetic limits them: a listed group holds more than a
``MAX_HOT_GROUPS``-th of all rows, and a slice at least a quarter of that, so there are fewer than ``MAX_HOT_GROUPS`` groups and
four times as many bounds. How finely a group is cut depends on how many rows it has, never on which rows are kept. A group
is one struct column, ``_key``, which is never null even where its parts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Default of ``split_rows``: rows a group may have before it is cut.
SPLIT_ROWS = 1_000_000
#: As ``split_rows``: no group is cut, and rows that storage keeps together by their keys stay where they are.
WHOLE = 0
MAX_HOT_GROUPS = 100_000
MAX_SLICES = 65_536
#: Slices aimed at in ``split_rows`` rows, and rows sampled (about) for each.
SLICES, SAMPLED = 4, 64
#: Hashes of groups that rows are counted by before any group is.
HASHES = 65_536

KEY, SLICE = "_key", "_slice"


def _largest(df: DataFrame, totals: Mapping[str, Column], split_rows: int) -> DataFrame:
    """The groups over ``split_rows`` and over a ``MAX_HOT_GROUPS``-th of all rows, into how many slices to cut each, the
    share of its rows to sample, and their ``totals``.

    Rows are counted by a hash of their group first, which takes a number a task and hash to add up. Only the groups of
    hashes with that many rows are counted themselves: as a rule there are none, and no row's keys are moved. Who wants
    totals has few groups, and large ones, which would only be counted twice: they are counted themselves at once.
    """
    counted = [F.count("*").alias("_rows"), *[c.alias(n) for n, c in totals.items()]]
    if totals:
        groups = df.groupBy(KEY).agg(*counted)
        least = F.greatest(F.lit(split_rows), groups.agg(F.sum("_rows")).scalar() / MAX_HOT_GROUPS)
    else:
        hashed = df.withColumn("_hash", F.pmod(F.xxhash64(KEY), F.lit(HASHES)).cast("int"))
        coarse = hashed.groupBy("_hash").agg(F.count("*").alias("_rows"))
        least = F.greatest(F.lit(split_rows), coarse.agg(F.sum("_rows")).scalar() / MAX_HOT_GROUPS)
        full = coarse.where(F.col("_rows") > least).select("_hash")  # at most HASHES
        groups = hashed.join(F.broadcast(full), "_hash", "left_semi").groupBy(KEY).agg(*counted)
    return groups.withColumn("_least", least).where("_rows > _least").selectExpr(
        f"`{KEY}` AS `_hot`", *totals, f"least({MAX_SLICES}, ceil(_rows * {SLICES} / _least)) AS _parts",
        f"least(1D, {SLICES * SAMPLED} / _least) AS _rate")


def _attach(df: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    # Null-safe, so that Spark infers no key filter on this side and can read a common input once.
    return df.join(F.broadcast(listed), F.expr(f"`{KEY}` <=> `{name}`"), "left")


def _oversized(totals: Iterable[str], *more: str) -> str:
    """Rows of groups on the list. The filter is on columns of the list itself: where that proves empty, Spark
    drops the branch unrun. It names all of them, so that every branch needs the same list and it is made once."""
    return " AND ".join(f"{c} IS NOT NULL" for c in ("_parts", *more, *totals))


def _bounds(rows: DataFrame, totals: Iterable[str]) -> DataFrame:
    """(_cut, _chunks): of each listed group the bounds between its slices, in order, in about as many chunks as there are
    in each. ``rows`` have the group's place in ``_at``."""
    whole = 1 << 40
    sampled = rows.where(_oversized(totals, "_rate")).where(
        F.pmod(F.xxhash64(*[c for c in rows.columns if c != KEY]), F.lit(whole)) < F.col("_rate") * whole)
    group = Window.partitionBy(KEY)
    nth = sampled.select(
        KEY, "_at", "_parts", F.row_number().over(group.orderBy("_at")).alias("_nth"), F.count("*").over(group).alias("_of"))
    ends = nth.where("floor(_nth * _parts / _of) > floor((_nth - 1) * _parts / _of) AND _nth < _of")
    listed = ends.groupBy(F.col(KEY).alias("_cut")).agg(F.sort_array(F.collect_set("_at")).alias("_all"))  # under MAX_SLICES
    width = "cast(ceil(sqrt(size(_all))) AS int)"
    return listed.selectExpr("_cut", f"transform(sequence(1, size(_all), {width}), k -> slice(_all, k, {width})) AS _chunks")


def slice_hot_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column] | None = None,
    split_rows: int | None = None,
) -> DataFrame:
    """Add ``_key``, the group; ``_slice``: null in ordinary groups, rising along ``order`` in oversized ones; and
    ``_parts``, set in the latter, which ``carry_in`` consumes.

    An oversized group is cut at equal depth along the whole of ``order`` (columns of any type that sorts), nulls first.
    Only rows that tie on all of its columns stay together, so slices have at most about ``split_rows`` rows but for those.

    ``totals`` are whole-group aggregates, never null, to attach to the rows of oversized groups (null elsewhere).
    ``split_rows`` defaults to ``SPLIT_ROWS``.
    """
    totals, split_rows = dict(totals or {}), split_rows or SPLIT_ROWS
    df = df.withColumn(KEY, F.struct(*keys))
    names = df.columns
    hot = _largest(df, totals, split_rows)
    marked = _attach(df, hot, "_hot").withColumn("_at", F.struct(*order))
    found = _attach(marked, _bounds(marked.drop("_hot"), totals), "_cut")
    # The chunk whose first bound is the last one reached, then the bounds reached in it.
    chunk = "size(filter(_chunks, c -> c[0] <= _at))"
    nth = (f"CASE WHEN coalesce({chunk}, 0) < 1 THEN 0 ELSE ({chunk} - 1) * {MAX_SLICES} "
           f"+ size(filter(_chunks[{chunk} - 1], b -> b <= _at)) END")
    return found.select(*names, *totals, "_parts", F.expr(
        f"CASE WHEN {_oversized((), '_rate')} THEN cast({nth} AS bigint) END").alias(SLICE))


def carry_in(
    sliced: DataFrame, summary: Mapping[str, Column], prefix: Mapping[str, Column], totals: Sequence[str] = (),
    keep_parts: bool = False,
) -> DataFrame:
    """Attach to every row of a sliced group what the earlier slices of the group add up to.

    ``summary`` aggregates one slice; ``prefix`` maps a new column to an expression over those summaries,
    evaluated in ``slices_before``/``slice_order`` windows. Null in ordinary groups and in first slices.
    """
    tails = sliced.where(_oversized(totals)).groupBy(KEY, SLICE).agg(*[c.alias(n) for n, c in summary.items()])
    carried = tails.select(KEY, SLICE, *[c.alias(n) for n, c in prefix.items()])
    # Stated, because an input already hashed on the keys would satisfy the window as it is, slices unspread.
    spread = (sliced if keep_parts else sliced.drop("_parts")).repartition(KEY, SLICE)
    return spread.join(carried, [KEY, SLICE], "left")


def slice_order() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(SLICE)


def slices_before() -> WindowSpec:
    return slice_order().rowsBetween(Window.unboundedPreceding, -1)


def whole_slice() -> WindowSpec:
    return Window.partitionBy(KEY, SLICE)


def within(order: Sequence[str]) -> WindowSpec:
    return whole_slice().orderBy(*order)


def up_to_here(order: Sequence[str]) -> WindowSpec:
    return within(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], split_rows: int | None = None,
) -> DataFrame:
    """Running totals along ``order`` within ``keys``; ``order`` must be a total order. Nulls add nothing, and
    a total is null until the first value."""
    if split_rows == WHOLE:
        here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: F.sum(c).over(here) for n, c in sums.items()})
    inputs = {n: f"_in_{n}" for n in sums}
    df = slice_hot_groups(df.withColumns({inputs[n]: c for n, c in sums.items()}), keys, order, split_rows=split_rows)
    df = carry_in(
        df,
        {f"_sum_{n}": F.sum(inputs[n]) for n in sums},
        {f"_carried_{n}": F.sum(f"_sum_{n}").over(slices_before()) for n in sums},
    )
    here = {n: F.sum(inputs[n]).over(up_to_here(order)) for n in sums}
    df = df.withColumns(here)
    carried = {n: F.col(f"_carried_{n}") for n in sums}
    return df.withColumns({
        n: F.coalesce(F.col(n) + carried[n], F.col(n), carried[n]) for n in sums
    }).drop(*inputs.values(), *[f"_carried_{n}" for n in sums], KEY, SLICE)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], name: str, first: str,
    split_rows: int | None = None,
) -> DataFrame:
    """Struct of ``cols`` from the row before along ``order`` (``name``) and whether there is none (``first``)."""
    row = F.struct(*cols)
    if split_rows == WHOLE:
        here = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: F.lag(row).over(here), first: F.row_number().over(here) == 1})
    df = slice_hot_groups(df, keys, order, split_rows=split_rows)
    df = carry_in(
        df,
        {"_last": F.max_by(row, F.struct(*order))},
        {"_carried": F.lag("_last").over(slice_order())},
    )
    w = within(order)
    opens = F.row_number().over(w) == 1
    return (
        df.withColumns({"_opens": opens, "_before": F.lag(row).over(w)})
        .withColumns({
            name: F.when(F.col("_opens"), F.col("_carried")).otherwise(F.col("_before")),
            first: F.col("_opens") & F.col("_carried").isNull(),
        })
        .drop("_opens", "_before", "_carried", KEY, SLICE)
    )


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
    split_rows: int | None = None,
) -> DataFrame:
    """Latest non-null ``value`` up to and including each row along ``order``; ``order`` must be total."""
    df = slice_hot_groups(df.withColumn("_v", value), keys, order, split_rows=split_rows)
    known = F.col("_v").isNotNull()
    df = carry_in(
        df,
        {"_last": F.max_by("_v", F.when(known, F.struct(*order)))},
        {"_carried": F.last("_last", ignorenulls=True).over(slices_before())},
    )
    here = F.last("_v", ignorenulls=True).over(up_to_here(order))
    return df.withColumn(name, F.coalesce(here, F.col("_carried"))).drop("_v", "_carried", KEY, SLICE)
