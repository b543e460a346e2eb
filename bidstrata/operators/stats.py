"""Counts, distributions and comparisons over offers.

Medians and quartiles are exact and interpolate linearly. Where a column holds counts, Spark's ``percentile``
is used directly: its buffer keeps one entry per distinct value, and N rows cannot form more than sqrt(2N)
distinct group sizes. For prices and MW, ``quantiles`` ranks the distinct values with sliced windows instead, so
no group has to fit one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidstrata.functions.units import autobidder_label
from bidstrata.operators.bands import band_number, bands_long
from bidstrata.operators.joins import share_within
from bidstrata.operators.slicing import (
    carry_in, slice_hot_groups, slices_before, up_to_here, whole_slice,
)
from bidstrata.schema import AUCTION, PERIOD, PRICE_BANDS

CATEGORY = "bidder_category"


# --- counts per auction ---------------------------------------------------------------------------

def rebid_counts(df: DataFrame, keys: Sequence[str] = AUCTION) -> DataFrame:
    """Offers per auction (``num_bids``) and rebids (``num_rebids`` = offers − 1); auctions lacking a key drop out.

    Count before joining the unit map: the category follows from DUID, and the counts are far fewer than bids.
    """
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("num_bids"))
    return counts.withColumn("num_rebids", F.col("num_bids") - 1)


def true_rebid_counts(flagged: DataFrame, keys: Sequence[str] = (*AUCTION, PERIOD)) -> DataFrame:
    """True rebids per auction and period, zeros included."""
    kept = flagged.dropna(subset=list(keys))
    return kept.groupBy(*keys).agg(F.count_if("is_true_rebid").alias("num_true_rebids"))


def participations(df: DataFrame, keys: Sequence[str] = ("DUID", "BIDTYPE", "SETTLEMENTDATE")) -> DataFrame:
    """Distinct auction participations: rebids do not count again."""
    return df.dropna(subset=list(keys)).select(*keys).distinct()


def participation_share(df: DataFrame, category: str = CATEGORY, mode: str = "participations") -> DataFrame:
    """Share of each service per category, over rows that are distinct participations.

    ``participations``: of all the category's participations, so a category sums to 100. ``auctions``: of the
    distinct (unit, day) pairs the category attended, so each service stands alone (60 of 100 is 60 %).
    """
    counts = df.groupBy(category, "BIDTYPE").agg(F.count("*").alias("auction_count"))
    if mode == "participations":
        return share_within(counts, [category], "auction_count", "participation_pct")
    if mode != "auctions":
        raise ValueError(f"unknown mode {mode!r}")
    days = (
        df.groupBy(category, "DUID", "SETTLEMENTDATE").agg(F.lit(1).alias("_one"))
        .groupBy(category).agg(F.count("*").alias("_days"))
    )
    pct = F.bround(F.col("auction_count") / F.col("_days") * 100, 2)
    return counts.join(days, category).withColumn("participation_pct", pct).drop("_days")


def participation_table(shares: DataFrame, services: Sequence[str], category: str = CATEGORY) -> DataFrame:
    """Category × service, 0 where a category never took part."""
    wide = shares.groupBy(category).pivot("BIDTYPE", list(services)).agg(F.first("participation_pct"))
    return wide.fillna(0.0)


# --- exact quantiles ------------------------------------------------------------------------------

def compact(df: DataFrame, by: Sequence[str], col: str, weight: str | None = None) -> DataFrame:
    """Distinct non-null values of ``col`` per group with their number of rows ``_w``; a row of ``df`` stands for one or,
    where values were counted before, for as many as the column ``weight`` says."""
    n = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(n.alias("_w"))


def _ranked(
    df: DataFrame, by: Sequence[str], col: str, mean: bool = False, split_rows: int | None = None, weight: str | None = None
) -> DataFrame:
    """Distinct values with the group's size ``_n`` (and ``_mean``) and the rows up to and with each value,
    ``_upto``. The group is one struct column, ``_g``: it is never null, so no branch of the plan adds a key
    filter of its own and all of them read one counting shuffle."""
    key, x = ["_g"], F.col(col)
    values = compact(df.select(F.struct(*by).alias("_g"), col, *([weight] if weight else [])), key, col, weight).withColumn("_xw", x * F.col("_w"))
    summed = ["_w", "_xw"] if mean else ["_w"]
    values = slice_hot_groups(values, key, [col], totals={f"_all{c}": F.sum(c) for c in summed}, split_rows=split_rows)
    values = carry_in(values, {"_sum": F.sum("_w")}, {"_carried": F.sum("_sum").over(slices_before())},
                      totals=[f"_all{c}" for c in summed])
    # An oversized group brings its totals along; in any other the window sees the whole group.
    whole = {c: F.coalesce(F.col(f"_all{c}"), F.sum(c).over(whole_slice())) for c in summed}
    means = [(whole["_xw"] / whole["_w"]).alias("_mean")] if mean else []
    upto = F.sum("_w").over(up_to_here([col])) + F.coalesce(F.col("_carried"), F.lit(0))
    return values.select("_g", col, "_w", whole["_w"].alias("_n"), *means, upto.alias("_upto"))


def _picks(col: str, probs: Mapping[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over ranked values that find the two neighbours of each quantile, and the quantiles from them."""
    below, picks, outs = F.col("_upto") - F.col("_w"), [], []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(at)), ("hi", F.floor(at) + 1)):
            hit = (below <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col(col))).alias(f"_{side}_{name}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_frac_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.coalesce(F.col(f"_hi_{name}"), F.col(f"_lo_{name}"))
        outs.append((lo + (hi - lo) * F.col(f"_frac_{name}")).alias(name))
    return picks, outs


def quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: Mapping[str, float], n_distinct: str | None = None,
    method: str = "ranked", split_rows: int | None = None, weight: str | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``col`` per group: one column per entry of ``probs``.

    ``ranked`` works on distinct values and their counts: running counts give every value its ranks, and the two
    values beside each wanted rank are picked by an ordinary aggregation. ``histogram`` hands the counted values to
    ``percentile``, which is cheaper and fit for columns of counts. A group of more than ``split_rows`` distinct values
    (``slicing.SPLIT_ROWS`` if not given) is ranked in slices. ``weight``: see ``compact``.
    """
    if not by:
        return quantiles(df.withColumn("_g", F.lit(0)), ["_g"], col, probs, n_distinct, method, split_rows, weight).drop("_g")
    by = list(by)
    distinct = [F.count("*").alias(n_distinct)] if n_distinct else []
    if method == "histogram":
        values = compact(df, by, col, weight).groupBy(*by).agg(
            F.percentile(col, list(probs.values()), F.col("_w")).alias("_q"), *distinct)
        outs = [F.col("_q")[i].alias(name) for i, name in enumerate(probs)]
        return values.select(*by, *outs, *([n_distinct] if n_distinct else []))
    if method != "ranked":
        raise ValueError(f"unknown method {method!r}")
    picks, outs = _picks(col, probs)
    found = _ranked(df, by, col, split_rows=split_rows, weight=weight).groupBy("_g").agg(*picks, *distinct)
    return found.select("_g.*", *outs, *([n_distinct] if n_distinct else []))


# --- distributions --------------------------------------------------------------------------------

def summary_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """N, mean, median, sample std, max and percentage of zeros of a count column."""
    x = F.col(col)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.percentile(x, 0.5).alias("median"),
        F.stddev_samp(x).alias("std"),
        F.max(x).alias("max"),
        (F.avg(F.when(x == 0, 1.0).otherwise(0.0)) * 100).alias("pct_zero"),
    )


def band_stats(long: DataFrame, by: Sequence[str], value: str = "PRICE", weight: str | None = None) -> DataFrame:
    """N, mean, std, min, quartiles, max and distinct values of a long band table, nulls left out. ``weight``: see ``compact``.

    All of it comes from one pass over the distinct values; the std is taken about the mean, not from squares.
    """
    by, x = list(by), F.col(value)
    picks, quartiles = _picks(value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    spread = F.sum(F.col("_w") * (x - F.col("_mean")) * (x - F.col("_mean")))
    found = _ranked(long, by, value, mean=True, weight=weight).groupBy("_g").agg(
        F.max("_n").alias("n"), F.max("_mean").alias("mean"), spread.alias("_spread"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.count("*").alias("n_distinct"), *picks,
    )
    n, d = F.col("n"), F.col("n_distinct")
    std = F.when(n > 1, F.when(d == 1, 0.0).otherwise(F.sqrt(F.col("_spread") / (n - 1))))
    return found.select("_g.*", "n", "mean", std.alias("std"), "min", *quartiles, "max", "n_distinct")


def unit_variation(
    df: DataFrame, by: Sequence[str] = ("DUID",), bands: Sequence[str] = PRICE_BANDS
) -> DataFrame:
    """Per unit and band: offers, std, coefficient of variation (0 for a zero mean) and distinct values.

    ``by=['DUID']`` pools a unit's services, as the daily report does; ``by=['DUID', 'BIDTYPE']`` keeps them apart.
    Attributes of the unit are joined to the result, not to the offers: a join on DUID would put all offers of a
    unit in one task and this aggregation would leave them there.
    """
    x = F.col("PRICE")
    per_band = bands_long(df, by, bands).groupBy(*by, band_number().alias("band")).agg(
        F.count("*").alias("n_offers"), F.stddev_samp(x).alias("std"), F.avg(x).alias("_mean"),
        F.count_distinct(x).alias("n_distinct"),
    )
    cv = F.when(F.col("_mean") == 0, 0.0).otherwise(F.try_divide(F.col("std"), F.col("_mean")))
    return per_band.withColumn("cv", cv).drop("_mean")


def group_variation(variation: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean within-unit std and distinct values per group (add ``band`` to ``by`` for the per-band means)."""
    return variation.groupBy(*by).agg(
        F.avg("std").alias("mean_std"), F.avg("n_distinct").alias("mean_distinct")
    )


def unit_service_variation(
    df: DataFrame, by: Sequence[str] = ("DUID", "BIDTYPE"), bands: Sequence[str] = PRICE_BANDS,
    shown: Sequence[int] = (1, 5, 10),
) -> DataFrame:
    """One row per (unit, service): offers, mean std over the bands, all distinct values, and std and distinct
    values of the ``shown`` bands."""
    per_band = unit_variation(df, by, bands)
    one = lambda i, c: F.max(F.when(F.col("band") == i, F.col(c)))
    return per_band.groupBy(*by).agg(
        F.max("n_offers").alias("n_offers"),
        F.avg("std").alias("avg_std_across_bands"),
        F.sum("n_distinct").alias("total_distinct_values"),
        *[one(i, "std").alias(f"std_pb{i}") for i in shown],
        *[one(i, "n_distinct").alias(f"n_distinct_pb{i}") for i in shown],
    )


def variation_summary(detail: DataFrame, by: Sequence[str] = ("is_autobidder",)) -> DataFrame:
    """Roll the (unit, service) rows up per group: units, combinations, means and medians."""
    by = list(by)
    means = detail.groupBy(*by).agg(
        F.count_distinct("DUID").alias("n_units"),
        F.count("*").alias("n_unit_service_combos"),
        F.avg("n_offers").alias("avg_offers_per_combo"),
        F.avg("avg_std_across_bands").alias("avg_price_band_std"),
        F.avg("total_distinct_values").alias("avg_distinct_values_per_combo"),
        F.percentile("total_distinct_values", 0.5).alias("median_distinct_values"),
    )
    return means.join(quantiles(detail, by, "avg_std_across_bands", {"median_price_band_std": 0.5}), by, "left")


def variation_by_entry_type(
    df: DataFrame, fleet: DataFrame, entry_col: str = "ENTRYTYPE", unit_keys: Sequence[str] = ("DUID", "BIDTYPE"),
    bands: Sequence[str] = PRICE_BANDS, shown: Sequence[int] = (1, 5, 10), group: str = "is_autobidder",
) -> DataFrame:
    """Per group of the ``fleet`` and entry type: units, entries, and per-(unit, service) means of entries, of
    distinct price combinations and of the std of the ``shown`` bands."""
    cols = {i: next(b for b in bands if b.endswith(f"D{i}")) for i in shown}
    per_unit = df.groupBy(entry_col, *unit_keys).agg(
        F.count("*").alias("_entries"),
        F.count_distinct(F.array(*bands)).alias("_combos"),
        *[F.stddev_samp(c).alias(f"_std{i}") for i, c in cols.items()],
    )
    return per_unit.join(fleet, unit_keys[0]).groupBy(group, entry_col).agg(
        F.count_distinct(unit_keys[0]).alias("n_units"),
        F.sum("_entries").alias("total_entries"),
        F.avg("_entries").alias("avg_entries_per_unit_service"),
        F.avg("_combos").alias("avg_price_combos"),
        *[F.avg(f"_std{i}").alias(f"avg_std_pb{i}") for i in shown],
    )


def unit_market_avg(
    counts: DataFrame, by: Sequence[str] = ("BIDTYPE", "DUID"), col: str = "num_true_rebids"
) -> DataFrame:
    """Mean, median, std and number of auctions of a count per unit and service; join the category afterwards."""
    return counts.groupBy(*by).agg(
        F.avg(col).alias("mean_rebids"), F.percentile(col, 0.5).alias("median_rebids"),
        F.stddev_samp(col).alias("std_rebids"), F.count("*").alias("num_auctions"),
    )


def avg_of_unit_means(unit_means: DataFrame, by: Sequence[str] = (CATEGORY, "BIDTYPE")) -> DataFrame:
    """Average of the units' averages, and how many units stand behind it."""
    return unit_means.groupBy(*by).agg(
        F.avg("mean_rebids").alias("avg_of_means"), F.count_distinct("DUID").alias("n_units")
    )


def dense_grid(
    df: DataFrame, rows: Mapping[str, Sequence], col: str, values: Sequence, agg: Column, fill: float | None = None
) -> DataFrame:
    """Table of ``agg`` with every combination of the listed row keys and a column per listed value of ``col``.

    Cells without data are null, or ``fill``. Listed keys make the grid; nothing is crossed with data.
    """
    cells = df.groupBy(*rows).pivot(col, list(values)).agg(agg)
    grid = _listed(df.sparkSession, rows).join(cells, list(rows), "left")
    return grid if fill is None else grid.fillna(fill, [str(v) for v in values])


def _listed(spark: SparkSession, lists: Mapping[str, Sequence]) -> DataFrame:
    grid = spark.range(1)
    for name, items in lists.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(i) for i in items])))
    return grid.drop("id")


def profile(df: DataFrame, distinct: Sequence[str], ranges: Sequence[str] = ()) -> DataFrame:
    """Row count, distinct counts and first/last values of the named columns, in one row."""
    # A column's distinct values apart from the others': several distinct counts in one aggregate repeat every row.
    numbers = {c: df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count("*")).scalar() for c in distinct}
    whole = df.agg(
        F.count("*").alias("n_rows"),
        *[f(c).alias(f"{p}_{c}") for c in ranges for p, f in (("min", F.min), ("max", F.max))],
    )
    return whole.select("n_rows", *[n.alias(f"n_{c}") for c, n in numbers.items()], *whole.columns[1:])


def period_rebid_summary(
    counts: DataFrame, by: Sequence[str] = ("DUID",), col: str = "num_true_rebids"
) -> DataFrame:
    """Per unit: periods without and with true rebids, and the mean and most per period."""
    return counts.groupBy(*by).agg(
        F.count("*").alias("n_periods"),
        F.count_if(F.col(col) == 0).alias("periods_without"),
        F.count_if(F.col(col) >= 1).alias("periods_with"),
        F.avg(col).alias("mean_rebids"),
        F.max(col).alias("max_rebids"),
    )


def true_rebid_share(compared: DataFrame, by: Sequence[str] = (CATEGORY,)) -> DataFrame:
    """Mean percentage of rebids that are true ones, over auctions with at least one rebid."""
    return compared.where(F.col("num_rebids") > 0).groupBy(*by).agg(
        F.count("*").alias("n_auctions"), F.avg("pct_true").alias("avg_pct_true")
    )


def services(df: DataFrame, col: str = "BIDTYPE") -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


# --- box plots, histograms, verdicts --------------------------------------------------------------

def _with_fences(df: DataFrame, by: Sequence[str], col: str, method: str, weight: str | None) -> DataFrame:
    """Distinct values with their group's quartiles and 1.5·IQR fences."""
    by = list(by)
    q = quantiles(df, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, method=method, weight=weight)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    q = q.withColumns({"_lower": F.col("q1") - reach, "_upper": F.col("q3") + reach})
    return compact(df, by, col, weight).join(q, by)


def box_stats(
    df: DataFrame, by: Sequence[str], col: str, method: str = "ranked", weight: str | None = None
) -> DataFrame:
    """Box-plot figures: N, quartiles, whiskers (last values within 1.5·IQR of the box, never inside it) and the
    number of outliers. ``weight``: see ``compact``."""
    x, inside = F.col(col), F.col(col).between(F.col("_lower"), F.col("_upper"))
    return (
        _with_fences(df, by, col, method, weight)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.sum("_w").alias("n"),
            F.min(F.when(inside, x)).alias("_lo"), F.max(F.when(inside, x)).alias("_hi"),
            F.sum(F.when(inside, 0).otherwise(F.col("_w"))).alias("n_outliers"),
        )
        .select(
            *by, "n", "q1", "median", "q3",
            F.least("_lo", "q1").alias("whisker_low"), F.greatest("_hi", "q3").alias("whisker_high"), "n_outliers",
        )
    )


def box_outliers(
    df: DataFrame, by: Sequence[str], col: str, method: str = "ranked", weight: str | None = None
) -> DataFrame:
    """Distinct values beyond the whiskers, with how often each occurs."""
    outside = ~F.col(col).between(F.col("_lower"), F.col("_upper"))
    return _with_fences(df, by, col, method, weight).where(outside).select(*by, col, F.col("_w").alias("n"))


def int_histogram(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Unit-width bins 0, 1, 2, … up to each group's greatest value, empty bins included. The last bin is
    closed, as in the charts: a value on its upper edge would fall in it, so no count is lost."""
    by, step = list(by), 4096
    counted = compact(df, by, col).withColumnRenamed(col, "bin").withColumn("bin", F.col("bin").cast("bigint"))
    top = counted.groupBy(*by).agg(F.max("bin").alias("_top"))
    # Two explodes, so that no single array grows with the greatest value.
    blocks = top.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor(F.col("_top") / step))))
    start = F.col("_b") * step
    bins = blocks.select(
        *by, F.explode(F.sequence(start, F.least(F.col("_top"), start + (step - 1)))).alias("bin")
    )
    return bins.join(counted, [*by, "bin"], "left").select(
        *by, "bin", F.coalesce(F.col("_w"), F.lit(0)).alias("n")
    )


# The ratios of means above and below which a verdict is given, and its words.
VARIES_MORE, VARIES_LESS = 1.1, 0.9
VERDICTS = {"more": "SUPPORTED", "less": "REJECTED", "alike": "INCONCLUSIVE"}


def compare_groups(
    variation: DataFrame, flag: str = "is_autobidder", col: str = "std", high: float = VARIES_MORE, low: float = VARIES_LESS
) -> DataFrame:
    """Mean of ``col`` in the flagged and in the other group, their ratio, and the verdict on whether the flagged
    group varies more."""
    means = variation.agg(
        F.avg(F.when(F.col(flag), F.col(col))).alias("autobidder_mean"),
        F.avg(F.when(~F.col(flag), F.col(col))).alias("other_mean"),
    )
    a, o = F.col("autobidder_mean"), F.col("other_mean")
    verdict = F.when(a > o * high, VERDICTS["more"]).when(a < o * low, VERDICTS["less"]).otherwise(VERDICTS["alike"])
    return means.withColumns({"ratio": F.try_divide(a, o), "verdict": verdict})


def labelled(df: DataFrame, flag: str = "is_autobidder") -> DataFrame:
    """Replace the boolean group flag by its label."""
    return df.withColumn(flag, autobidder_label(F.col(flag)))


# --- offered prices over time ---------------------------------------------------------------------

def hourly_offer_price(panel: DataFrame, ts: str, by: Sequence[str] = ("BIDTYPE",)) -> DataFrame:
    """Mean offered price per hour and service: plain over offers, and weighted by the MW offered."""
    hour = F.date_format(ts, "yyyy-MM-dd HH:00:00").alias("hour")
    return panel.groupBy(*by, hour).agg(*_mean_prices())


def peak_offer_price(
    panel: DataFrame, ts: str, peak_hours: Sequence[int], by: Sequence[str] = ("BIDTYPE",)
) -> DataFrame:
    """Mean offered price on and off peak; which hours are peak is the caller's choice."""
    window = F.when(F.hour(ts).isin(list(peak_hours)), "on-peak").otherwise("off-peak").alias("window")
    return panel.groupBy(*by, window).agg(*_mean_prices())


def _mean_prices() -> list[Column]:
    price, mw = F.col("offer_price"), F.col("offer_mw")
    priced_mw = F.sum(F.when(price.isNotNull(), mw))
    return [
        F.avg(price).alias("mean_price"),
        F.when(priced_mw > 0, F.try_divide(F.sum(price * mw), priced_mw)).alias("weighted_price"),
        F.count(price).alias("n_offers"),
    ]


def rebid_frequency(
    df: DataFrame, keys: Sequence[str] = AUCTION, order: str = "OFFERDATE", period: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Distinct offer versions per auction day, or per ``period`` of it.

    ``tasks``: how many to spread the rows over, by offer and then by auction (see ``archive.buckets_for``), where the
    session's number of shuffle partitions would give a task more than its memory holds as the table grows.
    """
    level = [*keys, period] if period else list(keys)
    if not tasks:
        return df.groupBy(*level).agg(F.count_distinct(order).alias("n_versions"))
    versions = df.select(*level, order).repartition(tasks, *level, order).distinct()
    return versions.repartition(tasks, *level).groupBy(*level).agg(F.count(order).alias("n_versions"))
