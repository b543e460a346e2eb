"""Joins of bids with units, prices with quantities, and bids with what dispatch applied.

No side is broadcast by hint: Spark broadcasts what its own size check allows, and otherwise shuffles, where
adaptive execution splits an oversized key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidstrata.functions.periods import period_id
from bidstrata.functions.units import is_autobidder, is_battery, unit_category
from bidstrata.operators.slicing import last_known
from bidstrata.operators.validity import in_force, merged_periods, overlaps, version_periods
from bidstrata.schema import ALIGN_DETAIL, AUCTION, OFFER_TIME


def unique_units(units: DataFrame, key: str = "DUID") -> DataFrame:
    """The unit map with a run-time check that ``key`` is unique, so that a join cannot multiply rows."""
    one = units.groupBy(key).agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in units.columns if c != key]
    )
    fail = F.raise_error(F.concat(F.lit("duplicate unit in map: "), F.col(key).cast("string")))
    return one.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(fail.cast("boolean"))).drop("_n")


def with_units(bids: DataFrame, units: DataFrame, how: str = "left", key: str = "DUID") -> DataFrame:
    """Attach the unit map and ``bidder_category``. ``how='inner'`` keeps only mapped units. Here as in every join with a
    map of units, a unit listed twice is an error."""
    return bids.join(unique_units(units, key), key, how).withColumn("bidder_category", unit_category())


def battery_fleet(units: DataFrame) -> DataFrame:
    """The batteries of the unit map with ``is_autobidder``."""
    return unique_units(units).where(is_battery()).select("DUID", is_autobidder().alias("is_autobidder"))


def align_detail(qty: DataFrame) -> DataFrame:
    """Give the detail table the header table's names for day and offer time."""
    return qty.withColumnsRenamed(ALIGN_DETAIL)


def price_quantity_panel(
    price: DataFrame, qty: DataFrame, keys: Sequence[str] = (*AUCTION, OFFER_TIME), units: DataFrame | None = None
) -> DataFrame:
    """Quantity detail with the prices of its offer version, optionally with the unit's ``dispatch_type``."""
    panel = qty.join(price, list(keys), "inner")
    if units is not None:
        panel = panel.join(unique_units(units.select("DUID", F.col("DISPATCHTYPE").alias("dispatch_type"))), "DUID", "left")
    return panel


def share_within(df: DataFrame, group: Sequence[str], value: str, name: str = "share_pct", scale: int = 2) -> DataFrame:
    """Each row's share of its group's total, in percent, rounded half-even."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    share = F.bround(F.try_divide(F.col(value), F.col("_total")) * 100, scale)
    return df.join(totals, list(group)).withColumn(name, share).drop("_total")


def compare_rebids(
    bid_counts: DataFrame, true_counts: DataFrame, keys: Sequence[str], per_period: bool = True
) -> DataFrame:
    """Rebid counts beside true-rebid counts of the same auctions.

    Bid counts are per unit and day, true counts per period: ``per_period`` repeats the former on every period,
    otherwise the latter are summed over the day first. Adds ``pct_true``, 0 where there was nothing to share.
    """
    if not per_period:
        true_counts = true_counts.groupBy(*keys).agg(F.sum("num_true_rebids").alias("num_true_rebids"))
    pct = F.coalesce(F.try_divide(F.col("num_true_rebids"), F.col("num_rebids")) * 100, F.lit(0.0))
    return bid_counts.join(true_counts, list(keys), "inner").withColumn("pct_true", pct)


def applied_offers(
    tracking: DataFrame, panel: DataFrame, origin: int = 240, convention: str = "end", how: str = "inner"
) -> DataFrame:
    """The (version, period) row that dispatch applied in each tracked interval.

    ``tracking`` has the interval in SETTLEMENTDATE and points at an offer by BIDSETTLEMENTDATE and
    BIDOFFERDATE; ``panel`` is keyed by SETTLEMENTDATE (day), OFFERDATE and PERIODID. A panel read from ``ingest`` has its
    directories' ``market_day`` too, which is joined on as well: only the days that the tracking names are read.
    """
    pointed = tracking.select(
        F.col("SETTLEMENTDATE").alias("interval"), "DUID", "BIDTYPE",
        F.col("BIDSETTLEMENTDATE").alias("SETTLEMENTDATE"), F.col("BIDOFFERDATE").alias("OFFERDATE"),
        period_id(F.col("SETTLEMENTDATE"), origin, convention).alias("PERIODID"),
    )
    keys = ["DUID", "BIDTYPE", "SETTLEMENTDATE", "OFFERDATE", "PERIODID"]
    if "market_day" in panel.columns:
        pointed, keys = pointed.withColumn("market_day", F.to_date("SETTLEMENTDATE")), [*keys, "market_day"]
    return pointed.join(panel, keys, how)


def with_region(
    df: DataFrame, unit_summary: DataFrame, at: str | None = None, start: str = "START_DATE", end: str = "END_DATE"
) -> DataFrame:
    """Attach the region a unit is registered in.

    With ``at``, a time column of ``df``, the registration in force at that time counts: ``start`` <= time < ``end``. A unit
    may then be listed once for each period; overlapping periods are an error, and a time in none gives no region.
    Without it a unit listed twice is an error.
    """
    if at is None:
        return df.join(unique_units(unit_summary.select("DUID", "REGIONID")), "DUID", "left")
    return in_force(df, unit_summary.select("DUID", start, end, "REGIONID"), ["DUID"], at, start, end)


def offer_in_force(
    intervals: DataFrame, offers: DataFrame, keys: Sequence[str] = ("DUID", "BIDTYPE"),
    interval_time: str = "SETTLEMENTDATE", offer_time: str = OFFER_TIME, cols: Sequence[str] = (),
    tiebreak: str | None = None, split_rows: int | None = None,
) -> DataFrame:
    """For each interval the latest offer made before it (at the same instant is too late), where dispatch
    tracking is missing. Adds ``offer_ts`` and ``cols`` of that offer, null where none was made yet.

    ``tiebreak`` (a column of the offers) settles offers of one instant: the greatest wins.
    """
    kept = [c for c in intervals.columns if c not in keys]
    payload = F.struct(F.col(offer_time).alias("offer_ts"), *cols)
    tie = F.col(tiebreak) if tiebreak else F.lit(0)
    no_tie = F.lit(None).cast(offers.schema[tiebreak].dataType if tiebreak else "int")
    both = intervals.select(
        *keys, F.col(interval_time).alias("_t"), F.lit(0).alias("_kind"), no_tie.alias("_tie"),
        F.struct(*kept).alias("_row"),
    ).unionByName(
        offers.select(
            *keys, F.col(offer_time).alias("_t"), F.lit(1).alias("_kind"), tie.alias("_tie"),
            payload.alias("_offer"),
        ),
        allowMissingColumns=True,
    )
    # An interval sorts ahead of offers of its own instant.
    filled = last_known(both, keys, ["_t", "_kind", "_tie"], F.col("_offer"), "_in_force", split_rows)
    return filled.where(F.col("_kind") == 0).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in kept],
        F.col("_in_force.offer_ts").alias("offer_ts"), *[F.col(f"_in_force.{c}").alias(c) for c in cols],
    )


def binding_constraints(
    results: DataFrame, definitions: DataFrame, lhs: DataFrame, per_interval: bool = False
) -> DataFrame:
    """Constraints that bound, their definition and the units on their left-hand side.

    By default one row per (constraint, unit) with the number of binding intervals and the mean and greatest
    marginal value: the results are summed up before the units join, so rows never multiply intervals by
    units. ``per_interval`` gives the full three-way join instead.
    """
    bound = results.where(F.col("MARGINALVALUE") > 0)
    if not per_interval:
        bound = bound.groupBy("CONSTRAINTID").agg(
            F.count("*").alias("binding_intervals"), F.avg("MARGINALVALUE").alias("mean_marginal_value"),
            F.max("MARGINALVALUE").alias("max_marginal_value"),
        )
    return bound.join(definitions, "CONSTRAINTID").join(lhs, "CONSTRAINTID")


def invoked_versions(definitions: DataFrame, sets: DataFrame, invocations: DataFrame) -> DataFrame:
    """(GENCONID, EFFECTIVEDATE, VERSIONNO, START_DATE, END_DATE): when each version of a constraint was both the one in
    force and invoked through some set it is in.

    ``sets`` lists the constraints of each set (GENCONSETID, GENCONID), ``invocations`` when a set was active
    (GENCONSETID, STARTINTERVALDATETIME, ENDINTERVALDATETIME). A constraint in several sets, or in a set invoked again
    meanwhile, is invoked once: periods are merged before they meet the versions, so none of the result overlap.
    """
    active = invocations.select(
        "GENCONSETID", F.col("STARTINTERVALDATETIME").alias("START_DATE"), F.col("ENDINTERVALDATETIME").alias("END_DATE"))
    by_constraint = sets.select("GENCONSETID", "GENCONID").distinct().join(merged_periods(active, ["GENCONSETID"]), "GENCONSETID")
    return overlaps(version_periods(definitions, ["GENCONID"]), merged_periods(by_constraint, ["GENCONID"]), ["GENCONID"])


def constraint_units(
    results: DataFrame, definitions: DataFrame, lhs: DataFrame, invoked: DataFrame | None = None, at: str = "SETTLEMENTDATE",
    unit: str = "CONNECTIONPOINTID", per_interval: bool = False,
) -> DataFrame:
    """Units on the left-hand side of constraints that bound, by the version of the constraint in force at the interval.

    ``results`` name a constraint CONSTRAINTID at ``at``. ``definitions`` (GENCONID, EFFECTIVEDATE, VERSIONNO, …) and ``lhs``
    (the same, ``unit``, FACTOR) hold every version; versions that do not count at an interval add nothing to it. With
    ``invoked`` (see ``invoked_versions``) only intervals at which the version was invoked count.

    By default a row per constraint and unit: the binding intervals, the mean and greatest marginal value, the number of
    versions among them, and the unit's factor in the latest. Intervals are summed up per version before units join, so
    rows never multiply intervals by units. ``per_interval`` gives a row per binding interval and unit, the version's
    other columns with it.
    """
    version = ["EFFECTIVEDATE", "VERSIONNO"]
    bound = results.where(F.col("MARGINALVALUE") > 0).withColumnRenamed("CONSTRAINTID", "GENCONID")
    if invoked is None:
        dated = in_force(bound, version_periods(definitions, ["GENCONID"]), ["GENCONID"], at, cols=version, how="inner")
    else:
        dated = in_force(bound, invoked, ["GENCONID"], at, cols=version, how="inner")
    columns = ["GENCONID", *version, unit, "FACTOR"]
    if per_interval:
        described = dated.join(definitions.dropDuplicates(["GENCONID", *version]), ["GENCONID", *version])
        return described.join(lhs.select(*columns).distinct(), ["GENCONID", *version]).withColumnRenamed("GENCONID", "CONSTRAINTID")
    sums = dated.groupBy("GENCONID", *version).agg(
        F.count("*").alias("n"), F.sum("MARGINALVALUE").alias("total"), F.max("MARGINALVALUE").alias("most"))
    # A constraint's versions are numbered, and compared by <= and >=, which are no join keys: left-hand sides, by far the
    # most rows, then lie by constraint, and neither taking out their repeats nor the sums per unit moves them again. Sums
    # kept as structs let Spark sort them once for all these steps, where hash tables of each would take a task's memory.
    numbered = sums.withColumn("_nth", F.row_number().over(Window.partitionBy("GENCONID").orderBy(*version)))
    same = " AND ".join(f"u.{c} <= s.{c} AND u.{c} >= s.{c}" for c in version)
    met = lhs.select(*columns).alias("u").join(numbered.alias("s"), F.expr(f"u.GENCONID = s.GENCONID AND {same}"))
    once = met.groupBy(F.col("u.GENCONID").alias("CONSTRAINTID"), unit, "_nth", "FACTOR").agg(
        F.max(F.struct("n", "total", "most")).alias("_sums"))
    return once.groupBy("CONSTRAINTID", unit).agg(
        F.sum("_sums.n").alias("binding_intervals"), (F.sum("_sums.total") / F.sum("_sums.n")).alias("mean_marginal_value"),
        F.max("_sums.most").alias("max_marginal_value"), F.count_distinct("_nth").alias("versions"),
        F.max(F.struct("_nth", "FACTOR")).alias("_last")
    ).withColumn("last_factor", F.col("_last.FACTOR")).drop("_last")


def with_error(pair: DataFrame) -> DataFrame:
    """Add ``error`` (forecast − actual), ``abs_error`` and ``pct_error`` to rows with ``actual`` and ``forecast``."""
    error = F.col("forecast") - F.col("actual")
    return pair.withColumns({
        "error": error, "abs_error": F.abs(error), "pct_error": F.try_divide(error, F.col("actual")) * 100,
    })


def demand_error(
    actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = ("REGIONID", "SETTLEMENTDATE"),
    value: str = "DEMAND", forecast_value: str | None = None,
) -> DataFrame:
    """Forecast beside actual demand, one forecast an interval: ``error``, ``abs_error`` and ``pct_error``.

    ``value`` names the actual figure, ``forecast_value`` (the same by default) the forecast one. A table that holds both,
    as the regional dispatch summary does, is given twice and read once.
    """
    mine = F.col(value).alias("actual")
    theirs = F.col(forecast_value or value).alias("forecast")
    if actual is forecast:
        return with_error(actual.select(*keys, mine, theirs))
    return with_error(actual.select(*keys, mine).join(forecast.select(*keys, theirs), list(keys)))


def forecast_error(
    actual: DataFrame, forecast: DataFrame, leads: Sequence[int], keys: Sequence[str] = ("REGIONID",),
    interval: str = "INTERVAL_DATETIME", issued: str = "LOAD_DATE", value: str = "OPERATIONAL_DEMAND",
    forecast_value: str = "OPERATIONAL_DEMAND_POE50", forecast_interval: str | None = None, how: str = "inner",
) -> DataFrame:
    """Actual demand beside what was forecast of it at each lead: for every interval and each of ``leads``, in minutes, the
    last forecast ``issued`` at least so long before the interval (of one issue time the greatest figure).

    A row per interval and lead: ``lead``, ``issued``, ``actual``, ``forecast`` and the errors. With ``how='left'`` intervals
    without so early a forecast are there too, the forecast null. All leads are found in one aggregation over the
    forecasts, which keeps one row of each interval per task, so neither many vintages nor a hot region gathers anywhere.
    """
    at = forecast_interval or interval
    made = forecast.where(F.col(issued).isNotNull() & F.col(forecast_value).isNotNull()).select(
        *keys, F.col(at).alias(interval), F.col(issued).alias("issued"), F.col(forecast_value).alias("forecast"))
    early = lambda minutes: F.col("issued") <= F.col(interval) - F.make_dt_interval(mins=F.lit(minutes))
    best = made.groupBy(*keys, interval).agg(*[
        F.max(F.when(early(m), F.struct("issued", "forecast"))).alias(f"_lead{m}") for m in leads])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("lead"), F.col(f"_lead{m}").alias("found")) for m in leads]))
    known = actual.select(*keys, interval, F.col(value).alias("actual")).join(best, [*keys, interval], how)
    long = known.select(*keys, interval, "actual", each.alias("_each")).select(
        *keys, interval, "_each.lead", "_each.found.issued", "actual", "_each.found.forecast")
    return with_error(long if how == "left" else long.where("issued IS NOT NULL"))


def error_by_lead(errors: DataFrame, by: Sequence[str] = ("REGIONID",)) -> DataFrame:
    """Per group and lead: intervals, those with a forecast, bias, mean absolute, root mean square and mean absolute
    percentage error."""
    return errors.groupBy(*by, "lead").agg(
        F.count("*").alias("intervals"), F.count("forecast").alias("forecasts"), F.avg("error").alias("bias"),
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg(F.abs("pct_error")).alias("mape"))


def dispatch_value(
    load: DataFrame, prices: DataFrame, units: DataFrame, keys: Sequence[str] = ("REGIONID", "SETTLEMENTDATE", "BIDTYPE"),
    at: str | None = None,
) -> DataFrame:
    """Unit dispatch at its region's price: adds ``REGIONID``, ``PRICE`` and ``value`` = MW × price × 5/60.

    ``load`` is long (DUID, SETTLEMENTDATE, BIDTYPE, MW); ``prices`` is the long regional price table. ``at``: see
    ``with_region``.
    """
    return (
        with_region(load, units, at)
        .join(prices, list(keys))
        .withColumn("value", F.col("MW") * F.col("PRICE") * 5 / 60)
    )
