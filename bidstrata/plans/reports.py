"""The analyses a user runs, each a set of named lazy DataFrames built from the operators.

``bids`` are price headers, ``qty`` quantity detail with the header's column names (``align_detail``), ``units``
the unit map. Anything that counts per auction is counted before the unit map is joined. Reports whose outputs share a
frame take a ``path``: where given, that frame is computed once, written there as Parquet and read by every output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstrata.functions.checks import (
    actual_run, band_order_violations, binding, counting_run, fcas_available, mentions_automation,
)
from bidstrata.functions.units import ancillary_only, exclude_units
from bidstrata.operators import bands as b
from bidstrata.operators import joins as j
from bidstrata.operators import outcomes as o
from bidstrata.operators import stats as s
from bidstrata.operators import versions as v
from bidstrata.schema import (
    AUCTION, BATTERY_CATEGORIES, CATEGORIES, OFFER_TIME, PERIOD, PRICE_BANDS, QUANTITY_BANDS, SERVICES,
)

CATEGORY = s.CATEGORY


def _once(df: DataFrame, path: str | None) -> DataFrame:
    if path is None:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _eligible(df: DataFrame, energy: str) -> DataFrame:
    return ancillary_only(exclude_units(df), energy)


def auction_counts(
    bids: DataFrame, units: DataFrame, keys: Sequence[str] = AUCTION, energy: str = "ENERGY"
) -> DataFrame:
    """Rebids per ancillary-service auction, with the unit's category."""
    return j.with_units(s.rebid_counts(_eligible(bids, energy), keys), units)


def _count_report(counts: DataFrame, col: str, services: Sequence[str]) -> dict[str, DataFrame]:
    grid = lambda agg, **kw: s.dense_grid(
        counts, {"BIDTYPE": services}, CATEGORY, CATEGORIES, agg, **kw)
    batteries = counts.where(F.col(CATEGORY).isin(BATTERY_CATEGORIES))
    return {
        "summary": s.summary_stats(counts, [CATEGORY], col),
        "mean_by_service": grid(F.avg(col)),
        "median_by_service": grid(F.percentile(col, 0.5)),
        "mean_bars": grid(F.avg(col), fill=0.0),
        "boxes": s.box_stats(counts, [CATEGORY], col, "histogram"),
        "boxes_by_service": s.box_stats(counts, [CATEGORY, "BIDTYPE"], col, "histogram"),
        "battery_boxes_by_service": s.box_stats(batteries, [CATEGORY, "BIDTYPE"], col, "histogram"),
        "histogram": s.int_histogram(counts, [CATEGORY], col),
    }


def rebid_report(
    bids: DataFrame, units: DataFrame, keys: Sequence[str] = AUCTION,
    services: Sequence[str] = SERVICES, energy: str = "ENERGY",
) -> dict[str, DataFrame]:
    """How often are offers resubmitted, by category and service?"""
    return _count_report(auction_counts(bids, units, keys, energy), "num_rebids", services)


def true_counts(
    qty: DataFrame, keys: Sequence[str] = (*AUCTION, PERIOD), order: Sequence[str] | None = None,
    bands: Sequence[str] = QUANTITY_BANDS, energy: str = "ENERGY",
) -> DataFrame:
    """True rebids per ancillary-service auction and period."""
    return s.true_rebid_counts(v.flag_true_rebids(_eligible(qty, energy), keys, order, bands), keys)


def true_rebid_report(
    qty: DataFrame, units: DataFrame, keys: Sequence[str] = (*AUCTION, PERIOD), order: Sequence[str] | None = None,
    bands: Sequence[str] = QUANTITY_BANDS, services: Sequence[str] = SERVICES, energy: str = "ENERGY",
    path: str | None = None,
) -> dict[str, DataFrame]:
    """How often does a rebid really change quantities?"""
    counts = _once(true_counts(qty, keys, order, bands, energy), path)
    per_unit = j.with_units(s.unit_market_avg(counts), units)
    return {
        **_count_report(j.with_units(counts, units), "num_true_rebids", services),
        "per_unit": per_unit,
        "per_unit_by_category": s.avg_of_unit_means(per_unit),
        "periods": s.period_rebid_summary(counts),
    }


def rebid_vs_true(
    bids: DataFrame, qty: DataFrame, units: DataFrame, keys: Sequence[str] = AUCTION,
    order: Sequence[str] | None = None, bands: Sequence[str] = QUANTITY_BANDS, per_period: bool = True,
    energy: str = "ENERGY",
) -> dict[str, DataFrame]:
    """Which share of rebids are true rebids?"""
    counts = s.rebid_counts(_eligible(bids, energy), keys)
    flagged = v.flag_true_rebids(_eligible(qty, energy), [*keys, PERIOD], order, bands)
    compared = j.compare_rebids(counts, s.true_rebid_counts(flagged, [*keys, PERIOD]), keys, per_period)
    compared = j.with_units(compared, units)
    return {"auctions": compared, "share": s.true_rebid_share(compared)}


def participation(
    bids: DataFrame, units: DataFrame, services: Sequence[str] = (*SERVICES, "ENERGY"), mode: str = "participations"
) -> dict[str, DataFrame]:
    """Which services does each category take part in?"""
    attended = j.with_units(s.participations(exclude_units(bids)), units)
    shares = s.participation_share(attended, mode=mode)
    return {"shares": shares, "table": s.participation_table(shares, services)}


def initial_price_report(
    bids: DataFrame, units: DataFrame, keys: Sequence[str] = AUCTION, order: Sequence[str] | None = None,
    bands: Sequence[str] = PRICE_BANDS, services: Sequence[str] = SERVICES, energy: str = "ENERGY",
    path: str | None = None,
) -> dict[str, DataFrame]:
    """Distribution of the first prices offered, per category, service and band."""
    first = _once(j.with_units(v.initial_offer(_eligible(bids, energy), keys, order, bands), units), path)
    long = b.bands_long(first, [CATEGORY, "BIDTYPE", "DUID", "SETTLEMENTDATE"], bands)
    batteries = long.where(F.col(CATEGORY).isin(BATTERY_CATEGORIES))
    by_band = [CATEGORY, "BIDTYPE", "PRICEBAND"]
    grid = lambda rows, agg: s.dense_grid(long, rows, "PRICEBAND", bands, agg)
    return {
        "offers": first,
        "long": long,
        "stats": s.band_stats(long, by_band),
        "boxes": s.box_stats(long, by_band, "PRICE"),
        "battery_boxes_8": s.box_stats(b.first_bands(batteries, 8), by_band, "PRICE"),
        "battery_boxes_5": s.box_stats(b.first_bands(batteries, 5), by_band, "PRICE"),
        "mean": grid({CATEGORY: CATEGORIES}, F.avg("PRICE")),
        "median": s.band_stats(long, [CATEGORY, "PRICEBAND"]).select(CATEGORY, "PRICEBAND", "median"),
        "mean_by_service": grid({CATEGORY: CATEGORIES, "BIDTYPE": services}, F.avg("PRICE")),
    }


def price_change_report(
    bids: DataFrame, units: DataFrame, keys: Sequence[str] = AUCTION, order: Sequence[str] | None = None,
    bands: Sequence[str] = PRICE_BANDS, services: Sequence[str] = SERVICES, energy: str = "ENERGY",
    path: str | None = None,
) -> dict[str, DataFrame]:
    """Change from the first to the last price of an auction, per category, service and band."""
    changes = _once(j.with_units(v.price_change(_eligible(bids, energy), keys, order, bands), units), path)
    long = b.changes_long(changes, [CATEGORY, "BIDTYPE", "DUID", "SETTLEMENTDATE"], bands)
    medians = s.quantiles(long, [CATEGORY, "BIDTYPE", "PRICEBAND"], "PRICE_CHANGE", {"median": 0.5})
    overall = s.quantiles(long, [CATEGORY, "PRICEBAND"], "PRICE_CHANGE", {"median": 0.5})
    grid = lambda df, rows, agg, **kw: s.dense_grid(df, rows, "PRICEBAND", bands, agg, **kw)
    both = {CATEGORY: CATEGORIES, "BIDTYPE": services}
    return {
        "changes": changes,
        "long": long,
        "mean": grid(long, {CATEGORY: CATEGORIES}, F.avg("PRICE_CHANGE")),
        "median": grid(overall, {CATEGORY: CATEGORIES}, F.first("median")),
        "mean_by_service": grid(long, both, F.avg("PRICE_CHANGE")),
        "median_bars": grid(medians, both, F.first("median"), fill=0.0),
    }


def daily_band_report(
    bids: DataFrame, units: DataFrame, bands: Sequence[str] = PRICE_BANDS, services: Sequence[str] = SERVICES
) -> dict[str, DataFrame]:
    """Do autobidder batteries vary their daily prices more than other batteries?"""
    daily = bids.where((F.col("ENTRYTYPE") == "DAILY") & F.col("BIDTYPE").isin(list(services)))
    fleet = j.battery_fleet(units)
    fleet_bids = daily.join(fleet, "DUID")
    long = b.bands_long(fleet_bids, ["is_autobidder"], bands)
    per_unit = s.unit_variation(daily, ["DUID"], bands).join(fleet, "DUID")
    return {
        "profile": s.profile(fleet_bids, ["DUID", "SETTLEMENTDATE"]),
        "stats": s.band_stats(long, ["is_autobidder", "PRICEBAND"]),
        "boxes": s.box_stats(long, ["is_autobidder", "PRICEBAND"], "PRICE"),
        "variation": per_unit,
        "variation_by_band": s.group_variation(per_unit, ["is_autobidder", "band"]),
        "variation_summary": s.labelled(s.group_variation(per_unit, ["is_autobidder"])),
        "verdict": s.compare_groups(per_unit),
    }


def first_offers(df: DataFrame, unit, service: str, n: int = 10, entry: str | None = "DAILY") -> DataFrame:
    """The first ``n`` offers of one unit and service by offer time and its tiebreaks."""
    wanted = (F.col("DUID") == unit) & (F.col("BIDTYPE") == service)
    if entry:
        wanted = wanted & (F.col("ENTRYTYPE") == entry)
    return df.where(wanted).orderBy(*v.default_order(df, PRICE_BANDS)).limit(n)


def variation_report(
    bids: DataFrame, units: DataFrame, bands: Sequence[str] = PRICE_BANDS, services: Sequence[str] = SERVICES,
    shown: Sequence[int] = (1, 5, 10),
) -> dict[str, DataFrame]:
    """How much does a unit vary its prices within one service, and does the entry type matter?"""
    fleet = j.battery_fleet(units)
    offers = bids.where(F.col("BIDTYPE").isin(list(services)))
    detail = s.unit_service_variation(offers, bands=bands, shown=shown).join(fleet, "DUID")
    return {
        "detail": detail,
        "summary": s.labelled(s.variation_summary(detail)),
        "by_entry_type": s.labelled(s.variation_by_entry_type(offers, fleet, bands=bands, shown=shown)),
    }


def price_quantity_export(
    price: DataFrame, qty: DataFrame, units: DataFrame, duid, service: str, limit: int | None = None,
    keys: Sequence[str] = (*AUCTION, OFFER_TIME),
) -> DataFrame:
    """Joined price and quantity bands of one unit and service, in offer order."""
    pick = lambda df: df.where((F.col("DUID") == duid) & (F.col("BIDTYPE") == service))
    panel = j.price_quantity_panel(pick(price), pick(qty), keys, units)
    ties = [c for c in panel.columns if c not in ("DUID", "SETTLEMENTDATE", PERIOD, OFFER_TIME)]
    panel = panel.orderBy("DUID", "SETTLEMENTDATE", PERIOD, OFFER_TIME, *ties)
    return panel.limit(limit) if limit else panel


def bid_curves(
    price: DataFrame, qty: DataFrame, keys: Sequence[str] = AUCTION, order: Sequence[str] | None = None,
    bands: Sequence[str] = QUANTITY_BANDS, n_bands: int = 10, split_rows: int | None = None,
) -> DataFrame:
    """Curve of every offer that changed quantities, numbered per auction and period.

    Unchanged offers are dropped before the price join, which therefore shuffles only what is kept.
    """
    detail = [*keys, PERIOD]
    numbered = v.number_true_rebids(qty, detail, order, bands, split_rows=split_rows)
    panel = j.price_quantity_panel(price, numbered, [*keys, OFFER_TIME])
    return b.bid_curve(panel, [*detail, OFFER_TIME, "version_index"], n_bands)


def applied_offer_report(
    tracking: DataFrame, price: DataFrame, qty: DataFrame, keys: Sequence[str] = AUCTION,
    peak_hours: Sequence[int] = tuple(range(7, 22)), origin: int = 240, convention: str = "end",
) -> dict[str, DataFrame]:
    """What dispatch applied in each interval, at what offered price, and how offers evolved over the day."""
    panel = b.weighted_offer_price(j.price_quantity_panel(price, qty, [*keys, OFFER_TIME]))
    applied = j.applied_offers(tracking, panel, origin, convention)
    return {
        "timeline": v.offer_timeline(price, keys),
        "panel": panel,
        "applied": applied,
        "hourly": s.hourly_offer_price(applied, "interval"),
        "peak": s.peak_offer_price(applied, "interval", peak_hours),
        "versions_per_day": s.rebid_frequency(price, keys),
        "versions_per_period": s.rebid_frequency(qty, keys, period=PERIOD),
    }


def market_report(
    regional_prices: DataFrame, load: DataFrame, unit_summary: DataFrame, bids: DataFrame,
    energy_order: Sequence[str] | None = None, runno: int = 1, intervention: int | Sequence[int] = 0,
    constraints: tuple[DataFrame, DataFrame, DataFrame] | None = None, demand: tuple[DataFrame, DataFrame] | None = None,
    qty: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Price separation, revenue, energy taken in, and checks on the bids behind them.

    ``regional_prices`` and ``load`` are the wide price and dispatch tables, of which the rows of one run count: RUNNO
    ``runno``, INTERVENTION ``intervention``; or, if that is a list, of each region, unit or constraint and interval the run
    that comes first in it (``counting_run``). ``load`` may also be long already (DUID, SETTLEMENTDATE, BIDTYPE, MW).
    Tables without these columns are taken to hold one run. A ``unit_summary`` with START_DATE and END_DATE lists units by
    period, and the one in force at the interval counts.

    With ``constraints`` (results, definitions, left-hand sides): ``binding`` and ``binding_by_unit``, the latter by version
    where the definitions have EFFECTIVEDATE. With ``demand`` (actual, forecast): ``demand_error``. With ``qty`` (detail with
    ENABLEMENTMIN … MAXAVAIL): ``available``, what each row's unit could offer of the service at the energy cleared in its
    interval, for detail with an ``interval`` column.
    """
    def one_run(df: DataFrame, of: str) -> DataFrame:
        if not {"RUNNO", "INTERVENTION"} <= set(df.columns):
            return df
        if isinstance(intervention, int):
            return actual_run(df, runno, intervention)
        return counting_run(df, [of, "SETTLEMENTDATE"], intervention)

    prices = b.regional_prices_long(one_run(regional_prices, "REGIONID"))
    load = one_run(load, "DUID")
    if "MW" not in load.columns:
        load = b.dispatch_load_long(load)
    energy = load.where(F.col("BIDTYPE") == "ENERGY")
    at = "SETTLEMENTDATE" if {"START_DATE", "END_DATE"} <= set(unit_summary.columns) else None
    out = {
        "separation": o.price_separation(prices),
        "value": j.dispatch_value(load, prices, unit_summary, at=at),
        "revenue": o.fcas_revenue(load, prices, unit_summary, at=at),
        "energy": o.cumulative_energy(energy, order=energy_order),
        "bad_bands": band_order_violations(bids, PRICE_BANDS),
        "automation": mentions_automation(bids, "REBIDEXPLANATION"),
    }
    if constraints:
        results, definitions, lhs = constraints
        run = one_run(results, "CONSTRAINTID")
        out["binding"] = binding(run)
        by_version = "EFFECTIVEDATE" in definitions.columns
        out["binding_by_unit"] = (j.constraint_units if by_version else j.binding_constraints)(run, definitions, lhs)
    if demand:
        out["demand_error"] = j.demand_error(*demand)
    if qty is not None:
        cleared = energy.select("DUID", F.col("SETTLEMENTDATE").alias("interval"), F.col("MW").alias("energy_mw"))
        limits = [F.col(c) for c in ("ENABLEMENTMIN", "LOWBREAKPOINT", "HIGHBREAKPOINT", "ENABLEMENTMAX", "MAXAVAIL")]
        out["available"] = qty.join(cleared, ["DUID", "interval"]).withColumn(
            "available_mw", fcas_available(F.col("energy_mw"), *limits))
    return out
