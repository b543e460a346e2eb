import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bidstrata.operators import bands as b
from bidstrata.operators import joins as j
from bidstrata.operators import outcomes as o
from bidstrata.operators import slicing
from bidstrata.operators import stats as s
from tests.conftest import at, on, rows


def test_unit_join_keeps_unmapped_units(spark):
    bids = spark.createDataFrame([("a",), ("b",)], "DUID string")
    units = spark.createDataFrame([("a", "BIDIRECTIONAL", True, "p")],
                                  "DUID string, DISPATCHTYPE string, AUTOBIDDER boolean, PARTICIPANT_NAME string")
    assert rows(j.with_units(bids, units), "DUID", "bidder_category") == [("a", "Autobidder Battery"), ("b", "Non-Battery")]
    assert rows(j.with_units(bids, units, "inner"), "DUID") == [("a",)]
    assert j.unique_units(units).count() == 1
    with pytest.raises(Exception, match="duplicate unit"):
        j.with_units(bids, units.union(units)).collect()
    with pytest.raises(Exception, match="duplicate unit"):
        j.with_region(bids, units.union(units).withColumn("REGIONID", F.lit("N"))).collect()
    with pytest.raises(Exception, match="duplicate unit"):
        j.battery_fleet(units.union(units)).collect()


def test_panel_needs_the_direction(spark):
    key = "DUID string, BIDTYPE string, DIRECTION string, SETTLEMENTDATE date, OFFERDATE timestamp_ntz"
    offer = [("a", "RAISEREG", d, on("2025-10-01"), at("2025-09-30T12:00:00")) for d in ("GEN", "LOAD")]
    price = spark.createDataFrame([(*k, float(i)) for i, k in enumerate(offer)], f"{key}, PRICEBAND1 double")
    qty = spark.createDataFrame([(*k, p, 5.0) for k in offer for p in (1, 2)], f"{key}, PERIODID int, BANDAVAIL1 double")
    assert j.price_quantity_panel(price, qty).count() == 4
    without = ["DUID", "BIDTYPE", "SETTLEMENTDATE", "OFFERDATE"]
    assert j.price_quantity_panel(price.drop("DIRECTION"), qty, without).count() == 8


def test_curve(spark):
    cols = ", ".join(f"PRICEBAND{i} double, BANDAVAIL{i} double" for i in (1, 2, 3))
    df = spark.createDataFrame([("a", -10.0, 1.0, 0.0, 2.0, 50.0, 3.0)], f"u string, {cols}")
    curve = [tuple(r) for r in b.bid_curve(df, ["u"], 3).orderBy("step").collect()]
    assert curve == [("a", 0, 0.0, -10.0), ("a", 1, 1.0, 0.0), ("a", 2, 3.0, 50.0), ("a", 3, 6.0, 50.0)]
    assert b.bid_curve(df, ["u"], 2).count() == 3


def test_weighted_price(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 1.0, 3.0), (2, 10.0, 20.0, 0.0, 0.0), (3, None, 20.0, 5.0, 1.0)],
                               "i int, p1 double, p2 double, q1 double, q2 double")
    got = b.weighted_offer_price(df, ["p1", "p2"], ["q1", "q2"])
    assert rows(got, "i", "offer_mw", "offer_price") == [(1, 4.0, 17.5), (2, 0.0, None), (3, 6.0, 20.0)]


def test_comparison_grains(spark):
    bids = spark.createDataFrame([("a", 2), ("b", 0)], "u string, num_rebids bigint")
    true = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 1, 0)], "u string, PERIODID int, num_true_rebids bigint")
    per_period = j.compare_rebids(bids, true, ["u"])
    assert rows(per_period, "u", "num_true_rebids", "pct_true") == [("a", 0, 0.0), ("a", 1, 50.0), ("b", 0, 0.0)]
    per_day = j.compare_rebids(bids, true, ["u"], per_period=False)
    assert rows(per_day, "u", "num_true_rebids", "pct_true") == [("a", 1, 50.0), ("b", 0, 0.0)]
    share = s.true_rebid_share(per_day.withColumn("bidder_category", F.lit("c")))
    assert rows(share) == [("c", 1, 50.0)]


def test_shares_add_up(spark):
    df = spark.createDataFrame([("c", "x", 1), ("c", "y", 3), ("d", "x", 5)], "g string, k string, n bigint")
    assert rows(j.share_within(df, ["g"], "n"), "g", "k", "share_pct") == [("c", "x", 25.0), ("c", "y", 75.0), ("d", "x", 100.0)]


def test_applied_offer(spark):
    tracking = spark.createDataFrame(
        [(at("2025-10-01T04:10:00"), "a", "RAISEREG", on("2025-10-01"), at("2025-09-30T12:00:00"))],
        "SETTLEMENTDATE timestamp_ntz, DUID string, BIDTYPE string, BIDSETTLEMENTDATE date, BIDOFFERDATE timestamp_ntz")
    panel = spark.createDataFrame(
        [("a", "RAISEREG", on("2025-10-01"), at("2025-09-30T12:00:00"), p, float(p)) for p in (1, 2, 3)],
        "DUID string, BIDTYPE string, SETTLEMENTDATE date, OFFERDATE timestamp_ntz, PERIODID int, mw double")
    assert rows(j.applied_offers(tracking, panel), "PERIODID", "mw") == [(2, 2.0)]
    assert rows(j.applied_offers(tracking, panel, convention="start"), "PERIODID") == [(3,)]


@pytest.mark.parametrize("whole", [True, False])
def test_offer_in_force(spark, monkeypatch, whole):
    monkeypatch.setattr(slicing, "SPLIT_ROWS", 10**6 if whole else 3)
    rnd, base = random.Random(4), at("2025-10-01T00:00:00")
    made = [(rnd.choice("aab"), base + timedelta(minutes=rnd.randrange(200)), i, float(i)) for i in range(60)]
    wanted = [(rnd.choice("aabc"), base + timedelta(minutes=rnd.randrange(200)), i) for i in range(120)]
    offers = spark.createDataFrame(made, "u string, OFFERDATE timestamp_ntz, n int, price double")
    intervals = spark.createDataFrame(wanted, "u string, SETTLEMENTDATE timestamp_ntz, i int")
    got = j.offer_in_force(intervals, offers, ["u"], cols=["price"], tiebreak="n")
    want = {}
    for u, t, i in wanted:
        before = [m for m in made if m[0] == u and m[1] < t]
        best = max(before, key=lambda m: (m[1], m[2])) if before else None
        want[i] = (best[1], best[3]) if best else (None, None)
    assert {r.i: (r.offer_ts, r.price) for r in got.collect()} == want


def test_binding_constraints(spark):
    results = spark.createDataFrame([("c1", 1, 5.0), ("c1", 2, 15.0), ("c1", 3, 0.0), ("c2", 1, 0.0)],
                                    "CONSTRAINTID string, t int, MARGINALVALUE double")
    definitions = spark.createDataFrame([("c1", "<="), ("c2", ">=")], "CONSTRAINTID string, kind string")
    lhs = spark.createDataFrame([("c1", "a", 1.0), ("c1", "b", -1.0), ("c2", "a", 1.0)],
                                "CONSTRAINTID string, DUID string, FACTOR double")
    got = j.binding_constraints(results, definitions, lhs)
    assert rows(got, "DUID", "binding_intervals", "mean_marginal_value", "max_marginal_value") == [
        ("a", 2, 10.0, 15.0), ("b", 2, 10.0, 15.0)]
    assert j.binding_constraints(results, definitions, lhs, per_interval=True).count() == 4


def test_demand_error(spark):
    schema = "REGIONID string, SETTLEMENTDATE int, DEMAND double"
    got = j.demand_error(spark.createDataFrame([("r", 1, 100.0), ("r", 2, 0.0)], schema),
                         spark.createDataFrame([("r", 1, 90.0), ("r", 2, 5.0)], schema))
    assert rows(got, "error", "abs_error", "pct_error") == [(-10.0, 10.0, -10.0), (5.0, 5.0, None)]


def test_prices_value_and_revenue(spark):
    wide = spark.createDataFrame([("r1", 1, 60.0, 12.0), ("r2", 1, 90.0, 24.0)],
                                 "REGIONID string, SETTLEMENTDATE int, RRP double, RAISEREGRRP double")
    prices = b.regional_prices_long(wide, prices=["RRP", "RAISEREGRRP"])
    assert rows(prices, "REGIONID", "BIDTYPE", "PRICE") == [
        ("r1", "ENERGY", 60.0), ("r1", "RAISEREG", 12.0), ("r2", "ENERGY", 90.0), ("r2", "RAISEREG", 24.0)]
    assert rows(o.price_separation(prices), "BIDTYPE", "separation") == [("ENERGY", 30.0), ("RAISEREG", 12.0)]
    load = spark.createDataFrame([("a", 1, "ENERGY", 10.0), ("a", 1, "RAISEREG", 5.0), ("b", 1, "RAISEREG", 5.0)],
                                 "DUID string, SETTLEMENTDATE int, BIDTYPE string, MW double")
    units = spark.createDataFrame([("a", "r1"), ("b", "r2")], "DUID string, REGIONID string")
    assert rows(j.dispatch_value(load, prices, units), "DUID", "BIDTYPE", "value") == [
        ("a", "ENERGY", 50.0), ("a", "RAISEREG", 5.0), ("b", "RAISEREG", 10.0)]
    assert rows(o.fcas_revenue(load, prices, units)) == [("a", "RAISEREG", 5.0, 5.0), ("b", "RAISEREG", 5.0, 10.0)]


@pytest.mark.parametrize("whole", [True, False])
def test_energy_taken_in(spark, monkeypatch, whole):
    monkeypatch.setattr(slicing, "SPLIT_ROWS", 10**6 if whole else 2)
    load = spark.createDataFrame([("a", t, mw) for t, mw in enumerate([-12.0, -12.0, 12.0, 0.0])],
                                 "DUID string, SETTLEMENTDATE int, MW double")
    got = o.cumulative_energy(load, efficiency=0.9)
    assert [r.cumulative_mwh for r in got.orderBy("SETTLEMENTDATE").collect()] == pytest.approx([0.9, 1.8, 0.8, 0.8])


def test_offer_prices_over_time(spark):
    df = spark.createDataFrame(
        [("x", at("2025-10-01T06:10:00"), 10.0, 1.0), ("x", at("2025-10-01T06:50:00"), 20.0, 3.0),
         ("x", at("2025-10-01T08:00:00"), None, 0.0)], "BIDTYPE string, t timestamp_ntz, offer_price double, offer_mw double")
    assert rows(s.hourly_offer_price(df, "t")) == [
        ("x", "2025-10-01 06:00:00", 15.0, 17.5, 2), ("x", "2025-10-01 08:00:00", None, None, 0)]
    assert rows(s.peak_offer_price(df, "t", [8]), "window", "mean_price") == [("off-peak", 15.0), ("on-peak", None)]


def test_wide_dispatch_becomes_long(spark):
    wide = spark.createDataFrame([("a", 1, 10.0, 2.0, None), ("b", 1, None, 0.0, 1.0)],
                                 "DUID string, SETTLEMENTDATE int, TOTALCLEARED double, RAISEREG double, LOWERREG double")
    assert rows(b.dispatch_load_long(wide), "DUID", "BIDTYPE", "MW") == [
        ("a", "ENERGY", 10.0), ("a", "RAISEREG", 2.0), ("b", "LOWERREG", 1.0), ("b", "RAISEREG", 0.0)]


@pytest.mark.parametrize("split", [10**6, 4])
def test_charge_stays_within_the_capacity_in_force(spark, split):
    """Against a plain loop: hot units, a null unit, missing MW and capacity, ties on time."""
    draw = random.Random(4)
    data = [(draw.choice(["hot"] * 6 + ["b", None]), at("2025-10-01T00:00:00") + timedelta(minutes=5 * (n // 3)), n,
             draw.choice([None, *range(-60, 61, 7)]), draw.choice([None, -1.0, 3.0, 8.0]) if n % 10 == 0 else 8.0) for n in range(300)]
    data = [(u, t, n, None if mw is None else float(mw), c) for u, t, n, mw, c in data]
    df = spark.createDataFrame(data, "DUID string, SETTLEMENTDATE timestamp_ntz, n int, MW double, MAXSTORAGECAPACITY double").repartition(3)
    got = {r.n: r.charge_mwh for r in o.state_of_charge(df, efficiency=0.9, initial=2.0, split_rows=split).collect()}
    level = {}
    for u, _, n, mw, c in sorted(data, key=lambda r: (r[1], r[2])):
        taken = 0.0 if mw is None else (-mw * 0.9 if mw < 0 else -mw) / 12
        cap = max(c or 0.0, 0.0)
        level[u] = min(cap, max(0.0, level.get(u, 2.0) + taken))
        assert got.pop(n) == (None if c is None or c < 0 else pytest.approx(level[u], abs=1e-9))
    assert not got and o.state_of_charge(df.where("false")).collect() == []


def test_capacity_of_the_version_in_force(spark):
    details = spark.createDataFrame(
        [("u", at("2025-10-01T00:00:00"), 1, 4.0), ("u", at("2025-10-03T00:00:00"), 1, 5.0), ("u", at("2025-10-03T00:00:00"), 2, 6.0), ("w", None, 1, 7.0)],
        "DUID string, EFFECTIVEDATE timestamp_ntz, VERSIONNO int, MAXSTORAGECAPACITY double")
    load = spark.createDataFrame([("u", at(f"2025-{d}T00:00:00")) for d in ("09-30", "10-01", "10-02", "10-03")] + [("w", at("2025-10-03T00:00:00"))],
                                 "DUID string, SETTLEMENTDATE timestamp_ntz")
    assert [r[2] for r in rows(o.with_capacity(load, details))] == [None, 4.0, 4.0, 6.0, None]
