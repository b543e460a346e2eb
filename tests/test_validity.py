"""Rows that hold for a period, against plain loops."""

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bidstrata.functions import checks
from bidstrata.operators import joins as j
from bidstrata.operators import outcomes as o
from bidstrata.operators import validity as v
from bidstrata.plans import reports
from tests.conftest import at, rows

PERIOD = "DUID string, START_DATE timestamp_ntz, END_DATE timestamp_ntz, REGIONID string"
D = lambda n: at("2025-10-01T00:00:00") + timedelta(days=n)


def holds(start, end, t):
    return t is not None and (start is None or start <= t) and (end is None or t < end)


def disjoint(seed):
    """Periods of some keys that do not overlap, with gaps, empty ones, open ends and a null key."""
    draw = random.Random(seed)
    out = []
    for key in ("a", "b", "c", None):
        day, first = 0, True
        for n in range(draw.randint(1, 9)):
            start, day = day + draw.choice([0, 0, 2]), day + draw.randint(1, 5) + 2
            out.append((key, None if first and draw.random() < 0.5 else D(start), D(day), f"{key}{n}"))
            first = False
        if draw.random() < 0.5:
            out.append((key, D(day), None, f"{key}-open"))
        out.append((key, D(day - 1), D(day - 1), "never"))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("many, split", [(False, None), (True, None), (True, 3), (False, 3)])
def test_each_row_gets_the_period_of_its_time(spark, seed, many, split):
    periods = disjoint(seed)
    asked = [(k, D(n) + timedelta(seconds=s) if n is not None else None, n) for k in ("a", "b", "c", "z", None) for n in (*range(-2, 45, 3), None) for s in (-1, 0)]
    df = spark.createDataFrame(asked, "DUID string, t timestamp_ntz, n int")
    dated = spark.createDataFrame(periods, PERIOD)
    for how in ("left", "inner"):
        expected = []
        for k, t, n in asked:
            found = [r for key, a, b, r in periods if key == k and holds(a, b, t)]
            assert len(found) <= 1
            if found or how == "left":
                expected.append((k, t, n, found[0] if found else None))
        got = v.in_force(df, dated, ["DUID"], "t", how=how, many=many, split_rows=split)
        assert Counter(rows(got)) == Counter(expected)


@pytest.mark.parametrize("split", [None, 2])
@pytest.mark.parametrize("bad", [
    [(0, 5), (4, 6)], [(0, None), (3, 4)], [(None, 5), (2, 9)], [(0, 9), (1, 2), (10, 11)], [(0, 1), (0, 1)], [(None, 1), (None, 3)]])
def test_overlaps_raise(spark, bad, split):
    day = lambda n: None if n is None else D(n)
    dated = spark.createDataFrame([("a", day(s), day(e), "r") for s, e in [*bad, (20, 21), (22, 23)]], PERIOD)
    with pytest.raises(Exception, match="periods overlap for DUID: a"):
        v.checked_periods(dated, ["DUID"], split_rows=split).count()
    df = spark.createDataFrame([("a", D(30))], "DUID string, t timestamp_ntz")
    with pytest.raises(Exception, match="periods overlap"):
        j.with_region(df, dated, at="t").collect()


def test_region_on_both_sides_of_a_move(spark):
    units = spark.createDataFrame([("u", None, D(5), "QLD1"), ("u", D(5), D(2999), "NSW1"), ("w", D(0), D(1), "VIC1")], PERIOD)
    df = spark.createDataFrame([("u", D(5) - timedelta(minutes=5), 1), ("u", D(5), 2), ("w", D(1), 3), ("x", D(0), 4)], "DUID string, t timestamp_ntz, n int")
    assert rows(j.with_region(df, units, at="t"), "n", "REGIONID") == [(1, "QLD1"), (2, "NSW1"), (3, None), (4, None)]
    with pytest.raises(Exception, match="duplicate unit"):
        j.with_region(df, units).collect()
    assert j.with_region(df, units.where("false"), at="t").where("REGIONID IS NULL").count() == 4


def merged(periods):
    out = []
    for key in {p[0] for p in periods}:
        own = sorted(((a is not None, a, b is None, b) for k, a, b, *_ in periods if k == key and (a is None or b is None or a < b)),
                     key=lambda r: (r[0], r[1] or D(0), r[2], r[3] or D(0)))
        for _, a, _, b in own:
            if out and out[-1][0] == key and (out[-1][2] is None or a is None or out[-1][2] >= a):
                out[-1][2] = None if out[-1][2] is None or b is None else max(out[-1][2], b)
            else:
                out.append([key, a, b])
    return Counter(map(tuple, out))


@pytest.mark.parametrize("split", [None, 3])
@pytest.mark.parametrize("seed", range(4))
def test_merging_periods(spark, seed, split):
    draw = random.Random(seed)
    data = []
    for _ in range(40):
        a = draw.choice([None, *range(60)]) if draw.random() < 0.3 else draw.randrange(60)
        b = None if draw.random() < 0.05 else (a or 0) + draw.randrange(-1, 6)
        data.append((draw.choice(["a", "b", None]), None if a is None else D(a), None if b is None else D(b), "r"))
    got = v.merged_periods(spark.createDataFrame(data, PERIOD), ["DUID"], split_rows=split)
    assert Counter(rows(got)) == merged(data)


def test_overlapping_periods_share_their_common_time(spark):
    left = spark.createDataFrame([("a", D(0), D(10), "l"), ("a", None, D(2), "m"), ("b", D(0), D(1), "n")], PERIOD)
    right = spark.createDataFrame([("a", D(1), None, "r"), ("a", D(10), D(11), "s"), ("b", D(1), D(2), "t")], PERIOD).withColumnRenamed("REGIONID", "x")
    got = v.overlaps(left, right, ["DUID"], cols=["x"])
    assert rows(got, "REGIONID", "x", "START_DATE", "END_DATE") == [("l", "r", D(1), D(10)), ("m", "r", D(1), D(2))]


def test_versions_count_until_the_next(spark):
    df = spark.createDataFrame(
        [("c", D(0), 1), ("c", D(5), 1), ("c", D(5), 3), ("c", D(5), 3), ("c", None, 9), ("d", D(2), None)], "k string, EFFECTIVEDATE timestamp_ntz, VERSIONNO int")
    assert rows(v.version_periods(df, ["k"])) == [
        ("c", D(0), 1, D(0), D(5)), ("c", D(5), 3, D(5), None), ("d", D(2), None, D(2), None)]
    asked = spark.createDataFrame([("c", D(n)) for n in (-1, 0, 4, 5)], "k string, t timestamp_ntz")
    assert rows(v.versions_in_force(asked, df, ["k"], "t"), "t", "VERSIONNO") == [(D(-1), None), (D(0), 1), (D(4), 1), (D(5), 3)]


# --- runs -----------------------------------------------------------------------------------------

RUNS = [  # region, interval, RUNNO, INTERVENTION, value
    ("A", 1, 1, 0, 10), ("A", 1, 1, 1, 11), ("A", 2, 1, 0, 20), ("B", 1, 1, 0, 30), ("B", 1, 2, 0, 31), ("B", 1, 2, 1, 32),
    ("C", 1, 1, 1, 40), (None, 1, 1, 0, 50), (None, 1, 1, 1, 51), ("D", 1, 1, None, 60), ("D", 1, None, 0, 61), ("E", 1, 1, 1, 70), ("E", 1, 1, 1, 71),
    ("F", 1, 1, 2, 80), ("F", 1, 1, None, 81),
]


@pytest.mark.parametrize("wish, rerun, values", [
    ((1, 0), "last", [11, 20, 32, 40, 51, 60, 70, 71, 80]), ((0, 1), "last", [10, 20, 31, 40, 50, 60, 70, 71, 80]),
    ((1, 0), "first", [11, 20, 30, 40, 51, 60, 70, 71, 80])])
def test_the_run_that_counts(spark, wish, rerun, values):
    df = spark.createDataFrame([(r, D(t), n, i, x) for r, t, n, i, x in RUNS], "REGIONID string, SETTLEMENTDATE timestamp_ntz, RUNNO int, INTERVENTION int, x int")
    assert [r[0] for r in rows(checks.counting_run(df, ["REGIONID", "SETTLEMENTDATE"], wish, rerun), "x")] == values
    assert checks.counting_run(df.where("false"), ["REGIONID"]).collect() == []
    with pytest.raises(ValueError):
        checks.counting_run(df, ["REGIONID"], rerun="any")


# --- constraints ----------------------------------------------------------------------------------

VERSIONS = "GENCONID string, EFFECTIVEDATE timestamp_ntz, VERSIONNO int, DESCRIPTION string"
POINTS = "GENCONID string, EFFECTIVEDATE timestamp_ntz, VERSIONNO int, CONNECTIONPOINTID string, FACTOR double"


def constraint_tables(spark, extra=()):
    results = spark.createDataFrame(
        [("c", D(n), float(n % 3)) for n in range(10)] + [("d", D(1), 5.0), ("none", D(1), 5.0)], "CONSTRAINTID string, SETTLEMENTDATE timestamp_ntz, MARGINALVALUE double")
    definitions = [("c", D(0), 1, "first"), ("c", D(6), 1, "dead"), ("c", D(6), 2, "second"), ("d", D(0), 1, "d"), *[(*e, "x") for e in extra]]
    points = [("c", D(0), 1, "p", 1.0), ("c", D(0), 1, "q", 2.0), ("c", D(6), 1, "w", 3.0), ("c", D(6), 2, "p", 4.0), ("d", D(0), 1, "p", 5.0)]
    return results, spark.createDataFrame(definitions, VERSIONS), spark.createDataFrame(points, POINTS)


def test_units_of_the_version_in_force(spark):
    got = j.constraint_units(*constraint_tables(spark))
    # c binds at days 1, 2, 4, 5 (first version) and 7, 8 (second).
    assert rows(got) == [
        ("c", "p", 6, 1.5, 2.0, 2, 4.0), ("c", "q", 4, 1.5, 2.0, 1, 2.0), ("d", "p", 1, 5.0, 5.0, 1, 5.0)]
    per = j.constraint_units(*constraint_tables(spark), per_interval=True)
    assert Counter(r.DESCRIPTION for r in per.collect()) == {"first": 8, "second": 2, "d": 1}


def test_versions_that_never_count_change_nothing(spark):
    extra = [("c", D(100), 1), ("c", D(6), 0), ("d", None, 7), ("e", D(0), 1)]
    assert rows(j.constraint_units(*constraint_tables(spark, extra))) == rows(j.constraint_units(*constraint_tables(spark)))


def test_only_invoked_intervals_count(spark):
    results, definitions, lhs = constraint_tables(spark)
    sets = spark.createDataFrame([("S", "c"), ("S", "c"), ("T", "c"), ("T", "d")], "GENCONSETID string, GENCONID string")
    calls = [("S", D(1), D(3)), ("S", D(2), D(5)), ("T", D(4), D(8)), ("T", D(4), D(8)), ("U", D(0), D(99))]
    invoked = j.invoked_versions(definitions, sets, spark.createDataFrame(calls, "GENCONSETID string, STARTINTERVALDATETIME timestamp_ntz, ENDINTERVALDATETIME timestamp_ntz"))
    assert rows(invoked, "GENCONID", "VERSIONNO", "START_DATE", "END_DATE") == [("c", 1, D(1), D(6)), ("c", 2, D(6), D(8)), ("d", 1, D(4), D(8))]
    assert rows(j.constraint_units(results, definitions, lhs, invoked)) == [("c", "p", 5, 1.4, 2.0, 2, 4.0), ("c", "q", 4, 1.5, 2.0, 1, 2.0)]


def test_left_hand_sides_are_moved_once(spark):
    results, definitions, lhs = constraint_tables(spark)
    twice = lhs.union(lhs).union(spark.createDataFrame([("c", D(6), 2, "p", 6.0), ("c", D(6), None, "p", 9.0), (None, D(0), 1, "p", 9.0)], POINTS))
    got = j.constraint_units(results, definitions, twice)
    # A repeated row counts once; a unit with two factors in a version, twice. The greatest nth is the last version's.
    assert [r[:6] for r in rows(got)] == [("c", "p", 8, 1.5, 2.0, 2), ("c", "q", 4, 1.5, 2.0, 1), ("d", "p", 1, 5.0, 5.0, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert moved and not any("CONNECTIONPOINTID" in line for line in moved)


# --- forecasts ------------------------------------------------------------------------------------

def test_the_last_forecast_early_enough(spark):
    hour = lambda n: at("2025-10-01T12:00:00") + timedelta(hours=n)
    actual = spark.createDataFrame([("R", hour(0), 100.0), ("R", hour(1), 0.0), ("S", hour(0), 50.0), (None, hour(0), 1.0)], "REGIONID string, INTERVAL_DATETIME timestamp_ntz, OPERATIONAL_DEMAND double")
    made = [("R", hour(0), hour(-3), 90.0), ("R", hour(0), hour(-1), 95.0), ("R", hour(0), hour(-1), 96.0), ("R", hour(0), hour(1), 1.0),
            ("R", hour(1), hour(-9), 5.0), ("R", hour(0), None, 7.0), ("R", hour(0), hour(0), None), ("S", hour(5), hour(-9), 1.0)]
    forecast = spark.createDataFrame(made, "REGIONID string, INTERVAL_DATETIME timestamp_ntz, LOAD_DATE timestamp_ntz, OPERATIONAL_DEMAND_POE50 double")
    got = j.forecast_error(actual, forecast, [0, 60, 61, 240])
    assert rows(got, "INTERVAL_DATETIME", "lead", "issued", "forecast", "error", "pct_error") == [
        (hour(0), 0, hour(-1), 96.0, -4.0, -4.0), (hour(0), 60, hour(-1), 96.0, -4.0, -4.0), (hour(0), 61, hour(-3), 90.0, -10.0, -10.0),
        *[(hour(1), m, hour(-9), 5.0, 5.0, None) for m in (0, 60, 61, 240)]]
    whole = j.forecast_error(actual, forecast, [0, 240], how="left")
    assert whole.count() == 8 and whole.where("forecast IS NULL").count() == 5
    by = {(r.REGIONID, r.lead): r for r in j.error_by_lead(whole).collect()}
    assert (by["R", 0].intervals, by["R", 0].forecasts, by["R", 0].bias, by["R", 0].mape) == (2, 2, 0.5, 4.0)
    assert (by["R", 240].forecasts, by["S", 0].forecasts, by["S", 0].mae) == (1, 0, None)


def test_one_table_with_both_figures_is_read_once(spark):
    df = spark.createDataFrame([("R", D(0), 10.0, 12.0)], "REGIONID string, SETTLEMENTDATE timestamp_ntz, TOTALDEMAND double, DEMANDFORECAST double")
    got = j.demand_error(df, df, value="TOTALDEMAND", forecast_value="DEMANDFORECAST")
    assert rows(got) == [("R", D(0), 10.0, 12.0, 2.0, 2.0, 20.0)] and "Join" not in got._jdf.queryExecution().toString()


# --- the market report ----------------------------------------------------------------------------

def test_market_report_by_period_and_run(spark):
    units = spark.createDataFrame([("u", None, D(1), "Q"), ("u", D(1), None, "N")], PERIOD)
    wide = "SETTLEMENTDATE timestamp_ntz, RUNNO int, {0} string, INTERVENTION int, "
    prices = spark.createDataFrame(
        [(D(n), 1, r, 0, p, p) for n, r, p in ((0, "Q", 10.0), (0, "N", 20.0), (1, "Q", 30.0), (1, "N", 40.0))] + [(D(1), 1, "N", 1, 400.0, 400.0)],
        wide.format("REGIONID") + "RRP double, RAISEREGRRP double")
    from bidstrata.schema import PRICE_BANDS, REGIONAL_PRICES
    prices = prices.withColumns({c: F.lit(None).cast("double") for c in REGIONAL_PRICES if c not in prices.columns})
    load = spark.createDataFrame([(D(0), 1, "u", 0, 12.0, 12.0), (D(1), 1, "u", 0, 24.0, 24.0), (D(1), 1, "u", 1, 36.0, 36.0)], wide.format("DUID") + "TOTALCLEARED double, RAISEREG double")
    bids = spark.createDataFrame([], ", ".join(f"{b} double" for b in PRICE_BANDS) + ", REBIDEXPLANATION string")
    plain = reports.market_report(prices, load, units, bids)["revenue"]
    assert rows(plain, "revenue") == [(12.0 * 10 / 12 + 24 * 40 / 12,)]
    assert rows(reports.market_report(prices, load, units, bids, intervention=(1, 0))["revenue"], "revenue") == [(10.0 + 36 * 400 / 12,)]


def test_cumulative_energy_has_a_total_order(spark):
    data = [("u", D(0), float(x % 7) - 3, x) for x in range(60)]
    df = spark.createDataFrame(data, "DUID string, SETTLEMENTDATE timestamp_ntz, MW double, n int")
    found = [{(r.n, round(r.cumulative_mwh, 9)) for r in got.collect()}
             for got in (o.cumulative_energy(df), o.cumulative_energy(df.repartition(5, "n"), split_rows=7))]
    assert found[0] == found[1] and len(found[0]) == 60
