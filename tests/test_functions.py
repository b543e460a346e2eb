import pytest
from pyspark.sql import functions as F

from bidstrata.functions import checks, periods
from bidstrata.functions import units as u
from bidstrata.schema import AUTOBIDDER_BATTERY, NON_BATTERY, OTHER_BATTERY
from tests.conftest import at, rows


def test_categories(spark):
    df = spark.createDataFrame(
        [(1, "BIDIRECTIONAL", True), (2, "BIDIRECTIONAL", None), (3, "BIDIRECTIONAL", False), (4, None, True),
         (5, "GENERATOR", True)], "i int, DISPATCHTYPE string, AUTOBIDDER boolean")
    assert rows(df.select("i", u.unit_category())) == [
        (1, AUTOBIDDER_BATTERY), (2, OTHER_BATTERY), (3, OTHER_BATTERY), (4, NON_BATTERY), (5, NON_BATTERY)]


def test_exclusions_keep_missing_values(spark):
    df = spark.createDataFrame(
        [("VSSEL1V1", "RAISEREG"), (None, "ENERGY"), ("A", None), ("A", "ENERGY")], "DUID string, BIDTYPE string")
    assert rows(u.exclude_units(df), "DUID") == [("A",), ("A",), (None,)]
    assert rows(u.ancillary_only(df)) == [("A", None), ("VSSEL1V1", "RAISEREG")]


@pytest.mark.parametrize("time,origin,convention,expected", [
    ("2025-10-01T00:05:00", 0, "end", 1), ("2025-10-02T00:00:00", 0, "end", 288), ("2025-10-01T00:00:00", 0, "start", 1),
    ("2025-10-01T23:55:00", 0, "start", 288), ("2025-10-01T04:05:00", 240, "end", 1),
    ("2025-10-02T04:00:00", 240, "end", 288), ("2025-10-01T04:07:30", 240, "end", 2),
])
def test_period_numbers(spark, time, origin, convention, expected):
    df = spark.createDataFrame([(at(time),)], "t timestamp_ntz")
    assert df.select(periods.period_id("t", origin, convention)).first()[0] == expected


def test_whole_day_maps_onto_1_to_288(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2025-10-01 00:05:00', timestamp_ntz'2025-10-02 00:00:00', "
                   "interval 5 minutes)) AS t")
    assert rows(periods.period_conventions(df, "t")) == [("end", 1, 288, 288), ("start", 1, 288, 288)]
    with pytest.raises(ValueError):
        periods.period_id("t", convention="middle")


def test_period_ranges_expand(spark):
    df = spark.createDataFrame([("a", 1, 3), ("b", 5, 5), ("c", 7, None)], "k string, PERIODID int, PERIODIDTO int")
    assert rows(periods.expand_periods(df)) == [
        ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 5, 5), ("c", 7, 7)]


def test_position_follows_local_time_through_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Australia/Sydney")
        times = [at("2025-10-05T01:59:59.999999"), at("2025-10-05T02:30:00"), at("2025-10-05T03:00:00"), at("2025-10-05T03:30:00")]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(times)], "i int, t timestamp_ntz")
        got = [r[0] for r in df.orderBy("i").select(F.expr(periods.position(df.schema["t"].dataType, "t"))).collect()]
        assert got == sorted(set(got)) and got[2] - got[1] == 30 * 60 * 10**6 and got[1] - got[0] == 1800 * 10**6 + 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_labels(spark):
    df = spark.createDataFrame([(at("2025-10-01T07:04:09"),), (None,)], "t timestamp_ntz")
    assert rows(df.select(periods.clock_label("t"), periods.stamp_label("t"))) == [
        ("07:04", "20251001_0704"), ("Unknown", "Unknown")]


@pytest.mark.parametrize("mw,expected", [
    (4, 0), (5, 0), (10, 15), (15, 30), (20, 30), (35, 30), (40, 15), (45, 0), (46, 0)])
def test_trapezium(spark, mw, expected):
    level = [F.lit(float(x)) for x in (mw, 5, 15, 35, 45, 30)]
    assert spark.range(1).select(checks.fcas_available(*level)).first()[0] == expected


def test_trapezium_with_coinciding_limits(spark):
    for mw, expected in ((9.0, 0.0), (10.0, 7.0), (20.0, 7.0), (21.0, 0.0)):
        got = spark.range(1).select(checks.fcas_available(*[F.lit(float(x)) for x in (mw, 10, 10, 20, 20, 7)])).first()[0]
        assert got == expected


def test_band_order_and_text(spark):
    df = spark.createDataFrame([(1, 1.0, None, 2.0, "Automated rebid"), (2, 3.0, 2.0, None, None), (3, 1.0, 1.0, 1.0, "x")],
                               "i int, a double, b double, c double, e string")
    assert rows(checks.band_order_violations(df, ["a", "b", "c"]), "i") == [(2,)]
    assert rows(checks.mentions_automation(df, "e"), "i", "mentions_automation") == [(1, True), (2, False), (3, False)]
