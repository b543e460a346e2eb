import random
import statistics

import pytest
from pyspark.sql import functions as F

from bidstrata.operators import bands as b
from bidstrata.operators import slicing
from bidstrata.operators import stats as s
from tests.conftest import rows


def quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


def spread(seed, n=400):
    """Groups of unlike size and shape: one holds a third of all rows, one is constant, one has far outliers."""
    rnd = random.Random(seed)
    data = []
    for _ in range(n):
        g = rnd.choice(["hot", "hot", "const", "tail", "few"])
        x = {"hot": rnd.randrange(100) / 4, "const": 7.5, "tail": 10.0 ** rnd.randrange(-3, 9),
             "few": float(rnd.randrange(2))}[g]
        data.append((g, x if rnd.random() > 0.05 else None))
    return data + [("one", 3.0), ("none", None)]


PROBS = {"q25": 0.25, "median": 0.5, "q75": 0.75, "p99": 0.99, "low": 0.0, "top": 1.0}


@pytest.mark.parametrize("whole", [True, False])
def test_quantiles_match_sorting(spark, monkeypatch, whole):
    monkeypatch.setattr(slicing, "SPLIT_ROWS", 10**6 if whole else 3)
    data = spread(3)
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r for r in s.quantiles(df, ["g"], "x", PROBS, n_distinct="d").collect()}
    groups = {g: [x for k, x in data if k == g and x is not None] for g in {k for k, _ in data}}
    assert set(got) == {g for g, xs in groups.items() if xs}
    for g, r in got.items():
        assert r.d == len(set(groups[g]))
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(quantile(groups[g], p), rel=1e-12)


def test_overall_quantile(spark, cut):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    assert s.quantiles(df, [], "x", {"q1": 0.25, "m": 0.5, "q3": 0.75}).first() == (1.75, 2.5, 4.75)


def test_band_stats(spark, cut):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 10.0, None)] + [("b", 4.0)], "g string, PRICE double")
    got = {r.g: r for r in s.band_stats(df, ["g"]).collect()}
    a = got["a"]
    assert (a.n, a.mean, a.min, a.q25, a.median, a.q75, a["max"], a.n_distinct) == (4, 4.0, 1.0, 1.75, 2.5, 4.75, 10.0, 4)
    assert a["std"] == pytest.approx(statistics.stdev([1, 2, 3, 10]))
    assert (got["b"].n, got["b"]["std"], got["b"].median) == (1, None, 4.0)


@pytest.mark.parametrize("whole", [True, False])
def test_box_figures(spark, monkeypatch, whole):
    monkeypatch.setattr(slicing, "SPLIT_ROWS", 10**6 if whole else 3)
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 100.0, -50.0]
    df = spark.createDataFrame([("g", x) for x in values], "g string, x double")
    q1, q3 = quantile(values, 0.25), quantile(values, 0.75)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [x for x in values if low <= x <= high]
    r = s.box_stats(df, ["g"], "x").first()
    assert (r.n, r.q1, r.q3) == (8, q1, q3)
    assert (r.whisker_low, r.whisker_high) == (min([*inside, q1]), max([*inside, q3]))
    assert r.n_outliers == len(values) - len(inside)
    out = s.box_outliers(df, ["g"], "x")
    assert sum(n for _, _, n in rows(out)) == r.n_outliers


def test_whiskers_never_lie_inside_the_box(spark):
    # No value between the third quartile and its fence.
    df = spark.createDataFrame([("g", x) for x in (0.0, 0.0, 0.0, 1000.0)], "g string, x double")
    r = s.box_stats(df, ["g"], "x").first()
    assert r.whisker_high == r.q3 and r.whisker_low == 0.0


def test_histogram_fills_empty_bins(spark):
    df = spark.createDataFrame([("g", 0), ("g", 0), ("g", 2), ("h", 9000)], "g string, n bigint")
    hist = s.int_histogram(df, ["g"], "n")
    assert rows(hist.where("g = 'g'")) == [("g", 0, 2), ("g", 1, 0), ("g", 2, 1)]
    h = hist.where("g = 'h'")
    assert h.count() == 9001 and h.agg(F.sum("n")).first()[0] == 1 and h.agg(F.count_distinct("bin")).first()[0] == 9001


def test_summary(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 5), ("b", 2)], "g string, n bigint")
    got = {r.g: r for r in s.summary_stats(df, ["g"], "n").collect()}
    assert (got["a"].n, got["a"].mean, got["a"].median, got["a"]["max"]) == (3, 2.0, 1.0, 5)
    assert got["a"].pct_zero == pytest.approx(100 / 3) and got["b"]["std"] is None


def test_counts_drop_missing_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "u string, d int")
    assert rows(s.rebid_counts(df, ["u", "d"])) == [("a", 1, 2, 1)]


def test_participation_modes(spark):
    bids = [("u", "ENERGY", d) for d in range(10)] + [("u", "RAISEREG", d) for d in range(6)] * 3
    df = spark.createDataFrame(bids, "DUID string, BIDTYPE string, SETTLEMENTDATE int")
    attended = s.participations(df).withColumn("bidder_category", F.lit("c"))
    share = {r.BIDTYPE: r.participation_pct for r in s.participation_share(attended).collect()}
    assert share == {"ENERGY": 62.5, "RAISEREG": 37.5}
    alone = {r.BIDTYPE: r.participation_pct for r in s.participation_share(attended, mode="auctions").collect()}
    assert alone == {"ENERGY": 100.0, "RAISEREG": 60.0}
    table = s.participation_table(s.participation_share(attended), ["ENERGY", "RAISEREG", "LOWERREG"])
    assert rows(table) == [("c", 62.5, 37.5, 0.0)]
    with pytest.raises(ValueError):
        s.participation_share(attended, mode="other")


def test_variation_of_constant_prices_is_exactly_zero(spark):
    data = [("a", "R1", True, 10000.1, 3.3)] * 50 + [("b", "R1", False, float(i), 0.0) for i in range(4)]
    df = spark.createDataFrame(data, "DUID string, BIDTYPE string, is_autobidder boolean, PRICEBAND1 double, PRICEBAND2 double")
    fleet = df.select("DUID", "is_autobidder").distinct()
    detail = s.unit_service_variation(df, bands=["PRICEBAND1", "PRICEBAND2"], shown=(1, 2)).join(fleet, "DUID")
    got = {r.DUID: r for r in detail.collect()}
    assert (got["a"].n_offers, got["a"].avg_std_across_bands, got["a"].total_distinct_values) == (50, 0.0, 2)
    assert got["b"].std_pb1 == pytest.approx(statistics.stdev(range(4))) and got["b"].n_distinct_pb2 == 1
    summary = {r.is_autobidder: r for r in s.variation_summary(detail).collect()}
    assert (summary[True].n_units, summary[True].median_price_band_std) == (1, 0.0)
    pooled = s.unit_variation(df, ["DUID"], ["PRICEBAND1", "PRICEBAND2"])
    assert rows(pooled.where("DUID = 'b' AND band = 2"), "std", "cv", "n_distinct") == [(0.0, 0.0, 1)]


def test_variation_across_services_only_shows_when_pooled(spark):
    data = [("a", svc, True, price) for svc, price in (("R1", 1.0), ("R2", 9.0)) for _ in range(5)]
    df = spark.createDataFrame(data, "DUID string, BIDTYPE string, is_autobidder boolean, PRICEBAND1 double")
    pooled = s.unit_variation(df, ["DUID"], ["PRICEBAND1"]).first()
    apart = s.unit_variation(df, ["DUID", "BIDTYPE"], ["PRICEBAND1"])
    assert pooled["std"] > 4 and {r["std"] for r in apart.collect()} == {0.0}


def test_summary_follows_from_detail(spark):
    detail = spark.createDataFrame(
        [(True, "a", "x", 10, 0.0, 10), (True, "a", "y", 20, 2.0, 12), (True, "b", "x", 30, 4.0, 20)],
        "is_autobidder boolean, DUID string, BIDTYPE string, n_offers bigint, avg_std_across_bands double, "
        "total_distinct_values bigint")
    r = s.variation_summary(detail).first()
    assert (r.n_units, r.n_unit_service_combos, r.avg_offers_per_combo, r.avg_price_band_std) == (2, 3, 20.0, 2.0)
    assert (r.avg_distinct_values_per_combo, r.median_price_band_std, r.median_distinct_values) == (14.0, 2.0, 12.0)


@pytest.mark.parametrize("auto,other,verdict", [
    (12.0, 10.0, "SUPPORTED"), (8.0, 10.0, "REJECTED"), (10.5, 10.0, "INCONCLUSIVE")])
def test_verdict(spark, auto, other, verdict):
    df = spark.createDataFrame([(True, auto), (False, other)], "is_autobidder boolean, std double")
    assert s.compare_groups(df).first().verdict == verdict


def test_grid_lists_every_cell(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 5.0)], "r string, c string, v double")
    grid = lambda **kw: rows(s.dense_grid(df, {"r": ["a", "b", "z"]}, "c", ["x", "y", "w"], F.avg("v"), **kw))
    assert grid() == [("a", 2.0, None, None), ("b", None, 5.0, None), ("z", None, None, None)]
    assert grid(fill=0.0) == [("a", 2.0, 0.0, 0.0), ("b", 0.0, 5.0, 0.0), ("z", 0.0, 0.0, 0.0)]


def test_melting_keeps_missing_bands(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "u string, PRICEBAND1 double, PRICEBAND10 double")
    long = b.bands_long(df, ["u"], ["PRICEBAND1", "PRICEBAND10"])
    assert rows(long.withColumn("n", b.band_number()), "PRICE", "n") == [(1.0, 1), (None, 10)]
    assert rows(b.first_bands(long, 8), "PRICEBAND") == [("PRICEBAND1",)]


def test_versions_counted_over_given_tasks(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", None), (None, 3), (None, 4)], "DUID string, OFFERDATE int")
    spread = s.rebid_frequency(df, ["DUID"], tasks=7)
    # Both the distinct offers and their counts are made in as many tasks as asked for, whatever the session's number.
    assert spread._jdf.queryExecution().executedPlan().toString().count(", 7), REPARTITION_BY_NUM") == 2
    assert rows(spread) == rows(s.rebid_frequency(df, ["DUID"])) == [("a", 2), ("b", 0), (None, 2)]
