import pytest
from pyspark.sql import functions as F

from bidstrata.plans import reports
from bidstrata.schema import PRICE_BANDS, QUANTITY_BANDS
from tests.conftest import SF, rows
from workload import tables

UNITS = [("A", "BIDIRECTIONAL", True, "p"), ("B", "BIDIRECTIONAL", None, "q"), ("C", "GENERATOR", None, "r")]
SERVICES = ["RAISEREG", "LOWERREG"]
KEYS = "DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, OFFERDATE"


@pytest.fixture(scope="module")
def book(spark):
    """Three units, two services and energy, two days, three offers a day: the second changes nothing, the third does."""
    offers = spark.createDataFrame([(u,) for u, *_ in UNITS], "DUID string").selectExpr(
        "DUID", "explode(array('RAISEREG', 'LOWERREG', 'ENERGY')) AS BIDTYPE", "'GEN' AS DIRECTION").selectExpr(
        "*", "explode(array(date'2025-10-01', date'2025-10-02')) AS SETTLEMENTDATE").selectExpr(
        "*", "explode(array(0, 1, 2)) AS v").withColumn(
        "OFFERDATE", F.expr("cast(SETTLEMENTDATE AS timestamp_ntz) + make_dt_interval(0, v)"))
    price = offers.select(
        *KEYS.split(", "), F.when(F.col("v") == 0, "DAILY").otherwise("REBID").alias("ENTRYTYPE"),
        F.lit("Automated").alias("REBIDEXPLANATION"),
        *[F.when(F.col("DUID") == "A", float(i)).otherwise(F.col("v") + float(i)).alias(b) for i, b in enumerate(PRICE_BANDS)])
    qty = offers.select(
        *KEYS.split(", "), F.explode(F.array(F.lit(1), F.lit(2))).alias("PERIODID"),
        *[F.when(F.col("v") == 2, 5.0).otherwise(1.0).alias(b) for b in QUANTITY_BANDS])
    units = spark.createDataFrame(UNITS, "DUID string, DISPATCHTYPE string, AUTOBIDDER boolean, PARTICIPANT_NAME string")
    return price, qty, units


def collected(frames):
    return {name: df.collect() for name, df in frames.items()}


def test_rebid_report(book):
    price, _, units = book
    got = collected(reports.rebid_report(price, units))
    assert {(r.bidder_category, r.n, r.mean) for r in got["summary"]} == {
        ("Autobidder Battery", 4, 2.0), ("Non-Autobidder Battery", 4, 2.0), ("Non-Battery", 4, 2.0)}
    assert len(got["mean_by_service"]) == 10 and all(r.n_outliers == 0 for r in got["boxes"])
    assert {(r.bin, r.n) for r in got["histogram"]} == {(0, 0), (1, 0), (2, 4)}


def test_true_rebid_reports(book):
    price, qty, units = book
    got = collected(reports.true_rebid_report(qty, units))
    assert {(r.n, r.mean) for r in got["summary"]} == {(8, 1.0)}
    assert {(r.avg_of_means, r.n_units) for r in got["per_unit_by_category"]} == {(1.0, 1)}
    for per_period, auctions in ((True, 8), (False, 4)):
        share = reports.rebid_vs_true(price, qty, units, per_period=per_period)["share"].collect()
        assert {(r.n_auctions, r.avg_pct_true) for r in share} == {(auctions, 50.0 if per_period else 100.0)}


def test_price_reports(book):
    price, _, units = book
    first = collected(reports.initial_price_report(price, units))
    assert len(first["offers"]) == 12 and len(first["long"]) == 120 and len(first["mean_by_service"]) == 30
    assert {r.PRICEBAND for r in first["battery_boxes_5"]} == set(PRICE_BANDS[:5])
    change = collected(reports.price_change_report(price, units))
    means = {r.bidder_category: r.PRICEBAND1 for r in change["mean"]}
    assert means == {"Autobidder Battery": 0.0, "Non-Autobidder Battery": 2.0, "Non-Battery": 2.0}
    assert {r.PRICEBAND4 for r in change["median"]} == {0.0, 2.0}


def test_participation_and_variation(book):
    price, _, units = book
    table = reports.participation(price, units)["table"].collect()
    assert {(r.ENERGY, r.RAISE1SEC) for r in table} == {(33.33, 0.0)}
    daily = collected(reports.daily_band_report(price, units))
    assert daily["profile"][0].n_rows == 8 and len(daily["stats"]) == 20
    assert daily["verdict"][0].verdict == "INCONCLUSIVE"
    varied = collected(reports.variation_report(price, units))
    assert {(r.is_autobidder, r.avg_price_band_std > 0) for r in varied["summary"]} == {
        ("Autobidder", False), ("Non-Autobidder", True)}
    assert len(varied["by_entry_type"]) == 4
    assert reports.first_offers(price, "A", "RAISEREG", 1).count() == 1


def test_curves_and_applied_offers(spark, book):
    price, qty, units = book
    curves = reports.bid_curves(price, qty)
    assert curves.count() == 3 * 3 * 2 * 2 * 2 * 11  # units, services, days, periods, kept versions, steps
    top = curves.where("DUID = 'B' AND BIDTYPE = 'ENERGY' AND PERIODID = 1 AND step = 10 AND version_index = 2").first()
    assert (top.cum_mw, top.price) == (50.0, 11.0)
    tracking = price.where("ENTRYTYPE = 'DAILY'").selectExpr(
        "cast(SETTLEMENTDATE AS timestamp_ntz) + make_dt_interval(0, 4, 5) AS SETTLEMENTDATE", "DUID", "BIDTYPE",
        "SETTLEMENTDATE AS BIDSETTLEMENTDATE", "OFFERDATE AS BIDOFFERDATE")
    got = collected(reports.applied_offer_report(tracking, price, qty))
    assert len(got["applied"]) == 18 and {r.PERIODID for r in got["applied"]} == {1}
    assert {r.version_label for r in got["timeline"]} == {"initial", "rebid 1", "rebid 2"}
    assert {r.n_versions for r in got["versions_per_period"]} == {3}
    assert {r.window for r in got["peak"]} == {"off-peak"}
    panel = reports.price_quantity_export(price, qty, units, "A", "RAISEREG", limit=5)
    assert panel.count() == 5 and panel.first().dispatch_type == "BIDIRECTIONAL"


def test_market_report(spark, book):
    price, _, _ = book
    wide = spark.createDataFrame([("N", 1, 60.0), ("S", 1, 90.0)], "REGIONID string, SETTLEMENTDATE int, RRP double")
    from bidstrata.schema import REGIONAL_PRICES

    wide = wide.select("*", *[F.lit(12.0).alias(c) for c in REGIONAL_PRICES[1:]])
    load = spark.createDataFrame([("A", 1, "ENERGY", 10.0), ("A", 1, "RAISEREG", 6.0)],
                                 "DUID string, SETTLEMENTDATE int, BIDTYPE string, MW double")
    region = spark.createDataFrame([("A", "N")], "DUID string, REGIONID string")
    got = collected(reports.market_report(wide, load, region, price))
    assert {(r.BIDTYPE, r.separation) for r in got["separation"] if r.separation} == {("ENERGY", 30.0)}
    assert [tuple(r) for r in got["revenue"]] == [("A", "RAISEREG", 6.0, 6.0)]
    assert got["energy"][0].cumulative_mwh == pytest.approx(-10 * 5 / 60)
    assert got["bad_bands"] == [] and all(r.mentions_automation for r in got["automation"])


def test_outputs_share_one_written_frame(spark, book, tmp_path):
    price, qty, units = book
    qty.write.parquet(str(tmp_path / "qty"))
    qty = spark.read.parquet(str(tmp_path / "qty"))
    plain, once = reports.true_rebid_report(qty, units), reports.true_rebid_report(qty, units, path=str(tmp_path / "counts"))
    assert all("BANDAVAIL1" in f._jdf.queryExecution().optimizedPlan().toString() for f in plain.values())
    for name, frame in once.items():
        assert "BANDAVAIL1" not in frame._jdf.queryExecution().optimizedPlan().toString(), name
        assert sorted(map(str, frame.collect())) == sorted(map(str, plain[name].collect())), name
    changed = reports.price_change_report(price, units, path=str(tmp_path / "changes"))
    assert changed["mean"].count() == 3 and reports.initial_price_report(price, units, path=str(tmp_path / "first"))["mean"].count() == 3


def test_market_report_takes_one_run(spark, book):
    price, _, _ = book
    from bidstrata.schema import REGIONAL_PRICES

    wide = spark.createDataFrame([("N", 1, 1, 0, 60.0), ("N", 1, 1, 1, 90.0), ("N", 1, 2, 0, 70.0)],
                                 "REGIONID string, SETTLEMENTDATE int, RUNNO int, INTERVENTION int, RRP double")
    wide = wide.select("*", *[F.lit(12.0).alias(c) for c in REGIONAL_PRICES[1:]])
    load = spark.createDataFrame([("A", 1, 1, 0, 10.0, 6.0), ("A", 1, 1, 1, 20.0, 8.0)],
                                 "DUID string, SETTLEMENTDATE int, RUNNO int, INTERVENTION int, TOTALCLEARED double, RAISEREG double")
    region = spark.createDataFrame([("A", "N")], "DUID string, REGIONID string")
    results = spark.createDataFrame([("c", 1, 1, 0, 5.0), ("c", 1, 1, 1, 7.0), ("d", 1, 1, 0, 0.0)],
                                    "CONSTRAINTID string, SETTLEMENTDATE int, RUNNO int, INTERVENTION int, MARGINALVALUE double")
    definitions = spark.createDataFrame([("c", "<=")], "CONSTRAINTID string, kind string")
    lhs = spark.createDataFrame([("c", "A", 1.0)], "CONSTRAINTID string, DUID string, FACTOR double")
    demand = spark.createDataFrame([("N", 1, 100.0)], "REGIONID string, SETTLEMENTDATE int, DEMAND double")
    detail = spark.createDataFrame([("A", 1, "RAISEREG", 0.0, 5.0, 15.0, 20.0, 8.0)],
                                   "DUID string, interval int, BIDTYPE string, ENABLEMENTMIN double, LOWBREAKPOINT double, "
                                   "HIGHBREAKPOINT double, ENABLEMENTMAX double, MAXAVAIL double")
    got = collected(reports.market_report(
        wide, load, region, price, constraints=(results, definitions, lhs), demand=(demand, demand), qty=detail))
    assert sorted((r.BIDTYPE, r.value) for r in got["value"]) == [("ENERGY", 50.0), ("RAISEREG", 6.0)]
    assert [(r.CONSTRAINTID, r.MARGINALVALUE) for r in got["binding"]] == [("c", 5.0)]
    assert [(r.DUID, r.binding_intervals) for r in got["binding_by_unit"]] == [("A", 1)]
    assert got["demand_error"][0].error == 0.0 and got["available"][0].available_mw == 8.0


def test_price_rows_of_lines_need_no_join(spark):
    made = tables.sided_prices(spark, SF)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    lines = tables.load(spark, SF, "lineitem")
    same = lines.select(F.col("l_orderkey").alias("L_ORDER"), F.col("l_linenumber").alias("PERIODID"), "l_extendedprice")
    joined = tables.detail(spark, SF).join(same, ["L_ORDER", "PERIODID"]).groupBy(*tables.FIVE).agg(F.min("l_extendedprice").alias("PRICEBAND1"))
    assert rows(made, *tables.FIVE, "PRICEBAND1") == rows(joined)
