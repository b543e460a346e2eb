import pytest
from pyspark.sql import functions as F

from bidstrata.schema import ALIGN_DETAIL, PRICE_BANDS, QUANTITY_BANDS, TABLES
from bidstrata.operators.joins import align_detail, price_quantity_panel
from bidstrata.operators import stats
from bidstrata.sources import archive, counted, sinks
from tests.conftest import SF, at, on, rows
from workload import queries
from workload.archives import write_archive


def line(table, **cells):
    names = [c for c, _ in TABLES[table]]
    return ",".join(["D", "BIDS", table, "2", *[str(cells.get(c, "")) for c in names]])


def write_part(directory, table, n, data, footer=None, suffix="CSV"):
    names = ",".join(["I", "BIDS", table, "2", *[c for c, _ in TABLES[table]]])
    text = ["C,SOURCE,ARCHIVE,PUBLIC,2025/11/01", names, *data, f"C,END OF REPORT,{footer or len(data) + 3}"]
    (directory / f"PUBLIC_ARCHIVE#{table}#FILE{n:02d}#202510010000.{suffix}").write_text("\n".join(text) + "\n")


def header(unit="UNIT7", direction="GEN", offer="2031/03/04 05:06:07.250", **more):
    prices = {b: -50 + 11 * k for k, b in enumerate(PRICE_BANDS)}
    return line("BIDDAYOFFER", DUID=unit, BIDTYPE="ENERGY", SETTLEMENTDATE='"2031/03/05 00:00:00"', OFFERDATE=offer,
                DIRECTION=direction, VERSIONNO=1, ENTRYTYPE="Daily", LASTCHANGED="2031/03/04 05:06:08", **prices, **more)


def test_archive_rows_and_types(spark, tmp_path):
    write_part(tmp_path, "BIDDAYOFFER", 1, [header(REBIDEXPLANATION='"Initial, first ""offer"""'), header(direction="LOAD", T1="bad")])
    df = archive.read_archive(spark, archive.parts(str(tmp_path), "BIDDAYOFFER"), "BIDDAYOFFER")
    assert df.count() == 2
    r = df.where("DIRECTION = 'GEN'").first()
    assert (r.SETTLEMENTDATE, r.OFFERDATE, r.LASTCHANGED) == (on("2031-03-05"), at("2031-03-04T05:06:07.250"), at("2031-03-04T05:06:08"))
    assert (r.PRICEBAND1, r.PRICEBAND10, r.ENTRYTYPE, r.T1) == (-50.0, 49.0, "DAILY", None)
    assert r.REBIDEXPLANATION == 'Initial, first "offer"'
    lost = archive.rejected_cells(spark, archive.parts(str(tmp_path), "BIDDAYOFFER"), "BIDDAYOFFER")
    assert rows(lost.where("rejected > 0")) == [("T1", 1)]


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "price.csv").write_text("\n".join([
        "C,SOURCE,ARCHIVE", "I,DISPATCH,DISPATCHPRICE,5,SETTLEMENTDATE,RUNNO,REGIONID,DISPATCHINTERVAL,INTERVENTION,RRP,EEP,LOWERREGRRP",
        "D,DISPATCH,DISPATCHPRICE,5,2025/10/01 00:05:00,1,N,20251001001,0,61.5,0,7", "C,END OF REPORT,4"]) + "\n")
    df = archive.read_archive(spark, str(tmp_path / "price.csv"), "DISPATCHPRICE")
    assert df.columns == ["SETTLEMENTDATE", "RUNNO", "REGIONID", "INTERVENTION", "RRP", "LOWERREGRRP"]
    assert df.first()[1:] == (1, "N", 0, 61.5, 7.0)
    other = tmp_path / "other.csv"
    other.write_text("C,x\nI,P,REGION,1,REGIONID,NAME\nD,P,REGION,1,N,North\nC,END OF REPORT,4\n")
    assert rows(archive.read_archive(spark, str(other), "REGION")) == [("N", "North")]
    other.with_name("empty.csv").write_text("C,x\n")
    with pytest.raises(ValueError, match="no column-name line"):
        archive.read_archive(spark, str(other.with_name("empty.csv")), "REGION")


def test_parts_of_differing_layouts(spark, tmp_path):
    a, b = tmp_path / "x#PRICE#FILE01#1.CSV", tmp_path / "x#PRICE#FILE02#1.CSV"
    a.write_text("C,x\nI,DISPATCH,PRICE,4,SETTLEMENTDATE,REGIONID,RRP\nD,DISPATCH,PRICE,4,2031/03/05 00:05:00,N,50\nC,END OF REPORT,4\n")
    b.write_text("C,x\nI,DISPATCH,PRICE,5,SETTLEMENTDATE,RUNNO,REGIONID,RRP\n"
                 "D,DISPATCH,PRICE,5,2031/03/05 00:10:00,1,S,60\nC,END OF REPORT,4\n")
    path = archive.parts(str(tmp_path), "PRICE")
    df = archive.read_archive(spark, path, "DISPATCHPRICE")  # the lines call the table PRICE
    assert df.columns == ["SETTLEMENTDATE", "RUNNO", "REGIONID", "RRP"]
    assert rows(df, "REGIONID", "RRP", "RUNNO") == [("N", 50.0, None), ("S", 60.0, 1)]
    assert rows(archive.rejected_cells(spark, path, "DISPATCHPRICE"), "column_name", "rejected") == [
        ("RRP", 0), ("RUNNO", 0), ("SETTLEMENTDATE", 0)]
    given = [("SETTLEMENTDATE", "timestamp_ntz"), ("REGIONID", "string"), ("RRP", "double")]
    assert archive.read_archive(spark, str(a), "PRICE", given).count() == 1
    with pytest.raises(ValueError, match="other columns"):
        archive.read_archive(spark, path, "PRICE", given)
    a.write_text(a.read_text() + b.read_text())
    with pytest.raises(ValueError, match="several"):
        archive.read_archive(spark, path, "PRICE")


def test_footers_of_files_that_share_a_name(spark, tmp_path):
    for month in ("01", "02"):
        (tmp_path / month).mkdir()
        write_part(tmp_path / month, "BIDDAYOFFER", 1, [header()])
    checked = archive.check_footer(spark, str(tmp_path / "*" / "*.CSV"))
    assert rows(checked, "data_rows", "complete") == [(1, True), (1, True)]


def test_detail_is_expanded_at_ingest(spark, tmp_path):
    write_part(tmp_path, "BIDOFFERPERIOD", 1, [
        line("BIDOFFERPERIOD", DUID="U", BIDTYPE="ENERGY", TRADINGDATE="2031/03/05 00:00:00",
             OFFERDATETIME="2031/03/04 05:06:07", PERIODID=4, PERIODIDTO=6)])
    archive.ingest_detail(archive.read_archive(spark, archive.parts(str(tmp_path), "BIDOFFERPERIOD"), "BIDOFFERPERIOD"), str(tmp_path / "d"))
    assert rows(spark.read.parquet(str(tmp_path / "d")), "PERIODID", "PERIODIDTO") == [(4, 4), (5, 5), (6, 6)]


def test_every_part_of_a_table_is_read(spark, tmp_path):
    write_part(tmp_path, "BIDDAYOFFER", 1, [header()])
    write_part(tmp_path, "BIDDAYOFFER", 2, [header("B"), header("C")], suffix="csv")
    write_part(tmp_path, "BIDOFFERPERIOD", 1, [line("BIDOFFERPERIOD", DUID="X")])
    df = archive.read_archive(spark, archive.parts(str(tmp_path), "BIDDAYOFFER"), "BIDDAYOFFER")
    assert rows(df, "DUID") == [("B",), ("C",), ("UNIT7",)]


def test_footer_check_finds_a_short_file(spark, tmp_path):
    write_part(tmp_path, "BIDDAYOFFER", 1, [header(), header("B")])
    write_part(tmp_path, "BIDDAYOFFER", 2, [header("C")], footer=99)
    checked = archive.check_footer(spark, archive.parts(str(tmp_path), "BIDDAYOFFER"))
    assert rows(checked, "data_rows", "footer_lines", "complete") == [(1, 99, False), (2, 5, True)]


def test_header_and_detail_join_after_alignment(spark, tmp_path):
    write_part(tmp_path, "BIDDAYOFFER", 1, [header(), header(direction="LOAD")])
    detail = [line("BIDOFFERPERIOD", DUID="UNIT7", BIDTYPE="ENERGY", TRADINGDATE="2031/03/05 00:00:00",
                   OFFERDATETIME="2031/03/04 05:06:07.250", DIRECTION="GEN", PERIODID=p, PERIODIDTO=p,
                   **{b: 0 for b in QUANTITY_BANDS}) for p in (1, 2, 3)]
    write_part(tmp_path, "BIDOFFERPERIOD", 1, detail)
    price = archive.read_archive(spark, archive.parts(str(tmp_path), "BIDDAYOFFER"), "BIDDAYOFFER")
    qty = align_detail(archive.read_archive(spark, archive.parts(str(tmp_path), "BIDOFFERPERIOD"), "BIDOFFERPERIOD"))
    assert not set(ALIGN_DETAIL) & set(qty.columns)
    assert price_quantity_panel(price, qty).count() == 3


def test_unit_map(spark, tmp_path):
    path = tmp_path / "units.csv"
    path.write_text("DUID,DISPATCHTYPE,FLAG,PARTICIPANT_NAME\nA,BIDIRECTIONAL,True,p\nB,GENERATOR,,q\nC,LOAD,x,r\n")
    got = archive.read_unit_map(spark, str(path), {"FLAG": "AUTOBIDDER"})
    assert rows(got, "DUID", "AUTOBIDDER") == [("A", True), ("B", None), ("C", None)]


def test_ingest_replaces_only_its_days(spark, tmp_path):
    dst = str(tmp_path / "bids")
    schema = "DUID string, BIDTYPE string, SETTLEMENTDATE date, x int"
    archive.ingest(spark.createDataFrame([("a", "R", on("2025-10-01"), 1), ("a", "R", on("2025-10-02"), 2)], schema), dst)
    archive.ingest(spark.createDataFrame([("a", "R", on("2025-10-02"), 3)], schema), dst)
    back = spark.read.parquet(dst)
    assert rows(back, "x", "market_day") == [(1, on("2025-10-01")), (3, on("2025-10-02"))]
    assert "PartitionFilters: [isnotnull(market_day" in back.where(
        F.col("market_day") == on("2025-10-01"))._jdf.queryExecution().toString()


def test_row_index_follows_the_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), "id").repartition(7)
    path = str(tmp_path / "out")
    (tmp_path / "held").mkdir()
    sinks.write_result(df, path, ["k"], index="row", directory=str(tmp_path / "held"))
    assert not list((tmp_path / "held").iterdir())
    back = spark.read.schema("row bigint, k bigint, id bigint").csv(path, header=True)
    assert back.count() == 1000 and back.where("row <> k").count() == 0
    sinks.write_result(df, str(tmp_path / "plain"), ["k"])
    assert spark.read.csv(str(tmp_path / "plain"), header=True).columns == ["k", "id"]


def test_lines_that_do_not_fit_go_to_quarantine(spark, tmp_path):
    good = header(REBIDEXPLANATION='"said ""wait"", twice"')
    surplus, missing, open_quote = good + ',x,"y, z"', good.rsplit(",", 1)[0], header(REBIDEXPLANATION='"never closed')
    write_part(tmp_path, "BIDDAYOFFER", 1, [good, surplus, missing, header("B"), open_quote, "E,what,is,this", "???"])
    write_part(tmp_path, "BIDDAYOFFER", 2, [header("C")])
    (tmp_path / "PUBLIC_ARCHIVE#BIDDAYOFFER#FILE03#1.CSV").write_text("C,x\nD,BIDS,BIDDAYOFFER,2,a,b\nC,END OF REPORT,4\n")
    path = archive.parts(str(tmp_path), "BIDDAYOFFER")
    wide = 4 + len(TABLES["BIDDAYOFFER"])
    listed = archive.quarantine(spark, path)
    assert rows(listed, "line", "cells", "columns", "reason") == sorted([
        (surplus, wide + 2, wide, "surplus cells"), (missing, wide - 1, wide, "missing cells"),
        (open_quote, None, wide, "open quote"),
        ("E,what,is,this", 4, wide, "unknown type"), ("???", 1, wide, "unknown type"), ("D,BIDS,BIDDAYOFFER,2,a,b", 6, None, "no column names")],
        key=lambda r: r[0])
    read = archive.read_archive(spark, path, "BIDDAYOFFER")
    assert sorted(r.DUID for r in read.collect()) == ["B", "C", "UNIT7"] and read.where("DUID = 'UNIT7'").first().REBIDEXPLANATION == 'said "wait", twice'
    assert read.select("DUID").count() == 3 and read.select("PRICEBAND3").where("PRICEBAND3 IS NOT NULL").count() == 3
    assert rows(archive.rejected_cells(spark, path, "BIDDAYOFFER").where("rejected > 0")) == []
    checked = archive.check_footer(spark, path)
    assert rows(checked, "data_rows", "quarantined", "footer_lines", "complete") == [(1, 0, 4, True), (1, 1, 4, False), (5, 5, 10, False)]


def test_clean_archives_have_an_empty_quarantine(spark, tmp_path):
    write_part(tmp_path, "BIDDAYOFFER", 1, [header("C"), header("D")])
    assert archive.quarantine(spark, archive.parts(str(tmp_path), "BIDDAYOFFER")).collect() == []


def test_bucketed_tables_meet_where_they_lie(spark, monkeypatch):
    from workload import queries as q
    from workload import tables as t

    price, qty = q.bucketed_panel(spark, SF, 4)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
        archive.join_in_place(spark)
        panel = price_quantity_panel(price, q.flagged_in_place(qty), t.FIVE)
        plan = panel._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SortMergeJoin" in plan and "Exchange" not in plan
        assert panel.count() == q.QUERIES["price_quantity_panel"](spark, SF).count()
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def counted_table(spark, path):
    data = [(on(f"2031-03-{d:02d}"), g, float((d * 7 + k * k) % 23)) for d in range(1, 9) for g in "ab" for k in range(30)] + [
        (on("2031-03-01"), "a", None), (None, "a", 5.0)]
    long = spark.createDataFrame(data, "SETTLEMENTDATE date, g string, PRICE double")
    counted.write_counts(counted.value_counts(long, ["g"]), path)
    return long


@pytest.mark.parametrize("first, last", [(None, None), ("2031-03-03", "2031-03-05"), ("2031-03-08", None)])
def test_counts_of_days_give_the_quartiles_of_their_offers(spark, tmp_path, first, last):
    path = str(tmp_path / "counts")
    long = counted_table(spark, path)
    counts = counted.counts_of_days(spark, path, first, last)
    own = long.where(F.coalesce(F.col("SETTLEMENTDATE") >= F.lit(first or "1900-01-01").cast("date"), F.lit(first is None))
                     & F.coalesce(F.col("SETTLEMENTDATE") <= F.lit(last or "2999-01-01").cast("date"), F.lit(first is None)))
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    assert rows(stats.quantiles(counts, ["g"], "PRICE", probs, weight="n")) == rows(stats.quantiles(own, ["g"], "PRICE", probs))
    assert rows(stats.quantiles(counts, ["g"], "PRICE", probs, method="histogram", weight="n")) == rows(stats.quantiles(own, ["g"], "PRICE", probs))
    assert rows(stats.box_stats(counts, ["g"], "PRICE", weight="n")) == rows(stats.box_stats(own, ["g"], "PRICE"))
    assert rows(stats.band_stats(counts, ["g"], weight="n")) == rows(stats.band_stats(own, ["g"]))


def test_a_day_counted_again_replaces_itself_alone(spark, tmp_path):
    path = str(tmp_path / "counts")
    counted_table(spark, path)
    before = rows(counted.counts_of_days(spark, path).where("market_day <> '2031-03-02'"))
    again = spark.createDataFrame([(on("2031-03-02"), "a", 1.0)] * 3, "SETTLEMENTDATE date, g string, PRICE double")
    counted.write_counts(counted.value_counts(again, ["g"]), path)
    assert rows(counted.counts_of_days(spark, path).where("market_day <> '2031-03-02'")) == before
    assert rows(counted.counts_of_days(spark, path, "2031-03-02", "2031-03-02"), "g", "PRICE", "n") == [("a", 1.0, 3)]
    plan = counted.counts_of_days(spark, path, "2031-03-02", "2031-03-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(market_day" in plan


def test_only_the_days_that_tracking_names_are_read(spark, tmp_path):
    from bidstrata.operators.joins import applied_offers

    days = [on(f"2031-03-{d:02d}") for d in range(1, 9)]
    panel = spark.createDataFrame(
        [(f"u{k % 5}", "ENERGY", d, at("2031-02-01T00:00:00"), p, float(k)) for d in days for k in range(10) for p in (1, 2) if k < 5],
        "DUID string, BIDTYPE string, SETTLEMENTDATE date, OFFERDATE timestamp_ntz, PERIODID int, PRICE double")
    archive.ingest(panel, str(tmp_path / "panel"))
    tracking = spark.createDataFrame(
        [(at("2031-03-03T04:05:00"), f"u{k}", "ENERGY", days[2], at("2031-02-01T00:00:00")) for k in range(3)] + [
            (at("2031-03-05T04:10:00"), "u1", "ENERGY", days[4], at("2031-02-01T00:00:00"))],
        "SETTLEMENTDATE timestamp_ntz, DUID string, BIDTYPE string, BIDSETTLEMENTDATE date, BIDOFFERDATE timestamp_ntz")
    tracking.write.parquet(str(tmp_path / "tracking"))
    week = spark.read.parquet(str(tmp_path / "tracking")).where("SETTLEMENTDATE < timestamp_ntz'2031-03-08'")
    found = applied_offers(week, spark.read.parquet(str(tmp_path / "panel")))
    assert rows(found.drop("market_day")) == rows(applied_offers(tracking, panel)) and found.count() == 4
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()



def test_units_have_bloom_filters(spark, tmp_path):
    df = spark.createDataFrame([(f"u{k:05d}", "ENERGY", on("2031-03-01")) for k in range(0, 4000, 2)], "DUID string, BIDTYPE string, SETTLEMENTDATE date")
    sizes = []
    for name, bloom in (("with", ["DUID", "absent"]), ("without", [])):
        archive.ingest(df.coalesce(1), str(tmp_path / name), bloom=bloom)
        sizes.append(sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet")))
        assert spark.read.parquet(str(tmp_path / name)).where("DUID IN ('u00500', 'u00501')").count() == 1
    assert sizes[0] > sizes[1] + 1_000  # the filters themselves


def test_an_archive_is_written_in_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(0, 1000, 1, 4).where("id < 250 OR id >= 500").select(
        F.concat(F.lit("U,"), F.col("id").cast("string")).alias("DUID"), F.lit("GEN").alias("DISPATCHTYPE"))
    write_archive(df.mapInArrow(counting, df.schema), "DUDETAILSUMMARY", df.columns, str(tmp_path / "a"))
    assert seen.value == 750  # a sort or a count beside the writing would read the rows again
    back = archive.read_archive(spark, str(tmp_path / "a"), "DUDETAILSUMMARY")
    assert rows(back, "DUID", "DISPATCHTYPE") == sorted((f"U,{n}", "GEN") for n in range(1000) if not 250 <= n < 500)
    # A partition without rows has no file of lines; every other one is complete.
    footers = rows(archive.check_footer(spark, str(tmp_path / "a")), "data_rows", "footer_lines", "complete")
    assert footers == [(250, 253, True)] * 3


def test_buckets_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(archive, "BUCKET_ROWS", 400)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert archive.buckets_for(lines.limit(100), least=8) == 8
    asked = []
    monkeypatch.setattr(archive, "ingest_together", lambda df, name, path, buckets, *a: asked.append(buckets) or df.createOrReplaceTempView(name))
    queries.panel_in_place(spark, SF)
    assert asked == [-(-lines.count() // 400)] * 2 and asked[0] > 8
