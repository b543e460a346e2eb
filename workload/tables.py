"""Bid-book views of the driver's tables, once as DataFrames and once as SQL for the check.

Each view is a plain projection (or one aggregation) of whole tables; see README for what plays what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidstrata.sources.archive import read_archive
from bidstrata.sources.sinks import scratch_path
from workload.archives import write_archive

DAY_AUCTION = ["DUID", "BIDTYPE", "SETTLEMENTDATE"]
SIDE_AUCTION = ["DUID", "BIDTYPE", "DIRECTION", "SETTLEMENTDATE"]
DETAIL_ORDER = ["OFFERDATE", "L_ORDER", "L_PART"]
OFFER_ORDER = ["OFFERDATE", "VERSIONNO"]
PRICES3 = ["PRICEBAND1", "PRICEBAND2", "PRICEBAND3"]
MWS3 = ["BANDAVAIL1", "BANDAVAIL2", "BANDAVAIL3"]
ENERGY = "view"
SERVICES = ["click", "error", "purchase", "signup"]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in a folder that driver and executors share."""
    return scratch_path(spark)


def r4(c: Column | str) -> Column:
    """Round to four places. The nudge settles halves, which float sums in another order land on either side of."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 4)


def s4(expr: str) -> str:
    return f"round({expr} + 1e-9, 4)"


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sday(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def sstamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


# --- offers: price headers from events ------------------------------------------------------------

def offers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    return load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("DUID"), F.col("event_type").alias("BIDTYPE"),
        F.trunc("ts", "week").alias("SETTLEMENTDATE"), F.col("ts").alias("OFFERDATE"),
        F.col("event_id").alias("VERSIONNO"),
        F.when(F.hour("ts") < 12, "DAILY").otherwise("REBID").alias("ENTRYTYPE"),
        F.col("value").alias("PRICEBAND1"), (F.col("value") + k).alias("PRICEBAND2"), (k * 2).alias("PRICEBAND3"),
    )


OFFERS = """offers AS (
    SELECT CAST(user_id AS VARCHAR) AS DUID, event_type AS BIDTYPE,
           CAST(date_trunc('week', ts) AS DATE) AS SETTLEMENTDATE, ts AS OFFERDATE, event_id AS VERSIONNO,
           CASE WHEN hour(ts) < 12 THEN 'DAILY' ELSE 'REBID' END AS ENTRYTYPE,
           value AS PRICEBAND1, value + k AS PRICEBAND2, k * 2 AS PRICEBAND3
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""


# --- units: the unit map from customers -----------------------------------------------------------

def units(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return load(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("DUID"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "BIDIRECTIONAL")
        .when(F.col("c_mktsegment") != "FURNITURE", "GENERATOR").alias("DISPATCHTYPE"),
        F.when(balance > 4000, True).when(balance > 0, False).alias("AUTOBIDDER"),
        F.col("c_name").alias("PARTICIPANT_NAME"),
    )


UNITS = """units AS (
    SELECT CAST(c_custkey AS VARCHAR) AS DUID,
           CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'BIDIRECTIONAL'
                WHEN c_mktsegment <> 'FURNITURE' THEN 'GENERATOR' END AS DISPATCHTYPE,
           CASE WHEN c_acctbal > 4000 THEN true WHEN c_acctbal > 0 THEN false END AS AUTOBIDDER,
           c_name AS PARTICIPANT_NAME
    FROM customer)"""

CATEGORY_SQL = """CASE WHEN coalesce(DISPATCHTYPE = 'BIDIRECTIONAL', false) AND coalesce(AUTOBIDDER, false)
         THEN 'Autobidder Battery'
         WHEN coalesce(DISPATCHTYPE = 'BIDIRECTIONAL', false) THEN 'Non-Autobidder Battery'
         ELSE 'Non-Battery' END"""


# --- detail: quantity rows from line items --------------------------------------------------------

def detail(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        *more,
        F.col("l_suppkey").cast("string").alias("DUID"), F.col("l_returnflag").alias("BIDTYPE"),
        F.col("l_linestatus").alias("DIRECTION"), F.trunc("l_shipdate", "year").alias("SETTLEMENTDATE"),
        F.col("l_shipdate").alias("OFFERDATE"), F.col("l_linenumber").alias("PERIODID"),
        F.col("l_orderkey").alias("L_ORDER"), F.col("l_partkey").alias("L_PART"),
        (F.floor(F.col("l_quantity") / 25) * 25.0).alias("BANDAVAIL1"),
        F.floor(F.col("l_discount") * 20).cast("double").alias("BANDAVAIL2"),
        F.when(F.col("l_tax") <= 0.04, 1.0).alias("BANDAVAIL3"),
    )


DETAIL = """detail AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS DUID, l_returnflag AS BIDTYPE, l_linestatus AS DIRECTION,
           CAST(date_trunc('year', l_shipdate) AS DATE) AS SETTLEMENTDATE, l_shipdate AS OFFERDATE,
           l_linenumber AS PERIODID, l_orderkey AS L_ORDER, l_partkey AS L_PART,
           floor(l_quantity / 25) * 25.0 AS BANDAVAIL1, CAST(floor(l_discount * 20) AS DOUBLE) AS BANDAVAIL2,
           CASE WHEN l_tax <= 0.04 THEN CAST(1 AS DOUBLE) END AS BANDAVAIL3
    FROM lineitem)"""


# --- header × detail: orders with their line items ------------------------------------------------

def headers(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("OFFER_ID"), F.col("o_custkey").cast("string").alias("DUID"),
        F.col("o_orderpriority").alias("BIDTYPE"), F.col("o_orderdate").alias("OFFERDATE"),
        (price * 0.001).alias("PRICEBAND1"), (price * 0.002).alias("PRICEBAND2"), (price * 0.003).alias("PRICEBAND3"),
    )


def header_detail(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("OFFER_ID"), F.col("l_linenumber").alias("PERIODID"),
        F.col("l_partkey").alias("L_PART"), F.col("l_suppkey").alias("L_SUPP"), F.col("l_shipdate").alias("SHIPPED"),
        F.col("l_quantity").alias("BANDAVAIL1"), (F.col("l_discount") * 100).alias("BANDAVAIL2"),
        (F.col("l_tax") * 100).alias("BANDAVAIL3"),
    )


PANEL = """headers AS (
    SELECT o_orderkey AS OFFER_ID, CAST(o_custkey AS VARCHAR) AS DUID, o_orderpriority AS BIDTYPE,
           o_orderdate AS OFFERDATE, o_totalprice * 0.001 AS PRICEBAND1, o_totalprice * 0.002 AS PRICEBAND2,
           o_totalprice * 0.003 AS PRICEBAND3
    FROM orders),
header_detail AS (
    SELECT l_orderkey AS OFFER_ID, l_linenumber AS PERIODID, l_partkey AS L_PART, l_suppkey AS L_SUPP,
           l_shipdate AS SHIPPED, l_quantity AS BANDAVAIL1, l_discount * 100 AS BANDAVAIL2, l_tax * 100 AS BANDAVAIL3
    FROM lineitem),
panel AS (SELECT * FROM header_detail JOIN headers USING (OFFER_ID))"""


# --- header and detail with the archive's five keys, from line items ------------------------------

FIVE = ["DUID", "BIDTYPE", "DIRECTION", "SETTLEMENTDATE", "OFFERDATE"]


def sided_prices(spark: SparkSession, sf: str) -> DataFrame:
    """One price row per unit, service, side, day and time; the side is the line's status. Lines of one order and number
    share the least price among them, as if lines were joined with themselves."""
    line = ["L_ORDER", "PERIODID"]
    priced = detail(spark, sf, F.col("l_extendedprice").alias("x")).dropna(subset=line)
    least = priced.withColumn("x", F.min("x").over(Window.partitionBy(*line)))
    return least.groupBy(*FIVE).agg(*[(F.min("x") * k).alias(f"PRICEBAND{k}") for k in (1, 2, 3)])


def sided_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Detail whose side depends on the discount, so that many rows have no price and some keys exist on both sides."""
    side = F.when(F.col("BANDAVAIL2") > 0, F.lit("F")).otherwise(F.lit("O"))
    return detail(spark, sf).withColumn("DIRECTION", side)


SIDED = f"""{DETAIL},
sided_prices AS (
    SELECT DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, OFFERDATE, min(l_extendedprice) AS PRICEBAND1,
           min(l_extendedprice) * 2 AS PRICEBAND2, min(l_extendedprice) * 3 AS PRICEBAND3
    FROM detail JOIN lineitem ON L_ORDER = l_orderkey AND PERIODID = l_linenumber GROUP BY ALL),
sided_detail AS (SELECT * REPLACE (CASE WHEN BANDAVAIL2 > 0 THEN 'F' ELSE 'O' END AS DIRECTION) FROM detail)"""


# --- market outcomes ------------------------------------------------------------------------------

def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    service = F.when(F.col("l_returnflag") == "A", "ENERGY").when(F.col("l_returnflag") == "R", "RAISEREG")
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("DUID"), F.col("l_shipdate").alias("SETTLEMENTDATE"),
        service.otherwise("LOWERREG").alias("BIDTYPE"), F.col("l_quantity").alias("MW"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("FLOW"),
        F.col("l_orderkey").alias("L_ORDER"), F.col("l_linenumber").alias("L_LINE"), F.col("l_partkey").alias("L_PART"),
    )


DISPATCH = """dispatch AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS DUID, l_shipdate AS SETTLEMENTDATE,
           CASE l_returnflag WHEN 'A' THEN 'ENERGY' WHEN 'R' THEN 'RAISEREG' ELSE 'LOWERREG' END AS BIDTYPE,
           l_quantity AS MW, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END AS FLOW,
           l_orderkey AS L_ORDER, l_linenumber AS L_LINE, l_partkey AS L_PART
    FROM lineitem)"""


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation").join(
        load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("r_name").alias("REGIONID"))


def unit_summary(spark: SparkSession, sf: str) -> DataFrame:
    supplier = load(spark, sf, "supplier")
    return supplier.join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("DUID"), "REGIONID"
    )


UNIT_SUMMARY = """unit_summary AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS DUID, r_name AS REGIONID
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PRICE_COLUMNS = ["RRP", "RAISEREGRRP", "LOWERREGRRP"]


def regional_prices(spark: SparkSession, sf: str) -> DataFrame:
    # Summed up per customer and day first, so that regions are joined to far fewer rows than there are orders.
    daily = load(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(
        F.sum("o_totalprice").alias("total"), F.count("*").alias("n"),
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"),
    )
    customer = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    placed = daily.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return placed.groupBy("REGIONID", F.col("o_orderdate").alias("SETTLEMENTDATE")).agg(
        (F.sum("total") / F.sum("n") / 1000).alias("RRP"), (F.min("low") / 1000).alias("RAISEREGRRP"),
        (F.max("high") / 1000).alias("LOWERREGRRP"),
    )


REGIONAL_PRICES = """regional_prices AS (
    SELECT r_name AS REGIONID, o_orderdate AS SETTLEMENTDATE, avg(o_totalprice) / 1000 AS RRP,
           min(o_totalprice) / 1000 AS RAISEREGRRP, max(o_totalprice) / 1000 AS LOWERREGRRP
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2),
prices_long AS (
    SELECT REGIONID, SETTLEMENTDATE, 'ENERGY' AS BIDTYPE, RRP AS PRICE FROM regional_prices
    UNION ALL SELECT REGIONID, SETTLEMENTDATE, 'RAISEREG', RAISEREGRRP FROM regional_prices
    UNION ALL SELECT REGIONID, SETTLEMENTDATE, 'LOWERREG', LOWERREGRRP FROM regional_prices)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Dispatch tracking: a morning event is an interval that points at the offer of its own time, any other at the
    offer its unit and service made before: of another time and period, or none at all."""
    mine = Window.partitionBy("DUID", "BIDTYPE").orderBy("OFFERDATE", "VERSIONNO")
    pointed = F.when(F.hour("OFFERDATE") < 12, F.col("OFFERDATE")).otherwise(F.lag("OFFERDATE").over(mine))
    return offers(spark, sf).withColumn("_at", pointed).select(
        F.col("OFFERDATE").alias("SETTLEMENTDATE"), "DUID", "BIDTYPE",
        F.trunc("_at", "week").alias("BIDSETTLEMENTDATE"), F.col("_at").alias("BIDOFFERDATE"),
    )


INTERVALS = """intervals AS (
    SELECT OFFERDATE AS interval, DUID, BIDTYPE, CASE WHEN hour(OFFERDATE) < 12 THEN OFFERDATE ELSE
           lag(OFFERDATE) OVER (PARTITION BY DUID, BIDTYPE ORDER BY OFFERDATE, VERSIONNO) END AS pointed
    FROM offers)"""


def dispatch_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The wide dispatch table, two runs in it."""
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("DUID"), F.col("l_shipdate").alias("SETTLEMENTDATE"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("RUNNO"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("INTERVENTION"),
        F.col("l_quantity").alias("TOTALCLEARED"), (F.col("l_discount") * 100).alias("RAISEREG"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("LOWERREG"), F.col("l_orderkey").alias("L_ORDER"),
        F.col("l_linenumber").alias("L_LINE"),
    )


LOAD_LONG = """one_run AS (SELECT * FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'),
load_long AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS DUID, l_shipdate AS SETTLEMENTDATE, l_orderkey AS L_ORDER, l_linenumber AS L_LINE,
           'ENERGY' AS BIDTYPE, l_quantity AS MW FROM one_run
    UNION ALL SELECT CAST(l_suppkey AS VARCHAR), l_shipdate, l_orderkey, l_linenumber, 'RAISEREG', l_discount * 100 FROM one_run
    UNION ALL SELECT CAST(l_suppkey AS VARCHAR), l_shipdate, l_orderkey, l_linenumber, 'LOWERREG', l_tax * 100 FROM one_run
    WHERE l_tax > 0)"""


# --- registers by period and version --------------------------------------------------------------

MARKET_STAMP = "yyyy/MM/dd HH:mm:ss"


def archived(df: DataFrame, table: str) -> DataFrame:
    """``df`` written out as archive files of ``table`` and read back by its declared types."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    times = {c: F.date_format(c, MARKET_STAMP) for c, kind in df.dtypes if kind.startswith(("timestamp", "date"))}
    write_archive(df.withColumns(times), table, df.columns, path)
    return read_archive(spark, path, table)


def unit_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Units that move to another region at a day of their own; every third is registered nowhere for 200 days between."""
    moved = F.date_add(F.lit("1995-06-01").cast("date"), (F.col("s_suppkey") % 2000).cast("int"))
    back = F.date_add(moved, F.when(F.col("s_suppkey") % 3 == 0, 200).otherwise(0))
    periods = F.array(
        F.struct(F.lit(None).cast("date").alias("START_DATE"), moved.alias("END_DATE"), F.col("s_nationkey").alias("n")),
        F.struct(back.alias("START_DATE"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("2999-12-31").cast("date")).alias("END_DATE"),
                 ((F.col("s_nationkey") + 7) % 25).alias("n")))
    return load(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("DUID"), F.explode(periods).alias("p")
    ).select("DUID", "p.START_DATE", "p.END_DATE", "p.n").join(nations(spark, sf), F.col("n") == F.col("n_nationkey")).select(
        "DUID", "START_DATE", "END_DATE", "REGIONID")


UNIT_PERIODS = """moves AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS DUID, s_nationkey AS n, DATE '1995-06-01' + CAST(s_suppkey % 2000 AS INTEGER) AS moved,
           CASE WHEN s_suppkey % 3 = 0 THEN 200 ELSE 0 END AS gap FROM supplier),
unit_periods AS (
    SELECT DUID, r_name AS REGIONID, since, till FROM (
        SELECT DUID, n, DATE '1900-01-01' AS since, moved AS till FROM moves
        UNION ALL SELECT DUID, (n + 7) % 25, moved + gap, DATE '2999-12-31' FROM moves)
    JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def storage_details(spark: SparkSession, sf: str) -> DataFrame:
    """Storage capacities, halved from a day of the unit's own by a second version; every ninth unit has none."""
    later = F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") % 900).cast("int"))
    size = F.when(F.col("s_suppkey") % 9 != 0, 4.0 + F.col("s_suppkey") % 13)
    versions = F.array(*[
        F.struct(since.alias("EFFECTIVEDATE"), F.lit(n).alias("VERSIONNO"), (size * share).alias("MAXSTORAGECAPACITY"))
        for since, n, share in ((F.lit("1990-01-01").cast("date"), 1, 1.0), (later, 1, 9.0), (later, 2, 0.5))])
    return load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("DUID"), F.explode(versions).alias("v")).select("v.*", "DUID")


STORAGE = """storage AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS DUID, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(4 + s_suppkey % 13 AS DOUBLE) END AS size,
           DATE '1997-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS later FROM supplier)"""


def constraint_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions a constraint: a first one, and two of one later date."""
    later = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 1500).cast("int"))
    versions = F.array(*[
        F.struct(since.alias("EFFECTIVEDATE"), F.lit(n).alias("VERSIONNO"))
        for since, n in ((F.lit("1990-01-01").cast("date"), 1), (later, 1), (later, 2))])
    return load(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("GENCONID"), F.explode(versions).alias("v"), F.col("p_type").alias("CONSTRAINTTYPE"),
        "p_size").select("v.*", "GENCONID", "CONSTRAINTTYPE", "p_size")


def constraint_points(spark: SparkSession, sf: str) -> DataFrame:
    """Units on the left-hand side: every one in first versions, half of them in the last."""
    pairs = load(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    versions = constraint_versions(spark, sf).select("EFFECTIVEDATE", "VERSIONNO", "GENCONID")
    return versions.join(pairs, F.col("GENCONID") == F.col("l_partkey").cast("string")).where("VERSIONNO = 1 OR l_suppkey % 2 = 0").select(
        F.col("l_suppkey").cast("string").alias("CONNECTIONPOINTID"), "EFFECTIVEDATE", "VERSIONNO", "GENCONID",
        (F.col("q") * F.col("VERSIONNO")).alias("FACTOR"))


def constraint_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Each constraint is in the set of its size, and every seventh in a common one too."""
    part = load(spark, sf, "part")
    own = part.select(F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string")).alias("GENCONSETID"), F.col("p_partkey").cast("string").alias("GENCONID"))
    return own.unionByName(part.where("p_partkey % 7 = 0").select(F.lit("ALL").alias("GENCONSETID"), F.col("p_partkey").cast("string").alias("GENCONID")))


def set_invocations(spark: SparkSession, sf: str) -> DataFrame:
    """When sets were invoked: from each day with an order, for a time that its number gives; periods overlap and repeat."""
    days = load(spark, sf, "orders").where("o_orderkey % 40 = 0").select(
        F.when(F.col("o_orderkey") % 200 == 0, F.lit("ALL")).otherwise(F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string"))).alias("GENCONSETID"),
        F.to_date("o_orderdate").alias("STARTINTERVALDATETIME"), (F.col("o_custkey") % 45).cast("int").alias("n"))
    return days.select("GENCONSETID", "STARTINTERVALDATETIME", F.date_add("STARTINTERVALDATETIME", F.col("n")).alias("ENDINTERVALDATETIME"))


CONSTRAINT_VERSIONS = """results AS (
    SELECT l_partkey AS k, l_shipdate AS t, l_discount - 0.05 AS mv FROM lineitem WHERE l_discount - 0.05 > 0),
versions AS (
    SELECT k, since, version, type, p_size, CASE WHEN since < later THEN later ELSE DATE '2999-12-31' END AS till FROM (
        SELECT p_partkey AS k, p_type AS type, p_size, DATE '1996-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS later FROM part),
        LATERAL (SELECT DATE '1990-01-01' AS since, 1 AS version UNION ALL SELECT later, 2)),
points AS (
    SELECT l_partkey AS k, CAST(l_suppkey AS VARCHAR) AS point, sum(l_quantity) AS q, l_suppkey % 2 = 0 AS stays FROM lineitem GROUP BY ALL)"""

INVOKED = """invocations AS (
    SELECT CASE WHEN o_orderkey % 200 = 0 THEN 'ALL' ELSE 'S' || (o_custkey % 5) END AS s, CAST(o_orderdate AS DATE) AS a,
           CAST(o_orderdate AS DATE) + CAST(o_custkey % 45 AS INTEGER) AS b FROM orders WHERE o_orderkey % 40 = 0),
sets AS (SELECT 'S' || (p_size % 5) AS s, p_partkey AS k FROM part UNION ALL SELECT 'ALL', p_partkey FROM part WHERE p_partkey % 7 = 0),
active AS (SELECT DISTINCT k, CAST(unnest(generate_series(a, b - 1, INTERVAL 1 DAY)) AS DATE) AS d FROM invocations JOIN sets USING (s) WHERE b > a)"""


def demand_actual(spark: SparkSession, sf: str) -> DataFrame:
    return regional_prices(spark, sf).select(
        F.col("SETTLEMENTDATE").alias("INTERVAL_DATETIME"), "REGIONID", F.round("RRP", 6).alias("OPERATIONAL_DEMAND"))


def demand_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Vintages: every order is a forecast of its day, issued up to two days before or, some, after it."""
    lead = (F.col("o_orderkey") % 97 - 4) * 30
    placed = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.select(
        F.col("o_orderdate").alias("INTERVAL_DATETIME"), "REGIONID",
        (F.col("o_orderdate") - F.make_dt_interval(mins=lead)).alias("LOAD_DATE"),
        F.round(F.col("o_totalprice") / 1000, 6).alias("OPERATIONAL_DEMAND_POE50"))


DEMAND_FORECASTS = """actual AS (SELECT REGIONID, SETTLEMENTDATE AS t, round(RRP, 6) AS actual FROM regional_prices),
vintages AS (
    SELECT r_name AS REGIONID, o_orderdate AS t, o_orderdate - INTERVAL 1 MINUTE * ((o_orderkey % 97 - 4) * 30) AS issued,
           round(o_totalprice / 1000, 6) AS forecast
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def period_sql(ts: str, origin: int, convention: str = "end") -> str:
    shift = origin * 60 + (1 if convention == "end" else 0)
    second = f"(hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}))"
    return f"CAST(floor((({second} - {shift} + 86400) % 86400) / 300) + 1 AS INTEGER)"
