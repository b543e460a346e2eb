"""One query per operator, each beside the SQL that must give the same rows.

``@query(sql)`` registers a function under its own name. Dates and times leave as text and fractions rounded,
so that both engines print the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidstrata.functions import checks, periods
from bidstrata.functions import units as u
from bidstrata.operators import bands as b
from bidstrata.operators import carry
from bidstrata.operators import joins as j
from bidstrata.operators import outcomes as o
from bidstrata.operators import slicing
from bidstrata.operators import stats as s
from bidstrata.operators import versions as v
from bidstrata.plans import reports
from bidstrata.schema import BATTERY_CATEGORIES, CATEGORIES
from bidstrata.schema import PRICE_BANDS as BANDS10
from bidstrata.schema import REGIONAL_PRICES as REGIONAL
from bidstrata.sources import archive, sinks
from bidstrata.sources import counted as cd
from workload import tables as t
from workload.archives import write_archive
from workload.tables import (
    CATEGORY_SQL, DAY_AUCTION, DETAIL, DETAIL_ORDER, DISPATCH, ENERGY, MWS3, OFFER_ORDER, OFFERS, PANEL, PRICES3,
    REGIONAL_PRICES, SERVICES, SIDE_AUCTION, UNIT_SUMMARY, UNITS, day, r4, s4, sday, sstamp, stamp,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CATEGORY = s.CATEGORY
SIDE_DETAIL = [*SIDE_AUCTION, "PERIODID"]


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


# --- shared SQL -----------------------------------------------------------------------------------

COUNTS = f"""{OFFERS}, {UNITS},
counts AS (
    SELECT DUID, BIDTYPE, SETTLEMENTDATE, count(*) AS num_bids, count(*) - 1 AS num_rebids
    FROM offers WHERE BIDTYPE <> '{ENERGY}' GROUP BY ALL),
counted AS (
    SELECT counts.*, {CATEGORY_SQL} AS bidder_category FROM counts LEFT JOIN units USING (DUID))"""

FLAGS = f"""{DETAIL},
lagged AS (
    SELECT *, row_number() OVER w AS rn, lag(BANDAVAIL1) OVER w AS p1, lag(BANDAVAIL2) OVER w AS p2,
           lag(BANDAVAIL3) OVER w AS p3
    FROM detail
    WINDOW w AS (PARTITION BY DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, PERIODID
                 ORDER BY OFFERDATE, L_ORDER, L_PART)),
flagged AS (
    SELECT *, rn = 1 AS is_first,
           rn > 1 AND (BANDAVAIL1 IS DISTINCT FROM p1 OR BANDAVAIL2 IS DISTINCT FROM p2
                       OR BANDAVAIL3 IS DISTINCT FROM p3) AS is_true_rebid
    FROM lagged)"""

TRUE_COUNTS = f"""{FLAGS}, {UNITS},
true_counts AS (
    SELECT DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, PERIODID,
           CAST(count(*) FILTER (is_true_rebid) AS BIGINT) AS num_true_rebids
    FROM flagged GROUP BY ALL),
true_counted AS (
    SELECT true_counts.*, {CATEGORY_SQL} AS bidder_category FROM true_counts LEFT JOIN units USING (DUID))"""

FLEET = f"""{OFFERS}, {UNITS},
fleet AS (
    SELECT offers.*, coalesce(AUTOBIDDER, false) AS is_autobidder FROM offers JOIN units USING (DUID)
    WHERE DISPATCHTYPE = 'BIDIRECTIONAL' AND BIDTYPE <> '{ENERGY}'),
daily AS (SELECT * FROM fleet WHERE ENTRYTYPE = 'DAILY')"""


def long_sql(source: str, ids: str, bands=tuple(PRICES3), suffix: str = "", value: str = "PRICE") -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{x}' AS PRICEBAND, {x}{suffix} AS {value} FROM {source}" for x in bands
    )


ENDS = f"""{OFFERS}, {UNITS},
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY DUID, BIDTYPE, SETTLEMENTDATE ORDER BY OFFERDATE, VERSIONNO) AS up,
           row_number() OVER (PARTITION BY DUID, BIDTYPE, SETTLEMENTDATE
                              ORDER BY OFFERDATE DESC, VERSIONNO) AS down
    FROM offers WHERE BIDTYPE <> '{ENERGY}'),
initial AS (
    SELECT numbered.*, {CATEGORY_SQL} AS bidder_category FROM numbered LEFT JOIN units USING (DUID) WHERE up = 1),
changes AS (
    SELECT i.DUID, i.BIDTYPE, i.SETTLEMENTDATE, i.bidder_category,
           {", ".join(f"i.{x} AS {x}, f.{x} AS {x}_FINAL, f.{x} - i.{x} AS {x}_CHANGE" for x in PRICES3)}
    FROM initial i JOIN (SELECT * FROM numbered WHERE down = 1) f USING (DUID, BIDTYPE, SETTLEMENTDATE))"""

STATS_SQL = ", ".join([
    "count(PRICE) AS n", f"{s4('avg(PRICE)')} AS mean", f"{s4('stddev_samp(PRICE)')} AS std",
    "min(PRICE) AS min", f"{s4('quantile_cont(PRICE, 0.25)')} AS q25", f"{s4('quantile_cont(PRICE, 0.5)')} AS median",
    f"{s4('quantile_cont(PRICE, 0.75)')} AS q75", "max(PRICE) AS max", "count(DISTINCT PRICE) AS n_distinct",
])


def summary_sql(col: str) -> str:
    return ", ".join([
        f"count({col}) AS n", f"{s4(f'avg({col})')} AS mean", f"{s4(f'median({col})')} AS median",
        f"{s4(f'stddev_samp({col})')} AS std", f"max({col}) AS max",
        f"{s4(f'avg(CASE WHEN {col} = 0 THEN 1.0 ELSE 0.0 END) * 100')} AS pct_zero",
    ])


def box_sql(source: str, by: str, col: str) -> str:
    return f"""box AS (
        SELECT {by}, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
               quantile_cont({col}, 0.75) AS q3 FROM {source} GROUP BY ALL),
    fenced AS (
        SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM box),
    placed AS (
        SELECT src.*, q1, median, q3, {col} BETWEEN lower_fence AND upper_fence AS inside
        FROM {source} src JOIN fenced USING ({by}))"""


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r4(c) for c in cols})


# --- frames several queries share -----------------------------------------------------------------

def counted(spark, sf):
    return reports.auction_counts(t.offers(spark, sf), t.units(spark, sf), DAY_AUCTION, ENERGY)


def flagged(spark, sf, null_equal=True):
    return v.flag_true_rebids(t.detail(spark, sf), SIDE_DETAIL, DETAIL_ORDER, MWS3, null_equal)


def true_counts(spark, sf):
    return reports.true_counts(t.detail(spark, sf), SIDE_DETAIL, DETAIL_ORDER, MWS3, ENERGY)


def unit_means(spark, sf):
    return j.with_units(s.unit_market_avg(true_counts(spark, sf)), t.units(spark, sf))


def ancillary_offers(spark, sf):
    return t.offers(spark, sf).where(F.col("BIDTYPE").isin(SERVICES))


def daily_offers(spark, sf):
    return ancillary_offers(spark, sf).where(F.col("ENTRYTYPE") == "DAILY")


def fleet_daily(spark, sf):
    return daily_offers(spark, sf).join(j.battery_fleet(t.units(spark, sf)), "DUID")


def initial_offers(spark, sf):
    first = v.initial_offer(
        u.ancillary_only(t.offers(spark, sf), ENERGY), DAY_AUCTION, OFFER_ORDER, ["OFFERDATE", *PRICES3])
    return j.with_units(first, t.units(spark, sf))


def offer_changes(spark, sf):
    return reports.price_change_report(
        t.offers(spark, sf), t.units(spark, sf), DAY_AUCTION, OFFER_ORDER, PRICES3, SERVICES, ENERGY)


def panel(spark, sf):
    return j.price_quantity_panel(t.headers(spark, sf), t.header_detail(spark, sf), ["OFFER_ID"])


# --- rebid counts ---------------------------------------------------------------------------------

@query(f"WITH {COUNTS} SELECT bidder_category, {summary_sql('num_rebids')} FROM counted GROUP BY 1")
def rebids_by_category(spark, sf):
    return rounded(s.summary_stats(counted(spark, sf), [CATEGORY], "num_rebids"), "mean", "median", "std", "pct_zero")


@query(f"""WITH {COUNTS} SELECT DUID, BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, num_bids, num_rebids
           FROM counts""")
def rebid_counts(spark, sf):
    offers = u.ancillary_only(t.offers(spark, sf), ENERGY)
    return s.rebid_counts(offers, DAY_AUCTION).withColumn("SETTLEMENTDATE", day("SETTLEMENTDATE"))


@query(f"""WITH {COUNTS} SELECT DUID, BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, PARTICIPANT_NAME,
                  {CATEGORY_SQL} AS bidder_category, num_rebids
           FROM counts LEFT JOIN units USING (DUID)""")
def bids_with_units(spark, sf):
    return counted(spark, sf).select(
        "DUID", "BIDTYPE", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), "PARTICIPANT_NAME", CATEGORY, "num_rebids")


@query(f"""WITH {OFFERS}, {UNITS} SELECT is_autobidder, BIDTYPE, count(*) AS n FROM (
             SELECT BIDTYPE, coalesce(AUTOBIDDER, false) AS is_autobidder FROM offers JOIN units USING (DUID)
             WHERE DISPATCHTYPE = 'BIDIRECTIONAL') GROUP BY ALL""")
def battery_bids(spark, sf):
    per_unit = t.offers(spark, sf).groupBy("DUID", "BIDTYPE").agg(F.count("*").alias("n"))
    joined = j.with_units(per_unit, t.units(spark, sf).where(u.is_battery()), "inner")
    return joined.groupBy(u.is_autobidder().alias("is_autobidder"), "BIDTYPE").agg(F.sum("n").alias("n"))


@query(f"WITH {UNITS} SELECT DUID, {CATEGORY_SQL} AS bidder_category, coalesce(AUTOBIDDER, false) AS is_autobidder, "
       "coalesce(DISPATCHTYPE = 'BIDIRECTIONAL', false) AS is_battery, "
       "CASE WHEN coalesce(AUTOBIDDER, false) THEN 'Autobidder' ELSE 'Non-Autobidder' END AS label FROM units")
def unit_categories(spark, sf):
    return t.units(spark, sf).select(
        "DUID", u.unit_category().alias("bidder_category"), u.is_autobidder().alias("is_autobidder"),
        u.is_battery().alias("is_battery"), u.autobidder_label(u.is_autobidder()).alias("label"))


@query(f"WITH {OFFERS} SELECT DUID, count(*) AS n FROM offers WHERE DUID NOT IN ('7', '11') GROUP BY 1")
def excluded_units(spark, sf):
    return u.exclude_units(t.offers(spark, sf), ["7", "11"]).groupBy("DUID").agg(F.count("*").alias("n"))


@query(f"WITH {OFFERS} SELECT BIDTYPE, ENTRYTYPE, count(*) AS n FROM offers WHERE BIDTYPE <> '{ENERGY}' GROUP BY ALL")
def ancillary_bids(spark, sf):
    return u.ancillary_only(t.offers(spark, sf), ENERGY).groupBy("BIDTYPE", "ENTRYTYPE").agg(F.count("*").alias("n"))


@query(f"""WITH {OFFERS} SELECT BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, count(*) AS n,
                  max(PRICEBAND1) AS top FROM offers
           WHERE ENTRYTYPE = 'DAILY' AND BIDTYPE IN ('click', 'signup', 'purchase') GROUP BY ALL""")
def filtered_bids(spark, sf):
    kept = t.offers(spark, sf).where(
        (F.col("ENTRYTYPE") == "DAILY") & F.col("BIDTYPE").isin("click", "signup", "purchase"))
    return kept.groupBy("BIDTYPE", day("SETTLEMENTDATE").alias("SETTLEMENTDATE")).agg(
        F.count("*").alias("n"), F.max("PRICEBAND1").alias("top"))


@query(f"""WITH {COUNTS} SELECT bidder_category, BIDTYPE, num_rebids, count(*) AS n FROM counted
           WHERE bidder_category IN ('Autobidder Battery', 'Non-Autobidder Battery') GROUP BY ALL""")
def battery_rebids(spark, sf):
    kept = counted(spark, sf).where(F.col(CATEGORY).isin(BATTERY_CATEGORIES))
    return kept.groupBy(CATEGORY, "BIDTYPE", "num_rebids").agg(F.count("*").alias("n"))


def _grid_sql(source: str, agg: str, services=tuple(SERVICES)) -> str:
    cells = ", ".join(
        f"{agg.replace('$', repr(c))} AS \"{c}\"" for c in CATEGORIES)
    wanted = " UNION ALL ".join(f"SELECT '{x}' AS BIDTYPE" for x in services)
    return f"SELECT g.BIDTYPE, {cells} FROM ({wanted}) g LEFT JOIN {source} c USING (BIDTYPE) GROUP BY g.BIDTYPE"


@query(f"WITH {COUNTS} " + _grid_sql("counted", s4("avg(num_rebids) FILTER (bidder_category = $)")))
def mean_rebid_grid(spark, sf):
    return s.dense_grid(
        counted(spark, sf), {"BIDTYPE": SERVICES}, CATEGORY, CATEGORIES, r4(F.avg("num_rebids")))


@query(f"WITH {COUNTS} " + _grid_sql(
    "counted", f"coalesce({s4('median(num_rebids) FILTER (bidder_category = $)')}, 0)", (*SERVICES, "reserve")))
def median_rebid_bars(spark, sf):
    return s.dense_grid(
        counted(spark, sf), {"BIDTYPE": [*SERVICES, "reserve"]}, CATEGORY, CATEGORIES,
        r4(F.percentile("num_rebids", 0.5)), fill=0.0)


@query(f"""WITH {COUNTS}, {box_sql('counted', 'bidder_category, BIDTYPE', 'num_rebids')}
    SELECT bidder_category, BIDTYPE, count(*) AS n, {s4('q1')} AS q1, {s4('median')} AS median, {s4('q3')} AS q3,
           {s4('least(min(num_rebids) FILTER (inside), q1)')} AS whisker_low,
           {s4('greatest(max(num_rebids) FILTER (inside), q3)')} AS whisker_high,
           count(*) FILTER (NOT inside) AS n_outliers
    FROM placed GROUP BY bidder_category, BIDTYPE, q1, median, q3""")
def rebid_boxes(spark, sf):
    return rounded(s.box_stats(counted(spark, sf), [CATEGORY, "BIDTYPE"], "num_rebids", "histogram"),
                   "q1", "median", "q3", "whisker_low", "whisker_high")


@query(f"""WITH {FLEET}, long AS ({long_sql('daily', 'BIDTYPE, is_autobidder')}),
    {box_sql('long', 'BIDTYPE, is_autobidder, PRICEBAND', 'PRICE')}
    SELECT BIDTYPE, is_autobidder, PRICEBAND, count(*) AS n, {s4('q1')} AS q1, {s4('median')} AS median, {s4('q3')} AS q3,
           {s4('least(min(PRICE) FILTER (inside), q1)')} AS whisker_low,
           {s4('greatest(max(PRICE) FILTER (inside), q3)')} AS whisker_high,
           count(*) FILTER (NOT inside) AS n_outliers
    FROM placed GROUP BY BIDTYPE, is_autobidder, PRICEBAND, q1, median, q3""")
def price_boxes(spark, sf):
    long = b.bands_long(fleet_daily(spark, sf), ["BIDTYPE", "is_autobidder"], PRICES3)
    return rounded(s.box_stats(long, ["BIDTYPE", "is_autobidder", "PRICEBAND"], "PRICE"),
                   "q1", "median", "q3", "whisker_low", "whisker_high")


@query(f"""WITH {FLEET}, long AS ({long_sql('daily', 'BIDTYPE, is_autobidder')}),
    {box_sql('long', 'BIDTYPE, is_autobidder, PRICEBAND', 'PRICE')}
    SELECT BIDTYPE, is_autobidder, PRICEBAND, {s4('PRICE')} AS PRICE, count(*) AS n FROM placed WHERE NOT inside
    GROUP BY BIDTYPE, is_autobidder, PRICEBAND, PRICE""")
def price_outliers(spark, sf):
    by = ["BIDTYPE", "is_autobidder", "PRICEBAND"]
    long = b.bands_long(fleet_daily(spark, sf), ["BIDTYPE", "is_autobidder"], PRICES3)
    return rounded(s.box_outliers(long, by, "PRICE"), "PRICE")


@query(f"""WITH {COUNTS}, tops AS (SELECT bidder_category, max(num_rebids) AS top FROM counted GROUP BY 1),
    bins AS (SELECT bidder_category, unnest(range(0, top + 1)) AS bin FROM tops)
    SELECT bins.bidder_category, bins.bin, count(counted.num_rebids) AS n
    FROM bins LEFT JOIN counted ON counted.bidder_category = bins.bidder_category AND counted.num_rebids = bins.bin
    GROUP BY ALL""")
def rebid_histogram(spark, sf):
    return s.int_histogram(counted(spark, sf), [CATEGORY], "num_rebids")


# --- versions -------------------------------------------------------------------------------------

ROW_KEYS = ["DUID", "BIDTYPE", "DIRECTION", "PERIODID", "L_ORDER", "L_PART"]
ROW_SQL = ", ".join(ROW_KEYS) + f", {sday('OFFERDATE')} AS OFFERDATE"


def detail_rows(df: DataFrame, *more) -> DataFrame:
    return df.select(*ROW_KEYS, day("OFFERDATE").alias("OFFERDATE"), *more)


@query(f"WITH {FLAGS} SELECT {ROW_SQL}, p1 AS BANDAVAIL1_PREV, p2 AS BANDAVAIL2_PREV, p3 AS BANDAVAIL3_PREV FROM flagged")
def lagged_bands(spark, sf):
    lagged = v.lag_bands(t.detail(spark, sf), SIDE_DETAIL, DETAIL_ORDER, MWS3)
    return detail_rows(lagged, *[f"{x}_PREV" for x in MWS3])


@query(f"WITH {FLAGS} SELECT {ROW_SQL}, is_first, is_true_rebid FROM flagged")
def true_rebid_flags(spark, sf):
    return detail_rows(flagged(spark, sf), "is_first", "is_true_rebid")


@query(f"""WITH {FLAGS} SELECT BIDTYPE, DIRECTION, CAST(count(*) FILTER (
        rn > 1 AND (coalesce(BANDAVAIL1 <> p1, true) OR coalesce(BANDAVAIL2 <> p2, true)
                    OR coalesce(BANDAVAIL3 <> p3, true))) AS BIGINT) AS n
    FROM flagged GROUP BY ALL""")
def true_rebids_null_unequal(spark, sf):
    return flagged(spark, sf, null_equal=False).groupBy("BIDTYPE", "DIRECTION").agg(
        F.count_if("is_true_rebid").alias("n"))


@query(f"WITH {FLAGS} SELECT {ROW_SQL}, is_first, is_true_rebid FROM flagged")
def true_rebid_flags_stepwise(spark, sf):
    """The same flags from three runs, each over some offers of every auction and what the runs before carried over."""
    keys, order = [*SIDE_AUCTION, "PERIODID"], t.DETAIL_ORDER
    nth = Window.partitionBy(*keys).orderBy(*order)
    steps = t.detail(spark, sf).withColumn("step", F.least(F.row_number().over(nth), F.lit(3)))
    path = t.scratch(spark)
    steps.write.partitionBy("step").parquet(path)
    held, out = None, None
    for step in (1, 2, 3):
        now = spark.read.parquet(path).where(F.col("step") == step).drop("step")
        if held is None:
            flagged = v.flag_true_rebids(now, keys, order, MWS3)
        else:
            flagged = carry.flag_true_rebids_after(now, held, keys, order, MWS3)
        made = carry.carry_of(now, keys, order, MWS3, before=held)
        kept = t.scratch(spark)
        made.write.parquet(kept)
        held = spark.read.parquet(kept)
        out = flagged if out is None else out.unionByName(flagged)
    return detail_rows(out, "is_first", "is_true_rebid")


@query(f"WITH {FLAGS} SELECT {ROW_SQL}, BANDAVAIL1, BANDAVAIL2, BANDAVAIL3 FROM flagged WHERE is_first OR is_true_rebid")
def kept_true_rebids(spark, sf):
    return detail_rows(v.keep_true_rebids(t.detail(spark, sf), SIDE_DETAIL, DETAIL_ORDER, MWS3), *MWS3)


@query(f"""WITH {ENDS} SELECT DUID, BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, {sstamp('OFFERDATE')} AS OFFERDATE,
        PRICEBAND1, {s4('PRICEBAND2')} AS PRICEBAND2, PRICEBAND3 FROM initial""")
def initial_offer(spark, sf):
    return initial_offers(spark, sf).select(
        "DUID", "BIDTYPE", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), stamp("OFFERDATE").alias("OFFERDATE"),
        "PRICEBAND1", r4("PRICEBAND2").alias("PRICEBAND2"), "PRICEBAND3")


@query(f"""WITH {ENDS} SELECT DUID, BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, {sstamp('OFFERDATE')} AS OFFERDATE,
        PRICEBAND1, PRICEBAND3 FROM numbered WHERE down = 1""")
def final_offer(spark, sf):
    last = v.final_offer(u.ancillary_only(t.offers(spark, sf), ENERGY), DAY_AUCTION, OFFER_ORDER,
                         ["OFFERDATE", "PRICEBAND1", "PRICEBAND3"])
    return last.withColumns({"SETTLEMENTDATE": day("SETTLEMENTDATE"), "OFFERDATE": stamp("OFFERDATE")})


@query(f"""WITH {ENDS} SELECT DUID, BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE,
        {", ".join(f"{s4(f'{x}{e}')} AS {x}{e}" for x in PRICES3 for e in ("", "_FINAL", "_CHANGE"))} FROM changes""")
def price_change(spark, sf):
    cols = [f"{x}{e}" for x in PRICES3 for e in ("", "_FINAL", "_CHANGE")]
    changed = v.price_change(u.ancillary_only(t.offers(spark, sf), ENERGY), DAY_AUCTION, OFFER_ORDER, PRICES3)
    return changed.select("DUID", "BIDTYPE", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"),
                          *[r4(c).alias(c) for c in cols])


@query(f"""WITH {OFFERS} SELECT DUID, BIDTYPE, VERSIONNO, row_number() OVER (
        PARTITION BY DUID, BIDTYPE, SETTLEMENTDATE ORDER BY OFFERDATE, VERSIONNO) AS version_index,
        'Rebid ' || row_number() OVER (PARTITION BY DUID, BIDTYPE, SETTLEMENTDATE ORDER BY OFFERDATE, VERSIONNO)
        || ' (' || strftime(OFFERDATE, '%H:%M') || ')' AS label, strftime(OFFERDATE, '%Y%m%d_%H%M') AS file_stamp
    FROM offers""")
def version_index(spark, sf):
    numbered = v.version_index(t.offers(spark, sf), DAY_AUCTION, OFFER_ORDER)
    label = F.concat(F.lit("Rebid "), F.col("version_index").cast("string"), F.lit(" ("),
                     periods.clock_label("OFFERDATE"), F.lit(")"))
    return numbered.select("DUID", "BIDTYPE", "VERSIONNO", "version_index", label.alias("label"),
                           periods.stamp_label("OFFERDATE").alias("file_stamp"))


@query(f"""WITH {OFFERS},
    numbered AS (SELECT *, row_number() OVER (
        PARTITION BY DUID, BIDTYPE, SETTLEMENTDATE ORDER BY OFFERDATE, VERSIONNO) AS version_index FROM offers),
    placed AS (SELECT *, version_index - min(version_index) FILTER (ENTRYTYPE = 'DAILY') OVER (
        PARTITION BY DUID, BIDTYPE, SETTLEMENTDATE) AS nth FROM numbered)
    SELECT DUID, BIDTYPE, VERSIONNO, version_index,
           CASE WHEN nth = 0 THEN 'initial' WHEN nth > 0 THEN 'rebid ' || nth ELSE 'before initial' END AS version_label
    FROM placed""")
def offer_timeline(spark, sf):
    return v.offer_timeline(t.offers(spark, sf), DAY_AUCTION, OFFER_ORDER).select(
        "DUID", "BIDTYPE", "VERSIONNO", "version_index", "version_label")


# --- true rebids ----------------------------------------------------------------------------------

@query(f"""WITH {TRUE_COUNTS} SELECT DUID, BIDTYPE, DIRECTION, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, PERIODID,
        num_true_rebids FROM true_counts""")
def true_rebid_counts(spark, sf):
    counts = s.true_rebid_counts(flagged(spark, sf), SIDE_DETAIL)
    return counts.withColumn("SETTLEMENTDATE", day("SETTLEMENTDATE"))


@query(f"WITH {TRUE_COUNTS} SELECT bidder_category, {summary_sql('num_true_rebids')} FROM true_counted GROUP BY 1")
def true_rebid_summary(spark, sf):
    counted = j.with_units(true_counts(spark, sf), t.units(spark, sf))
    return rounded(s.summary_stats(counted, [CATEGORY], "num_true_rebids"),
                   "mean", "median", "std", "pct_zero")


@query(f"""WITH {TRUE_COUNTS} SELECT bidder_category, BIDTYPE, DUID, {s4('avg(num_true_rebids)')} AS mean_rebids,
        {s4('median(num_true_rebids)')} AS median_rebids, {s4('stddev_samp(num_true_rebids)')} AS std_rebids,
        count(*) AS num_auctions FROM true_counted GROUP BY ALL""")
def unit_market_averages(spark, sf):
    cols = ["mean_rebids", "median_rebids", "std_rebids"]
    return rounded(unit_means(spark, sf).select(CATEGORY, "BIDTYPE", "DUID", *cols, "num_auctions"), *cols)


@query(f"""WITH {TRUE_COUNTS}, per_unit AS (
        SELECT bidder_category, BIDTYPE, DUID, avg(num_true_rebids) AS m FROM true_counted GROUP BY ALL)
    SELECT bidder_category, BIDTYPE, {s4('avg(m)')} AS avg_of_means, count(DISTINCT DUID) AS n_units
    FROM per_unit GROUP BY ALL""")
def average_of_unit_means(spark, sf):
    return rounded(s.avg_of_unit_means(unit_means(spark, sf)), "avg_of_means")


@query(f"""WITH {TRUE_COUNTS} SELECT DUID, count(*) AS n_periods,
        count(*) FILTER (num_true_rebids = 0) AS periods_without, count(*) FILTER (num_true_rebids >= 1) AS periods_with,
        {s4('avg(num_true_rebids)')} AS mean_rebids, max(num_true_rebids) AS max_rebids
    FROM true_counts GROUP BY 1""")
def period_rebids(spark, sf):
    counts = s.true_rebid_counts(flagged(spark, sf), SIDE_DETAIL)
    return rounded(s.period_rebid_summary(counts), "mean_rebids")


COMPARED = f"""{TRUE_COUNTS},
bid_counts AS (
    SELECT DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, count(*) - 1 AS num_rebids FROM detail GROUP BY ALL),
day_counts AS (
    SELECT DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, CAST(sum(num_true_rebids) AS BIGINT) AS num_true_rebids
    FROM true_counts GROUP BY ALL),
compared AS (
    SELECT *, coalesce(num_true_rebids / nullif(num_rebids, 0) * 100, 0) AS pct_true
    FROM bid_counts JOIN day_counts USING (DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE)),
per_period AS (
    SELECT *, coalesce(num_true_rebids / nullif(num_rebids, 0) * 100, 0) AS pct_true
    FROM bid_counts JOIN true_counts USING (DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE))"""


def compared(spark, sf, per_period):
    detail = t.detail(spark, sf)
    return reports.rebid_vs_true(
        detail, detail, t.units(spark, sf), SIDE_AUCTION, DETAIL_ORDER, MWS3, per_period, ENERGY)


@query(f"""WITH {COMPARED} SELECT DUID, BIDTYPE, DIRECTION, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, PERIODID,
        num_rebids, num_true_rebids, {s4('pct_true')} AS pct_true FROM per_period""")
def rebids_beside_true_rebids(spark, sf):
    return compared(spark, sf, True)["auctions"].select(
        *SIDE_AUCTION[:3], day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), "PERIODID", "num_rebids",
        "num_true_rebids", r4("pct_true").alias("pct_true"))


@query(f"""WITH {COMPARED} SELECT {CATEGORY_SQL} AS bidder_category, count(*) AS n_auctions,
        {s4('avg(pct_true)')} AS avg_pct_true
    FROM compared LEFT JOIN units USING (DUID) WHERE num_rebids > 0 GROUP BY 1""")
def true_rebid_share(spark, sf):
    return rounded(compared(spark, sf, False)["share"], "avg_pct_true")


# --- participation --------------------------------------------------------------------------------

ATTENDED = f"""{OFFERS}, {UNITS},
attended AS (
    SELECT DISTINCT DUID, BIDTYPE, SETTLEMENTDATE, {CATEGORY_SQL} AS bidder_category
    FROM offers LEFT JOIN units USING (DUID)),
per_service AS (SELECT bidder_category, BIDTYPE, count(*) AS auction_count FROM attended GROUP BY ALL)"""


def attended(spark, sf):
    return j.with_units(s.participations(t.offers(spark, sf)), t.units(spark, sf))


@query(f"WITH {ATTENDED} SELECT bidder_category, DUID, BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE FROM attended")
def participations(spark, sf):
    return attended(spark, sf).select(CATEGORY, "DUID", "BIDTYPE", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"))


SHARES = """shares AS (
    SELECT *, round_even(auction_count / sum(auction_count) OVER (PARTITION BY bidder_category) * 100, 2) AS pct
    FROM per_service)"""


@query(f"WITH {ATTENDED}, {SHARES} SELECT bidder_category, BIDTYPE, auction_count, pct AS participation_pct FROM shares")
def participation_share(spark, sf):
    return s.participation_share(attended(spark, sf))


@query(f"""WITH {ATTENDED}, days AS (
        SELECT bidder_category, count(*) AS n FROM (SELECT DISTINCT bidder_category, DUID, SETTLEMENTDATE FROM attended)
        GROUP BY 1)
    SELECT bidder_category, BIDTYPE, auction_count, round_even(auction_count / n * 100, 2) AS participation_pct
    FROM per_service JOIN days USING (bidder_category)""")
def participation_per_auction(spark, sf):
    return s.participation_share(attended(spark, sf), mode="auctions")


@query(f"WITH {ATTENDED}, {SHARES} SELECT bidder_category, " + ", ".join(
    f"coalesce(max(pct) FILTER (BIDTYPE = '{x}'), 0.0) AS {x}" for x in (*SERVICES, ENERGY, "reserve"))
       + " FROM shares GROUP BY 1")
def participation_table(spark, sf):
    return s.participation_table(s.participation_share(attended(spark, sf)), [*SERVICES, ENERGY, "reserve"])


@query(f"""WITH {COUNTS}, totals AS (SELECT DUID, CAST(sum(num_bids) AS BIGINT) AS unit_bids FROM counts GROUP BY 1),
    per AS (SELECT DUID, BIDTYPE, CAST(sum(num_bids) AS BIGINT) AS bids FROM counts GROUP BY ALL)
    SELECT DUID, BIDTYPE, bids, round_even(bids / unit_bids * 100, 2) AS share_pct FROM per JOIN totals USING (DUID)""")
def share_of_unit_bids(spark, sf):
    per = s.rebid_counts(u.ancillary_only(t.offers(spark, sf), ENERGY), ["DUID", "BIDTYPE"]).select(
        "DUID", "BIDTYPE", F.col("num_bids").alias("bids"))
    return j.share_within(per, ["DUID"], "bids")


@query(f"WITH {OFFERS} SELECT DISTINCT BIDTYPE FROM offers")
def service_list(spark, sf):
    return s.services(t.offers(spark, sf))


@query(f"""WITH {OFFERS} SELECT count(*) AS n_rows, count(DISTINCT DUID) AS "n_DUID",
        count(DISTINCT SETTLEMENTDATE) AS "n_SETTLEMENTDATE", count(DISTINCT OFFERDATE) AS "n_OFFERDATE",
        {sstamp('min(OFFERDATE)')} AS "min_OFFERDATE", {sstamp('max(OFFERDATE)')} AS "max_OFFERDATE" FROM offers""")
def offer_profile(spark, sf):
    prof = s.profile(t.offers(spark, sf), ["DUID", "SETTLEMENTDATE", "OFFERDATE"], ["OFFERDATE"])
    return prof.withColumns({c: stamp(c) for c in ("min_OFFERDATE", "max_OFFERDATE")})


# --- price distributions --------------------------------------------------------------------------

@query(f"WITH {FLEET}, long AS ({long_sql('daily', 'is_autobidder')}) "
       f"SELECT is_autobidder, PRICEBAND, {STATS_SQL} FROM long GROUP BY 1, 2")
def daily_band_stats(spark, sf):
    long = b.bands_long(fleet_daily(spark, sf), ["is_autobidder"], PRICES3)
    return rounded(s.band_stats(long, ["is_autobidder", "PRICEBAND"]), "mean", "std", "q25", "median", "q75")


@query(f"WITH {ENDS}, long AS ({long_sql('initial', 'bidder_category, BIDTYPE')}) "
       f"SELECT bidder_category, BIDTYPE, PRICEBAND, {STATS_SQL} FROM long GROUP BY 1, 2, 3")
def initial_price_stats(spark, sf):
    by = [CATEGORY, "BIDTYPE", "PRICEBAND"]
    long = b.bands_long(initial_offers(spark, sf), [CATEGORY, "BIDTYPE"], PRICES3)
    return rounded(s.band_stats(long, by), "mean", "std", "q25", "median", "q75")


@query(f"WITH {ENDS}, long AS ({long_sql('initial', 'DUID, BIDTYPE, SETTLEMENTDATE')}) SELECT DUID, BIDTYPE, "
       f"{sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, PRICEBAND, {s4('PRICE')} AS PRICE FROM long "
       "WHERE PRICEBAND IN ('PRICEBAND1', 'PRICEBAND2')")
def initial_prices_long(spark, sf):
    long = b.bands_long(initial_offers(spark, sf), DAY_AUCTION, PRICES3)
    return b.first_bands(long, 2).select(
        "DUID", "BIDTYPE", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), "PRICEBAND", r4("PRICE").alias("PRICE"))


@query(f"WITH {ENDS}, long AS ({long_sql('initial', 'bidder_category, BIDTYPE')}) SELECT bidder_category, BIDTYPE, "
       + ", ".join(f"{s4(f'avg(PRICE) FILTER (PRICEBAND = {x!r})')} AS {x}" for x in PRICES3)
       + " FROM long GROUP BY 1, 2")
def initial_price_grid(spark, sf):
    long = b.bands_long(initial_offers(spark, sf), [CATEGORY, "BIDTYPE"], PRICES3)
    grid = s.dense_grid(long, {CATEGORY: CATEGORIES, "BIDTYPE": SERVICES}, "PRICEBAND", PRICES3, F.avg("PRICE"))
    return rounded(grid, *PRICES3)


CHANGES_LONG = f"long AS ({long_sql('changes', 'DUID, BIDTYPE, bidder_category', suffix='_CHANGE', value='PRICE_CHANGE')})"


@query(f"WITH {ENDS}, {CHANGES_LONG} SELECT bidder_category, PRICEBAND, count(*) AS n, {s4('avg(PRICE_CHANGE)')} AS mean "
       "FROM long GROUP BY 1, 2")
def price_changes_long(spark, sf):
    long = offer_changes(spark, sf)["long"]
    return long.groupBy(CATEGORY, "PRICEBAND").agg(F.count("*").alias("n"), r4(F.avg("PRICE_CHANGE")).alias("mean"))


@query(f"WITH {ENDS}, {CHANGES_LONG} SELECT bidder_category, BIDTYPE, "
       + ", ".join(f"coalesce({s4(f'median(PRICE_CHANGE) FILTER (PRICEBAND = {x!r})')}, 0) AS {x}" for x in PRICES3)
       + " FROM long GROUP BY 1, 2")
def price_change_bars(spark, sf):
    return rounded(offer_changes(spark, sf)["median_bars"], *PRICES3)


VARIATION = f"""{FLEET}, long AS ({long_sql('daily', 'DUID, is_autobidder')}),
variation AS (
    SELECT is_autobidder, DUID, CAST(right(PRICEBAND, 1) AS INTEGER) AS band, count(*) AS n_offers,
           stddev_samp(PRICE) AS std, count(DISTINCT PRICE) AS n_distinct,
           CASE WHEN avg(PRICE) = 0 THEN 0.0 ELSE stddev_samp(PRICE) / avg(PRICE) END AS cv
    FROM long GROUP BY is_autobidder, DUID, PRICEBAND)"""


def variation(spark, sf):
    per_unit = s.unit_variation(daily_offers(spark, sf), ["DUID"], PRICES3)
    return per_unit.join(j.battery_fleet(t.units(spark, sf)), "DUID")


@query(f"""WITH {VARIATION} SELECT is_autobidder, DUID, band, n_offers, {s4('std')} AS std, n_distinct, {s4('cv')} AS cv
    FROM variation""")
def unit_variation(spark, sf):
    return rounded(variation(spark, sf), "std", "cv")


@query(f"""WITH {VARIATION} SELECT CASE WHEN is_autobidder THEN 'Autobidder' ELSE 'Non-Autobidder' END AS is_autobidder,
        {s4('avg(std)')} AS mean_std, {s4('avg(n_distinct)')} AS mean_distinct FROM variation GROUP BY 1""")
def group_variation(spark, sf):
    return rounded(s.labelled(s.group_variation(variation(spark, sf), ["is_autobidder"])), "mean_std", "mean_distinct")


@query(f"""WITH {VARIATION}, means AS (
        SELECT avg(std) FILTER (is_autobidder) AS a, avg(std) FILTER (NOT is_autobidder) AS o FROM variation)
    SELECT {s4('a')} AS autobidder_mean, {s4('o')} AS other_mean, {s4('a / nullif(o, 0)')} AS ratio,
           CASE WHEN a > o * 1.1 THEN 'SUPPORTED' WHEN a < o * 0.9 THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS verdict
    FROM means""")
def variation_verdict(spark, sf):
    return rounded(s.compare_groups(variation(spark, sf)), "autobidder_mean", "other_mean", "ratio")


COMBOS = f"""{FLEET}, long AS ({long_sql('fleet', 'DUID, BIDTYPE, is_autobidder')}),
per_band AS (
    SELECT is_autobidder, DUID, BIDTYPE, PRICEBAND, count(*) AS n, stddev_samp(PRICE) AS std,
           count(DISTINCT PRICE) AS d FROM long GROUP BY ALL),
combos AS (
    SELECT is_autobidder, DUID, BIDTYPE, max(n) AS n_offers, avg(std) AS avg_std_across_bands,
           CAST(sum(d) AS BIGINT) AS total_distinct_values,
           max(std) FILTER (PRICEBAND = 'PRICEBAND1') AS std_pb1, max(std) FILTER (PRICEBAND = 'PRICEBAND3') AS std_pb3,
           max(d) FILTER (PRICEBAND = 'PRICEBAND1') AS n_distinct_pb1,
           max(d) FILTER (PRICEBAND = 'PRICEBAND3') AS n_distinct_pb3
    FROM per_band GROUP BY ALL)"""


def combos(spark, sf):
    detail = s.unit_service_variation(ancillary_offers(spark, sf), bands=PRICES3, shown=(1, 3))
    return detail.join(j.battery_fleet(t.units(spark, sf)), "DUID")


@query(f"""WITH {COMBOS} SELECT is_autobidder, DUID, BIDTYPE, n_offers, {s4('avg_std_across_bands')} AS avg_std_across_bands,
        total_distinct_values, {s4('std_pb1')} AS std_pb1, {s4('std_pb3')} AS std_pb3, n_distinct_pb1, n_distinct_pb3
    FROM combos""")
def unit_service_variation(spark, sf):
    return rounded(combos(spark, sf), "avg_std_across_bands", "std_pb1", "std_pb3")


@query(f"""WITH {COMBOS} SELECT is_autobidder, count(DISTINCT DUID) AS n_units, count(*) AS n_unit_service_combos,
        {s4('avg(n_offers)')} AS avg_offers_per_combo, {s4('avg(avg_std_across_bands)')} AS avg_price_band_std,
        {s4('avg(total_distinct_values)')} AS avg_distinct_values_per_combo,
        {s4('median(avg_std_across_bands)')} AS median_price_band_std,
        {s4('median(total_distinct_values)')} AS median_distinct_values
    FROM combos GROUP BY 1""")
def variation_summary(spark, sf):
    return rounded(s.variation_summary(combos(spark, sf)), "avg_offers_per_combo", "avg_price_band_std",
                   "avg_distinct_values_per_combo", "median_price_band_std", "median_distinct_values")


@query(f"""WITH {FLEET}, per_unit AS (
        SELECT is_autobidder, ENTRYTYPE, DUID, BIDTYPE, count(*) AS n,
               count(DISTINCT (PRICEBAND1, PRICEBAND2, PRICEBAND3)) AS c, stddev_samp(PRICEBAND1) AS s1,
               stddev_samp(PRICEBAND3) AS s3
        FROM fleet GROUP BY ALL)
    SELECT is_autobidder, ENTRYTYPE, count(DISTINCT DUID) AS n_units, CAST(sum(n) AS BIGINT) AS total_entries,
           {s4('avg(n)')} AS avg_entries_per_unit_service, {s4('avg(c)')} AS avg_price_combos,
           {s4('avg(s1)')} AS avg_std_pb1, {s4('avg(s3)')} AS avg_std_pb3
    FROM per_unit GROUP BY ALL""")
def variation_by_entry_type(spark, sf):
    fleet = j.battery_fleet(t.units(spark, sf))
    out = s.variation_by_entry_type(ancillary_offers(spark, sf), fleet, bands=PRICES3, shown=(1, 3))
    return rounded(out, "avg_entries_per_unit_service", "avg_price_combos", "avg_std_pb1", "avg_std_pb3")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1) + 1e-9, 4) AS p10,
        round(quantile_cont(l_extendedprice, 0.5) + 1e-9, 4) AS p50,
        round(quantile_cont(l_extendedprice, 0.99) + 1e-9, 4) AS p99, count(DISTINCT l_extendedprice) AS n_distinct
    FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, sf):
    q = s.quantiles(t.load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
                    {"p10": 0.1, "p50": 0.5, "p99": 0.99}, n_distinct="n_distinct")
    return rounded(q, "p10", "p50", "p99")


COUNTED_RANGES = {"whole": ("1995-01-01", "2001-12-31"), "middle": ("1996-04-01", "1999-09-30"), "quarter": ("1998-01-01", "1998-03-31")}


def counted_prices(spark, sf):
    """Prices of line items by quarter, counted and written; a first, wrong version of one quarter is replaced."""
    path, days = t.scratch(spark), t.load(spark, sf, "lineitem").withColumn("SETTLEMENTDATE", F.trunc("l_shipdate", "quarter"))
    counts = cd.value_counts(days, ["l_returnflag"], "l_extendedprice")
    wrong = counts.where("market_day = '1998-01-01'").withColumn("n", F.col("n") * 7)
    cd.write_counts(counts.where("market_day <> '1998-01-01'").unionByName(wrong), path)
    cd.write_counts(counts.where("market_day = '1998-01-01'"), path)
    return path


COUNTED_SQL = " UNION ALL ".join(f"SELECT '{name}' AS days, * FROM lineitem WHERE l_shipdate BETWEEN '{a}' AND '{b}'" for name, (a, b) in COUNTED_RANGES.items())


@query(f"""WITH ranged AS ({COUNTED_SQL})
    SELECT days, l_returnflag, count(*) AS n, {s4('avg(l_extendedprice)')} AS mean, {s4('stddev_samp(l_extendedprice)')} AS std, min(l_extendedprice) AS min,
           {s4('quantile_cont(l_extendedprice, 0.25)')} AS q25, {s4('quantile_cont(l_extendedprice, 0.5)')} AS median,
           {s4('quantile_cont(l_extendedprice, 0.75)')} AS q75, max(l_extendedprice) AS max, count(DISTINCT l_extendedprice) AS n_distinct
    FROM ranged GROUP BY 1, 2""")
def stats_of_counted_days(spark, sf):
    path, out = counted_prices(spark, sf), None
    for name, (first, last) in COUNTED_RANGES.items():
        stats = s.band_stats(cd.counts_of_days(spark, path, first, last), ["l_returnflag"], "l_extendedprice", weight=cd.COUNT)
        stats = stats.select(F.lit(name).alias("days"), "*")
        out = stats if out is None else out.unionByName(stats)
    return rounded(out, "mean", "std", "q25", "median", "q75")


@query(f"""WITH ranged AS ({COUNTED_SQL}), {box_sql('ranged', 'days, l_returnflag', 'l_extendedprice')}
    SELECT days, l_returnflag, count(*) AS n, {s4('q1')} AS q1, {s4('median')} AS median, {s4('q3')} AS q3,
           {s4('least(min(l_extendedprice) FILTER (inside), q1)')} AS whisker_low,
           {s4('greatest(max(l_extendedprice) FILTER (inside), q3)')} AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers
    FROM placed GROUP BY days, l_returnflag, q1, median, q3""")
def boxes_of_counted_days(spark, sf):
    path, out = counted_prices(spark, sf), None
    for name, (first, last) in COUNTED_RANGES.items():
        boxes = s.box_stats(cd.counts_of_days(spark, path, first, last), ["l_returnflag"], "l_extendedprice", weight=cd.COUNT)
        boxes = boxes.select(F.lit(name).alias("days"), "*")
        out = boxes if out is None else out.unionByName(boxes)
    return rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


# --- panel and curves -----------------------------------------------------------------------------

PANEL_KEYS = "OFFER_ID, PERIODID, L_PART, L_SUPP, " + sday("SHIPPED") + " AS SHIPPED"


def panel_keys():
    return ["OFFER_ID", "PERIODID", "L_PART", "L_SUPP", day("SHIPPED").alias("SHIPPED")]


SIDED_KEYS = "DUID, BIDTYPE, DIRECTION, PERIODID, L_ORDER, L_PART, " + sstamp("OFFERDATE") + " AS OFFERDATE"


def sided_keys():
    return ["DUID", "BIDTYPE", "DIRECTION", "PERIODID", "L_ORDER", "L_PART", stamp("OFFERDATE").alias("OFFERDATE")]


@query(f"""WITH {t.SIDED} SELECT {SIDED_KEYS}, {", ".join(f"{s4(x)} AS {x}" for x in PRICES3 + MWS3)}
    FROM sided_detail JOIN sided_prices USING (DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, OFFERDATE)""")
def price_quantity_panel(spark, sf):
    joined = j.price_quantity_panel(t.sided_prices(spark, sf), t.sided_detail(spark, sf), t.FIVE)
    return joined.select(*sided_keys(), *[r4(x).alias(x) for x in PRICES3 + MWS3])


@query(f"""WITH {t.SIDED}, flagged AS (
        SELECT *, row_number() OVER w = 1 AS is_first, row_number() OVER w > 1 AND (
            BANDAVAIL1 IS DISTINCT FROM lag(BANDAVAIL1) OVER w OR BANDAVAIL2 IS DISTINCT FROM lag(BANDAVAIL2) OVER w
            OR BANDAVAIL3 IS DISTINCT FROM lag(BANDAVAIL3) OVER w) AS is_true_rebid
        FROM sided_detail WINDOW w AS (PARTITION BY DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, PERIODID ORDER BY OFFERDATE, L_ORDER, L_PART))
    SELECT {SIDED_KEYS}, is_first, is_true_rebid, {s4("PRICEBAND1")} AS PRICEBAND1
    FROM flagged JOIN sided_prices USING (DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, OFFERDATE)""")
def panel_in_place(spark, sf):
    """Changes flagged on the quantity side, then prices joined, both sides read from buckets of their auctions."""
    price, qty = bucketed_panel(spark, sf, archive.buckets_for(t.load(spark, sf, "lineitem"), least=8))
    panel = j.price_quantity_panel(price, flagged_in_place(qty), t.FIVE)
    return panel.select(*sided_keys(), "is_first", "is_true_rebid", r4("PRICEBAND1").alias("PRICEBAND1"))


def bucketed_panel(spark, sf, buckets):
    """Price and quantity side of the panel as bucketed tables."""
    out = []
    for df, order in ((t.sided_prices(spark, sf), ["OFFERDATE"]), (t.sided_detail(spark, sf), ["PERIODID", "OFFERDATE"])):
        path = t.scratch(spark)
        name = "bidstrata_" + path.rsplit("-", 1)[-1]
        archive.ingest_together(df, name, path, buckets, t.SIDE_AUCTION, order)
        out.append(spark.table(name))
    return out


def flagged_in_place(qty):
    return v.flag_true_rebids(qty, [*t.SIDE_AUCTION, "PERIODID"], t.DETAIL_ORDER, MWS3, split_rows=slicing.WHOLE)


@query(f"""WITH {t.SIDED}, {UNITS}, four AS (SELECT * EXCLUDE (DIRECTION) FROM sided_prices)
    SELECT {SIDED_KEYS}, {s4("PRICEBAND1")} AS PRICEBAND1, DISPATCHTYPE AS dispatch_type
    FROM sided_detail JOIN four USING (DUID, BIDTYPE, SETTLEMENTDATE, OFFERDATE) LEFT JOIN units USING (DUID)""")
def panel_with_dispatch_type(spark, sf):
    joined = j.price_quantity_panel(
        t.sided_prices(spark, sf).drop("DIRECTION"), t.sided_detail(spark, sf), [k for k in t.FIVE if k != "DIRECTION"],
        t.units(spark, sf))
    return joined.select(*sided_keys(), r4("PRICEBAND1").alias("PRICEBAND1"), "dispatch_type")


@query(f"""WITH {t.SIDED}, flagged AS (
        SELECT *, row_number() OVER w AS nth, lag(BANDAVAIL1) OVER w AS p1, lag(BANDAVAIL2) OVER w AS p2, lag(BANDAVAIL3) OVER w AS p3
        FROM sided_detail WINDOW w AS (PARTITION BY DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, PERIODID ORDER BY OFFERDATE, L_ORDER, L_PART)),
    kept AS (
        SELECT *, row_number() OVER (PARTITION BY DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, PERIODID ORDER BY OFFERDATE, L_ORDER, L_PART)
               AS version_index FROM flagged
        WHERE nth = 1 OR BANDAVAIL1 IS DISTINCT FROM p1 OR BANDAVAIL2 IS DISTINCT FROM p2 OR BANDAVAIL3 IS DISTINCT FROM p3),
    panel AS (SELECT * FROM kept JOIN sided_prices USING (DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, OFFERDATE)),
    steps AS (
        SELECT *, 0 AS step, 0.0 AS cum_mw, PRICEBAND1 AS price FROM panel
        UNION ALL SELECT *, 1, BANDAVAIL1, PRICEBAND2 FROM panel
        UNION ALL SELECT *, 2, BANDAVAIL1 + BANDAVAIL2, PRICEBAND3 FROM panel
        UNION ALL SELECT *, 3, BANDAVAIL1 + BANDAVAIL2 + BANDAVAIL3, PRICEBAND3 FROM panel)
    SELECT DUID, BIDTYPE, DIRECTION, {sday("SETTLEMENTDATE")} AS SETTLEMENTDATE, PERIODID, {sstamp("OFFERDATE")} AS OFFERDATE,
           version_index, step, {s4("cum_mw")} AS cum_mw, {s4("price")} AS price FROM steps""")
def bid_curve_job(spark, sf):
    curves = reports.bid_curves(
        t.sided_prices(spark, sf), t.sided_detail(spark, sf), t.FIVE[:4], ["OFFERDATE", "L_ORDER", "L_PART"], MWS3, 3)
    return curves.select(
        "DUID", "BIDTYPE", "DIRECTION", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), "PERIODID", stamp("OFFERDATE").alias("OFFERDATE"),
        F.col("version_index").cast("long").alias("version_index"), "step", r4("cum_mw").alias("cum_mw"), r4("price").alias("price"))


@query(f"""WITH {PANEL},
    steps AS (
        SELECT *, 0 AS step, 0.0 AS cum_mw, PRICEBAND1 AS price FROM panel
        UNION ALL SELECT *, 1, BANDAVAIL1, PRICEBAND2 FROM panel
        UNION ALL SELECT *, 2, BANDAVAIL1 + BANDAVAIL2, PRICEBAND3 FROM panel
        UNION ALL SELECT *, 3, BANDAVAIL1 + BANDAVAIL2 + BANDAVAIL3, PRICEBAND3 FROM panel)
    SELECT DUID, step, count(*) AS n, {s4('sum(cum_mw)')} AS mw, {s4('max(price)')} AS top_price
    FROM steps GROUP BY 1, 2""")
def bid_curves(spark, sf):
    curve = b.bid_curve(panel(spark, sf), ["DUID"], 3)
    return curve.groupBy("DUID", "step").agg(
        F.count("*").alias("n"), r4(F.sum("cum_mw")).alias("mw"), r4(F.max("price")).alias("top_price"))


WEIGHTED = f"""{PANEL}, weighted AS (
    SELECT *, BANDAVAIL1 + BANDAVAIL2 + BANDAVAIL3 AS offer_mw,
           (PRICEBAND1 * BANDAVAIL1 + PRICEBAND2 * BANDAVAIL2 + PRICEBAND3 * BANDAVAIL3)
           / nullif(BANDAVAIL1 + BANDAVAIL2 + BANDAVAIL3, 0) AS offer_price FROM panel)"""


def weighted(spark, sf):
    return b.weighted_offer_price(panel(spark, sf), PRICES3, MWS3)


@query(f"WITH {WEIGHTED} SELECT {PANEL_KEYS}, {s4('offer_mw')} AS offer_mw, {s4('offer_price')} AS offer_price FROM weighted")
def weighted_offer_price(spark, sf):
    return weighted(spark, sf).select(*panel_keys(), r4("offer_mw").alias("offer_mw"), r4("offer_price").alias("offer_price"))


OFFERED = f"""{OFFERS}, offered AS (
    SELECT *, PRICEBAND1 + PRICEBAND3 AS offer_mw,
           (PRICEBAND1 * PRICEBAND1 + PRICEBAND2 * PRICEBAND3) / nullif(PRICEBAND1 + PRICEBAND3, 0) AS offer_price
    FROM offers)"""
MEAN_PRICES = f"""{s4('avg(offer_price)')} AS mean_price,
    {s4('sum(offer_price * offer_mw) / nullif(sum(offer_mw) FILTER (offer_price IS NOT NULL), 0)')} AS weighted_price,
    count(offer_price) AS n_offers"""


def offered(spark, sf):
    """Events with two priced quantities each: they carry a time of day, which the panel's offers lack."""
    return b.weighted_offer_price(
        t.offers(spark, sf), ["PRICEBAND1", "PRICEBAND2"], ["PRICEBAND1", "PRICEBAND3"])


@query(f"WITH {OFFERED} SELECT BIDTYPE, strftime(OFFERDATE, '%Y-%m-%d %H:00:00') AS hour, {MEAN_PRICES} FROM offered GROUP BY 1, 2")
def hourly_offer_price(spark, sf):
    return rounded(s.hourly_offer_price(offered(spark, sf), "OFFERDATE"), "mean_price", "weighted_price")


@query(f"""WITH {OFFERED} SELECT BIDTYPE, CASE WHEN hour(OFFERDATE) BETWEEN 7 AND 21 THEN 'on-peak' ELSE 'off-peak' END
        AS "window", {MEAN_PRICES} FROM offered GROUP BY 1, 2""")
def peak_offer_price(spark, sf):
    return rounded(s.peak_offer_price(offered(spark, sf), "OFFERDATE", range(7, 22)), "mean_price", "weighted_price")


@query(f"""WITH {DETAIL} SELECT DUID, BIDTYPE, DIRECTION, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, PERIODID,
        count(DISTINCT OFFERDATE) AS n_versions FROM detail GROUP BY ALL""")
def rebid_frequency(spark, sf):
    tasks = archive.buckets_for(t.load(spark, sf, "lineitem"), least=8)
    freq = s.rebid_frequency(t.detail(spark, sf), SIDE_AUCTION, period="PERIODID", tasks=tasks)
    return freq.withColumn("SETTLEMENTDATE", day("SETTLEMENTDATE"))


# --- applied offers -------------------------------------------------------------------------------

@query(f"""WITH {OFFERS} SELECT VERSIONNO, {t.period_sql('OFFERDATE', 240)} AS market_period,
        {t.period_sql('OFFERDATE', 0)} AS ending_period, {t.period_sql('OFFERDATE', 0, 'start')} AS starting_period
    FROM offers""")
def period_ids(spark, sf):
    return t.offers(spark, sf).select(
        "VERSIONNO", periods.period_id("OFFERDATE", 240).alias("market_period"),
        periods.period_id("OFFERDATE").alias("ending_period"),
        periods.period_id("OFFERDATE", convention="start").alias("starting_period"))


@query(f"""WITH {OFFERS} SELECT convention, min(p) AS first_period, max(p) AS last_period, count(DISTINCT p) AS n_periods
    FROM (SELECT 'end' AS convention, {t.period_sql('OFFERDATE', 240)} AS p FROM offers
          UNION ALL SELECT 'start', {t.period_sql('OFFERDATE', 240, 'start')} FROM offers) GROUP BY 1""")
def period_convention_check(spark, sf):
    return periods.period_conventions(t.offers(spark, sf), "OFFERDATE", 240)


@query(f"""WITH {OFFERS}, {t.INTERVALS}, panel AS (SELECT *, {t.period_sql('OFFERDATE', 240)} AS PERIODID FROM offers)
    SELECT DUID, BIDTYPE, {sstamp('interval')} AS interval, PERIODID, VERSIONNO, PRICEBAND1
    FROM intervals JOIN panel USING (DUID, BIDTYPE)
    WHERE OFFERDATE = pointed AND SETTLEMENTDATE = CAST(date_trunc('week', pointed) AS DATE)
      AND PERIODID = {t.period_sql('interval', 240)}""")
def applied_offers(spark, sf):
    offers = t.offers(spark, sf).withColumn("PERIODID", periods.period_id("OFFERDATE", 240))
    applied = j.applied_offers(t.intervals(spark, sf), offers)
    return applied.select("DUID", "BIDTYPE", stamp("interval").alias("interval"), "PERIODID", "VERSIONNO", "PRICEBAND1")


@query(f"""WITH {OFFERS}, made AS (SELECT DUID, OFFERDATE AS offer_ts, PRICEBAND1 FROM offers WHERE BIDTYPE = '{ENERGY}'),
    wanted AS (SELECT DUID, VERSIONNO, OFFERDATE AS ts FROM offers WHERE BIDTYPE <> '{ENERGY}')
    SELECT wanted.DUID, VERSIONNO, {sstamp('offer_ts')} AS offer_ts, PRICEBAND1
    FROM wanted ASOF LEFT JOIN made ON wanted.DUID = made.DUID AND wanted.ts > made.offer_ts""")
def offer_in_force(spark, sf):
    offers = t.offers(spark, sf)
    wanted = u.ancillary_only(offers, ENERGY).select("DUID", "VERSIONNO", F.col("OFFERDATE").alias("SETTLEMENTDATE"))
    made = offers.where(F.col("BIDTYPE") == ENERGY).select("DUID", "OFFERDATE", "PRICEBAND1", "VERSIONNO")
    found = j.offer_in_force(wanted, made, ["DUID"], cols=["PRICEBAND1"], tiebreak="VERSIONNO")
    return found.select("DUID", "VERSIONNO", stamp("offer_ts").alias("offer_ts"), "PRICEBAND1")


# --- market outcomes ------------------------------------------------------------------------------

@query(f"WITH {DETAIL}, {UNIT_SUMMARY} SELECT REGIONID, BIDTYPE, count(*) AS n FROM detail "
       "LEFT JOIN unit_summary USING (DUID) GROUP BY 1, 2")
def bids_by_region(spark, sf):
    per_unit = t.detail(spark, sf).groupBy("DUID", "BIDTYPE").agg(F.count("*").alias("n"))
    placed = j.with_region(per_unit, t.unit_summary(spark, sf))
    return placed.groupBy("REGIONID", "BIDTYPE").agg(F.sum("n").alias("n"))


@query(f"WITH {REGIONAL_PRICES} SELECT REGIONID, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, BIDTYPE, "
       f"{s4('PRICE')} AS PRICE FROM prices_long")
def regional_prices_long(spark, sf):
    long = b.regional_prices_long(t.regional_prices(spark, sf), prices=t.PRICE_COLUMNS)
    return rounded(long.withColumn("SETTLEMENTDATE", day("SETTLEMENTDATE")), "PRICE")


def prices(spark, sf):
    return b.regional_prices_long(t.regional_prices(spark, sf), prices=t.PRICE_COLUMNS)


@query(f"""WITH {REGIONAL_PRICES} SELECT {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, BIDTYPE, count(*) AS n_regions,
        {s4('min(PRICE)')} AS min_price, {s4('max(PRICE)')} AS max_price, {s4('max(PRICE) - min(PRICE)')} AS separation
    FROM prices_long GROUP BY prices_long.SETTLEMENTDATE, BIDTYPE""")
def price_separation(spark, sf):
    spread = o.price_separation(prices(spark, sf)).withColumn("SETTLEMENTDATE", day("SETTLEMENTDATE"))
    return rounded(spread, "min_price", "max_price", "separation")


VALUED = f"""{REGIONAL_PRICES}, {DISPATCH}, {UNIT_SUMMARY}, valued AS (
    SELECT dispatch.*, REGIONID, PRICE, MW * PRICE * 5 / 60 AS value
    FROM dispatch JOIN unit_summary USING (DUID) JOIN prices_long USING (REGIONID, SETTLEMENTDATE, BIDTYPE))"""


@query(f"""WITH {VALUED} SELECT DUID, BIDTYPE, L_ORDER, L_LINE, L_PART, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, REGIONID,
        {s4('PRICE')} AS PRICE, {s4('value')} AS value FROM valued""")
def dispatch_value(spark, sf):
    valued = j.dispatch_value(t.dispatch(spark, sf), prices(spark, sf), t.unit_summary(spark, sf))
    return valued.select("DUID", "BIDTYPE", "L_ORDER", "L_LINE", "L_PART",
                         day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), "REGIONID",
                         r4("PRICE").alias("PRICE"), r4("value").alias("value"))


@query(f"""WITH {VALUED} SELECT DUID, BIDTYPE, {s4('sum(MW)')} AS total_mw, {s4('sum(value)')} AS revenue
    FROM valued WHERE BIDTYPE <> 'ENERGY' GROUP BY 1, 2""")
def fcas_revenue(spark, sf):
    return rounded(o.fcas_revenue(t.dispatch(spark, sf), prices(spark, sf), t.unit_summary(spark, sf)),
                   "total_mw", "revenue")


@query(f"""WITH {DISPATCH} SELECT DUID, L_ORDER, L_LINE, L_PART, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE,
        {s4('''sum(CASE WHEN FLOW < 0 THEN -FLOW * 0.85 ELSE -FLOW END * 5 / 60) OVER (
            PARTITION BY DUID ORDER BY SETTLEMENTDATE, L_ORDER, L_LINE, L_PART
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')} AS cumulative_mwh
    FROM dispatch""")
def cumulative_energy(spark, sf):
    order = ["SETTLEMENTDATE", "L_ORDER", "L_LINE", "L_PART"]
    stored = o.cumulative_energy(t.dispatch(spark, sf), ["DUID"], order, "FLOW", efficiency=0.85)
    return stored.select("DUID", "L_ORDER", "L_LINE", "L_PART", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"),
                         r4("cumulative_mwh").alias("cumulative_mwh"))


@query(f"""WITH RECURSIVE {DISPATCH}, {t.STORAGE}, steps AS (
        SELECT DUID, L_ORDER, L_LINE, L_PART, SETTLEMENTDATE, CASE WHEN SETTLEMENTDATE < later THEN size ELSE size * 0.5 END AS cap,
               CASE WHEN FLOW < 0 THEN -FLOW * CAST(0.85 AS DOUBLE) ELSE -FLOW END * (CAST(5 AS DOUBLE) / 60) AS taken,
               row_number() OVER (PARTITION BY DUID ORDER BY SETTLEMENTDATE, L_ORDER, L_LINE, L_PART) AS n
        FROM dispatch JOIN storage USING (DUID)),
    levels AS (
        SELECT DUID, n, least(coalesce(cap, 0), greatest(0, 1.5 + taken)) AS level FROM steps WHERE n = 1
        UNION ALL
        SELECT steps.DUID, steps.n, least(coalesce(cap, 0), greatest(0, level + taken))
        FROM levels JOIN steps ON steps.DUID = levels.DUID AND steps.n = levels.n + 1)
    SELECT DUID, L_ORDER, L_LINE, L_PART, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, {s4('CASE WHEN cap IS NOT NULL THEN level END')} AS charge_mwh
    FROM steps JOIN levels USING (DUID, n)""")
def state_of_charge(spark, sf):
    load = o.with_capacity(t.dispatch(spark, sf), t.archived(t.storage_details(spark, sf), "DUDETAIL"))
    level = o.state_of_charge(load, order=["SETTLEMENTDATE", "L_ORDER", "L_LINE", "L_PART"], mw="FLOW", efficiency=0.85, initial=1.5)
    return level.select("DUID", "L_ORDER", "L_LINE", "L_PART", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), r4("charge_mwh").alias("charge_mwh"))


CONSTRAINTS = """results AS (
    SELECT l_partkey AS CONSTRAINTID, l_shipdate AS SETTLEMENTDATE, l_discount - 0.05 AS MARGINALVALUE FROM lineitem),
definitions AS (SELECT p_partkey AS CONSTRAINTID, p_type AS CONSTRAINTTYPE FROM part),
lhs AS (SELECT l_partkey AS CONSTRAINTID, CAST(l_suppkey AS VARCHAR) AS DUID, sum(l_quantity) AS FACTOR
        FROM lineitem GROUP BY ALL)"""


def constraint_results(spark, sf):
    return t.load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("CONSTRAINTID"), F.col("l_shipdate").alias("SETTLEMENTDATE"),
        (F.col("l_discount") - 0.05).alias("MARGINALVALUE"))


@query(f"""WITH {CONSTRAINTS}, bound AS (
        SELECT CONSTRAINTID, count(*) AS binding_intervals, {s4('avg(MARGINALVALUE)')} AS mean_marginal_value,
               {s4('max(MARGINALVALUE)')} AS max_marginal_value FROM results WHERE MARGINALVALUE > 0 GROUP BY 1)
    SELECT CONSTRAINTID, CONSTRAINTTYPE, DUID, FACTOR, binding_intervals, mean_marginal_value, max_marginal_value
    FROM bound JOIN definitions USING (CONSTRAINTID) JOIN lhs USING (CONSTRAINTID)""")
def binding_constraints(spark, sf):
    definitions = t.load(spark, sf, "part").select(
        F.col("p_partkey").alias("CONSTRAINTID"), F.col("p_type").alias("CONSTRAINTTYPE"))
    lhs = t.load(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("CONSTRAINTID"), F.col("l_suppkey").cast("string").alias("DUID")
    ).agg(F.sum("l_quantity").alias("FACTOR"))
    found = j.binding_constraints(constraint_results(spark, sf), definitions, lhs)
    return rounded(found, "mean_marginal_value", "max_marginal_value")


@query(f"""WITH {CONSTRAINTS} SELECT CONSTRAINTID, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, {s4('MARGINALVALUE')}
        AS MARGINALVALUE FROM results WHERE MARGINALVALUE > 0""")
def binding_intervals(spark, sf):
    bound = checks.binding(constraint_results(spark, sf))
    return rounded(bound.withColumn("SETTLEMENTDATE", day("SETTLEMENTDATE")), "MARGINALVALUE")


@query(f"""WITH {DETAIL}, {t.UNIT_PERIODS}
    SELECT detail.DUID, BIDTYPE, REGIONID, count(*) AS n, {sday('min(OFFERDATE)')} AS first_day, {sday('max(OFFERDATE)')} AS last_day
    FROM detail LEFT JOIN unit_periods ON detail.DUID = unit_periods.DUID AND since <= OFFERDATE AND OFFERDATE < till
    GROUP BY detail.DUID, BIDTYPE, REGIONID""")
def bids_by_region_dated(spark, sf):
    units = t.archived(t.unit_periods(spark, sf), "DUDETAILSUMMARY")
    placed = j.with_region(t.detail(spark, sf), units, at="OFFERDATE")
    return placed.groupBy("DUID", "BIDTYPE", "REGIONID").agg(
        F.count("*").alias("n"), day(F.min("OFFERDATE")).alias("first_day"), day(F.max("OFFERDATE")).alias("last_day"))


@query(f"""WITH {REGIONAL_PRICES}, {t.UNIT_PERIODS}, {DISPATCH}
    SELECT dispatch.DUID, BIDTYPE, REGIONID, count(*) AS n, {s4('sum(MW)')} AS total_mw, {s4('sum(MW * PRICE * 5 / 60)')} AS revenue
    FROM dispatch JOIN unit_periods ON dispatch.DUID = unit_periods.DUID AND since <= SETTLEMENTDATE AND SETTLEMENTDATE < till
    JOIN prices_long USING (REGIONID, SETTLEMENTDATE, BIDTYPE) GROUP BY 1, 2, 3""")
def dispatch_value_dated(spark, sf):
    units = t.archived(t.unit_periods(spark, sf), "DUDETAILSUMMARY")
    value = j.dispatch_value(t.dispatch(spark, sf), prices(spark, sf), units, at="SETTLEMENTDATE")
    return value.groupBy("DUID", "BIDTYPE", "REGIONID").agg(
        F.count("*").alias("n"), r4(F.sum("MW")).alias("total_mw"), r4(F.sum("value")).alias("revenue"))


def _runs_sql(name: str, wish: str) -> str:
    return f"""SELECT '{name}' AS preference, DUID, count(*) AS n, sum(l_quantity) AS mw, count(DISTINCT day) AS intervals,
        CAST(sum(INTERVENTION) AS BIGINT) AS intervened FROM (
        SELECT *, rank() OVER (PARTITION BY DUID, day ORDER BY RUNNO DESC, {wish}) AS place FROM runs) WHERE place = 1 GROUP BY ALL"""


@query(f"""WITH runs AS (
        SELECT CAST(l_suppkey AS VARCHAR) AS DUID, date_trunc('month', l_shipdate) AS day, l_quantity,
               CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS RUNNO, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTERVENTION
        FROM lineitem)
    {_runs_sql('intervened', 'INTERVENTION DESC')} UNION ALL {_runs_sql('undisturbed', 'INTERVENTION')}""")
def counting_runs(spark, sf):
    runs = t.dispatch_wide(spark, sf).withColumn("SETTLEMENTDATE", F.trunc("SETTLEMENTDATE", "month"))
    runs = t.archived(runs.select("SETTLEMENTDATE", "RUNNO", "DUID", "INTERVENTION", "TOTALCLEARED"), "DISPATCHLOAD")
    found = [
        checks.counting_run(runs, ["DUID", "SETTLEMENTDATE"], wish).groupBy("DUID").agg(
            F.count("*").alias("n"), F.sum("TOTALCLEARED").alias("mw"), F.count_distinct("SETTLEMENTDATE").alias("intervals"),
            F.sum("INTERVENTION").alias("intervened")).select(F.lit(name).alias("preference"), "*")
        for name, wish in (("intervened", (1, 0)), ("undisturbed", (0, 1)))]
    return found[0].unionByName(found[1])


def constraint_archives(spark, sf):
    results = constraint_results(spark, sf).select("SETTLEMENTDATE", F.col("CONSTRAINTID").cast("string").alias("CONSTRAINTID"), "MARGINALVALUE")
    return (t.archived(results, "DISPATCHCONSTRAINT"), t.archived(t.constraint_versions(spark, sf).drop("p_size"), "GENCONDATA"),
            t.archived(t.constraint_points(spark, sf), "SPDCONNECTIONPOINTCONSTRAINT"))


VERSION_SUMS = f"""SELECT CAST(k AS VARCHAR) AS CONSTRAINTID, point AS CONNECTIONPOINTID, CAST(sum(n) AS BIGINT) AS binding_intervals,
        {s4('sum(total) / sum(n)')} AS mean_marginal_value, {s4('max(most)')} AS max_marginal_value, count(*) AS versions,
        max(version) * any_value(q) AS last_factor
    FROM bound JOIN points USING (k) WHERE version = 1 OR stays GROUP BY 1, 2"""


@query(f"""WITH {t.CONSTRAINT_VERSIONS}, bound AS (
        SELECT k, version, count(*) AS n, sum(mv) AS total, max(mv) AS most FROM results JOIN versions USING (k)
        WHERE since <= t AND t < till GROUP BY ALL) {VERSION_SUMS}""")
def constraint_versions(spark, sf):
    return rounded(j.constraint_units(*constraint_archives(spark, sf)), "mean_marginal_value", "max_marginal_value")


@query(f"""WITH {t.CONSTRAINT_VERSIONS}, {t.INVOKED}, bound AS (
        SELECT results.k, version, count(*) AS n, sum(mv) AS total, max(mv) AS most FROM results JOIN versions USING (k)
        JOIN active ON active.k = results.k AND d = CAST(t AS DATE) WHERE since <= t AND t < till GROUP BY ALL) {VERSION_SUMS}""")
def constraints_invoked(spark, sf):
    results, definitions, lhs = constraint_archives(spark, sf)
    invoked = j.invoked_versions(
        definitions, t.constraint_sets(spark, sf), t.archived(t.set_invocations(spark, sf), "GENCONSETINVOKE"))
    return rounded(j.constraint_units(results, definitions, lhs, invoked), "mean_marginal_value", "max_marginal_value")


LEADS = (0, 60, 720, 2400)


@query(f"""WITH {REGIONAL_PRICES}, {t.DEMAND_FORECASTS}, found AS (
        SELECT REGIONID, t, lead, actual, (SELECT max(struct_pack(issued, forecast)) FROM vintages v
            WHERE v.REGIONID = a.REGIONID AND v.t = a.t AND v.issued <= a.t - INTERVAL 1 MINUTE * lead) AS best
        FROM actual a, (SELECT unnest([{', '.join(map(str, LEADS))}]) AS lead))
    SELECT REGIONID, {sday('t')} AS interval, lead, {sstamp('best.issued')} AS issued, {s4('actual')} AS actual,
           {s4('best.forecast')} AS forecast, {s4('best.forecast - actual')} AS error, {s4('abs(best.forecast - actual)')} AS abs_error,
           round((best.forecast - actual) / nullif(actual, 0) * 100, 1) AS pct_error
    FROM found""")
def demand_error_by_vintage(spark, sf):
    errors = demand_errors(spark, sf).withColumnRenamed("INTERVAL_DATETIME", "interval")
    shown = errors.withColumns({"interval": day("interval"), "issued": stamp("issued"), "pct_error": F.round("pct_error", 1)})
    return rounded(shown, "actual", "forecast", "error", "abs_error")


def demand_errors(spark, sf):
    return j.forecast_error(
        t.archived(t.demand_actual(spark, sf), "DEMANDOPERATIONALACTUAL"),
        t.archived(t.demand_forecasts(spark, sf), "DEMANDOPERATIONALFORECAST"), LEADS, how="left")


@query(f"""WITH {REGIONAL_PRICES}, {t.DEMAND_FORECASTS}, found AS (
        SELECT REGIONID, t, lead, actual, (SELECT max(struct_pack(issued, forecast)) FROM vintages v
            WHERE v.REGIONID = a.REGIONID AND v.t = a.t AND v.issued <= a.t - INTERVAL 1 MINUTE * lead) AS best
        FROM actual a, (SELECT unnest([{', '.join(map(str, LEADS))}]) AS lead)),
    errors AS (SELECT *, best.forecast - actual AS e FROM found)
    SELECT REGIONID, lead, count(*) AS intervals, count(e) AS forecasts, {s4('avg(e)')} AS bias, {s4('avg(abs(e))')} AS mae,
           {s4('sqrt(avg(e * e))')} AS rmse, {s4('avg(abs(e / nullif(actual, 0) * 100))')} AS mape FROM errors GROUP BY 1, 2""")
def demand_error_by_lead(spark, sf):
    return rounded(j.error_by_lead(demand_errors(spark, sf)), "bias", "mae", "rmse", "mape")


@query(f"""WITH {UNIT_SUMMARY}, actual AS (
        SELECT r_name AS REGIONID, o_orderdate AS d, sum(o_totalprice) AS actual
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
    forecast AS (
        SELECT REGIONID, l_shipdate AS d, sum(l_extendedprice) AS forecast
        FROM lineitem JOIN unit_summary ON DUID = CAST(l_suppkey AS VARCHAR) GROUP BY 1, 2)
    SELECT REGIONID, {sday('d')} AS SETTLEMENTDATE, {s4('actual')} AS actual, {s4('forecast')} AS forecast,
           {s4('forecast - actual')} AS error, {s4('abs(forecast - actual)')} AS abs_error,
           {s4('(forecast - actual) / nullif(actual, 0) * 100')} AS pct_error
    FROM actual JOIN forecast USING (REGIONID, d)""")
def demand_error(spark, sf):
    daily = t.load(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.sum("o_totalprice").alias("total"))
    customer = t.load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    actual = (
        daily.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("REGIONID", F.col("o_orderdate").alias("SETTLEMENTDATE")).agg(F.sum("total").alias("DEMAND"))
    )
    shipped = t.load(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("DUID"), F.col("l_shipdate").alias("SETTLEMENTDATE")
    ).agg(F.sum("l_extendedprice").alias("total"))
    forecast = j.with_region(shipped, t.unit_summary(spark, sf)).groupBy("REGIONID", "SETTLEMENTDATE").agg(
        F.sum("total").alias("DEMAND"))
    error = j.demand_error(actual, forecast).withColumn("SETTLEMENTDATE", day("SETTLEMENTDATE"))
    return rounded(error, "actual", "forecast", "error", "abs_error", "pct_error")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sday('l_shipdate')} AS l_shipdate,
        {s4('''CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 0.0
                    WHEN l_quantity < 15 THEN l_tax * 100 * (l_quantity - 5) / 10
                    WHEN l_quantity <= 35 THEN l_tax * 100
                    ELSE l_tax * 100 * (45 - l_quantity) / 10 END''')} AS available
    FROM lineitem""")
def fcas_available(spark, sf):
    level = [F.lit(float(x)) for x in (5, 15, 35, 45)]
    available = checks.fcas_available(F.col("l_quantity"), *level, F.col("l_tax") * 100)
    return t.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("l_shipdate"),
        r4(available).alias("available"))


@query(f"WITH {OFFERS} SELECT VERSIONNO, PRICEBAND3, PRICEBAND1 FROM offers WHERE PRICEBAND3 > PRICEBAND1")
def band_order_violations(spark, sf):
    bad = checks.band_order_violations(t.offers(spark, sf), ["PRICEBAND3", "PRICEBAND1"])
    return bad.select("VERSIONNO", "PRICEBAND3", "PRICEBAND1")


@query("SELECT doc_id, coalesce(regexp_matches(text, '(?i)licen[sc]e|automated|algorithm'), false) AS mentions_automation "
       "FROM documents")
def automation_mentions(spark, sf):
    found = checks.mentions_automation(t.load(spark, sf, "documents"), "text", "(?i)licen[sc]e|automated|algorithm")
    return found.select("doc_id", "mentions_automation")


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS mw FROM lineitem "
       "WHERE l_linenumber = 1 AND l_linestatus = 'O' GROUP BY 1")
def actual_run(spark, sf):
    runs = t.load(spark, sf, "lineitem").select(
        "l_returnflag", "l_quantity", F.col("l_linenumber").alias("RUNNO"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("INTERVENTION"))
    return checks.actual_run(runs).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("mw"))


# --- projections, order and limits ----------------------------------------------------------------

@query("SELECT l_orderkey AS OFFER_ID, l_linenumber AS PERIODID, "
       f"{sday('l_shipdate')} AS SETTLEMENTDATE, {sstamp('l_shipdate')} AS OFFERDATE FROM lineitem")
def aligned_detail(spark, sf):
    raw = t.load(spark, sf, "lineitem").withColumnsRenamed(
        {"l_orderkey": "OFFER_ID", "l_linenumber": "PERIODID", "l_shipdate": "OFFERDATETIME"}
    ).withColumn("TRADINGDATE", F.to_date("OFFERDATETIME"))
    return j.align_detail(raw).select(
        "OFFER_ID", "PERIODID", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), stamp("OFFERDATE").alias("OFFERDATE"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, ': (.*)}', 1) AS DOUBLE) AS k, "
       "TRY_CAST(event_type AS DOUBLE) AS bad, replace(event_type, 'i', '') AS squeezed, "
       "substring(event_type, 1, 4) AS short, event_type || '_' || user_id AS auction_label FROM events")
def safe_casts_and_text(spark, sf):
    return t.load(spark, sf, "events").select(
        "event_id", F.regexp_extract("props", r": (.*)\}", 1).try_cast("double").alias("k"),
        F.col("event_type").try_cast("double").alias("bad"), F.regexp_replace("event_type", "i", "").alias("squeezed"),
        F.substring("event_type", 1, 4).alias("short"),
        F.concat_ws("_", "event_type", "user_id").alias("auction_label"))


@query(f"""WITH {OFFERS} SELECT VERSIONNO, {sstamp('OFFERDATE')} AS OFFERDATE, PRICEBAND1 FROM offers
    WHERE DUID = '7' AND BIDTYPE = 'click' ORDER BY offers.OFFERDATE, VERSIONNO LIMIT 10""")
def first_offers(spark, sf):
    found = reports.first_offers(t.offers(spark, sf), "7", "click", 10, entry=None)
    return found.select("VERSIONNO", stamp("OFFERDATE").alias("OFFERDATE"), "PRICEBAND1")


@query(f"WITH {DETAIL} SELECT DISTINCT {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, PERIODID FROM detail")
def distinct_periods(spark, sf):
    pairs = t.detail(spark, sf).select("SETTLEMENTDATE", "PERIODID").dropDuplicates()
    return pairs.withColumn("SETTLEMENTDATE", day("SETTLEMENTDATE"))


@query(f"""WITH {t.SIDED}, {UNITS} SELECT {SIDED_KEYS}, {s4("PRICEBAND1")} AS PRICEBAND1, DISPATCHTYPE AS dispatch_type
    FROM sided_detail JOIN sided_prices USING (DUID, BIDTYPE, DIRECTION, SETTLEMENTDATE, OFFERDATE) LEFT JOIN units USING (DUID)
    WHERE DUID = '7' AND BIDTYPE = 'R'
    ORDER BY sided_detail.SETTLEMENTDATE, PERIODID, sided_detail.OFFERDATE, DIRECTION, L_ORDER, L_PART LIMIT 20""")
def ordered_export(spark, sf):
    top = reports.price_quantity_export(
        t.sided_prices(spark, sf), t.sided_detail(spark, sf), t.units(spark, sf), "7", "R", 20, t.FIVE)
    return top.select(*sided_keys(), r4("PRICEBAND1").alias("PRICEBAND1"), "dispatch_type")


@query(f"WITH {OFFERS} SELECT BIDTYPE, ENTRYTYPE, count(*) AS n, avg(PRICEBAND3) AS mean3 FROM offers GROUP BY 1, 2")
def view_query(spark, sf):
    t.offers(spark, sf).createOrReplaceTempView("bidstrata_offers")
    return spark.sql(
        "SELECT BIDTYPE, ENTRYTYPE, count(*) AS n, avg(PRICEBAND3) AS mean3 FROM bidstrata_offers GROUP BY ALL")


# --- files ----------------------------------------------------------------------------------------

ARCHIVED = [("DUID", "string"), ("BIDTYPE", "string"), ("SETTLEMENTDATE", "date"), ("OFFERDATE", "timestamp_ntz"),
            ("VERSIONNO", "bigint"), ("ENTRYTYPE", "upper"), ("PRICEBAND1", "double"), ("NOTE", "string")]


def archived(spark, sf):
    """The offers as archive files, the day and time in the archive's notation and a note with commas."""
    offers = t.offers(spark, sf).select(
        "DUID", "BIDTYPE", F.date_format("SETTLEMENTDATE", "yyyy/MM/dd HH:mm:ss").alias("SETTLEMENTDATE"),
        F.date_format("OFFERDATE", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("OFFERDATE"), "VERSIONNO",
        F.lower("ENTRYTYPE").alias("ENTRYTYPE"),
        F.when(F.col("BIDTYPE") == "error", "n/a").otherwise(F.col("PRICEBAND1").cast("string")).alias("PRICEBAND1"),
        F.concat_ws(", ", "BIDTYPE", "ENTRYTYPE").alias("NOTE"))
    path = t.scratch(spark)
    write_archive(offers, "BIDDAYOFFER", [c for c, _ in ARCHIVED], path)
    return path


@query(f"""WITH {OFFERS} SELECT DUID, BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, {sstamp('OFFERDATE')} AS OFFERDATE,
        VERSIONNO, ENTRYTYPE, CASE WHEN BIDTYPE <> 'error' THEN PRICEBAND1 END AS PRICEBAND1,
        BIDTYPE || ', ' || ENTRYTYPE AS NOTE FROM offers""")
def archive_scan(spark, sf):
    rows = archive.read_archive(spark, archived(spark, sf), "BIDDAYOFFER", ARCHIVED)
    return rows.withColumns({"SETTLEMENTDATE": day("SETTLEMENTDATE"), "OFFERDATE": stamp("OFFERDATE")})


#: The second and third part of the archive: another order of columns, one more, one fewer.
LATER = ["BIDTYPE", "RUNNO", "DUID", "SETTLEMENTDATE", "OFFERDATE", "VERSIONNO", "ENTRYTYPE", "PRICEBAND1"]


@query(f"""WITH {OFFERS} SELECT DUID, BIDTYPE, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, {sstamp('OFFERDATE')} AS OFFERDATE,
        CAST(VERSIONNO AS INTEGER) AS VERSIONNO, ENTRYTYPE, PRICEBAND1, CASE WHEN BIDTYPE IN ('click', 'error') THEN PRICEBAND2 END AS PRICEBAND2
    FROM offers""")
def archive_parts(spark, sf):
    offers = t.offers(spark, sf).select(
        "DUID", "BIDTYPE", F.date_format("SETTLEMENTDATE", "yyyy/MM/dd HH:mm:ss").alias("SETTLEMENTDATE"),
        F.date_format("OFFERDATE", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("OFFERDATE"), "VERSIONNO",
        F.lower("ENTRYTYPE").alias("ENTRYTYPE"), "PRICEBAND1", "PRICEBAND2", F.lit(1).alias("RUNNO"))
    path = t.scratch(spark)
    shares = [F.col("BIDTYPE").isin("click", "error"), F.col("BIDTYPE") == "purchase", ~F.col("BIDTYPE").isin("click", "error", "purchase")]
    for n, (share, columns) in enumerate(zip(shares, ([*LATER[:1], "PRICEBAND2", *LATER[2:]], LATER, LATER)), 1):
        write_archive(offers.where(share), "BIDDAYOFFER", columns, f"{path}/PUBLIC_ARCHIVE#BIDDAYOFFER#FILE{n:02d}#202510.CSV")
    rows = archive.read_archive(spark, archive.parts(path, "BIDDAYOFFER"), "BIDDAYOFFER")
    return rows.withColumns({"SETTLEMENTDATE": day("SETTLEMENTDATE"), "OFFERDATE": stamp("OFFERDATE")})


@query(f"""WITH {DETAIL} SELECT DUID, {sday('SETTLEMENTDATE')} AS SETTLEMENTDATE, L_ORDER, PERIODID AS first_period,
        unnest(range(PERIODID, greatest(PERIODID, CAST(BANDAVAIL2 AS INTEGER)) + 1)) AS PERIODID FROM detail""")
def expanded_periods(spark, sf):
    path = t.scratch(spark)
    detail = t.detail(spark, sf).select(
        "DUID", "BIDTYPE", F.col("SETTLEMENTDATE").alias("TRADINGDATE"), F.col("OFFERDATE").alias("OFFERDATETIME"), "L_ORDER",
        "PERIODID", F.col("PERIODID").alias("first_period"), F.col("BANDAVAIL2").cast("int").alias("PERIODIDTO"))
    archive.ingest_detail(detail, path)
    return spark.read.parquet(path).select(
        "DUID", day("SETTLEMENTDATE").alias("SETTLEMENTDATE"), "L_ORDER", "first_period", F.col("PERIODID").cast("long").alias("PERIODID"))


@query(f"""WITH {t.LOAD_LONG} SELECT DUID, {sstamp('SETTLEMENTDATE')} AS SETTLEMENTDATE, L_ORDER, L_LINE, BIDTYPE, {s4('MW')} AS MW
    FROM load_long""")
def dispatch_load_long(spark, sf):
    one = checks.actual_run(t.dispatch_wide(spark, sf))
    long = b.dispatch_load_long(one, ["SETTLEMENTDATE", "DUID", "L_ORDER", "L_LINE"])
    return long.select("DUID", stamp("SETTLEMENTDATE").alias("SETTLEMENTDATE"), "L_ORDER", "L_LINE", "BIDTYPE", r4("MW").alias("MW"))


@query(f"""WITH {REGIONAL_PRICES}, {UNIT_SUMMARY}, {t.LOAD_LONG}
    SELECT DUID, BIDTYPE, {s4('sum(MW)')} AS total_mw, {s4('sum(MW * PRICE * 5 / 60)')} AS revenue
    FROM load_long JOIN unit_summary USING (DUID) JOIN prices_long USING (REGIONID, SETTLEMENTDATE, BIDTYPE)
    WHERE BIDTYPE <> 'ENERGY' GROUP BY 1, 2""")
def market_revenue_one_run(spark, sf):
    one = t.regional_prices(spark, sf).withColumns({"RUNNO": F.lit(1), "INTERVENTION": F.lit(0)})
    other = one.withColumns({"RUNNO": F.lit(2), "INTERVENTION": F.lit(1), **{c: F.col(c) * 2 for c in t.PRICE_COLUMNS}})
    prices = one.unionByName(other)
    prices = prices.withColumns({c: F.lit(None).cast("double") for c in REGIONAL if c not in prices.columns})
    made = reports.market_report(prices, t.dispatch_wide(spark, sf), t.unit_summary(spark, sf), t.offers(spark, sf).select(
        *[F.lit(0.0).alias(c) for c in BANDS10], F.lit("").alias("REBIDEXPLANATION")))
    return made["revenue"].select("DUID", "BIDTYPE", r4("total_mw").alias("total_mw"), r4("revenue").alias("revenue"))


@query("""SELECT 'PRICEBAND1' AS column_name, count(*) FILTER (event_type = 'error') AS rejected FROM events
    UNION ALL SELECT 'VERSIONNO', 0 UNION ALL SELECT 'SETTLEMENTDATE', 0 UNION ALL SELECT 'OFFERDATE', 0""")
def archive_rejects(spark, sf):
    return archive.rejected_cells(spark, archived(spark, sf), "BIDDAYOFFER", ARCHIVED)


@query("""SELECT reason, count(*) AS n, min(cells) AS least, max(cells) AS most, CAST(sum(k) AS BIGINT) AS numbers FROM (
        SELECT event_id AS k, CASE event_id % 11 WHEN 0 THEN 'surplus cells' WHEN 1 THEN 'missing cells' WHEN 2 THEN 'open quote'
            WHEN 3 THEN 'unknown type' ELSE 'good' END AS reason,
            CASE event_id % 11 WHEN 0 THEN 9 WHEN 1 THEN 6 WHEN 2 THEN NULL ELSE 7 END AS cells FROM events)
    GROUP BY ALL""")
def archive_quarantine(spark, sf):
    """Events as lines of an archive, four in eleven spoilt, counted by reason, the good ones from what is read as data."""
    path, kind = t.scratch(spark), F.col("event_id") % 11
    line = F.concat(
        F.when(kind == 3, "X").otherwise("D"), F.lit(",EVENTS,LOG,1,"), F.col("event_id").cast("string"), F.lit(','), F.when(kind == 2, '"').otherwise(""),
        F.col("event_type"), F.when(kind != 1, F.concat(F.lit(','), F.col("value").cast("string"))).otherwise(""), F.when(kind == 0, ',"a, b",').otherwise(""))
    lines = t.load(spark, sf, "events").select(line.alias("value"))
    head = spark.range(1).selectExpr("explode(array('C,EVENTS,LOG', 'I,EVENTS,LOG,1,EVENT,KIND,VALUE')) AS value")
    head.unionByName(lines).coalesce(1).write.text(path)
    good = archive.read_archive(spark, path, "LOG", [("EVENT", "bigint"), ("KIND", "string"), ("VALUE", "double")])
    bad = archive.quarantine(spark, path).select(
        "reason", "cells", F.split("line", ",")[4].cast("bigint").alias("k"))
    return bad.unionByName(good.select(F.lit("good").alias("reason"), F.lit(7).alias("cells"), F.col("EVENT").alias("k"))).groupBy("reason").agg(
        F.count("*").alias("n"), F.min("cells").alias("least"), F.max("cells").alias("most"), F.sum("k").alias("numbers"))


@query("SELECT count(*) AS data_rows, CAST(0 AS BIGINT) AS incomplete FROM events")
def archive_footers(spark, sf):
    return archive.check_footer(spark, archived(spark, sf)).agg(
        F.sum("data_rows").alias("data_rows"), F.count_if(~F.col("complete")).alias("incomplete"))


@query(f"WITH {UNITS} SELECT DUID, DISPATCHTYPE, AUTOBIDDER, PARTICIPANT_NAME FROM units")
def unit_map_scan(spark, sf):
    path = t.scratch(spark)
    t.units(spark, sf).withColumnRenamed("AUTOBIDDER", "FLAG").write.csv(path, header=True)
    return archive.read_unit_map(spark, path, {"FLAG": "AUTOBIDDER"})


@query(f"""WITH {OFFERS} SELECT {sday('SETTLEMENTDATE')} AS market_day, BIDTYPE, count(*) AS n, {s4('sum(PRICEBAND1)')} AS total
    FROM offers GROUP BY offers.SETTLEMENTDATE, BIDTYPE""")
def parquet_ingest(spark, sf):
    path = t.scratch(spark)
    archive.ingest(t.offers(spark, sf), path)
    days = spark.read.parquet(path).groupBy("market_day", "BIDTYPE").agg(
        F.count("*").alias("n"), r4(F.sum("PRICEBAND1")).alias("total"))
    return days.withColumn("market_day", day("market_day"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index, o_orderkey, o_totalprice FROM orders")
def indexed_result(spark, sf):
    path = t.scratch(spark)
    orders = t.load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    sinks.write_result(orders, path, ["o_totalprice", "o_orderkey"], index="row_index")
    return spark.read.schema("row_index bigint, o_orderkey bigint, o_totalprice double").csv(path, header=True)


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 10")
def table_preview(spark, sf):
    return archive.preview(t.load(spark, sf, "events").select("event_id", "event_type", "value").orderBy("event_id"), 10)
