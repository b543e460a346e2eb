import random
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidstrata.operators import joins, outcomes, slicing
from bidstrata.operators import stats as s
from bidstrata.operators import versions as v
from bidstrata.schema import PRICE_BANDS, QUANTITY_BANDS
from tests.conftest import at, on, rows

KEYS = ["u", "p"]
ORDER = ["t", "n"]
SCHEMA = "u string, p int, t timestamp_ntz, n int, a double, b double"


def offers(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def walk(data, null_equal=True):
    """The flags by a plain loop: (is_first, is_true_rebid) per row id."""
    out = {}
    for key in {r[:2] for r in data}:
        prev = None
        for r in sorted((r for r in data if r[:2] == key), key=lambda r: (r[2] is not None, r[2], r[3])):
            bands = r[4:]
            if prev is None:
                changed = False
            elif null_equal:
                changed = bands != prev
            else:
                changed = any(x is None or y is None or x != y for x, y in zip(bands, prev))
            out[r[3]] = (prev is None, changed)
            prev = bands
    return out


def random_offers(n=300, seed=1, ties=True):
    """A group with a third of all rows, small groups around it, repeated times and missing bands."""
    rnd = random.Random(seed)
    base = at("2025-10-01T00:00:00")
    data = []
    for i in range(n):
        u = "hot" if rnd.random() < 0.4 else f"u{rnd.randrange(20)}"
        t = base + timedelta(seconds=rnd.randrange(60) if ties else i * 7)
        data.append((u, 1, t, i, rnd.choice([None, 1.0, 2.0]), float(rnd.randrange(2))))
    return data


def test_interleaved_periods_count_every_change(spark):
    data = [("x", p, at(f"2025-10-01T0{o}:00:00"), o * 10 + p, float(o), 0.0) for o in range(3) for p in range(4)]
    flagged = v.flag_true_rebids(offers(spark, data), KEYS, ORDER, ["a", "b"])
    assert rows(s.true_rebid_counts(flagged, KEYS)) == [("x", p, 2) for p in range(4)]


def test_resubmission_is_a_rebid_but_not_a_true_one(spark):
    data = [("x", 1, at(f"2025-10-01T0{o}:00:00"), o, 5.0, None) for o in range(3)]
    df = offers(spark, data)
    assert rows(s.rebid_counts(df, KEYS)) == [("x", 1, 3, 2)]
    assert rows(s.true_rebid_counts(v.flag_true_rebids(df, KEYS, ORDER, ["a", "b"]), KEYS)) == [("x", 1, 0)]


def test_two_directions_are_two_auctions(spark):
    data = [("x", d, at(f"2025-10-01T0{o}:00:00"), o * 2 + d, float(d), 0.0) for o in range(3) for d in range(2)]
    df = offers(spark, data)
    with_side = v.flag_true_rebids(df, KEYS, ORDER, ["a", "b"])
    assert with_side.where("is_true_rebid").count() == 0
    without = v.flag_true_rebids(df, ["u"], ORDER, ["a", "b"])
    assert without.where("is_true_rebid").count() == 5


@pytest.mark.parametrize("null_equal,expected", [(True, [0, 1]), (False, [1, 1])])
def test_missing_bands(spark, null_equal, expected):
    data = [("x", 1, at(f"2025-10-01T0{o}:00:00"), o, a, 0.0) for o, a in enumerate([None, None, 5.0])]
    flagged = v.flag_true_rebids(offers(spark, data), KEYS, ORDER, ["a", "b"], null_equal)
    assert [int(r.is_true_rebid) for r in flagged.orderBy("t").collect()[1:]] == expected


@pytest.mark.parametrize("null_equal", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_flags_match_a_plain_loop(spark, monkeypatch, null_equal, whole):
    monkeypatch.setattr(slicing, "SPLIT_ROWS", 10**6 if whole else 3)
    for seed in (1, 2):
        data = random_offers(seed=seed)
        random.Random(seed).shuffle(data)
        flagged = v.flag_true_rebids(offers(spark, data), KEYS, ORDER, ["a", "b"], null_equal)
        got = {r.n: (r.is_first, r.is_true_rebid) for r in flagged.collect()}
        assert got == walk(data, null_equal)


def test_slices_really_cut_the_big_group(spark, cut):
    sliced = slicing.slice_hot_groups(offers(spark, random_offers()), KEYS, ORDER)
    n = {r.u: r.n for r in sliced.groupBy("u").agg(F.count_distinct("_slice").alias("n")).collect()}
    assert n["hot"] > 20


def test_one_instant_is_cut_along_the_tiebreak(spark, cut):
    t0, t1 = at("2025-10-01T00:00:00"), at("2025-10-02T00:00:00")
    rnd = random.Random(8)
    data = [("hot", 1, t1 if i % 10 == 0 else t0, i, rnd.choice([1.0, 2.0]), 0.0) for i in range(200)]
    df = offers(spark, data)
    sliced = slicing.slice_hot_groups(df, KEYS, ORDER)
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 6
    got = {r.n: (r.is_first, r.is_true_rebid) for r in v.flag_true_rebids(df, KEYS, ORDER, ["a", "b"]).collect()}
    assert got == walk(data)


def test_crowded_times_are_cut_again(spark, cut):
    base = at("2025-10-01T00:00:00")
    data = [("hot", 1, base + timedelta(microseconds=i), i, float(i % 3), 0.0) for i in range(200)]
    data += [("hot", 1, base + timedelta(days=9000), 200, 0.0, 0.0)]
    df = offers(spark, data)
    sizes = slicing.slice_hot_groups(df, KEYS, ORDER).groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 6
    assert {r.n: r.version_index for r in v.version_index(df, KEYS, ORDER).collect()} == {i: i + 1 for i in range(201)}


def test_slices_with_missing_keys_and_times(spark, cut):
    data = [r if r[3] % 9 else (None, 1, r[2], *r[3:]) for r in random_offers(80)]
    data = [r if r[3] % 7 else (r[0], 1, None, *r[3:]) for r in data]
    got = {r.n: (r.is_first, r.is_true_rebid)
           for r in v.flag_true_rebids(offers(spark, data), KEYS, ORDER, ["a", "b"]).collect()}
    far_past = [(r[0], r[1], r[2] or at("1900-01-01T00:00:00"), *r[3:]) for r in data]
    assert got == walk(far_past)


@pytest.mark.parametrize("whole", [True, False])
def test_version_numbers(spark, monkeypatch, whole):
    monkeypatch.setattr(slicing, "SPLIT_ROWS", 10**6 if whole else 3)
    data = random_offers(200)
    want, seen = {}, {}
    for r in sorted(data, key=lambda r: (r[0], r[2], r[3])):
        seen[r[0]] = seen.get(r[0], 0) + 1
        want[r[3]] = seen[r[0]]
    numbered = v.version_index(offers(spark, data), KEYS, ORDER)
    assert {r.n: r.version_index for r in numbered.collect()} == want
    assert set(numbered.columns) == {"u", "p", "t", "n", "a", "b", "version_index"}


@pytest.mark.parametrize("whole", [True, False])
def test_running_sum_and_last_known(spark, monkeypatch, whole):
    monkeypatch.setattr(slicing, "SPLIT_ROWS", 10**6 if whole else 3)
    data = random_offers(200, seed=5)
    total, last, want = {}, {}, {}
    for r in sorted(data, key=lambda r: (r[0], r[2], r[3])):
        if r[4] is not None:
            total[r[0]] = total.get(r[0], 0) + r[4]
            last[r[0]] = r[4]
        want[r[3]] = (total.get(r[0]), last.get(r[0]))
    df = slicing.running_sums(offers(spark, data), KEYS, ORDER, {"total": F.col("a")})
    df = slicing.last_known(df, KEYS, ORDER, F.col("a"), "last")
    assert {r.n: (r.total, r.last) for r in df.collect()} == want


def test_keep_compares_with_the_row_before_even_if_that_was_dropped(spark):
    data = [("x", 1, at(f"2025-10-01T0{o}:00:00"), o, a, 0.0) for o, a in enumerate([1.0, 1.0, 2.0, 2.0, 1.0])]
    kept = v.keep_true_rebids(offers(spark, data), KEYS, ORDER, ["a", "b"])
    assert sorted(r.n for r in kept.collect()) == [0, 2, 4]
    assert kept.columns == ["u", "p", "t", "n", "a", "b"]


def test_lagged_bands(spark):
    data = [("x", 1, at(f"2025-10-01T0{o}:00:00"), o, float(o), None) for o in range(3)]
    lagged = v.lag_bands(offers(spark, data), KEYS, ORDER, ["a", "b"])
    assert rows(lagged, "n", "a_PREV", "is_first") == [(0, None, True), (1, 0.0, False), (2, 1.0, False)]


def test_initial_and_final_offers_take_the_first_of_tied_rows(spark):
    t0, t1 = at("2025-10-01T00:00:00"), at("2025-10-01T01:00:00")
    data = [("x", 1, t1, 4, 40.0, 0.0), ("x", 1, t0, 2, 20.0, 0.0), ("x", 1, t1, 3, 30.0, 0.0),
            ("x", 1, t0, 1, 10.0, 0.0), ("x", 1, None, 0, 99.0, 0.0), (None, 1, t0, 5, 7.0, 0.0)]
    df = offers(spark, data)
    assert rows(v.initial_offer(df, KEYS, ORDER, ["n", "a"])) == [("x", 1, 1, 10.0)]
    assert rows(v.final_offer(df, KEYS, ORDER, ["n", "a"])) == [("x", 1, 3, 30.0)]
    change = v.price_change(df, KEYS, ORDER, ["a"])
    assert rows(change) == [("x", 1, 10.0, 30.0, 20.0)]


def test_initial_offer_is_not_after_the_final_one(spark):
    df = offers(spark, random_offers())
    both = v.initial_offer(df, KEYS, ORDER, ["t"]).withColumnRenamed("t", "t0").join(
        v.final_offer(df, KEYS, ORDER, ["t"]), KEYS)
    assert both.where("t0 > t").count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_timeline_starts_at_the_first_daily_entry(spark, monkeypatch, whole):
    monkeypatch.setattr(slicing, "SPLIT_ROWS", 10**6 if whole else 2)
    entries = ["REBID", "Daily", "REBID", "DAILY", "REBID"]
    data = [("x", 1, at(f"2025-10-01T0{i}:00:00"), i, e) for i, e in enumerate(entries)]
    data += [("y", 1, at("2025-10-01T00:00:00"), 9, "REBID")]
    df = spark.createDataFrame(data, "u string, p int, t timestamp_ntz, n int, ENTRYTYPE string")
    assert rows(v.offer_timeline(df, KEYS, ORDER), "n", "version_index", "version_label") == [
        (0, 1, "before initial"), (1, 2, "initial"), (2, 3, "rebid 1"), (3, 4, "rebid 2"), (4, 5, "rebid 3"),
        (9, 1, "before initial")]


def largest_slice(df):
    return df.groupBy("_key", "_slice").count().agg(F.max("count")).first()[0]


def test_a_big_group_of_missing_keys_is_cut(spark):
    data = [(None, 1, *r[2:]) if r[3] % 2 else r for r in random_offers(300, ties=False)]
    sliced = slicing.slice_hot_groups(offers(spark, data), KEYS, ORDER, split_rows=20)
    assert sliced.where("u IS NULL").groupBy("_slice").count().count() > 10 and largest_slice(sliced) <= 20
    flagged = v.flag_true_rebids(offers(spark, data), KEYS, ORDER, ["a", "b"], split_rows=20)
    assert {r.n: (r.is_first, r.is_true_rebid) for r in flagged.collect()} == walk(data)


@pytest.mark.parametrize("tie", ["n", "text"])
def test_ten_thousand_ties(spark, tie):
    """All of one instant; the second order column, a number or a text, divides them."""
    df = spark.range(10_000).selectExpr(
        "'hot' AS u", "1 AS p", "timestamp_ntz'2025-10-01' AS t", "cast(id AS int) AS n", "cast(id % 7 AS double) AS a", "0D AS b",
        "concat(char(97 + cast(id / 400 AS int)), lpad(cast(id AS string), 6, '0')) AS text").repartition(4)
    sliced = slicing.slice_hot_groups(df, KEYS, ["t", tie], split_rows=1000)
    assert largest_slice(sliced) <= 1000
    numbered = v.version_index(df, KEYS, ["t", tie], split_rows=1000)
    assert numbered.where("version_index <> n + 1").count() == 0


def test_untimed_rows_are_cut_along_the_tiebreak(spark):
    data = [("hot", 1, None, i, float(i % 2), 0.0) for i in range(200)] + [("hot", 1, at("2025-10-01T00:00:00"), 200, 0.0, 0.0)]
    df = offers(spark, data)
    assert largest_slice(slicing.slice_hot_groups(df.where("t IS NULL"), KEYS, ORDER, split_rows=10)) <= 10
    got = v.version_index(df, KEYS, ORDER, split_rows=10)
    assert {r.n: r.version_index for r in got.collect()} == {i: i + 1 for i in range(201)}


def test_text_as_the_first_order_column(spark):
    data = [(f"k{i % 3}", f"{chr(97 + i % 26)}{i:03d}", i) for i in range(120)]
    df = spark.createDataFrame(data, "u string, x string, i int")
    got = {r.i: r.version_index for r in v.version_index(df, ["u"], ["x"], split_rows=5).collect()}
    want = {}
    for k in range(3):
        want |= {i: n for n, (_, _, i) in enumerate(sorted(r for r in data if r[0] == f"k{k}"), 1)}
    assert got == want


def test_default_orders_do_not_depend_on_the_input(spark):
    """Offers of one instant, default arguments: any order of the input gives the same rows."""
    bands = [*PRICE_BANDS, *QUANTITY_BANDS]
    rnd, t = random.Random(6), at("2025-09-30T12:00:00")
    data = [("A", "R", "GEN", on("2025-10-01"), p, t, None if rnd.random() < 0.3 else rnd.randrange(2), rnd.choice(["DAILY", "REBID"]),
             *[float(rnd.randrange(2)) for _ in bands]) for p in (1, 2) for _ in range(12)]
    schema = "DUID string, BIDTYPE string, DIRECTION string, SETTLEMENTDATE date, PERIODID int, OFFERDATE timestamp_ntz, VERSIONNO int, " \
             "ENTRYTYPE string, " + ", ".join(f"{x} double" for x in bands)
    jobs = {
        "lag": v.lag_bands, "flag": v.flag_true_rebids, "keep": v.keep_true_rebids, "initial": v.initial_offer, "final": v.final_offer,
        "change": v.price_change, "index": v.version_index, "timeline": v.offer_timeline, "number": v.number_true_rebids,
    }
    seen = {}
    for _ in range(2):
        rnd.shuffle(data)
        df = spark.createDataFrame(data, schema).coalesce(1)
        for name, job in jobs.items():
            seen.setdefault(name, []).append(rows(job(df)))
    assert [n for n, (a, b) in seen.items() if a != b] == []


@pytest.mark.parametrize("split_rows", [10**6, 4])
def test_kept_and_numbered_in_one_pass(spark, split_rows):
    data = random_offers(250, seed=9)
    df = offers(spark, data)
    two = v.version_index(v.keep_true_rebids(df, KEYS, ORDER, ["a", "b"]), KEYS, ORDER)
    one = v.number_true_rebids(df, KEYS, ORDER, ["a", "b"], split_rows=split_rows)
    assert {r.n: r.version_index for r in one.collect()} == {r.n: r.version_index for r in two.collect()}
    assert one.columns == two.columns


@pytest.fixture(scope="module")
def crowded(spark):
    """10,000 rows of one instant amid 10,000 others, all of one group."""
    return spark.range(20_000).selectExpr(
        "'hot' AS u", "1 AS p", "timestamp_ntz'2025-10-01' + make_dt_interval(0, 0, 0, if(id < 10000, 5000, id - 10000)) AS t",
        "cast((id * 7919) % 20000 AS int) AS n", "cast(floor(id / 3) % 5 AS double) AS a", "cast(id % 2 AS double) AS b",
        "if(id % 3 = 0, 'DAILY', 'REBID') AS ENTRYTYPE").repartition(4).cache()


def test_a_crowded_instant_is_cut_as_deep_as_the_rest(crowded):
    sliced = slicing.slice_hot_groups(crowded, KEYS, ORDER, split_rows=100)
    assert largest_slice(sliced) <= 200
    order = [r[0] for r in sliced.orderBy(*ORDER).select("_slice").collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("operator", [
    lambda df, n: v.lag_bands(df, KEYS, ORDER, ["a", "b"], split_rows=n),
    lambda df, n: v.flag_true_rebids(df, KEYS, ORDER, ["a", "b"], split_rows=n),
    lambda df, n: v.keep_true_rebids(df, KEYS, ORDER, ["a", "b"], split_rows=n),
    lambda df, n: v.number_true_rebids(df, KEYS, ORDER, ["a", "b"], split_rows=n),
    lambda df, n: v.version_index(df, KEYS, ORDER, split_rows=n),
    lambda df, n: v.offer_timeline(df, KEYS, ORDER, split_rows=n),
    lambda df, n: outcomes.cumulative_energy(df, KEYS, ORDER, "a", split_rows=n).withColumn("cumulative_mwh", F.round("cumulative_mwh", 6)),
    lambda df, n: joins.offer_in_force(
        df.where("n % 2 = 0").withColumnRenamed("t", "SETTLEMENTDATE"), df.where("n % 2 = 1").withColumnRenamed("t", "OFFERDATE"), KEYS, cols=["n", "a"], tiebreak="n", split_rows=n),
], ids=["lag", "flag", "keep", "number", "index", "timeline", "energy", "in_force"])
def test_slices_of_a_crowded_instant_equal_the_plain_window(crowded, operator):
    assert sorted(map(repr, operator(crowded, 100).collect())) == sorted(map(repr, operator(crowded, 10**6).collect()))


def test_groups_are_counted_by_hash_first(spark, monkeypatch, cut):
    df = spark.range(60).selectExpr("id % 7 % 3 AS k", "id AS t")
    plan = slicing.slice_hot_groups(df, ["k"], ["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan  # only groups whose hash has many rows are counted themselves
    plain = rows(df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t")).cast("bigint")))
    for hashes in (1, 2, 65_536):
        monkeypatch.setattr(slicing, "HASHES", hashes)
        assert rows(slicing.running_sums(df, ["k"], ["t"], {"n": F.lit(1)})) == plain
