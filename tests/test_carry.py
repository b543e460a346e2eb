"""Months one after another equal one run over all of them."""

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bidstrata.operators import carry
from bidstrata.operators import joins as j
from bidstrata.operators import versions as v
from bidstrata.operators.slicing import running_sums
from tests.conftest import at, rows

KEYS, ORDER, BANDS = ["u", "p"], ["t", "n"], ["a", "b"]


@pytest.fixture(scope="module")
def months(spark):
    """Three months of offers; some groups pause in one, one is hot, some keys and bands are null."""
    draw, out = random.Random(8), []
    for m in range(3):
        for k in range(200):
            u = draw.choice(["hot", "hot", "x", "y", None, f"only{m}"])
            out.append((u, draw.choice([1, None]), at("2025-01-01T00:00:00") + timedelta(days=40 * m, minutes=draw.randrange(3000)), 1000 * m + k,
                        draw.choice([None, 1.0, 2.0]), float(draw.randrange(2)), m))
    return spark.createDataFrame(out, "u string, p int, t timestamp_ntz, n int, a double, b double, m int").repartition(4).cache()


def stepwise(months, cols, step, sums=None):
    """Each month with the carry of those before it."""
    held, found = carry.carry_of(months.where("m < 0"), KEYS, ORDER, cols, sums), []
    for m in range(3):
        now = months.where(f"m = {m}")
        found += step(now, held).collect()
        held = carry.carry_of(now, KEYS, ORDER, cols, sums, held)
    return Counter(map(tuple, found)), held


@pytest.mark.parametrize("split", [10**6, 5])
@pytest.mark.parametrize("null_equal", [True, False])
def test_true_rebids(months, split, null_equal):
    got, held = stepwise(months, BANDS, lambda now, c: carry.flag_true_rebids_after(now, c, KEYS, ORDER, BANDS, null_equal, split))
    assert got == Counter(map(tuple, v.flag_true_rebids(months, KEYS, ORDER, BANDS, null_equal).select(*months.columns, "is_first", "is_true_rebid").collect()))
    assert rows(held) == rows(carry.carry_of(months, KEYS, ORDER, BANDS))


@pytest.mark.parametrize("split", [10**6, 5])
def test_running_sums(months, split):
    sums = {"total": F.col("b"), "nth": F.lit(1).cast("bigint")}
    got, _ = stepwise(months, [], lambda now, c: carry.running_sums_after(now, c, KEYS, ORDER, sums, split), sums)
    assert got == Counter(map(tuple, running_sums(months, KEYS, ORDER, sums).select(*months.columns, *sums).collect()))


def test_offers_in_force(months):
    made = months.where("n % 3 <> 0").withColumnRenamed("t", "OFFERDATE")
    asked = months.where("n % 3 = 0").select("u", "p", F.col("t").alias("SETTLEMENTDATE"), "m")
    options = {"keys": KEYS, "cols": ["n", "a"], "tiebreak": "n"}
    held, found = carry.carry_of(made.where("m < 0"), KEYS, ["OFFERDATE", "n"], ["a"]), []
    for m in range(3):
        now = made.where(f"m = {m}")
        found += carry.offer_in_force_after(asked.where(f"m = {m}"), now, held, **options).collect()
        held = carry.carry_of(now, KEYS, ["OFFERDATE", "n"], ["a"], before=held)
    assert Counter(map(tuple, found)) == Counter(map(tuple, j.offer_in_force(asked, made, **options).collect()))


def test_a_late_row_is_an_error(months):
    held = carry.carry_of(months.where("m = 1"), KEYS, ORDER, BANDS)
    with pytest.raises(Exception, match="comes before what is carried"):
        carry.flag_true_rebids_after(months.where("m = 0"), held, KEYS, ORDER, BANDS).collect()


def test_late_rows_are_found_without_a_join(months):
    held = carry.carry_of(months.where("m = 0"), KEYS, ORDER, BANDS)
    plan = carry.flag_true_rebids_after(months.where("m = 1"), held, KEYS, ORDER, BANDS)._jdf.queryExecution().optimizedPlan().toString()
    assert "_k0" not in plan  # the carried rows' keys beside those of new rows
    again = months.where("m = 0").limit(1).drop("m")
    with pytest.raises(Exception, match="comes before what is carried"):  # a new row at the very time of the carried one
        carry.flag_true_rebids_after(again, carry.carry_of(again, KEYS, ORDER, BANDS), KEYS, ORDER, BANDS).collect()


def test_a_month_reads_itself_and_the_carry_only(spark, months, tmp_path):
    for m in range(3):
        months.where(f"m = {m}").drop("m").write.parquet(str(tmp_path / f"month={m}"))
    first, second = (spark.read.parquet(str(tmp_path / f"month={m}")) for m in (0, 1))
    carry.carry_of(first, KEYS, ORDER, BANDS).write.parquet(str(tmp_path / "carry"))
    flagged = carry.flag_true_rebids_after(second, spark.read.parquet(str(tmp_path / "carry")), KEYS, ORDER, BANDS)
    assert flagged.count() == second.count()
    assert {f.split("/")[-2] for f in flagged.inputFiles()} == {"month=1", "carry"}
