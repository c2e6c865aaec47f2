import random

import pytest
from pyspark.sql import Window as W, functions as F

from itemweld.operators.ranking import quantiles, running_sums, with_percent_rank


@pytest.fixture
def values(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"g{i % 4}", rng.choice([None, 1.0, 2.0, round(rng.random(), 3)])) for i in range(3000)]
    rows.append((9999, "single", 1.0))
    return spark.createDataFrame(rows, "id int, g string, v double")


@pytest.mark.parametrize("descending", [False, True])
def test_percent_rank_equals_the_window(values, stages, descending):
    df = values.where("v IS NOT NULL") if descending else values
    order = F.col("v").desc() if descending else F.col("v").asc_nulls_first()
    want = df.withColumn("p", F.percent_rank().over(W.partitionBy("g").orderBy(order)))
    got = with_percent_rank(df, "g", "v", "p", stages, descending)
    assert sorted(map(tuple, got.select("id", "p").collect())) == sorted(map(tuple, want.select("id", "p").collect()))


def test_quantiles_equal_percentile(values, stages):
    got = {r.g: (r.a, r.b) for r in quantiles(values, "g", "v", {"a": 0.5, "b": 0.99}, stages).collect()}
    want = {r.g: (r.a, r.b) for r in values.where("v IS NOT NULL").groupBy("g").agg(
        F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.99)).alias("b")).collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g]) for g in want)


def test_weighted_rank_is_the_rank_of_the_rows_it_stands_for(spark, stages):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 else "g", rng.choice([0.5, 1.0, round(rng.random(), 2)]), rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v double, w int")
    order = W.partitionBy("g").orderBy(F.col("v").desc())
    unfolded = df.withColumn("one", F.explode(F.sequence(F.lit(1), "w"))).withColumn("p", F.percent_rank().over(order))
    got = with_percent_rank(df, "g", "v", "p", stages, descending=True, weight="w")
    assert set(map(tuple, got.select("id", "p").collect())) == set(map(tuple, unfolded.select("id", "p").collect()))


def test_running_sums_of_no_rows(spark, stages):
    df = spark.createDataFrame([], "g string, v double, w int")
    assert running_sums(df, "g", "v", {"n": F.col("w"), "m": F.lit(1)}, stages).collect() == []
