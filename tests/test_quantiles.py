import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskset.operators import missing, ordering, quantiles


def frame(spark, n=4000, seed=0):
    r = np.random.default_rng(seed)
    # a third of all rows share one value
    x = np.where(r.uniform(size=n) < 0.34, 5.0, r.normal(0, 10, n).round(2))
    return spark.createDataFrame([(int(i), "ab"[i % 2], float(v)) for i, v in enumerate(x)], "id int, g string, x double"), x


@pytest.mark.parametrize("limit", [None, 50])
def test_quantile7_matches_numpy(spark, limit):
    df, x = frame(spark)
    probs = [0.0, 0.05, 0.25, 0.5, 0.61, 0.75, 0.95, 1.0]
    got = quantiles.quantile_values(df, "x", probs, distinct_limit=limit)
    assert np.allclose(got, np.quantile(x, probs), atol=1e-12)


def test_grouped_quantiles_agree_on_every_path(spark):
    df, _ = frame(spark)
    probs = [0.1, 0.5, 0.9]
    key = lambda t: {(r.g, r.variable, r.prob): r.value for r in t.collect()}
    direct = key(quantiles.quantile7(df, ["x"], probs, ["g"]))
    narrowed = key(quantiles.quantile7(df, ["x"], probs, ["g"], distinct_limit=20))
    counted = key(quantiles._by_running_count(df, ["x"], probs, ["g"]))
    assert direct.keys() == narrowed.keys() == counted.keys()
    for k in direct:
        assert direct[k] == pytest.approx(narrowed[k]) == pytest.approx(counted[k])


def test_running_sums_in_buckets(spark):
    r = np.random.default_rng(3)
    rows = sorted({(k, round(float(v), 1)) for k, v in zip(r.integers(0, 3, 3000), r.exponential(20, 3000))})
    df = spark.createDataFrame([(int(k), v, int(r.integers(1, 9))) for k, v in rows], "k int, v double, n int")
    for descending in (False, True):
        one = ordering.running_sums(df, ["k"], "v", ["n"], descending).select("k", "v", "cum_n")
        many = ordering.running_sums(df, ["k"], "v", ["n"], descending, rows_per_bucket=50).select("k", "v", "cum_n")
        assert one.exceptAll(many).count() == 0 and many.count() == len(rows)


def test_bucketed_running_sum_never_gathers_rows_in_one_partition(spark):
    df = spark.range(5000).select((F.col("id") * 1.5).alias("v"), F.lit(1).alias("n"))
    plan = ordering.running_sums(df, [], "v", ["n"], rows_per_bucket=100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("InMemoryRelation")[0]


def test_ties_go_to_the_lower_group(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 10)], "x double")
    out = {r.x: r.group for r in quantiles.quantile_group(df, "x").collect()}
    assert (out[3.0], out[3.0 + 1], out[5.0], out[7.0], out[9.0]) == (1, 2, 2, 3, 4)


@pytest.mark.parametrize("n,ranks", [(4, [1, 1, 2, 3, 4]), (5, [1, 1, 2, 4, 5]), (6, [1, 2, 3, 4, 6]),
                                     (7, [1, 2, 4, 5, 7]), (8, [1, 2, 4, 6, 8])])
def test_type3_ranks(n, ranks):
    assert [quantiles.type3_rank(n, p) for p in (0, 0.25, 0.5, 0.75, 1)] == ranks


def test_quantile3_counts_distinct_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3, 4, 5, 6]], "x double")
    assert [r.value for r in quantiles.quantile3(df, "x").orderBy("prob").collect()] == [1.0, 2.0, 3.0, 4.0, 6.0]


def test_fence_is_strict(spark):
    # q1 = 4, q3 = 8, k = 1: the points on the bounds 0 and 12 stay
    df = spark.createDataFrame([(float(v),) for v in [0, 4, 4, 6, 8, 8, 12]], "x double")
    assert missing.fence_bounds(df, "x", 1) == (0.0, 12.0)
    assert missing.iqr_fence(df, "x", 1).count() == 7
    more = df.union(spark.createDataFrame([(12.5,)], "x double"))
    r = missing.fence_report(more, "x", 1, (0.0, 12.0)).first()
    assert (r.n_before, r.n_removed, r.n_left) == (8, 1, 7)


def test_fence_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "f.parquet")
    spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit("y").alias("other")).write.parquet(path)
    plan = missing.iqr_fence(spark.read.parquet(path).select("x"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(x" in plan and "other" not in plan


def test_sparse_columns_at_the_limit(spark):
    n = 100
    rows = [(1.0, None if i < 20 else 1.0, float("nan") if i < 21 else 1.0, None) for i in range(n)]
    df = spark.createDataFrame(rows, "full double, twenty double, more double, none double")
    kept, dropped = missing.drop_sparse_columns(df, 0.2)
    assert kept.columns == ["full", "twenty"] and dropped == ["more", "none"]
    profile = [(r.variable, r.n_miss) for r in missing.missing_profile(df).collect()]
    assert profile == [("none", 100), ("more", 21), ("twenty", 20), ("full", 0)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=8, max_size=60))
def test_groups_cover_all_rows(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert quantiles.quantile_group(df, "x").where("group between 1 and 4").count() == len(xs)


def test_arg_max_and_frequencies(spark):
    df = spark.createDataFrame([(3.0, 2), (5.0, 9), (5.0, 4), (None, 1)], "ll double, c int")
    assert quantiles.arg_max(df, "ll", "c").first().c == 4
    t = quantiles.freq_table(spark.createDataFrame([("a",), ("a",), (None,)], "v string"), "v", ["b", "a"])
    assert [(r.level, r.n) for r in t.collect()] == [("b", 0), ("a", 2)]


def test_data_distribution_limits(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 3 == 0]) for i in range(1000)], "x double, f string")
    r = {x.variable: x for x in quantiles.data_distribution(df, ["x"], ["f"]).collect()}
    assert (r["x"].low, r["x"].adjust_to, r["x"].high) == (0.0, 499.5, 999.0)
    assert r["x"].low_prediction == pytest.approx(9.99) and r["f"].adjust_level == "a"


def test_infinite_and_huge_values(spark):
    x = [float("-inf"), float("inf"), 1.5e308, -1.5e308] + [float(i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = quantiles.quantile_values(df, "x", [0.0, 0.25, 0.5, 1.0], distinct_limit=10)
    assert got == quantiles.quantile_values(df, "x", [0.0, 0.25, 0.5, 1.0])
