"""One rule for missing values, printed ties, level order, and limits on what the driver holds."""

import math
import os
import subprocess
import sys

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskset.operators import auc, impute, km, missing, nonparam, ordering, quantiles, tableone
from riskset.operators.clean import set_levels
from riskset.operators.report import format_pval

NAN = float("nan")


@pytest.fixture(scope="module")
def gaps(spark):
    r = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], [float(v), None, NAN][0 if i % 9 else 1 + i % 2]) for i, v in enumerate(r.normal(5, 2, 400))]
    return spark.createDataFrame(rows, "id long, g string, x double").persist()


def test_nan_is_missing_everywhere(spark, gaps):
    clean = gaps.where(F.col("x").isNotNull() & ~F.isnan("x"))
    left = gaps.count() - clean.count()
    assert left > 0

    def same(fn):
        both = [sorted(map(tuple, fn(df).collect()), key=str) for df in (gaps, clean)]
        for a, b in zip(*both):
            assert a == pytest.approx(b) if all(isinstance(v, (int, float)) for v in a) else str(a) == str(b)
        assert len(both[0]) == len(both[1]) > 0

    same(lambda df: nonparam.one_way_anova(df, ["x"], "g"))
    same(lambda df: nonparam.kruskal_wallis(df, ["x"], "g"))
    same(lambda df: tableone.continuous_moments(df, ["x"], "g"))
    same(lambda df: quantiles.box_stats(df, "x", "g", 0.5))
    same(lambda df: quantiles.box_outliers(df, "x", "g", 0.5))
    same(lambda df: quantiles.histogram(df, "x", 1.0))
    same(lambda df: auc.roc_points(df.withColumn("y", (F.col("id") % 2).cast("int")), F.col("x"), "y"))
    assert missing.iqr_fence(gaps, "x", 0.2).count() == missing.iqr_fence(clean, "x", 0.2).count() + left
    report = missing.fence_report(gaps, "x", 0.2).first()
    assert report.n_removed == missing.fence_report(clean, "x", 0.2).first().n_removed
    groups = quantiles.quantile_group(gaps, "x", out="q").where("q is null").count()
    assert groups == left


def test_anova_against_its_definition(spark):
    r = np.random.default_rng(1)
    x = 1e6 + r.normal(0, 1, 300)
    g = r.integers(0, 3, 300)
    df = spark.createDataFrame([("abc"[k], float(v)) for k, v in zip(g, x)], "g string, x double")
    got = nonparam.one_way_anova(df, ["x"], "g").first()
    exact = [[Fraction(float(v)) for v in x[g == k]] for k in range(3)]
    means = [sum(v) / len(v) for v in exact]
    mean = sum(sum(v) for v in exact) / 300
    between = sum(len(v) * (m - mean) ** 2 for v, m in zip(exact, means)) / 2
    within = sum((z - m) ** 2 for v, m in zip(exact, means) for z in v) / 297
    assert got.f_stat == pytest.approx(float(between / within), rel=1e-12) and (got.df1, got.df2) == (2, 297)


def test_printed_ties_follow_the_stored_value(spark):
    df = spark.createDataFrame([("a", 2.12), ("a", 2.13), ("b", 12.25), ("b", 12.25)], "g string, x double")
    df = df.withColumn("x", F.when(F.col("g") == "a", F.lit(2.125)).otherwise(F.col("x")))
    t = {r.stratum: r.summary for r in tableone.baseline_table(df, ["x"], "g", test=False).where("variable = 'x'").collect()}
    assert t["a"].startswith("2.12 ")
    text = format_pval(spark.createDataFrame([(0.0625,), (0.5,)], "p double"), "p", "t").orderBy("p").collect()
    assert [r.t for r in text] == ["0.0625", "0.5000"]
    assert format_pval(spark.createDataFrame([(0.0625,)], "p double"), "p", "t", digits=2).first().t == "0.062"


def test_levels_in_their_order_with_empty_ones(spark):
    df = set_levels(spark.createDataFrame([("s", v) for v in ["x", "z", "z"]], "g string, c string"), "c", ["z", "none", "x"])
    t = tableone.baseline_table(df, ["c"], "g", ["c"], test=False).where("variable = 'c'").orderBy("level_order").collect()
    assert [(r.level, r.n) for r in t] == [("z", 2), ("none", 0), ("x", 1)]


def test_prediction_limits_follow_one_formula(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") <= 40, F.col("id").cast("double")).alias("b"))
    got = {r.variable: r for r in quantiles.data_distribution(df, ["a", "b"]).collect()}
    assert (got["a"].low_prediction, got["a"].high_prediction) == pytest.approx((5.95, 95.05))
    assert got["b"].low_prediction == pytest.approx(np.quantile(np.arange(1, 41), 0.05))


def test_many_groups_and_columns_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SPANS_IN_DRIVER", 10)
    df = spark.range(3000).select((F.col("id") % 20).alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    got = {(r.g, r.variable, r.prob): r.value for r in quantiles.quantile7(df, ["a", "b"], [0.25, 0.5], ["g"], distinct_limit=5).collect()}
    rows = df.toPandas()
    for (g, v, p), value in got.items():
        assert value == pytest.approx(np.quantile(rows[rows.g == g][v], p))
    assert len(got) == 80


def plain_logrank(t, e, g, k):
    """Observed, expected and covariance from the definition."""
    obs, exp, v = np.bincount(g, e, minlength=k), np.zeros(k), np.zeros((k, k))
    for at in np.unique(t[e == 1]):
        n_g = np.bincount(g[t >= at], minlength=k).astype(float)
        n, d = n_g.sum(), e[t == at].sum()
        exp += d * n_g / n
        if n > 1:
            v += d * (n - d) / (n * n * (n - 1)) * (np.diag(n * n_g) - np.outer(n_g, n_g))
    return obs, exp, v


@pytest.mark.parametrize("rows_per_bucket", [None, 40])
@pytest.mark.parametrize("cells", [2_000_000, 100])
def test_logrank_of_many_groups(spark, monkeypatch, rows_per_bucket, cells):
    monkeypatch.setattr(km, "BLOCK_CELLS", cells)
    r = np.random.default_rng(6)
    n, k = 900, 40
    t, e, g = r.choice(np.round(r.exponential(1, 200), 3), n), r.integers(0, 2, n), r.integers(0, k, n)
    df = spark.createDataFrame([(float(a), int(b), f"{c:03d}") for a, b, c in zip(t, e, g)], "t double, e int, g string").repartition(3)
    groups, obs, exp, v, size = km.logrank_parts(df, "t", "e", "g", rows_per_bucket, groups_as_columns=5)
    want = plain_logrank(t, e, g, k)
    assert groups == [f"{c:03d}" for c in range(k)] and size == np.bincount(g, minlength=k).tolist()
    assert (obs == want[0]).all() and exp == pytest.approx(want[1]) and np.allclose(v, want[2], rtol=1e-9, atol=1e-9)


def test_logrank_of_a_thousand_groups(spark):
    r = np.random.default_rng(7)
    n, k = 6000, 1000
    t, e, g = r.integers(1, 30, n).astype(float), r.integers(0, 2, n), np.append(np.arange(k), r.integers(0, k, n - k))
    df = spark.createDataFrame([(float(a), int(b), f"{c:04d}") for a, b, c in zip(t, e, g)], "t double, e int, g string")
    got = km.logrank(df, "t", "e", "g").first()
    obs, exp, v = plain_logrank(t, e, g, k)
    use = np.flatnonzero(exp > 0)[1:]
    assert got.df == len(use) and got.chisq == pytest.approx((obs - exp)[use] @ np.linalg.pinv(v[np.ix_(use, use)]) @ (obs - exp)[use], rel=1e-6)


def test_rank_and_chi_square_with_thousands_of_groups(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("g"), (F.col("id") % 7).cast("double").alias("x"),
                                    (F.col("id") % 3).cast("string").alias("c"))
    rank = nonparam.kruskal_wallis(df, ["x"], "g").first()
    chi = nonparam.chi_square_independence(df, ["c"], "g").first()
    assert rank.df == 4999 and math.isfinite(rank.h_stat) and chi.df == 4999 * 2 and math.isfinite(chi.chi2)


def test_cut_values_are_even_and_keep_hot_values(spark):
    df = spark.range(100_000).repartition(40).select(
        F.when(F.col("id") % 4 == 0, F.lit(0.5)).otherwise(F.rand(3)).alias("v"))
    cuts = ordering.cut_values(df, "v", 100_000, 5000)
    assert 0.5 in cuts
    size = ordering.with_bucket(df, "v", cuts).where("bucket % 2 = 1").groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert 10 <= len(cuts) <= 20 and size <= 3 * 5000
    plan = df.groupBy((F.spark_partition_id() % ordering.SKETCHES).alias("k")).agg(F.percentile_approx("v", [0.5]))
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


def test_starting_values_come_from_all_observed(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("k"))
    run = impute.Imputer(df, "id")
    start = [r.v_v for r in run.open.where("g_v").select("v_v").collect()]
    assert len(set(start)) > 1000 and set(start) <= {float(i) for i in range(0, 4000, 2)}
    with pytest.raises(ValueError):
        impute.Imputer(df, "id", donors=0)


def test_one_checkpoint_for_each_round(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(impute, "cut_lineage", lambda df: calls.append(1) or df.persist())
    df = spark.range(300).select("id", F.rand(1).alias("a"), F.when(F.col("id") % 5 > 0, F.rand(2)).alias("b"), F.when(F.col("id") % 7 > 0, F.rand(3)).alias("c"))
    impute.Imputer(df, "id").run(3)
    assert len(calls) == 1 + 3


def test_donors_of_unneeded_buckets_stay(spark):
    df = spark.range(20_000).select("id", F.rand(1).alias("a"), F.rand(2).alias("x")).select(
        "id", "a", F.when((F.col("id") % 4000 != 0), F.col("a") * 2 + F.col("x") / 100).alias("b"))
    out = impute.complete_imputation(impute.impute_pmm(df, "id", maxit=1, rows_per_bucket=500, donors=1, match="fitted"))
    filled = out.where("id % 4000 = 0").select("a", "b").collect()
    assert len(filled) == 5 and all(abs(r.b - 2 * r.a) < 0.05 for r in filled)


def test_package_reaches_workers_from_another_folder(tmp_path):
    """A step with Python code, run where the package is not importable by itself."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate())
print("ROWS", e.queries()["g2_linear_fit"](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
