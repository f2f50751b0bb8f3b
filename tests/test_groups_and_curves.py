import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskset.functions import tails
from riskset.operators import km, nonparam, tableone


def test_tails():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(7.0, 3) == pytest.approx(0.07189777249646513, abs=1e-12)
    assert tails.chi2_tail(400, 2) == pytest.approx(math.exp(-200), rel=1e-9)
    assert tails.f_tail(2.7, 3, 100) == pytest.approx(0.0497, abs=5e-5)
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


@pytest.mark.parametrize("s0,d0,d", [(1000.0, 300.0, 5000), (6000.0, 5500.0, 5000), (5000.0, 5000.0, 5000), (9e5, 10.0, 5000)])
def test_closed_forms_for_large_ties(s0, d0, d):
    f = np.arange(d) / d
    v = s0 - f * d0
    direct = [(1 / v).sum(), (f / v).sum(), (1 / v**2).sum(), (f / v**2).sum(), (f * f / v**2).sum(), np.log(v).sum()]
    assert np.allclose(tails.tie_sums(s0, d0, d, True), direct, rtol=1e-9)


def test_kaplan_meier_by_hand(spark):
    # the event at 3 comes before the censoring at 3; the last subject is an event
    rows = [("a", 1.0, 1), ("a", 2.0, 0), ("a", 3.0, 1), ("a", 3.0, 0), ("a", 5.0, 1), ("b", 2.0, 0), ("b", 4.0, 0)]
    df = spark.createDataFrame(rows, "g string, t double, e int")
    curve = {(r.stratum, r.time): (r.n_risk, r.n_event, r.n_censor, r.surv) for r in km.kaplan_meier(df, "t", "e", "g").collect()}
    assert curve[("a", 1.0)][:3] == (5, 1, 0) and curve[("a", 1.0)][3] == pytest.approx(0.8)
    assert curve[("a", 3.0)][:3] == (3, 1, 1) and curve[("a", 3.0)][3] == pytest.approx(0.8 * 2 / 3)
    assert curve[("a", 5.0)][3] == 0.0 and curve[("b", 4.0)][3] == 1.0
    marks = {(r.stratum, r.time) for r in km.censor_marks(km.kaplan_meier(df, "t", "e", "g")).collect()}
    assert marks == {("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0)}
    table = {(r.stratum, r.time): r.n_risk for r in km.risk_table(df, "t", "e", "g", (0, 3)).collect()}
    assert table == {("a", 0.0): 5, ("a", 3.0): 3, ("b", 0.0): 2, ("b", 3.0): 1}


def test_curves_fall_and_agree_across_buckets(spark):
    r = np.random.default_rng(5)
    rows = [("ab"[i % 2], float(np.ceil(t * 10) / 10), int(e)) for i, (t, e) in enumerate(zip(r.exponential(20, 3000), r.integers(0, 2, 3000)))]
    df = spark.createDataFrame(rows, "g string, t double, e int").persist()
    one = km.kaplan_meier(df, "t", "e", "g").orderBy("stratum", "time").collect()
    many = km.kaplan_meier(df, "t", "e", "g", rows_per_bucket=40).orderBy("stratum", "time").collect()
    assert [x[:5] for x in one] == [x[:5] for x in many]
    assert np.allclose([x.surv for x in one], [x.surv for x in many], atol=1e-12)
    a = [x.surv for x in one if x.stratum == "a"]
    assert all(0 <= q <= p <= 1 for p, q in zip(a, a[1:]))


def naive_logrank(t, e, g):
    groups = sorted(set(g))
    k = len(groups)
    o, ex, v = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for u in np.unique(t[e == 1]):
        n, d = (t >= u).sum(), ((t == u) & (e == 1)).sum()
        ng = np.array([((t >= u) & (g == x)).sum() for x in groups], float)
        o += [((t == u) & (e == 1) & (g == x)).sum() for x in groups]
        ex += d * ng / n
        if n > 1:
            v += d * (n - d) / (n - 1) * (np.diag(ng / n) - np.outer(ng, ng) / n**2)
    dev = (o - ex)[1:]
    return float(dev @ np.linalg.solve(v[1:, 1:], dev))


def test_logrank(spark):
    r = np.random.default_rng(6)
    n = 400
    g = r.choice(["a", "b", "c"], n)
    t = np.ceil(r.exponential(10, n) * (1 + (g == "b")))
    e = r.integers(0, 2, n)
    df = spark.createDataFrame([(x, float(y), int(z)) for x, y, z in zip(g, t, e)], "g string, t double, e int")
    out = km.logrank(df, "t", "e", "g").first()
    assert out.chisq == pytest.approx(naive_logrank(t, e, g)) and out.df == 2
    assert km.logrank(df, "t", "e", "g", rows_per_bucket=5).first().chisq == pytest.approx(out.chisq)


def test_rank_test_with_ties(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    r = nonparam.kruskal_wallis(df, ["x"], "g").first()
    # ranks 1,3,3 | 3,5,6
    h = 12 / 42 * (7**2 / 3 + 14**2 / 3) - 21
    assert r.h_stat == pytest.approx(h / (1 - 24 / (6**3 - 6))) and r.df == 1
    assert nonparam.kruskal_wallis(df, ["x"], "g", rows_per_bucket=2).first().h_stat == pytest.approx(r.h_stat)
    assert nonparam.kruskal_wallis(df, ["x"], "g", groups_as_columns=1).first().h_stat == pytest.approx(r.h_stat)


def test_correction_only_for_two_by_two(spark):
    counts = {("n", "x"): 10, ("n", "y"): 20, ("m", "x"): 30, ("m", "y"): 25}
    df = spark.createDataFrame([k for k, c in counts.items() for _ in range(c)], "v string, g string")
    t = np.array([[10, 20], [30, 25]], float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    assert nonparam.chi_square_independence(df, ["v"], "g").first().chi2 == pytest.approx(((abs(t - e) - 0.5) ** 2 / e).sum())
    more = df.union(spark.createDataFrame([("o", "x")] * 7 + [("o", "y")] * 5, "v string, g string"))
    t = np.array([[10, 20], [30, 25], [7, 5]], float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    assert nonparam.chi_square_independence(more, ["v"], "g").first().chi2 == pytest.approx(((t - e) ** 2 / e).sum())


def test_anova_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("c", 9.0)], "g string, x double")
    r = nonparam.one_way_anova(df, ["x"], "g").first()
    between = 2 * (2 - 4.6) ** 2 + 2 * (5 - 4.6) ** 2 + (9 - 4.6) ** 2
    assert r.f_stat == pytest.approx((between / 2) / (4 / 2)) and (r.df1, r.df2) == (2, 2)


def test_baseline_table(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 10.0, "x"), ("a", 2.0, 20.0, "y"), ("b", 3.0, 30.0, "x"), ("b", 5.0, None, None)],
        "g string, m double, q double, c string")
    t = tableone.baseline_table(df, ["m", "q", "c"], "g", ["c"], ["q"]).collect()
    cell = {(r.variable, r.level, r.stratum): r for r in t}
    assert cell[("n", None, "a")].n == 2
    assert cell[("m", None, "b")].center == 4.0 and cell[("m", None, "b")].spread_low == pytest.approx(math.sqrt(2))
    assert cell[("q", None, "a")].summary == "15.00 [12.50, 17.50]"
    assert cell[("c", "y", "b")].n == 0 and cell[("c", "x", "b")].percent == 100.0
    assert {r.test for r in t if r.variable != "n"} == {"anova", "kruskal", "chisq"}
    overall = tableone.baseline_table(df, ["m"], None)
    assert {r.p_value for r in overall.collect()} == {None}
    text = tableone.baseline_text(tableone.baseline_table(df, ["m", "c"], "g", ["c"]), ["a", "b"]).collect()
    assert text[0].a == "2" and text[0].b == "2"


def test_skewed_group_does_not_matter(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("g"),
                                  (F.col("id") % 10).cast("double").alias("t"), (F.col("id") % 2).cast("int").alias("e"))
    total = km.kaplan_meier(df, "t", "e", "g").groupBy("stratum").agg((F.sum("n_event") + F.sum("n_censor")).alias("n"))
    assert {r.stratum: r.n for r in total.collect()} == {"hot": 2900, "cold": 100}


def test_empty_input(spark):
    df = spark.createDataFrame([], "t double, e int, g string, x double")
    assert km.kaplan_meier(df, "t", "e", "g").count() == 0
    assert km.logrank(df, "t", "e", "g").first().chisq is None
    assert nonparam.kruskal_wallis(df, ["x"], "g").count() == 0
    assert nonparam.chi_square_independence(df, ["g"], "g").count() == 0
