import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskset.operators.hinges import HingeSums
from riskset.operators import auc, cox, design, glm, threshold
from riskset.operators.frame import Model
from riskset.plans import discrimination
from tests import brute


def data(n=800, seed=2):
    r = np.random.default_rng(seed)
    x, z = r.normal(35, 8, n).round(1), r.normal(0, 1, n)
    eta = -0.12 * np.minimum(x - 33, 0) + 0.4 * z - 0.3
    y = (r.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(int)
    t = np.ceil(r.exponential(15 * np.exp(-eta)))
    return pd.DataFrame(dict(x=x, z=z, y=y, t=t, e=r.integers(0, 2, n), lin=-0.5 * np.minimum(x - 33, 0) + r.normal(0, 1, n)))


@pytest.fixture(scope="module")
def both(spark):
    pdf = data()
    return pdf, spark.createDataFrame(pdf).persist()


def test_logistic(spark, both):
    pdf, df = both
    models = [Model("a", ("x", "z")), Model("b", ("z",))]
    fits = glm.logistic_fits(df, "y", design.numeric_terms("x", "z"), models)
    for fit, cols in zip(fits, (["x", "z"], ["z"])):
        b, v, ll = brute.logistic(pdf.y.to_numpy(float), pdf[cols].to_numpy())
        assert np.allclose(fit.coef, b, atol=1e-7) and np.allclose(fit.cov, v, rtol=1e-5)
        assert fit.loglik == pytest.approx(ll)


def test_linear_with_an_aliased_term(spark, both):
    pdf, df = both
    terms = {**design.numeric_terms("x", "z"), "sum": F.col("x") + F.col("z")}
    fit = glm.linear_fit(df, "lin", terms)
    b, ll = brute.linear_ll(pdf.lin.to_numpy(), pdf[["x", "z"]].to_numpy())
    assert np.allclose(fit.coef[:3], b) and math.isnan(fit.coef[3]) and fit.loglik == pytest.approx(ll)
    assert fit.df_residual == len(pdf) - 3


def test_profile_limits_lie_on_the_profile(spark, both):
    pdf, df = both
    batch = glm.GlmBatch(df, F.col("y").cast("double"), design.numeric_terms("x", "z"), [Model("a", ("x", "z"))])
    fitted = batch.fit_logistic()
    y, z = pdf.y.to_numpy(float), pdf[["z"]].to_numpy()
    for limit in batch.profile_limits([(0, "x")], fitted)[(0, "x")]:
        constrained = brute.logistic(y, z, limit * pdf.x.to_numpy())[2]
        assert 2 * (fitted[0][0].loglik - constrained) == pytest.approx(3.841458820694124, abs=1e-6)


def test_auc_direction_ties_and_missing(spark, both):
    pdf, df = both
    coarse = np.floor(pdf.x / 5)
    out = {x.Model: x for x in auc.auc(df, {"x": F.col("x"), "tied": F.floor(F.col("x") / 5), "none": F.lit(None)}, "y").collect()}
    assert out["x"].C_index == pytest.approx(brute.auc(pdf.x.to_numpy(), pdf.y.to_numpy()))
    assert out["tied"].C_index == pytest.approx(brute.auc(coarse.to_numpy(), pdf.y.to_numpy()))
    assert out["x"].direction == ">" and "none" not in out
    split = {x.Model: x.C_index for x in auc.auc(df, {"x": F.col("x")}, "y", rows_per_bucket=25).collect()}
    assert split["x"] == pytest.approx(out["x"].C_index)


def test_auc_depends_on_ranks_only(spark, both):
    _, df = both
    a = [r.C_index for r in auc.auc(df, {"a": F.col("x"), "b": F.exp(F.col("x") / 10)}, "y").orderBy("Model").collect()]
    assert a[0] == pytest.approx(a[1])


def test_combined_scores(spark, both):
    pdf, df = both
    table = discrimination.auc_table(df, "x", {"Z": "z", "L": "lin"}, "y").persist()
    b, _, _ = brute.logistic(pdf.y.to_numpy(float), pdf[["x", "z"]].to_numpy())
    got = {r.Model: r.C_index for r in table.collect()}
    assert got["x + Z"] == pytest.approx(brute.auc(b[1] * pdf.x.to_numpy() + b[2] * pdf.z.to_numpy(), pdf.y.to_numpy()), abs=1e-6)
    rows = discrimination.score_comparison(table, "x", ["Z", "L"]).collect()
    assert [(r.Group, r.Subgroup) for r in rows][:3] == [("Z", "x Alone"), ("Z", "Score Alone"), ("Z", "Score+x")]
    assert rows[2].label == f"{got['x + Z']:.3f}"


def hinge(x, c):
    return np.where(x > c, x - c, 0.0)


def test_linear_search_by_definition(spark, both):
    pdf, df = both
    x, z, y = pdf.x.to_numpy(), pdf.z.to_numpy(), pdf.lin.to_numpy()
    want = brute.threshold(x, lambda c, _: brute.linear_ll(y, np.column_stack([x, z, hinge(x, c)]))[1])
    terms = design.numeric_terms("z")
    assert threshold.threshold_search(df, "x", "gaussian", terms, outcome="lin") == want
    assert threshold.threshold_search(df, "x", "gaussian", terms, outcome="lin", value_limit=3) == want
    assert abs(want - 33) < 2


def test_every_cut_from_one_pass(spark):
    """Fits with a hinge at any cut, from all values at hand, from a part of them, and from the table alone."""
    r = np.random.default_rng(12)
    n = 900
    x, z, w = r.choice(np.round(1e5 + r.normal(0, 3, 400), 2), n), r.normal(1e4, 2, n), r.uniform(0.5, 2, n)
    y = 1e6 + x + 2 * hinge(x, 1e5 + 1) - z + r.normal(0, 1, n)
    rows = [tuple(map(float, v)) for v in zip(x, z, y, w)] + [(99_000.0, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (100_500.0, 1.0, float("nan"), 1.0), (1e5, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, z double, y double, w double").repartition(3)
    cuts = [1e5 - 2.005, 1e5 + 0.123, float(np.sort(x)[500]), 1e5 + 5.5]

    def loglik(c):
        d = np.column_stack([np.ones(n), x - 1e5, z - 1e4, hinge(x, c)]) * np.sqrt(w)[:, None]
        v = (y - 1e6) * np.sqrt(w)
        rss = ((v - d @ np.linalg.lstsq(d, v, rcond=None)[0]) ** 2).sum()
        return -0.5 * n * (math.log(2 * math.pi * rss / n) + 1) + 0.5 * np.log(w).sum()

    want = [loglik(c) for c in cuts]
    for limit in (10_000, 150, 0):
        sums = HingeSums(df, "x", {"z": F.col("z")}, "y", "w", limit)
        assert sums.whole == (limit == 10_000) and sums.n == n
        assert sums.logliks(cuts) == pytest.approx(want, rel=1e-10)
        low, high = 1e5 - 0.5, 1e5 + 0.7
        inside = sorted({float(v) for v in x if low < v < high} | {1e5})
        assert sums.values(low, high) == (None if limit == 0 else inside)
        assert sums.logliks(inside[:5]) == pytest.approx([loglik(c) for c in inside[:5]], rel=1e-10)
        if limit:
            every = np.array([v[0] for v in rows if v[0] is not None])
            assert sums.quantiles([0, 0.05, 0.333, 0.95, 1]) == pytest.approx(np.quantile(every, [0, 0.05, 0.333, 0.95, 1]).tolist(), rel=1e-15)
        fits = sums.two_piece(1e5 + 1)
        assert fits[1].loglik == pytest.approx(fits[2].loglik, rel=1e-12) == pytest.approx(loglik(1e5 + 1), rel=1e-10)
        b0, b1 = fits[1].coef[fits[1].at("x")], fits[1].coef[fits[1].at("X2")]
        assert fits[2].coef[fits[2].at("X1")] == pytest.approx(b0, rel=1e-7) and fits[2].coef[fits[2].at("X2")] == pytest.approx(b0 + b1, rel=1e-7)
        sums.release()


def test_cox_search_by_definition(spark, both):
    pdf, df = both
    x, t, e = pdf.x.to_numpy(), pdf.t.to_numpy(), pdf.e.to_numpy()

    def loglik(c, coarse):
        return brute.cox(t, e, np.column_stack([x, hinge(x, c)]), efron=not coarse)[2]

    assert threshold.threshold_search(df, "x", "cox", time="t", event="e") == brute.threshold(x, loglik)


def test_two_piece_cox(spark, both):
    pdf, df = both
    rows = {r.row: r for r in threshold.threshold_effect(df, "x", "cox", cutpoint=33.0, time="t", event="e").collect()}
    x, t, e = pdf.x.to_numpy(), pdf.t.to_numpy(), pdf.e.to_numpy()
    up, down = hinge(x, 33), np.where(x <= 33, x - 33, 0)
    f0, f1, f2 = (brute.cox(t, e, m) for m in (x[:, None], np.column_stack([x, up]), np.column_stack([down, up])))
    assert rows["single"].estimate == pytest.approx(math.exp(f0[0][0]), rel=1e-6)
    assert rows["below"].estimate == pytest.approx(math.exp(f1[0][0]), rel=1e-6)
    assert rows["above"].estimate == pytest.approx(math.exp(f2[0][1]), rel=1e-6)
    # both two-piece forms span one space; the upper slope is the lower slope plus the hinge
    assert f1[2] == pytest.approx(f2[2]) and f2[0][1] == pytest.approx(f1[0][0] + f1[0][1], abs=1e-7)
    assert rows["loglik"].estimate == pytest.approx(2 * (f2[2] - f0[2]), abs=1e-4)
    text = threshold.cut_table(threshold.threshold_effect(df, "x", "cox", cutpoint=33.0, time="t", event="e")).collect()
    assert [r.Outcome for r in text][2:5] == ["Inflection point", "<33", ">33"] and text[2][2] == "33"


def test_two_piece_logistic_and_lrm(spark, both):
    pdf, df = both
    a = threshold.threshold_effect(df, "x", "binomial", design.numeric_terms("z"), cutpoint=33.0, outcome="y").collect()
    b = threshold.threshold_effect(df, "x", "lrm", design.numeric_terms("z"), cutpoint=33.0, outcome="y").collect()
    assert a == b and a[0].lower < a[0].estimate < a[0].upper
    with pytest.raises(ValueError):
        threshold.threshold_effect(df, "x", "poisson", outcome="y")


def test_weights_apply_to_every_stage(spark, both):
    pdf, df = both
    doubled = df.withColumn("w", F.when(F.col("z") > 0, 2.0).otherwise(1.0))
    repeated = df.union(df.where("z > 0"))
    a = threshold.threshold_effect(doubled, "x", "binomial", cutpoint=33.0, weight="w", outcome="y").collect()
    b = threshold.threshold_effect(repeated, "x", "binomial", cutpoint=33.0, outcome="y").collect()
    for p, q in zip(a, b):
        assert p.estimate == pytest.approx(q.estimate, rel=1e-6) if p.estimate else q.estimate is None


def test_nested_models(spark, both):
    _, df = both
    fits = cox.cox_fits(df, "t", "e", design.numeric_terms("x", "z"), [Model("s", ("x",)), Model("l", ("x", "z"))])
    r = threshold.nested_model_test(cox.fit_statistics(spark, fits), [("s", "l")]).first()
    assert r.stat == pytest.approx(2 * (fits[1].loglik - fits[0].loglik)) and 0 <= r.p_value <= 1
