import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskset.operators import clean, cox, design
from riskset.operators.frame import Model
from riskset.plans import coxflows
from tests import brute


def data(n=500, seed=0, days=True):
    r = np.random.default_rng(seed)
    x1, x2 = r.normal(50, 8, n), r.integers(0, 2, n).astype(float)
    t = r.exponential(20 * np.exp(-0.05 * (x1 - 50) - 0.4 * x2))
    c = r.exponential(25, n)
    time = np.minimum(t, c)
    time = np.ceil(time) if days else time.round(6)
    return pd.DataFrame(dict(t=time, e=(t <= c).astype(int), x1=x1, x2=x2, w=r.uniform(0.5, 2, n),
                             f=r.choice(["a", "b", "c"], n)))


@pytest.fixture(scope="module")
def days(spark):
    pdf = data()
    return pdf, spark.createDataFrame(pdf).persist()


def terms():
    return design.numeric_terms("x1", "x2")


@pytest.mark.parametrize("ties", ["efron", "breslow"])
@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("layout", [{}, {"max_points": 0, "rows_per_bucket": 40}])
def test_fit_matches_definition(spark, ties, weight, layout):
    pdf = data()
    fit = cox.cox_fit(spark.createDataFrame(pdf), "t", "e", terms(), ties=ties, weight=weight, **layout)
    b, v, ll = brute.cox(pdf.t.to_numpy(), pdf.e.to_numpy(), pdf[["x1", "x2"]].to_numpy(), ties == "efron",
                         pdf.w.to_numpy() if weight else None)
    assert np.allclose(fit.coef, b, atol=1e-7) and np.allclose(fit.cov, v, rtol=1e-6)
    assert fit.loglik == pytest.approx(ll, rel=1e-9) and fit.converged and fit.events == pdf.e.sum()


def test_near_continuous_times_agree_between_layouts(spark):
    pdf = data(3000, 3, days=False)
    pdf.loc[:900, "t"] = 7.0  # a hot time with many tied events
    df = spark.createDataFrame(pdf).repartition(6)
    points = cox.cox_fit(df, "t", "e", terms())
    cut = cox.cox_fit(df, "t", "e", terms(), max_points=10, rows_per_bucket=300)
    assert np.allclose(points.coef, cut.coef, atol=1e-10) and points.loglik == pytest.approx(cut.loglik, rel=1e-12)


def wide_data(n=4000, k=19, seed=8):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, k))
    t = r.exponential(np.exp(-x[:, :3].sum(axis=1) * 0.3)).round(9)
    t[::9] = 0.25  # a hot time
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(k)])
    return pdf.assign(t=t, e=(r.uniform(size=n) < 0.6).astype(int))


@pytest.mark.parametrize("runs_from", [cox.RUNS_FROM, 3])
@pytest.mark.parametrize("joined_by", ["-1", "10m"])
def test_many_models_over_continuous_times(spark, monkeypatch, runs_from, joined_by):
    """Nineteen models of three terms each: the bucketed sums, by either join, agree with the sums per time."""
    monkeypatch.setattr(cox, "RUNS_FROM", runs_from)
    df = spark.createDataFrame(wide_data()).repartition(5).persist()
    design = {f"x{i}": F.col(f"x{i}") for i in range(19)}
    models = [Model(f"m{i}", ("x0", f"x{i}", f"x{(i + 5) % 18 + 1}") if i else ("x0",)) for i in range(19)]
    by_time = cox.cox_fits(df, "t", "e", design, models)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined_by)
    try:
        cut = cox.cox_fits(df, "t", "e", design, models, max_points=10, rows_per_bucket=150)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for a, b in zip(by_time, cut):
        assert np.allclose(a.coef, b.coef, atol=1e-9) and np.allclose(a.cov, b.cov, rtol=1e-8)
        assert a.loglik == pytest.approx(b.loglik, rel=1e-11) and (a.n, a.events) == (b.n, b.events)


def test_buckets_depend_on_rows_alone_and_rows_stay(spark):
    df = spark.createDataFrame(wide_data(2000)).persist()
    design = {f"x{i}": F.col(f"x{i}") for i in range(19)}
    narrow = cox.RiskLayout(df, "t", "e", design, doubles=1, max_points=10, rows_per_bucket=100)
    wide = cox.RiskLayout(df, "t", "e", design, doubles=cox.BATCH_DOUBLES, max_points=10, rows_per_bucket=100)
    assert narrow.buckets == wide.buckets > 30
    batch = cox.CoxBatch(wide, [Model("all", tuple(design))])
    plans = [cox.model_plan(batch.frame, batch.models[0], np.zeros(19))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        scanned = batch.scanned(plans).persist()
        rows = batch.streamed(plans, scanned)
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    top = plan.split("InMemoryTableScan")[0]  # what is done to the rows before they are streamed
    assert "SortMergeJoin" in top and "Exchange" not in top and "Sort [" not in top
    narrow.release()
    wide.release()


def test_scaling_a_covariate_scales_its_coefficient(spark, days):
    _, df = days
    a = cox.cox_fit(df, "t", "e", {"x1": F.col("x1")})
    b = cox.cox_fit(df, "t", "e", {"x1": F.col("x1") * 1000 + 5})
    assert a.coef[0] == pytest.approx(1000 * b.coef[0], rel=1e-7) and a.loglik == pytest.approx(b.loglik)


def test_batch_equals_separate_fits(spark, days):
    _, df = days
    masks = {"x2=1": F.col("x2")}
    models = [Model("a", ("x1",)), Model("b", ("x2",)), Model("c", ("x1", "x2")), Model("d", ("x1",), "x2=1")]
    batch = cox.cox_fits(df, "t", "e", terms(), models, masks)
    for m, fit in zip(models, batch):
        sub = df.where("x2 = 1") if m.rows else df
        alone = cox.cox_fit(sub, "t", "e", {t: terms()[t] for t in m.terms})
        assert np.allclose(fit.coef, alone.coef, atol=1e-8) and fit.n == alone.n
        assert fit.loglik == pytest.approx(alone.loglik, rel=1e-10)


def test_missing_rows_are_left_out_per_model(spark, days):
    pdf, df = days
    holes = df.withColumn("x1", F.when(F.col("x1") > 45, F.col("x1")))
    fits = cox.cox_fits(holes, "t", "e", terms(), [Model("a", ("x1",)), Model("b", ("x2",))])
    assert fits[0].n == (pdf.x1 > 45).sum() and fits[1].n == len(pdf)


def test_aliased_terms_are_null(spark, days):
    _, df = days
    out = coxflows.cox_multivariable(df.withColumn("both", 10 * F.col("x1") + 5 * F.col("x2")), "t", "e",
                                     ["x1", "x2", "both"]).collect()
    assert [r.coefficient is None for r in out] == [False, False, True] and out[2].HR is None


def test_no_events(spark):
    df = spark.createDataFrame([(float(i), 0, float(i % 3)) for i in range(1, 20)], "t double, e int, x double")
    fit = cox.cox_fit(df, "t", "e", {"x": F.col("x")})
    assert math.isnan(fit.coef[0]) and not fit.converged and fit.events == 0


def test_sweep_reports_levels_only_when_several(spark, days):
    pdf, df = days
    out = coxflows.cox_univariable_sweep(df.drop("w"), "t", "e").collect()
    assert [(r.Variable, r.Levels) for r in out] == [("x1", None), ("x2", None), ("f", "fb"), ("f", "fc")]
    x = np.column_stack([(pdf.f == "b"), (pdf.f == "c")]).astype(float)
    b, v, _ = brute.cox(pdf.t.to_numpy(), pdf.e.to_numpy(), x)
    assert [r.Coef for r in out[2:]] == pytest.approx(list(b), abs=1e-7)
    assert out[2].HR_CI_Upper == pytest.approx(math.exp(b[0] + 1.959963984540054 * math.sqrt(v[0, 0])), rel=1e-6)


def test_adjusted_forms_and_trend(spark, days):
    _, df = days
    df = df.withColumn("grp", F.when(F.col("x1") < 45, 1).when(F.col("x1") < 55, 2).otherwise(3))
    forms = coxflows.cox_adjusted(df, "t", "e", ["x2"], "x1", "grp", [1, 2, 3])
    assert [r.variable for r in forms["factor"].collect()] == ["x2", "grp2", "grp3"]
    trend = coxflows.p_for_trend(clean.as_factor(df, "grp", [1, 2, 3]), "t", "e", "grp", {"m": ["x2"]}).collect()
    assert trend[1].coef == pytest.approx(forms["trend"].collect()[1].coefficient)
    assert trend[0].model == "unadjusted"


def test_spline_basis_and_curve(spark, days):
    pdf, df = days
    knots = [40.0, 50.0, 60.0]
    terms = design.rcs_basis("x1", knots)
    at = spark.createDataFrame([(v,) for v in (35.0, 40.0, 50.0, 60.0, 70.0)], "x1 double").select(*terms.values()).collect()
    assert [r[1] for r in at][:2] == [0.0, 0.0]
    assert [r[1] for r in at] == pytest.approx([design.rcs_values(v, knots)[1] for v in (35, 40, 50, 60, 70)])
    # beyond the last knot the curve is a straight line
    far = [design.rcs_values(v, knots)[1] for v in (60, 65, 70)]
    assert far[2] - far[1] == pytest.approx(far[1] - far[0])
    s = coxflows.cox_spline_fit(df, "t", "e", "x1", ["x2"])
    curve = s.hr_curve(spark.createDataFrame([(s.reference,), (60.0,)], "x double")).collect()
    assert curve[0].hr == pytest.approx(1.0) and curve[0].lower == pytest.approx(1.0)
    assert curve[1].lower < curve[1].hr < curve[1].upper
    anova = {r.term: r for r in s.wald_anova().collect()}
    b, v = s.fit.coef[1], s.fit.cov[1, 1]
    assert anova[" Nonlinear"].chisq == pytest.approx(b * b / v) and anova["x1"].df == 2 and anova["TOTAL"].df == 3


def test_subgroups(spark, days):
    pdf, df = days
    df = df.withColumn("arm", (F.col("x1") > 50).cast("int"))
    out = coxflows.subgroup_cox(df, "t", "e", "arm", {"x2": [0.0, 1.0], "f": ["a", "b", "c"]}).collect()
    assert [(r.variable, r.level) for r in out] == [("Overall", None), ("x2", None), ("x2", "0.0"), ("x2", "1.0"),
                                                    ("f", None), ("f", "a"), ("f", "b"), ("f", "c")]
    sub = pdf[pdf.f == "b"]
    b, _, _ = brute.cox(sub.t.to_numpy(), sub.e.to_numpy(), (sub.x1 > 50).to_numpy(float)[:, None])
    assert out[6].estimate == pytest.approx(math.exp(b[0]), rel=1e-6)
    assert out[6].total == len(sub) and out[6].events == sub.e.sum()
    arm = (pdf.x1 > 50).to_numpy(float)
    d = np.column_stack([arm, pdf.f == "b", pdf.f == "c"]).astype(float)
    full = np.column_stack([d, arm * d[:, 1], arm * d[:, 2]])
    t, e = pdf.t.to_numpy(), pdf.e.to_numpy()
    stat = 2 * (brute.cox(t, e, full)[2] - brute.cox(t, e, d)[2])
    assert out[4].p_interaction == pytest.approx(math.exp(-stat / 2), rel=1e-5)


@pytest.mark.parametrize("layout", [{}, {"max_points": 5, "rows_per_bucket": 20}])
@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_subgroups_from_counted_cells(spark, days, layout, ties):
    """Fourteen factors, some with gaps and values that are no level: the cells give what the rows give."""
    _, df = days
    df = df.withColumn("arm", (F.col("x1") > 50).cast("int"))
    factors = {"f": ["a", "b"], "x2": [0.0, 1.0]}
    for k in range(12):
        df = df.withColumn(f"g{k}", F.when(F.pmod(F.hash("t", "x1", F.lit(k)), F.lit(11)) != 0, F.pmod(F.hash("x1", F.lit(k)), F.lit(2 + k % 3)).cast("string")))
        factors[f"g{k}"] = [str(v) for v in range(2 + k % 3)]
    df = df.withColumn("e", F.when(F.col("t") != 3, F.col("e"))).persist()
    rows, cells = (coxflows.subgroup_cox(df, "t", "e", "arm", factors, compress=c, ties=ties, **layout).collect() for c in (False, True))
    assert len(rows) == len(cells) == 1 + sum(1 + len(v) for v in factors.values())
    for a, b in zip(rows, cells):
        for name, x, y in zip(a.__fields__, a, b):
            assert (x == pytest.approx(y, rel=1e-6, abs=1e-9)) if isinstance(x, float) else x == y, (a.variable, a.level, name)


def test_model_groups_respect_the_state_limit():
    models = [Model(str(i), tuple(f"x{j}" for j in range(30))) for i in range(40)]
    groups = cox.model_groups(models)
    assert sum(groups, []) == models and cox.batch_doubles(groups) <= cox.BATCH_DOUBLES


def test_tie_sums_of_many_times_are_added_together(monkeypatch):
    """Times with a few events each cost no call of their own; the sums are those of one time after the other."""
    from riskset.functions.tails import DIRECT_TIES, tie_sums

    r = np.random.default_rng(3)
    d = r.integers(1, 40, 500).astype(float)
    d[:2] = DIRECT_TIES, DIRECT_TIES + 1
    d0 = d * r.uniform(0.5, 1, 500)
    s0 = d0 + r.uniform(1, 1e4, 500)
    calls = []
    monkeypatch.setattr(cox, "tie_sums", lambda *a: calls.append(a) or tie_sums(*a))
    out = cox._tie_table(s0, d0, d, True)
    assert len(calls) == 1
    assert np.allclose(out, np.array([tie_sums(*map(float, x), True) for x in zip(s0, d0, d)]).T, rtol=1e-12)


def test_a_task_reads_many_buckets_and_each_row_twice(spark):
    """Partitions follow rows, not buckets, and the buckets' vectors are made once an evaluation."""
    df = spark.range(3000).select((F.rand(1) * 100).alias("t"), (F.rand(2) < 0.4).cast("int").alias("e"), F.randn(3).alias("x")).localCheckpoint()
    layout = cox.RiskLayout(df, "t", "e", {"x": F.col("x")}, max_points=10, rows_per_bucket=20)
    assert layout.buckets > 200 and layout.moved.rdd.getNumPartitions() <= 8
    batch = cox.CoxBatch(layout, [Model("m", ("x",))])
    runs = spark.sparkContext.accumulator(0)
    kernel = cox._total_kernel

    def counted(plans):
        inner = kernel(plans)

        def run(batches):
            runs.add(1)
            yield from inner(batches)

        return run

    cox._total_kernel = counted
    try:
        found = batch.evaluate([0], [np.array([0.3])])[0]
    finally:
        cox._total_kernel = kernel
    assert 0 < runs.value <= layout.parted.rdd.getNumPartitions()
    whole = cox.RiskLayout(df, "t", "e", {"x": F.col("x")})
    same = cox.CoxBatch(whole, [Model("m", ("x",))]).evaluate([0], [np.array([0.3])])[0]
    assert found[0] == pytest.approx(same[0]) and np.allclose(found[2], same[2]) and found[3:] == same[3:] == [3000, same[4]]
    layout.release()
    whole.release()
