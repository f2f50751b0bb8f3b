"""Cox analyses built from batches of fits: sweeps, adjusted models, splines, subgroups."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.functions.tails import Z_975, chi2_tail, normal_two_sided
from riskset.operators.clean import levels_of, select_dynamic
from riskset.operators.cox import CoxFit, cox_fits, cox_summary, summary_rows, wald_test
from riskset.operators.design import design_for, dummy_code, numeric_terms, rcs_basis, rcs_knots, rcs_values, with_levels
from riskset.operators.frame import Model
from riskset.operators.missing import significant_names
from riskset.operators.quantiles import quantile_values

SWEEP_SCHEMA = ("row_order int, Variable string, Levels string, Coef double, HR double, HR_CI_Lower double, "
                "HR_CI_Upper double, P_Value double")
MULTI_SCHEMA = ("row_order int, variable string, coefficient double, HR double, CI_lower double, "
                "CI_upper double, p_value double")


def cox_univariable_sweep(df: DataFrame, time: str, event: str, variables: Sequence[str] | None = None,
                          **kw) -> DataFrame:
    """One single-variable model per column, all fitted in the same passes.

    One row per coefficient; ``Levels`` is missing when the variable has just one.
    """
    names = list(variables or [c for c in df.columns if c not in (time, event)])
    df = with_levels(df, names)
    design, models = {}, []
    for n in names:
        terms = design_for(df, [n])
        design.update(terms)
        models.append(Model(n, tuple(terms)))
    rows = []
    for fit in cox_fits(df, time, event, design, models, **kw):
        for r in summary_rows(fit):
            level = None if len(fit.terms) == 1 else r[2]
            rows.append((len(rows) + 1, fit.key, level, r[3], r[4], r[8], r[9], r[7]))
    return df.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def multivariable_rows(df: DataFrame, fit: CoxFit) -> DataFrame:
    rows = [(r[1], r[2], r[3], r[4], r[8], r[9], r[7]) for r in summary_rows(fit)]
    return df.sparkSession.createDataFrame(rows, MULTI_SCHEMA)


def cox_multivariable(df: DataFrame, time: str, event: str, names: Sequence[str], **kw) -> DataFrame:
    """One joint model; exactly collinear terms come out null, the later column being the one dropped."""
    df = with_levels(select_dynamic(df, [time, event, *names]), list(dict.fromkeys(names)))
    design = design_for(df, list(dict.fromkeys(names)))
    fit = cox_fits(df, time, event, design, [Model("joint", tuple(design))], **kw)[0]
    return multivariable_rows(df, fit)


def cox_screened_multivariable(df: DataFrame, time: str, event: str, sweep: DataFrame | None = None,
                               alpha: float = 0.05, **kw) -> DataFrame:
    """Joint model of every variable with any level below ``alpha`` in the sweep."""
    sweep = cox_univariable_sweep(df, time, event) if sweep is None else sweep
    names = significant_names(sweep, alpha, order="row_order")
    if not names:
        return df.sparkSession.createDataFrame([], MULTI_SCHEMA)
    return cox_multivariable(df, time, event, names, **kw)


def p_for_trend(df: DataFrame, time: str, event: str, group: str,
                adjustments: Mapping[str, Sequence[str]] | None = None, **kw) -> DataFrame:
    """(model, coef, hr, ci_lower, ci_upper, p_value) of the group code as one number.

    The unadjusted model and each named adjustment set are fitted together.
    """
    sets = {"unadjusted": (), **(adjustments or {})}
    used = list(dict.fromkeys(n for s in sets.values() for n in s))
    df = with_levels(df, used)
    design = design_for(df, used)
    design["__trend"] = _code(df, group)
    models = [Model(k, (*design_for(df, s), "__trend")) for k, s in sets.items()]
    rows = []
    for fit in cox_fits(df, time, event, design, models, **kw):
        r = summary_rows(fit)[-1]
        rows.append((fit.key, r[3], r[4], r[8], r[9], r[7]))
    return df.sparkSession.createDataFrame(
        rows, "model string, coef double, hr double, ci_lower double, ci_upper double, p_value double")


def _code(df: DataFrame, group: str) -> Column:
    if df.schema[group].metadata.get("levels"):
        from riskset.functions.columns import factor_code

        return factor_code(F.col(group), levels_of(df, group)).cast("double")
    return F.col(group).cast("double")


def cox_adjusted(df: DataFrame, time: str, event: str, covariates: Sequence[str], exposure: str, group: str,
                 group_levels: Sequence, **kw) -> dict[str, DataFrame]:
    """Fixed covariates plus the exposure as a number, as a trend and as a category.

    The three models run as one batch; keys ``continuous``, ``trend``, ``factor``.
    """
    df = with_levels(df, covariates)
    base = design_for(df, covariates)
    forms = {
        "continuous": numeric_terms(exposure),
        "trend": {f"{group} (trend)": _code(df, group)},
        "factor": dummy_code(group, group_levels),
    }
    design = dict(base)
    for terms in forms.values():
        design.update(terms)
    models = [Model(k, (*base, *terms)) for k, terms in forms.items()]
    out = {}
    for fit in cox_fits(df, time, event, design, models, **kw):
        fit.terms = [group if t == f"{group} (trend)" else t for t in fit.terms]
        out[fit.key] = multivariable_rows(df, fit)
    return out


class SplineFit:
    """Cox model with a restricted cubic spline in ``var``."""

    def __init__(self, df: DataFrame, fit: CoxFit, var: str, knots: list[float], reference: float):
        self.spark, self.fit, self.var, self.knots, self.reference = df.sparkSession, fit, var, knots, reference
        self.spline_terms = [t for t in fit.terms if t.rstrip("'") == var]

    def table(self) -> DataFrame:
        return cox_summary(self.spark, [self.fit])

    def wald_anova(self) -> DataFrame:
        """(row_order, term, chisq, df, p_value): each term, the spline as a whole and its nonlinear part, and all."""
        rows = []

        def add(name, terms):
            chisq, k = wald_test(self.fit, terms)
            rows.append((len(rows) + 1, name, chisq, k, chi2_tail(chisq, k)))

        add(self.var, self.spline_terms)
        add(" Nonlinear", self.spline_terms[1:])
        for t in self.fit.terms:
            if t not in self.spline_terms:
                add(t, [t])
        add("TOTAL", self.fit.terms)
        return self.spark.createDataFrame(
            rows, "row_order int, term string, chisq double, df int, p_value double")

    def hr_curve(self, xs: DataFrame, x: str = "x") -> DataFrame:
        """HR relative to the reference value with its 95% band, for each value in ``xs``.

        The contrast and its variance are column expressions with the fitted numbers
        as literals, so any number of values stays distributed.
        """
        at = [self.fit.at(t) for t in self.spline_terms]
        ref = rcs_values(self.reference, self.knots)
        basis = list(rcs_basis(x, self.knots).values())
        gap = [b - F.lit(r) for b, r in zip(basis, ref)]
        b = np.nan_to_num(self.fit.coef[at])
        v = np.nan_to_num(self.fit.cov[np.ix_(at, at)])
        eta, var = F.lit(0.0), F.lit(0.0)
        for j in range(len(at)):
            eta = eta + F.lit(float(b[j])) * gap[j]
            for k in range(len(at)):
                var = var + F.lit(float(v[j, k])) * gap[j] * gap[k]
        se = F.sqrt(F.greatest(var, F.lit(0.0)))
        return xs.select(F.col(x).cast("double").alias("x"), F.exp(eta).alias("hr"),
                         F.exp(eta - F.lit(Z_975) * se).alias("lower"), F.exp(eta + F.lit(Z_975) * se).alias("upper"))

    def grid(self, low: float, high: float, points: int = 200) -> DataFrame:
        step = (high - low) / max(points - 1, 1)
        return self.spark.range(points).select((F.lit(low) + F.col("id") * F.lit(step)).alias("x"))


def cox_spline_fit(df: DataFrame, time: str, event: str, var: str, covariates: Sequence[str] = (),
                   knots: int | Sequence[float] = 3, reference: float | None = None, **kw) -> SplineFit:
    """Spline of ``var`` plus covariates; the reference defaults to the median of ``var``."""
    df = with_levels(df, covariates)
    if isinstance(knots, int):
        knots = rcs_knots(df, var, knots)
    reference = quantile_values(df, var, [0.5])[0] if reference is None else reference
    design = {**rcs_basis(var, knots), **design_for(df, covariates)}
    fit = cox_fits(df, time, event, design, [Model("spline", tuple(design))], **kw)[0]
    return SplineFit(df, fit, var, list(knots), float(reference))


SUBGROUP_SCHEMA = ("row_order int, variable string, level string, events long, total long, events_low long, "
                   "total_low long, events_high long, total_high long, percent double, estimate double, "
                   "lower double, upper double, p_value double, p_interaction double")


#: levels of all factors together that one aggregation counts side by side
LEVELS_AT_ONCE = 300


def subgroup_cox(df: DataFrame, time: str, event: str, arm: str, subgroups: Mapping[str, Sequence],
                 interaction: str = "auto", compress: bool | None = None, **kw) -> DataFrame:
    """Effect of a 0/1 ``arm`` overall and within every level of every subgroup factor.

    ``subgroups`` maps each factor to its levels. All level models, and the models
    with and without interaction, run as one batch. P for interaction is the
    Wald test when one coefficient carries it and the likelihood-ratio test when
    several do; ``interaction`` forces ``"wald"`` or ``"lrt"``.

    Where far fewer (time, event, arm, factor, level) cells than rows are to be expected, one pass counts the cells, and
    every fit reads them in place of the rows. Else each model reads the rows through a mask: no row is copied
    per subgroup. Both give the same numbers; ``compress`` forces one.
    """
    if compress is None:
        levels = sum(len(v) for v in subgroups.values())
        compress = "weight" not in kw and levels <= LEVELS_AT_ONCE
        if compress:
            size = df.agg(F.approx_count_distinct(time).alias("times"), F.count(F.lit(1)).alias("rows")).first()
            compress = 2 * 2 * 2 * size.times * (1 + levels) <= size.rows
    run = _subgroups_from_cells if compress else _subgroups_from_rows
    fits, counts = run(df, time, event, arm, subgroups, **kw)

    def line(key, variable, level, base):
        n = counts[key]
        r = summary_rows(fits[key])[0]
        return [variable, level, n[0][0] + n[1][0], n[0][1] + n[1][1], n[0][0], n[0][1], n[1][0], n[1][1],
                100.0 * (n[0][1] + n[1][1]) / base if base else None, r[4], r[8], r[9], r[7], None]

    rows = [line("Overall", "Overall", None, sum(c[1] for c in counts["Overall"]))]
    for f, levels in subgroups.items():
        rows.append([f, None] + [None] * 11 + [_interaction_p(fits[f"{f}|main"], fits[f"{f}|crossed"],
                                                              arm, interaction)])
        base = sum(c[1] for v in levels for c in counts[f"{f}={v}"])
        rows += [line(f"{f}={v}", f, str(v), base) for v in levels]
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], SUBGROUP_SCHEMA)


def _subgroups_from_rows(df, time, event, arm, subgroups, **kw):
    """The fits by key, and the counts of :func:`_subgroup_counts`; every model reads the rows."""
    treat = F.col(arm).cast("double")
    design: dict[str, Column] = {arm: treat}
    masks, models = {}, [Model("Overall", (arm,))]
    for f, levels in subgroups.items():
        dummies = dummy_code(f, levels)
        crossed = {f"{arm}:{t}": treat * c for t, c in dummies.items()}
        design.update(dummies)
        design.update(crossed)
        for v in levels:
            masks[f"{f}={v}"] = F.coalesce((F.col(f).cast("string") == str(v)).cast("double"), F.lit(0.0))
            models.append(Model(f"{f}={v}", (arm,), f"{f}={v}"))
        models.append(Model(f"{f}|main", (arm, *dummies)))
        models.append(Model(f"{f}|crossed", (arm, *dummies, *crossed)))
    fits = {f.key: f for f in cox_fits(df, time, event, design, models, masks=masks, **kw)}
    return fits, _subgroup_counts(df, time, event, arm, subgroups)


def subgroup_cells(df: DataFrame, time: str, event: str, arm: str, subgroups: Mapping[str, Sequence]) -> DataFrame:
    """(factor, level, time, event, arm, n): how many rows each cell has, from one pass; factor -1 is all rows."""
    number = lambda c: F.col(c).cast("double")
    rows = df.select(number(time).alias("time"), (number(event) == 1).cast("double").alias("event"), number(arm).alias("arm"),
                     *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(subgroups)]).dropna(subset=["time", "event", "arm"])
    places = [(i, j, str(v)) for i, levels in enumerate(subgroups.values()) for j, v in enumerate(levels)]
    wide = rows.groupBy("time", "event", "arm").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"f{i}") == v).alias(f"n{i}_{j}") for i, j, v in places])
    cells = [F.struct(F.lit(-1).alias("factor"), F.lit(0).alias("level"), F.col("n").alias("n"))]
    cells += [F.struct(F.lit(i).alias("factor"), F.lit(j).alias("level"), F.col(f"n{i}_{j}").alias("n")) for i, j, _ in places]
    long = wide.select("time", "event", "arm", F.explode(F.array(*cells)).alias("cell"))
    return long.select("cell.factor", "cell.level", "time", "event", "arm", "cell.n").where("n > 0")


def _subgroups_from_cells(df, time, event, arm, subgroups, **kw):
    """As :func:`_subgroups_from_rows`, from counted cells."""
    cells = subgroup_cells(df, time, event, arm, subgroups).persist(StorageLevel.MEMORY_AND_DISK)
    widest = max((len(v) for v in subgroups.values()), default=1)
    design = {"arm": F.col("arm")}
    design.update({f"level{j}": (F.col("level") == j).cast("double") for j in range(1, widest)})
    design.update({f"arm:level{j}": F.col("arm") * design[f"level{j}"] for j in range(1, widest)})
    of = lambda i: (F.col("factor") == i)
    masks, models = {"all": of(-1).cast("double")}, [Model("Overall", ("arm",), "all")]
    for i, (f, levels) in enumerate(subgroups.items()):
        masks[f"{i}"] = of(i).cast("double")
        dummies = [f"level{j}" for j in range(1, len(levels))]
        for j, v in enumerate(levels):
            masks[f"{i}={j}"] = (of(i) & (F.col("level") == j)).cast("double")
            models.append(Model(f"{f}={v}", ("arm",), f"{i}={j}"))
        models.append(Model(f"{f}|main", ("arm", *dummies), f"{i}"))
        models.append(Model(f"{f}|crossed", ("arm", *dummies, *[f"arm:{d}" for d in dummies]), f"{i}"))
    try:
        fits = {f.key: f for f in cox_fits(cells, "time", "event", design, models, masks=masks, counts="n", **kw)}
        rows = (cells.where(F.col("arm").isin(0.0, 1.0)).groupBy("factor", "level", "arm")
                .agg(F.sum(F.col("event") * F.col("n")).alias("events"), F.sum("n").alias("total")).collect())
    finally:
        cells.unpersist()
    for fit in fits.values():
        fit.terms = [t.replace("arm", arm, 1) if t == "arm" or t.startswith("arm:") else t for t in fit.terms]
    names = list(subgroups)
    counts = _no_counts(subgroups)
    for r in rows:
        key = "Overall" if r.factor < 0 else f"{names[r.factor]}={list(subgroups[names[r.factor]])[r.level]}"
        counts[key][int(r.arm)] = [int(r.events), int(r.total)]
    return fits, counts


def _interaction_p(main: CoxFit, crossed: CoxFit, arm: str, how: str) -> float | None:
    terms = [t for t in crossed.terms if t.startswith(f"{arm}:")]
    live = [t for t in terms if not math.isnan(crossed.coef[crossed.at(t)])]
    if not live:
        return None
    if how == "wald" or (how == "auto" and len(live) == 1):
        chisq, k = wald_test(crossed, live)
        return normal_two_sided(math.sqrt(chisq)) if k == 1 else chi2_tail(chisq, k)
    return chi2_tail(max(2 * (crossed.loglik - main.loglik), 0.0), len(live))


def _no_counts(subgroups) -> dict[str, list[list[int]]]:
    return {k: [[0, 0], [0, 0]] for k in ["Overall", *[f"{f}={v}" for f, levels in subgroups.items() for v in levels]]}


def _subgroup_counts(df, time, event, arm, subgroups) -> dict[str, list[list[int]]]:
    """Per subgroup key: [events, total] in arm 0 and arm 1; one aggregation for all factors."""
    keys = [F.when(F.col(f).cast("string").isin([str(v) for v in levels]),
                   F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f, levels in subgroups.items()]
    rows = (df.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(arm).isin(0, 1))
            .select(F.col(arm).cast("int").alias("arm"), (F.col(event).cast("int") == 1).cast("long").alias("ev"),
                    F.explode(F.array(F.lit("Overall"), *keys)).alias("key"))
            .where(F.col("key").isNotNull())
            .groupBy("key", "arm").agg(F.sum("ev").alias("events"), F.count(F.lit(1)).alias("total")).collect())
    out = _no_counts(subgroups)
    for r in rows:
        out[r["key"]][r["arm"]] = [int(r["events"]), int(r["total"])]
    return out
