"""Threshold search and two-piece regression."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.functions.tails import Z_975, chi2_tail
from riskset.operators.cox import CoxBatch, RiskLayout, batch_doubles, model_groups, summary_rows
from riskset.operators.design import hinge_above, hinge_below
from riskset.operators.frame import Model, build_frame
from riskset.operators.glm import GlmBatch, term_row
from riskset.operators.hinges import HingeSums
from riskset.operators.missing import open_interval
from riskset.operators.quantiles import distinct_ranks, quantile_values, type3_rank
from riskset.operators.small import cut_lineage

# candidate percentiles of the coarse scan, half-width of the refinement window, and its limits (fixed values)
COARSE = tuple(0.05 * k for k in range(1, 20))
WINDOW, LOWEST, HIGHEST = 0.04, 0.05, 0.95
ENOUGH = 5

VALUES_ON_DRIVER = 100_000


@dataclass
class Effect:
    """Effect size with its 95% limits and p-value, on the ratio scale for Cox and logistic."""

    estimate: float | None
    lower: float | None
    upper: float | None
    p_value: float | None


class _Family:
    """One persisted layout of the outcome and base terms, on which every stage fits."""

    def __init__(self, df, var, covariates, weight):
        self.var = var
        self.base: dict[str, Column] = {var: F.col(var).cast("double"), **covariates}
        self.others = [t for t in self.base if t != var]
        self.warm: np.ndarray | None = None

    def x(self) -> Column:
        return self.layout.ref(self.var)

    def logliks(self, cuts: Sequence[float], coarse: bool) -> list[float]:
        extra = {f"cut{k}": hinge_above(self.x(), c) for k, c in enumerate(cuts)}
        models = [Model(str(k), (*self.base, f"cut{k}")) for k in range(len(cuts))]
        fits = self.fits(models, extra, coarse)
        if not coarse:
            # neighbouring cuts have neighbouring coefficients: start the next step there
            self.warm = fits[_best([f.loglik for f in fits])].coef
        return [f.loglik for f in fits]

    def quantiles(self, df: DataFrame, probs: Sequence[float]) -> list[float]:
        return quantile_values(df, self.var, probs)

    def values(self, df: DataFrame, low: float, high: float, limit: int) -> "_Values":
        return _Values(df, self.var, low, high, limit)

    def starts(self, models: Sequence[Model]):
        return None if self.warm is None else [self.warm] * len(models)

    def final_models(self) -> list[Model]:
        return [Model("fit0", tuple(self.base)), Model("fit1", (*self.base, "X2")),
                Model("fit2", (*self.others, "X1", "X2"))]

    def hinges(self, cut: float) -> dict[str, Column]:
        return {"X1": hinge_below(self.x(), cut), "X2": hinge_above(self.x(), cut)}


class _Cox(_Family):
    def __init__(self, df, var, covariates, weight, time, event, **layout):
        super().__init__(df, var, covariates, weight)
        widest = [Model(str(k), (*self.base, "cut")) for k in range(len(COARSE))]
        self.layout = RiskLayout(df, time, event, self.base, weight=weight,
                                 doubles=batch_doubles(model_groups(widest)), **layout)

    def fits(self, models, extra, coarse):
        # the coarse scan uses the Breslow likelihood
        ties = "breslow" if coarse else "efron"
        return [f for g in model_groups(models)
                for f in CoxBatch(self.layout, g, ties, extra, self.var).fit(start=self.starts(g))]

    def effects(self, cut):
        fits = CoxBatch(self.layout, self.final_models(), "efron", self.hinges(cut), self.var).fit()

        def effect(fit, term):
            row = {r[2]: r for r in summary_rows(fit)}[term]
            return Effect(row[4], row[8], row[9], row[7])

        return ([effect(fits[0], self.var), effect(fits[1], self.var), effect(fits[2], "X2")],
                fits[0].loglik, fits[2].loglik)


class _Glm(_Family):
    def __init__(self, df, var, covariates, weight, outcome):
        super().__init__(df, var, covariates, weight)
        self.layout = build_frame(df, F.col(outcome).cast("double"), F.lit(0.0), weight, self.base)


class _Logistic(_Glm):
    def fits(self, models, extra, coarse):
        return GlmBatch.over(self.layout, models, extra, self.var).fit_logistic(start=self.starts(models))[0]

    def effects(self, cut):
        batch = GlmBatch.over(self.layout, self.final_models(), self.hinges(cut), self.var)
        fitted = batch.fit_logistic()
        fits = fitted[0]
        wanted = [(0, self.var), (1, self.var), (2, "X2")]
        limits = batch.profile_limits(wanted, fitted)

        def effect(i, term):
            b = fits[i].coef[fits[i].at(term)]
            if math.isnan(b):
                return Effect(None, None, None, None)
            lo, hi = limits[(i, term)]
            return Effect(math.exp(b), None if lo is None else math.exp(lo),
                          None if hi is None else math.exp(hi), term_row(fits[i], term)[3])

        return [effect(i, t) for i, t in wanted], fits[0].loglik, fits[2].loglik


class _Linear(_Family):
    """Every cut's fit follows from sums per distinct value of the variable, taken in one pass."""

    def __init__(self, df, var, covariates, weight, outcome, value_limit):
        super().__init__(df, var, covariates, weight)
        self.layout = HingeSums(df, var, covariates, outcome, weight, value_limit)

    def logliks(self, cuts, coarse):
        return self.layout.logliks(cuts)

    def quantiles(self, df, probs):
        found = self.layout.quantiles(probs)
        return super().quantiles(df, probs) if found is None else found

    def values(self, df, low, high, limit):
        found = self.layout.values(low, high)
        return super().values(df, low, high, limit) if found is None else _Values.of(found)

    def effects(self, cut):
        fits = self.layout.two_piece(cut)

        def effect(fit, term):
            if math.isnan(fit.coef[fit.at(term)]):
                return Effect(None, None, None, None)
            b, se, _, p = term_row(fit, term)
            return Effect(b, b - Z_975 * se, b + Z_975 * se, p)

        return ([effect(fits[0], self.var), effect(fits[1], self.var), effect(fits[2], "X2")],
                fits[0].loglik, fits[2].loglik)


def _family(df, var, family, covariates, weight, value_limit, **kw) -> _Family:
    covariates = dict(covariates or {})
    if family == "cox":
        return _Cox(df, var, covariates, weight, **kw)
    if family in ("binomial", "logistic", "lrm"):
        return _Logistic(df, var, covariates, weight, **kw)
    if family in ("gaussian", "linear"):
        return _Linear(df, var, covariates, weight, value_limit=value_limit, **kw)
    raise ValueError(f"unknown family {family}")


def _best(logliks: Sequence[float]) -> int:
    """First position of the largest value, missing values last."""
    return int(np.argmax([-math.inf if v is None or math.isnan(v) else v for v in logliks]))


class _Values:
    """The distinct observed values inside the window, by rank.

    A few are held as a list; beyond that they stay a ranked, checkpointed table and
    each step looks up only the ranks it needs.
    """

    def __init__(self, df: DataFrame, var: str, low: float, high: float, limit: int):
        x = F.col(var).cast("double")
        inside = df.select(x.alias("value")).where((F.col("value") > low) & (F.col("value") < high))
        few = [r[0] for r in inside.distinct().take(limit + 1)]
        self.table = None
        if len(few) <= limit:
            self.values = sorted(few)
            self.n = len(few)
        else:
            self.table = cut_lineage(distinct_ranks(inside, "value"))
            self.n = self.table.agg(F.max("n")).first()[0]

    @classmethod
    def of(cls, values: Sequence[float]) -> "_Values":
        """Values that are at hand."""
        out = cls.__new__(cls)
        out.table, out.values, out.n = None, sorted(values), len(values)
        return out

    def at(self, ranks: Sequence[int]) -> list[float]:
        if self.table is None:
            return [self.values[r - 1] for r in ranks]
        found = {r.pos: r.value for r in self.table.where(F.col("pos").isin(list(set(ranks)))).collect()}
        return [found[r] for r in ranks]


def _quarters(first: int, last: int) -> list[int]:
    n = last - first + 1
    return [first + type3_rank(n, p) - 1 for p in (0, 0.25, 0.5, 0.75, 1)]


def _next_ranks(first: int, last: int) -> list[int]:
    """The ranks that a step over ``first`` to ``last`` tries."""
    return _quarters(first, last)[1:4] if last - first + 1 > ENOUGH else list(range(first, last + 1))


def _search(fam: _Family, df: DataFrame, low_p: float | None, high_p: float | None, digits: int,
            trace: list | None, value_limit: int) -> float:
    if low_p is None or high_p is None:
        cuts = fam.quantiles(df, COARSE)
        logliks = fam.logliks(cuts, coarse=True)
        best = _best(logliks)
        if trace is not None:
            trace += [("coarse", c, ll, k == best) for k, (c, ll) in enumerate(zip(cuts, logliks))]
        low_p = max(COARSE[best] - WINDOW, LOWEST)
        high_p = min(COARSE[best] + WINDOW, HIGHEST)
    low, high = fam.quantiles(df, [low_p, high_p])
    values = fam.values(df, low, high, value_limit)
    first, last = 1, values.n
    step = 0
    scored: dict[int, tuple[float, float]] = {}  # by rank: (cut, log-likelihood)

    def score(ranks: Sequence[int]) -> None:
        new = sorted(set(ranks) - scored.keys())
        if new:
            cuts = values.at(new)
            scored.update(zip(new, zip(cuts, fam.logliks(cuts, coarse=False))))

    def choose(stage: str, ranks: Sequence[int]) -> int:
        cuts, logliks = zip(*(scored[r] for r in ranks))
        best = _best(logliks)
        if trace is not None:
            trace.extend((stage, c, ll, k == best) for k, (c, ll) in enumerate(zip(cuts, logliks)))
        return best

    while last - first + 1 > ENOUGH:
        ranks = _quarters(first, last)
        if not scored.keys() >= set(ranks[1:4]):
            # the cuts of this step and, whichever of them wins, those of the next
            score([*ranks[1:4], *(r for k in range(3) for r in _next_ranks(ranks[k], ranks[k + 2]))])
        step += 1
        best = choose(f"narrow{step}", ranks[1:4])
        first, last = ranks[best], ranks[best + 2]
    if last < first:
        found = low
    elif last == first:
        found = values.at([first])[0]
    else:
        left = list(range(first, last + 1))
        score(left)
        found = scored[left[choose("final", left)]][0]
    return round(found, digits)


def threshold_search(df: DataFrame, var: str, family: str, covariates: Mapping[str, Column] | None = None,
                     weight: str | None = None, low_p: float | None = None, high_p: float | None = None,
                     digits: int = 3, trace: list | None = None, value_limit: int = VALUES_ON_DRIVER,
                     **outcome) -> float:
    """The cut of ``var`` whose hinge term gives the largest log-likelihood.

    Coarse scan over 19 percentiles, then the distinct observed values in the window
    around the best one are narrowed by quarters until at most five are left to try
    one by one. A pass scores the three cuts of a step together with those that the
    next step would need for each outcome, so that two steps cost one batch of fits. ``low_p``/``high_p`` give the window and skip the scan. ``outcome`` is
    ``time=, event=`` for Cox and ``outcome=`` otherwise. Case weights, when named,
    apply to every stage.
    """
    fam = _family(df, var, family, covariates, weight, value_limit, **outcome)
    try:
        return _search(fam, df, low_p, high_p, digits, trace, value_limit)
    finally:
        fam.layout.release()


def coarse_scan(df: DataFrame, var: str, family: str, covariates: Mapping[str, Column] | None = None,
                weight: str | None = None, **outcome) -> DataFrame:
    """(candidate, prob, cut, loglik) of the 19 coarse candidates."""
    fam = _family(df, var, family, covariates, weight, VALUES_ON_DRIVER, **outcome)
    try:
        cuts = fam.quantiles(df, COARSE)
        logliks = fam.logliks(cuts, coarse=True)
    finally:
        fam.layout.release()
    rows = [(k + 1, round(COARSE[k], 2), float(c), float(ll)) for k, (c, ll) in enumerate(zip(cuts, logliks))]
    return df.sparkSession.createDataFrame(rows, "candidate int, prob double, cut double, loglik double")


def refinement_window(df: DataFrame, var: str, best_p: float) -> DataFrame:
    """(value, low, high): the distinct observed values strictly inside the window around a percentile."""
    low, high = quantile_values(df, var, [max(best_p - WINDOW, LOWEST), min(best_p + WINDOW, HIGHEST)])
    inside = open_interval(df, var, low, high)
    return inside.select(F.col(var).cast("double").alias("value"), F.lit(low).alias("low"), F.lit(high).alias("high"))


RESULT = T.StructType([
    T.StructField("row_order", T.IntegerType()), T.StructField("row", T.StringType()),
    T.StructField("estimate", T.DoubleType()), T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
])
EFFECT_COLUMN = "the effect size, 95%CI, P value"


def threshold_effect(df: DataFrame, var: str, family: str, covariates: Mapping[str, Column] | None = None,
                     cutpoint: float | None = None, weight: str | None = None, **outcome) -> DataFrame:
    """Typed two-piece result, six rows.

    single: effect of ``var`` alone; cutpoint: the inflection point (in ``estimate``);
    below: effect of ``var`` with the upper hinge added; above: effect of the upper
    hinge with both pieces; loglik: the two log-likelihoods (``lower``, ``upper``) and
    their likelihood-ratio statistic; lrt: its p-value.
    """
    fam = _family(df, var, family, covariates, weight, VALUES_ON_DRIVER, **outcome)
    try:
        cut = cutpoint if cutpoint is not None else _search(fam, df, None, None, 3, None, VALUES_ON_DRIVER)
        effects, ll0, ll2 = fam.effects(float(cut))
    finally:
        fam.layout.release()
    stat = 2 * (ll2 - ll0)
    tail = chi2_tail(max(stat, 0.0), 1)
    rows = [
        (1, "single", *_four(effects[0])),
        (2, "cutpoint", float(cut), None, None, None),
        (3, "below", *_four(effects[1])),
        (4, "above", *_four(effects[2])),
        (5, "loglik", stat, ll0, ll2, None),
        (6, "lrt", None, None, None, tail),
    ]
    return df.sparkSession.createDataFrame(rows, RESULT)


def _four(e: Effect):
    return e.estimate, e.lower, e.upper, e.p_value


def number(x: float | None, digits: int = 3) -> str:
    """A rounded number as text: up to 15 significant digits, no trailing zeros, short form for large ones."""
    if x is None or math.isnan(x):
        return "NA"
    x = round(x, digits)
    fixed = f"{x:.15g}"
    if "e" in fixed or x == 0:
        return "0" if x == 0 else fixed
    digits_ = fixed.replace("-", "").replace(".", "").strip("0") or "0"
    sci = f"{x:.{len(digits_) - 1}e}"
    return sci if len(sci) < len(fixed) else fixed


def p_floor(p: float | None, digits: int = 3) -> str:
    if p is None:
        return "NA"
    return "<0." + "0" * (digits - 1) + "1" if p < 10.0**-digits else f"{p:.{digits}f}"


def cut_table(result: DataFrame, digits: int = 3, p_digits: int = 3) -> DataFrame:
    """The printed six-row table (row_order, Outcome, effect text) of a typed two-piece result."""
    r = {x.row: x for x in result.collect()}

    def text(x):
        if x.estimate is None:
            return "NA(NA-NA)NA"
        return (f"{number(x.estimate, digits)}({number(x.lower, digits)}-{number(x.upper, digits)})"
                f"{number(x.p_value, digits)}")

    cut = number(r["cutpoint"].estimate, 15)
    rows = [
        (1, "Model 1 Fitting model by standard linear regression", text(r["single"])),
        (2, "Model 2 Fitting model by two-piecewise linear regression", ""),
        (3, "Inflection point", cut),
        (4, "<" + cut, text(r["below"])),
        (5, ">" + cut, text(r["above"])),
        (6, "P for likelihood ratio test", p_floor(r["lrt"].p_value, p_digits)),
    ]
    return result.sparkSession.createDataFrame(
        rows, T.StructType([T.StructField("row_order", T.IntegerType()), T.StructField("Outcome", T.StringType()),
                            T.StructField(EFFECT_COLUMN, T.StringType())]))


def nested_model_test(fits: DataFrame, pairs: Sequence[tuple[str, str]], df: int = 1) -> DataFrame:
    """(small, large, stat, p_value) for pairs of rows of a fit-statistics table."""
    spec = fits.sparkSession.createDataFrame(list(pairs), "small string, large string")
    small = fits.select(F.col("model").alias("small"), F.col("loglik").alias("ll_small"))
    large = fits.select(F.col("model").alias("large"), F.col("loglik").alias("ll_large"))
    from riskset.functions.tails import chi2_tail_column

    stat = F.greatest(2 * (F.col("ll_large") - F.col("ll_small")), F.lit(0.0))
    return (F.broadcast(spec).join(small, "small").join(large, "large")
            .select("small", "large", stat.alias("stat"))
            .withColumn("p_value", chi2_tail_column(F.col("stat"), F.lit(float(df)))))
