"""Logistic and linear regression, many models per pass, and profile intervals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskset.functions.tails import CHI2_1_95, Z_975, normal_two_sided, t_two_sided
from riskset.operators.frame import (
    Frame, Model, ModelPlan, build_frame, chunks, emit, fold, gram, independent_columns,
    model_plan, pack, packed_size, solve_kept, unpack,
)

INTERCEPT = "(Intercept)"
LOGIT_MAX_ITER = 25
LOGIT_EPS = 1e-8


@dataclass
class GlmFit:
    key: str
    family: str
    terms: list[str]  # the intercept first
    coef: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    df_residual: int
    iterations: int
    converged: bool

    def at(self, term: str) -> int:
        return self.terms.index(term)


def _with_one(plan: ModelPlan, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    part, ok = plan.rows(x)
    return np.column_stack([ok.astype(float), part]), ok


def _logit_kernel(plans: Sequence[ModelPlan]):
    """[n, loglik] + score + information."""

    def kernel(batches):
        held: dict = {}
        for cols in chunks(batches):
            y, w, x = cols[0], cols[2], np.column_stack(cols[3:]) if len(cols) > 3 else np.empty((len(cols[0]), 0))
            for m, plan in enumerate(plans):
                part, ok = _with_one(plan, x)
                eta = part @ plan.beta
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                wk = np.where(ok, w, 0.0)
                ll = (wk * (y * eta - np.logaddexp(0.0, eta))).sum()
                v = np.concatenate([[ok.sum(), ll], part.T @ (wk * (y - mu)), pack(gram(part, wk * mu * (1 - mu)))])
                held[(m, 0)] = held.get((m, 0), 0.0) + v
        yield from emit(held)

    return kernel


def _moment_kernel(plans: Sequence[ModelPlan]):
    """[n, sum w, sum wyy, sum log w] + X'wy + X'wX, y taken about a shared centre."""

    def kernel(batches):
        held: dict = {}
        for cols in chunks(batches):
            y, w, x = cols[0], cols[2], np.column_stack(cols[3:]) if len(cols) > 3 else np.empty((len(cols[0]), 0))
            for m, plan in enumerate(plans):
                part, ok = _with_one(plan, x)
                wk = np.where(ok, w, 0.0)
                v = np.concatenate([[ok.sum(), wk.sum(), (wk * y * y).sum(), np.log(w[ok]).sum()],
                                    part.T @ (wk * y), pack(gram(part, wk))])
                held[(m, 0)] = held.get((m, 0), 0.0) + v
        yield from emit(held)

    return kernel


class GlmBatch:
    def __init__(self, df: DataFrame, outcome: Column, design: Mapping[str, Column], models: Sequence[Model],
                 masks: Mapping[str, Column] | None = None, weight: str | None = None, persist: bool = True):
        self.models = list(models)
        # the second outcome slot is unused here
        self.frame: Frame = build_frame(df, outcome, F.lit(0.0), weight, design, masks, persist)

    @classmethod
    def over(cls, frame: Frame, models: Sequence[Model], extra: Mapping[str, Column] | None = None,
             scale_of: str | None = None) -> "GlmBatch":
        """A batch on an existing frame, with further terms computed from the frame's."""
        batch = cls.__new__(cls)
        batch.models, batch.frame = list(models), frame.extended(extra or {}, scale_of)
        return batch

    def release(self) -> None:
        self.frame.release()

    def _forth(self, m: Model, coef: np.ndarray) -> np.ndarray:
        plan = model_plan(self.frame, m, coef)
        return np.concatenate([[coef[0] + coef[1:] @ plan.center], coef[1:] * plan.scale])

    def _back(self, m: Model, beta: np.ndarray, cov: np.ndarray):
        """Coefficients and covariance on the original scale."""
        q = len(beta)
        plan = model_plan(self.frame, m, beta)
        a = np.zeros((q, q))
        a[0, 0] = 1.0
        for j in range(q - 1):
            a[j + 1, j + 1] = 1 / plan.scale[j]
            a[0, j + 1] = -plan.center[j] / plan.scale[j]
        kept = ~np.isnan(np.diag(cov))
        c = np.full((q, q), np.nan)
        part = a[np.ix_(kept, kept)]
        c[np.ix_(kept, kept)] = part @ cov[np.ix_(kept, kept)] @ part.T
        return np.where(kept, a @ np.where(kept, beta, 0.0), np.nan), c

    def logistic_at(self, active: Sequence[int], betas: Sequence[np.ndarray]):
        plans = [model_plan(self.frame, self.models[i], b) for i, b in zip(active, betas)]
        stats = fold(self.frame.df, _logit_kernel(plans), sum(2 + p.p + 1 + packed_size(p.p + 1) for p in plans), self.frame.pieces)
        out = []
        for m, plan in enumerate(plans):
            q = plan.p + 1
            v = stats.get((m, 0), np.zeros(2 + q + packed_size(q)))
            out.append((float(v[1]), v[2:2 + q], unpack(v[2 + q:], q), int(v[0])))
        return out

    def fit_logistic(self, max_iter: int = LOGIT_MAX_ITER, eps: float = LOGIT_EPS,
                     start: Sequence[np.ndarray] | None = None):
        """Newton from zero, or from given coefficients; returns the fits and the
        scaled (beta, state, keep) that profile limits need."""
        k = len(self.models)
        beta = [np.zeros(len(m.terms) + 1) for m in self.models]
        if start is not None:
            beta = [self._forth(m, np.nan_to_num(b)) for m, b in zip(self.models, start)]
        trial = [b.copy() for b in beta]
        state: list = [None] * k
        keep: list = [None] * k
        its, done = [0] * k, [False] * k
        active = list(range(k))
        for sweep in range(max_iter + 1):
            if not active:
                break
            still = []
            for i, r in zip(active, self.logistic_at(active, [trial[i] for i in active])):
                if state[i] is None:
                    keep[i] = independent_columns(r[2])
                else:
                    its[i] = sweep
                    if not np.isfinite(r[0]) or r[0] < state[i][0] - 1e-12 * abs(state[i][0]):
                        trial[i] = (trial[i] + beta[i]) / 2
                        still.append(i)
                        continue
                    # deviance criterion
                    dev, old = -2 * r[0], -2 * state[i][0]
                    if abs(dev - old) / (abs(dev) + 0.1) < eps:
                        # a last step from sums already at hand
                        last, _ = solve_kept(r[2], r[1], keep[i])
                        beta[i], state[i], done[i] = trial[i] + last, r, True
                        continue
                beta[i], state[i] = trial[i], r
                if not keep[i].any():
                    continue
                step, _ = solve_kept(r[2], r[1], keep[i])
                trial[i] = beta[i] + step
                still.append(i)
            active = still
        fits = []
        for i, m in enumerate(self.models):
            _, cov = solve_kept(state[i][2], np.zeros(len(beta[i])), keep[i])
            coef, cov = self._back(m, beta[i], cov)
            n = state[i][3]
            fits.append(GlmFit(m.key, "binomial", [INTERCEPT, *m.terms], coef, cov, state[i][0], n,
                               n - int(keep[i].sum()), its[i], done[i]))
        return fits, beta, state, keep

    def profile_limits(self, wanted: Sequence[tuple[int, str]], fitted, max_iter: int = 30):
        """Profile-likelihood 95% limits for (model index, term) pairs, all solved together.

        For each limit, Newton on: log-likelihood = maximum - 3.84/2, and zero score
        for every other coefficient.
        """
        _, beta, state, keep = fitted
        jobs = []
        for i, term in wanted:
            j = self.models[i].terms.index(term) + 1
            kept = np.flatnonzero(keep[i])
            if j not in kept:
                continue
            inv = np.linalg.inv(state[i][2][np.ix_(kept, kept)])
            at = list(kept).index(j)
            for sign in (-1.0, 1.0):
                b = beta[i].copy()
                b[kept] += sign * math.sqrt(CHI2_1_95 / inv[at, at]) * inv[:, at]
                jobs.append(dict(i=i, term=term, j=j, sign=sign, b=b, kept=kept, done=False, size=math.inf))
        for _ in range(max_iter):
            live = [x for x in jobs if not x["done"]]
            if not live:
                break
            for x, r in zip(live, self.logistic_at([x["i"] for x in live], [x["b"] for x in live])):
                kept, at = x["kept"], list(x["kept"]).index(x["j"])
                target = state[x["i"]][0] - CHI2_1_95 / 2
                jac = -r[2][np.ix_(kept, kept)]
                rhs = r[1][kept].copy()
                jac[at], rhs[at] = r[1][kept], r[0] - target
                step = -np.linalg.solve(jac, rhs)
                size = float(np.abs(step).max())
                limit = 2.0 * max(1.0, float(np.abs(x["b"] - beta[x["i"]]).max()))
                if size > limit:
                    step *= limit / size
                x["b"][kept] += step
                x["done"] = size < 1e-9 * max(1.0, float(np.abs(x["b"]).max()))
        out = {}
        for x in jobs:
            scale = self.frame.scaling.scale[self.frame.index[x["term"]]]
            out.setdefault((x["i"], x["term"]), {})[x["sign"]] = (
                float(x["b"][x["j"]] / scale) if x["done"] else None)
        return {k: (v.get(-1.0), v.get(1.0)) for k, v in out.items()}

    def fit_linear(self) -> list[GlmFit]:
        """Closed form from one pass; the log-likelihood uses the maximum-likelihood variance."""
        plans = [model_plan(self.frame, m, np.zeros(len(m.terms) + 1)) for m in self.models]
        shift = self.frame.first_mean
        shifted = self.frame.df.withColumn("a", F.col("a") - F.lit(shift))
        stats = fold(shifted, _moment_kernel(plans), sum(4 + p.p + 1 + packed_size(p.p + 1) for p in plans), self.frame.pieces)
        fits = []
        for i, m in enumerate(self.models):
            q = len(m.terms) + 1
            v = stats.get((i, 0), np.zeros(4 + q + packed_size(q)))
            n, yy, xy, xx = int(v[0]), v[2], v[4:4 + q], unpack(v[4 + q:], q)
            keep = independent_columns(xx)
            beta, cov = solve_kept(xx, xy, keep)
            rss = max(float(yy - beta @ xy), 0.0)
            df = n - int(keep.sum())
            ll = -0.5 * n * (math.log(2 * math.pi * rss / n) + 1) + 0.5 * float(v[3]) if rss > 0 and n else math.nan
            coef, cov = self._back(m, beta, cov * (rss / df if df > 0 else math.nan))
            coef[0] += shift
            fits.append(GlmFit(m.key, "gaussian", [INTERCEPT, *m.terms], coef, cov, ll, n, df, 1, True))
        return fits


def _binary(outcome: str) -> Column:
    return F.col(outcome).cast("double")


def logistic_fits(df: DataFrame, outcome: str, design: Mapping[str, Column], models: Sequence[Model],
                  **kw) -> list[GlmFit]:
    batch = GlmBatch(df, _binary(outcome), design, models, **kw)
    try:
        return batch.fit_logistic()[0]
    finally:
        batch.release()


def linear_fits(df: DataFrame, outcome: str, design: Mapping[str, Column], models: Sequence[Model],
                **kw) -> list[GlmFit]:
    batch = GlmBatch(df, F.col(outcome), design, models, **kw)
    try:
        return batch.fit_linear()
    finally:
        batch.release()


def logistic_fit(df: DataFrame, outcome: str, design: Mapping[str, Column], **kw) -> GlmFit:
    return logistic_fits(df, outcome, design, [Model("model", tuple(design))], **kw)[0]


def linear_fit(df: DataFrame, outcome: str, design: Mapping[str, Column], **kw) -> GlmFit:
    return linear_fits(df, outcome, design, [Model("model", tuple(design))], **kw)[0]


SUMMARY_SCHEMA = ("model string, term_order int, term string, coef double, se double, statistic double, "
                  "p_value double, ci_lower double, ci_upper double, loglik double, n long")


def term_row(fit: GlmFit, term: str) -> tuple[float, float, float, float]:
    """coef, se, statistic, p: normal tail for logistic, t tail for linear fits."""
    j = fit.at(term)
    se = math.sqrt(fit.cov[j, j])
    stat = fit.coef[j] / se
    p = normal_two_sided(stat) if fit.family == "binomial" else t_two_sided(stat, fit.df_residual)
    return float(fit.coef[j]), se, float(stat), float(p)


def glm_summary(spark: SparkSession, fits: Sequence[GlmFit]) -> DataFrame:
    """Coefficient table with Wald limits; aliased terms have nulls."""
    rows = []
    for f in fits:
        for j, term in enumerate(f.terms):
            if math.isnan(f.coef[j]):
                rows.append((f.key, j, term) + (None,) * 6 + (f.loglik, f.n))
                continue
            b, se, stat, p = term_row(f, term)
            rows.append((f.key, j, term, b, se, stat, p, b - Z_975 * se, b + Z_975 * se, f.loglik, f.n))
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def linear_predictor(fit: GlmFit, design: Mapping[str, Column]) -> Column:
    """The fitted linear predictor as a column expression (aliased terms count as 0)."""
    out = F.lit(float(fit.coef[0]))
    for t, b in zip(fit.terms[1:], fit.coef[1:]):
        if not math.isnan(b):
            out = out + F.lit(float(b)) * design[t]
    return out


def fitted_probability(fit: GlmFit, design: Mapping[str, Column]) -> Column:
    return 1 / (1 + F.exp(-linear_predictor(fit, design)))
