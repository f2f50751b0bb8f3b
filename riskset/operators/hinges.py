"""Linear models with one hinge, for any number of cuts from one pass over the rows.

The hinge of a cut c is (x - c) for x > c and 0 elsewhere, so its products with every other term are sums of
(x - c) u over the rows beyond c. One pass adds the other terms up per distinct x, together with the cross-products that have
nothing to do with the cut; the products of any cut then follow from running sums over the distinct values, from the
largest down, in which no large numbers are subtracted.

Up to a limit the distinct values come to the driver. Beyond it they stay a persisted table; cuts are looked up in it, all of
a step in one pass, until the values between two cuts are few enough to come.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.operators.frame import chunks, gram, independent_columns, pack, packed_size, solve_kept, unpack
from riskset.operators.glm import INTERCEPT, GlmFit
from riskset.operators.nonparam import near_values
from riskset.operators.ordering import cut_values, with_bucket

SPANS = 1000  #: spans of values that quantiles are looked up by


def _kernel(shift: Sequence[float], width: int):
    """Rows (part 0, x, rows, rows used, sum of log w, sums of w u) per distinct x; the cross-products in further parts."""
    m = len(shift)

    def kernel(batches):
        total = np.zeros(packed_size(m + 1))
        for cols in chunks(batches):
            w, u = cols[0], np.column_stack(cols[1:]) - np.asarray(shift)
            ok = ~np.isnan(u).any(axis=1) & (w > 0)
            x = cols[1]
            wk = np.where(ok, w, 0.0)
            one = np.column_stack([np.ones(len(w)), np.where(ok[:, None], u, 0.0)])
            total += pack(gram(one, wk))
            sums = np.column_stack([np.ones(len(w)), ok, np.where(ok, np.log(np.where(ok, w, 1.0)), 0.0), one[:, :1] * wk[:, None],
                                    one[:, 2:] * wk[:, None]])
            order = np.argsort(x, kind="stable")[: int((~np.isnan(x)).sum())]
            if len(order):
                x, sums = x[order], sums[order]
                starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                yield _batch(np.zeros(len(starts), int), x[starts], np.add.reduceat(sums, starts, axis=0))
        lines = np.zeros(-(-len(total) // width) * width)
        lines[:len(total)] = total
        lines = lines.reshape(-1, width)
        yield _batch(np.arange(1, len(lines) + 1), np.full(len(lines), np.nan), lines)

    return kernel


def _batch(part, x, sums) -> pa.RecordBatch:
    columns = [pa.array(part, pa.int32()), pa.array(x, mask=np.isnan(x)), *[pa.array(np.ascontiguousarray(sums[:, k])) for k in range(sums.shape[1])]]
    return pa.RecordBatch.from_arrays(columns, ["part", "x", *[f"s{k}" for k in range(sums.shape[1])]])


class HingeSums:
    """The moments of an outcome, a variable and covariates, with those of the variable's hinge at any cut."""

    def __init__(self, df: DataFrame, var: str, covariates: Mapping[str, Column], outcome: str, weight: str | None, limit: int):
        self.var, self.limit, self.spans = var, limit, None
        self.terms = [var, *covariates]
        num = lambda c: c.cast("double")
        y = num(F.col(outcome))
        rows = df.select((num(F.col(weight)) if weight else F.lit(1.0)).alias("w"), num(F.col(var)).alias("u0"),
                         *[num(c).alias(f"u{k}") for k, c in enumerate(covariates.values(), 1)], y.alias(f"u{len(self.terms)}"))
        names = [f"u{k}" for k in range(len(self.terms) + 1)]
        self.shift = list(near_values(rows, names).values())
        width = 3 + len(names)  # rows, rows used, log w, w, then covariates and outcome
        sums = [f"s{k}" for k in range(width)]
        part = rows.mapInArrow(_kernel(self.shift, width), f"part int, x double, {', '.join(f'{s} double' for s in sums)}")
        self.table = part.groupBy("part", "x").agg(*[F.sum(s).alias(s) for s in sums]).persist(StorageLevel.MEMORY_AND_DISK)
        self.sums = sums
        m = len(names)
        lines = -(-packed_size(m + 1) // width)
        found = self.table.limit(limit + lines + 1).toArrow()
        self.whole = found.num_rows <= limit + lines
        got = found if self.whole else self.table.where("part > 0").toArrow()
        part, x, values = (got["part"].to_numpy(), got["x"].to_numpy(), np.column_stack([got[s].to_numpy() for s in sums]))
        order = np.argsort(part[part > 0])
        flat = values[part > 0][order].ravel() if len(order) else np.zeros(packed_size(m + 1))
        self.moments = unpack(flat[:packed_size(m + 1)], m + 1)  # constant, variable, covariates, outcome
        if self.whole:
            self._hold(x[part == 0], values[part == 0], None)
            used, log_w = values[part == 0][:, 1].sum(), values[part == 0][:, 2].sum()
            self.table.unpersist()
        else:
            self.x = None
            used, log_w = self.table.where("part = 0").agg(F.sum("s1"), F.sum("s2")).first()
        self.n, self.log_w = int(round(used)), float(log_w)

    def release(self) -> None:
        self.table.unpersist()

    # --- the values at hand -------------------------------------------------------------

    def _hold(self, x, values, above) -> None:
        """Keeps the running sums over ``x``; ``above``: (r, sums, sums times x - r, squares about r) of all larger values."""
        order = np.argsort(x)
        self.raw, s, self.rows = x[order], values[order][:, 3:], values[order][:, 0]
        self.x = self.raw - self.shift[0]
        k = len(self.x)
        if above is None:
            above = (self.x[-1] if k else 0.0, np.zeros(s.shape[1]), np.zeros(s.shape[1]), 0.0)
        ref, beyond, about, square = self.beyond = above
        upto = np.vstack([np.cumsum(s[::-1], axis=0)[::-1], np.zeros((1, s.shape[1]))]) + beyond  # from a value on
        gap = np.diff(np.append(self.x, ref)) if k else np.zeros(0)
        # moving the cut from one value to the next lower one adds the gap to all rows beyond
        moved = gap[:, None] * upto[1:]
        first = np.vstack([np.cumsum(moved[::-1], axis=0)[::-1], np.zeros((1, s.shape[1]))]) + about
        more = 2 * gap * first[1:, 0] + gap**2 * upto[1:, 0]
        self.from_value, self.first = upto, first
        self.square = np.append(np.cumsum(more[::-1])[::-1], 0.0) + square

    def focus(self, low: float, high: float) -> bool:
        """Brings the values strictly between two numbers to the driver if they are few; whether they are there."""
        if self.whole:
            return True
        inside = self.table.where((F.col("part") == 0) & (F.col("x") > low) & (F.col("x") < high))
        got = inside.limit(self.limit + 1).toArrow()
        if got.num_rows > self.limit:
            return False
        away = F.col("x") - F.lit(high)
        row = self.table.where((F.col("part") == 0) & (F.col("x") >= high)).agg(
            *[F.sum(s) for s in self.sums[3:]], *[F.sum(F.col(s) * away) for s in self.sums[3:]], F.sum(F.col("s3") * away * away)).first()
        v = np.array([r or 0.0 for r in row])
        m = len(self.sums) - 3
        self._hold(got["x"].to_numpy(), np.column_stack([got[s].to_numpy() for s in self.sums]),
                   (high - self.shift[0], v[:m], v[m:2 * m], v[2 * m]))
        self.held = (low, high)
        return True

    def values(self, low: float, high: float) -> list[float] | None:
        """The distinct values strictly between two numbers, or None where they are not at hand."""
        if not self.focus(low, high):
            return None
        return self.raw[(self.raw > low) & (self.raw < high)].tolist()

    def quantiles(self, probs: Sequence[float]) -> list[float | None] | None:
        """Interpolated quantiles of the variable over all rows that have it, or None where they would need too many values."""
        if self.whole:
            total = self.rows.sum()
            at = self._ranked(0.0, self.raw, self.rows)
        else:
            total = self._spans()["upto"].max()
            at = self._looked_up({r for p in probs for r in (math.floor((total - 1) * p), math.ceil((total - 1) * p))})
            if at is None:
                return None
        if not total:
            return [None] * len(probs)
        out = []
        for p in probs:
            h = (total - 1) * p
            a, b = at(math.floor(h)), at(math.ceil(h))
            out.append(a if a == b else a + (h - math.floor(h)) * (b - a))
        return out

    @staticmethod
    def _ranked(below: float, x, rows):
        """The value that holds a rank, counted from 0; ``below`` rows come before ``x``."""
        ends = below + np.cumsum(rows)
        return lambda r: float(x[np.searchsorted(ends, r, side="right")])

    def _spans(self):
        """How many rows lie in each span of values: (bucket, rows, upto), once for all quantiles."""
        if self.spans is None:
            values = self.table.where("part = 0")
            n = values.count()
            self.cuts = cut_values(values, "x", n, max(1, n // SPANS))
            spans = with_bucket(values, "x", self.cuts).groupBy("bucket").agg(F.sum("s0").alias("rows"), F.count(F.lit(1)).alias("values"))
            self.spans = spans.toPandas().sort_values("bucket")
            self.spans["upto"] = self.spans["rows"].cumsum()
        return self.spans

    def _looked_up(self, ranks: set[int]):
        """The values of some ranks, from the spans that hold them; None where those have too many values."""
        spans = self._spans()
        at = np.unique(np.searchsorted(spans["upto"].to_numpy(), sorted(ranks), side="right"))
        wanted = spans.iloc[at]
        if wanted["values"].sum() > self.limit:
            return None
        inside = with_bucket(self.table.where("part = 0"), "x", self.cuts).where(F.col("bucket").isin([int(b) for b in wanted["bucket"]]))
        got = inside.select("bucket", "x", "s0").toPandas().sort_values("x")
        parts = {i: self._ranked(s.upto - s.rows, g["x"].to_numpy(), g["s0"].to_numpy())
                 for i, s in zip(at, wanted.itertuples()) for g in [got[got["bucket"] == s.bucket]]}
        return lambda r: parts[np.searchsorted(spans["upto"].to_numpy(), r, side="right")](r)

    # --- fits ------------------------------------------------------------------------------

    def _products(self, cuts: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """The hinge's products with (constant, covariates, outcome), a row for each cut, and with itself."""
        cuts = np.asarray(cuts, float)
        c = cuts - self.shift[0]
        here = self.whole or (self.x is not None and ((cuts >= self.held[0]) & (cuts < self.held[1])).all())
        if here:
            at = np.searchsorted(self.raw, cuts, side="right")
            ref = self.beyond[0]
            away = np.where(at < len(self.x), self.x[np.minimum(at, len(self.x) - 1)] if len(self.x) else ref, ref) - c
            away = np.where((at == len(self.x)) & (self.from_value[-1, 0] == 0), 0.0, away)
            first = self.first[at] + away[:, None] * self.from_value[at]
            return first, self.square[at] + 2 * away * self.first[at, 0] + away**2 * self.from_value[at, 0]
        beyond = F.col("x")
        sums = []
        for v in cuts.tolist():
            away = F.when(beyond > v, beyond - v).otherwise(0.0)
            sums += [*[F.sum(F.col(s) * away) for s in self.sums[3:]], F.sum(F.col("s3") * away * away)]
        row = np.array([r or 0.0 for r in self.table.where("part = 0").agg(*sums).first()]).reshape(len(c), -1)
        return row[:, :-1], row[:, -1]

    def _fulls(self, cuts: Sequence[float]) -> list[np.ndarray]:
        """Cross-products of (constant, variable, covariates, hinge, outcome) for each cut."""
        first, square = self._products(cuts)
        m = len(self.moments)
        out = []
        for c, h, hh in zip(np.asarray(cuts, float) - self.shift[0], first, square):
            full = np.zeros((m + 1, m + 1))
            old = [*range(m - 1), m]
            full[np.ix_(old, old)] = self.moments
            # x = (x - c) + c beyond the cut
            line = np.concatenate([[h[0], hh + c * h[0]], h[1:-1], [hh, h[-1]]])
            full[m - 1, :] = full[:, m - 1] = line
            out.append(full)
        return out

    def fit(self, full: np.ndarray, key: str, names: Sequence[str], change: np.ndarray | None = None) -> GlmFit:
        """Least squares of the last term on the others; ``change``: the design's columns in terms of them."""
        xx, xy, yy = full[:-1, :-1], full[:-1, -1], full[-1, -1]
        if change is not None:
            xx, xy = change.T @ xx @ change, change.T @ xy
        size = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
        xx, xy = xx / np.outer(size, size), xy / size
        keep = independent_columns(xx)
        # the constant is taken out first: what is left is as small as the columns' spread
        mean = xx[0, 1:] / xx[0, 0] if xx[0, 0] > 0 else np.zeros(len(xy) - 1)
        level = xy[0] / xx[0, 0] if xx[0, 0] > 0 else 0.0
        yy, xy = yy - level * xy[0], xy[1:] - mean * xy[0]
        beta, inner = solve_kept(xx[1:, 1:] - np.outer(mean, mean) * xx[0, 0], xy, keep[1:])
        rss = max(float(yy - beta @ xy), 0.0)
        n, df = self.n, self.n - int(keep.sum())
        ll = -0.5 * n * (math.log(2 * math.pi * rss / n) + 1) + 0.5 * self.log_w if rss > 0 and n else math.nan
        cov = np.full(xx.shape, np.nan)
        cov[1:, 1:] = inner
        if keep[0]:
            known = np.where(np.isnan(inner), 0.0, inner)
            cov[0, 0] = 1 / xx[0, 0] + mean @ known @ mean
            cov[0, 1:] = cov[1:, 0] = np.where(keep[1:], -mean @ known, np.nan)
        coef = np.where(keep, np.append(level - mean @ beta, beta) / size, np.nan)
        return GlmFit(key, "gaussian", [INTERCEPT, *names], coef, cov * (rss / df if df > 0 else math.nan) / np.outer(size, size), ll, n, df, 1, True)

    def logliks(self, cuts: Sequence[float]) -> list[float]:
        """The log-likelihood with each cut's hinge added."""
        return [self.fit(full, str(k), [*self.terms, "hinge"]).loglik for k, full in enumerate(self._fulls(cuts))]

    def two_piece(self, cut: float) -> list[GlmFit]:
        """The fits with the variable alone, with the upper hinge added, and with both pieces in its place."""
        full = self._fulls([cut])[0]
        q, c = len(self.terms), cut - self.shift[0]
        change = np.zeros((q + 2, q + 2))  # constant, covariates, lower piece, upper piece
        change[0, 0] = 1.0
        for k in range(q - 1):
            change[2 + k, 1 + k] = 1.0
        change[[0, 1, q + 1], q] = [-c, 1.0, -1.0]
        change[q + 1, q + 1] = 1.0
        return [self.fit(self.moments, "fit0", self.terms), self.fit(full, "fit1", [*self.terms, "X2"]),
                self.fit(full, "fit2", [*self.terms[1:], "X1", "X2"], change)]
