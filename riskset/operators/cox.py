"""Proportional hazards regression, many models per pass.

Each Newton step needs sums over everyone still at risk at each event time.

* Few distinct times: every time is a bucket of its own. One pass gives, per time,
  the risk-weighted sums of 1, x and xx'; the driver adds them up from the last time
  to the first. No row is ever shuffled, so it does not matter how many share a time.
* Many distinct times: the time range is cut at approximate quantiles, into as many
  buckets as the rows ask for, whatever the models. Cut values stay where they are, as above.
  Rows strictly between two cuts are moved once, in strips of neighbouring buckets of which a partition
  holds several, and kept sorted by bucket and falling time.
  A first pass gives a vector per bucket, holding every model's sums. Spark adds the later
  buckets' vectors up in two levels, runs of buckets first, and joins the sums of a strip's buckets to the
  first of its rows, from which a second pass streams the buckets. The driver gets one
  vector of results.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskset.functions.tails import DIRECT_TIES, Z_975, normal_two_sided, tie_sums
from riskset.operators.frame import (
    CHUNK_ROWS, STATE_DOUBLES, Frame, Model, ModelPlan, build_frame, chunks, emit, extra_columns, fold, gram,
    independent_columns, model_plan, pack, packed_size, solve_kept, unpack,
)
from riskset.operators.ordering import cut_values, with_bucket

MAX_POINTS = 20_000
ROWS_PER_BUCKET = 20_000
ROWS_PER_TASK = 500_000  #: rows between cuts that one task reads; a task for each bucket would cost more than its rows
RESULT_PARTS = 64  #: partial results that come to the driver
MAX_ITER = 20
EPS = 1e-9


@dataclass
class CoxFit:
    key: str
    terms: list[str]
    coef: np.ndarray  # NaN where aliased
    cov: np.ndarray
    loglik0: float
    loglik: float
    n: int
    events: int
    iterations: int
    converged: bool

    def at(self, term: str) -> int:
        return self.terms.index(term)


# --- one model's vector per bucket -------------------------------------------
# [n, s0, d, wd, D0, eta] + s1 + D1 + ex + S2 + D2
_HEAD = 6


def _size(p: int) -> int:
    return _HEAD + 3 * p + 2 * packed_size(p)


def _split(v: np.ndarray, p: int):
    g = packed_size(p)
    a = _HEAD
    return (v[..., :_HEAD], v[..., a:a + p], v[..., a + p:a + 2 * p], v[..., a + 2 * p:a + 3 * p],
            v[..., a + 3 * p:a + 3 * p + g], v[..., a + 3 * p + g:])


def _weights(plan: ModelPlan, x: np.ndarray, event: np.ndarray, w: np.ndarray):
    part, ok = plan.rows(x)
    eta = part @ plan.beta
    with np.errstate(over="ignore"):
        risk = np.where(ok, w * np.exp(eta), 0.0)
    many = 1.0 if plan.counts is None else x[:, plan.counts]
    return part, ok, eta, risk, np.where(ok, event, 0.0), many


def _segment_sums(plan, part, ok, eta, risk, ev, many, w, starts) -> np.ndarray:
    """One packed vector per segment of rows that are already grouped together; ``many``: rows that one stands for."""
    p, n = plan.p, len(risk)
    iu = np.triu_indices(p)
    cols = [ok * many, risk, ev * many, ev * w, ev * risk, ev * w * eta]
    add = lambda z: np.add.reduceat(z, starts, axis=0)
    head = add(np.column_stack(cols))
    rx, ex = part * risk[:, None], part * (ev * w)[:, None]
    parts = [head, add(rx), add(rx * ev[:, None]), add(ex)]
    if p <= 4:
        pairs = rx[:, iu[0]] * part[:, iu[1]]
        parts += [add(pairs), add(pairs * ev[:, None])]
    else:
        ends = np.append(starts[1:], n)
        full = np.empty((len(starts), len(iu[0])))
        died = np.empty_like(full)
        for k, (s, e) in enumerate(zip(starts, ends)):
            full[k] = (part[s:e].T @ rx[s:e])[iu]
            hit = ev[s:e] > 0
            died[k] = (part[s:e][hit].T @ rx[s:e][hit])[iu]
        parts += [full, died]
    return np.concatenate(parts, axis=1)


def _point_kernel(plans: Sequence[ModelPlan], times: np.ndarray):
    """Partial vectors per (model, time)."""

    def kernel(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for cols in chunks(batches):
            t, event, w = cols[0], cols[1], cols[2]
            code, x = np.searchsorted(times, t), np.column_stack(cols[3:])
            order = np.argsort(code, kind="stable")
            code, event, w, x = code[order], event[order], w[order], x[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            for m, plan in enumerate(plans):
                sums = _segment_sums(plan, *_weights(plan, x, event, w), w, starts)
                for b, row in zip(code[starts], sums):
                    at = (m, int(b))
                    held[at] = held[at] + row if at in held else row
        yield from emit(held)

    return kernel


def _tie_table(s0, d0, d, efron):
    """The six per-time sums for arrays of times."""
    out = np.zeros((6, len(s0)))
    single = (d == 1) | (not efron)
    if single.any():
        s, k = s0[single], d[single]
        out[0, single], out[2, single], out[5, single] = k / s, k / s**2, k * np.log(s)
    several = np.flatnonzero(~single & (d <= DIRECT_TIES))
    several = several[np.argsort(d[several], kind="stable")]
    counts, first = np.unique(d[several], return_index=True)
    for k, at in zip(counts, np.split(several, first[1:])):
        f = np.arange(int(k)) / k  # times with as many events go together
        size = max(1, CHUNK_ROWS // len(f))
        for part in (at[j:j + size] for j in range(0, len(at), size)):
            i = 1 / (s0[part, None] - f * d0[part, None])
            fi = f * i
            out[:, part] = i.sum(1), fi.sum(1), (i * i).sum(1), (fi * i).sum(1), (fi * fi).sum(1), -np.log(i).sum(1)
    for i in np.flatnonzero(~single & (d > DIRECT_TIES)):
        out[:, i] = tie_sums(float(s0[i]), float(d0[i]), float(d[i]), True)
    return out


def _cross(a, b, w):
    return (a * w[:, None]).T @ b


def _event_terms(s0, s1, d, wd, d0, d1, efron):
    """Log-likelihood, score and outer-product parts summed over event times; also wa, wb per time."""
    a, b, c2, c3, c4, slog = _tie_table(s0, d0, d, efron)
    mean = wd / d
    wa, wb = mean * a, mean * b
    ll = -(mean * slog).sum()
    score = -(wa @ s1 - wb @ d1)
    mixed = _cross(s1, d1, mean * c3)
    outer = _cross(s1, s1, mean * c2) - mixed - mixed.T + _cross(d1, d1, mean * c4)
    return ll, score, outer, wa, wb


VECTORS = "bucket int, stats array<double>"
#: vectors that Spark does not add up: null bytes cost the rows without one next to nothing
SCANNED = "bucket int, stats binary"
RESULTS = -1  #: the bucket of a row that holds results
LATER = 2**31 - 1  #: the bucket of a row that holds the sums of all later runs of buckets
RUNS_FROM = 256  #: buckets that one task adds up alone


def _starts(sizes: Sequence[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(int)


def vector_batch(rows: Sequence[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0] + [len(v) for _, v in rows]), pa.int32())
    values = pa.array(np.concatenate([v for _, v in rows]) if rows else np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.ListArray.from_arrays(offsets, values)], ["bucket", "stats"])


def _bytes_batch(rows: Sequence[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                                      ["bucket", "stats"])


def _vectors(stats: pa.Array) -> np.ndarray:
    """The vectors of a batch, one in each row."""
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), -1)


def _total_kernel(plans: Sequence[ModelPlan]):
    """Partial vectors per bucket, all models side by side; a task holds a bounded number of them."""
    width = sum(_size(plan.p) for plan in plans)

    def kernel(batches):
        held: dict[int, np.ndarray] = {}
        for cols in chunks(batches):
            event, w, code, x = cols[1], cols[2], cols[3].astype(int), np.column_stack(cols[4:])
            order = np.argsort(code, kind="stable")
            code, event, w, x = code[order], event[order], w[order], x[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            sums = np.concatenate([_segment_sums(plan, *_weights(plan, x, event, w), w, starts) for plan in plans], axis=1)
            for b, row in zip(code[starts].tolist(), sums):
                held[b] = held[b] + row if b in held else row
            if len(held) * width > STATE_DOUBLES:
                yield vector_batch(list(held.items()))
                held = {}
        if held:
            yield vector_batch(list(held.items()))

    return kernel


def _later_kernel(batches):
    """(run, the sum of all later runs' vectors) from runs in falling order."""
    after = None
    for batch in batches:
        v = _vectors(batch.column(1))
        if not len(v):
            continue
        after = np.zeros(v.shape[1]) if after is None else after
        upto = after + np.cumsum(v, axis=0)
        yield vector_batch(list(zip(batch.column(0).to_pylist(), upto - v)))
        after = upto[-1]


def _result_size(p: int) -> int:
    """[log-likelihood, rows, events] + score + information."""
    return 3 + p + packed_size(p)


def _scan_kernel(plans: Sequence[ModelPlan], efron: bool):
    """From bucket vectors by falling bucket within a run: [bucket] + the risk sums [s0, s1, S2] later than each open bucket,
    and the task's results: everything but what goes on inside open buckets."""
    at = _starts([_size(plan.p) for plan in plans])
    into = _starts([_result_size(plan.p) for plan in plans])

    def advance(v, ids, after, results):
        """Adds the results of buckets ``ids``; their offsets, and the sums up to the last one."""
        offsets, upto = [], []
        point = ids % 2 == 0
        for m, plan in enumerate(plans):
            p, r = plan.p, results[into[m]:into[m + 1]]
            head, s1, d1, ex, s2, d2 = _split(v[:, at[m]:at[m + 1]], p)
            own = np.concatenate([head[:, 1:2], s1, s2], axis=1)
            total = (0.0 if after is None else after[m]) + np.cumsum(own, axis=0)
            offsets.append(total - own)
            upto.append(total[-1])
            r[0] += head[:, 5].sum()
            r[1] += head[:, 0].sum()
            r[2] += head[:, 2].sum()
            r[3:3 + p] += ex.sum(axis=0)
            use = point & (head[:, 2] > 0)
            if use.any():
                s0_at, s1_at, s2_at = total[use, 0], total[use, 1:1 + p], total[use, 1 + p:]
                ll, score, outer, wa, wb = _event_terms(s0_at, s1_at, head[use, 2], head[use, 3], head[use, 4], d1[use], efron)
                r[0] += ll
                r[3:3 + p] += score
                r[3 + p:] += wa @ s2_at - wb @ d2[use] - pack(outer)
        return np.concatenate(offsets, axis=1), upto

    def kernel(batches):
        results, run, after = np.zeros(into[-1]), None, None
        for batch in batches:
            runs, ids = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            v = _vectors(batch.column(2))
            cuts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else []
            for s, e in zip(cuts, np.append(cuts[1:], len(runs)) if len(runs) else []):
                if runs[s] != run:
                    run, after = runs[s], None
                if ids[s] == LATER:
                    parts = [_split(v[s, at[m]:at[m + 1]], plan.p) for m, plan in enumerate(plans)]
                    after = [np.concatenate([x[0][1:2], x[1], x[4]]) for x in parts]
                    s += 1
                if s == e:
                    continue
                offsets, after = advance(v[s:e], ids[s:e], after, results)
                open_ = np.flatnonzero(ids[s:e] % 2 == 1)
                if len(open_):
                    yield _bytes_batch([(int(ids[s + k]), np.append(ids[s + k], offsets[k])) for k in open_])
        if run is not None:
            yield _bytes_batch([(RESULTS, results)])

    return kernel


def add_vectors(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.cast("int").alias("bucket")).agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("stats"))


def _later_sums(totals: DataFrame, buckets: int) -> DataFrame:
    """(run, bucket, stats): the buckets dealt into runs, each led by a row with the sums of all later runs."""
    if buckets <= RUNS_FROM:
        return totals.select(F.lit(0).alias("run"), "bucket", "stats").repartition(1)
    size = math.isqrt(buckets) + 1
    run = F.floor(F.col("bucket") / size)
    later = (add_vectors(totals, run).repartition(1).sortWithinPartitions(F.col("bucket").desc()).mapInArrow(_later_kernel, VECTORS)
             .select(F.col("bucket").alias("run"), F.lit(LATER).alias("bucket"), "stats"))
    return totals.select(run.cast("int").alias("run"), "bucket", "stats").unionByName(later).repartition("run")


def _open_kernel(plans: Sequence[ModelPlan], efron: bool):
    """Stream rows sorted by (bucket, falling time); per-task state is one vector per model.

    The last column, ``later``, holds on the first row of a strip of buckets, for each of them, the risk sums [s0, s1, S2]
    of all later buckets.
    """
    at = _starts([1 + plan.p + packed_size(plan.p) for plan in plans])

    class Stream:
        def __init__(self, m, plan):
            self.m, self.plan, self.p = m, plan, plan.p
            self.acc = np.zeros(_result_size(plan.p))
            self.pending = None
            self.bucket = None

        def enter(self, bucket, later):
            if bucket != self.bucket:
                self.bucket = bucket
                off = later[bucket][at[self.m]:at[self.m + 1]]
                self.s0, self.s1 = off[0], off[1:1 + self.p].copy()
                self.s2 = unpack(off[1 + self.p:], self.p)

        def add(self, ll, score, info):
            self.acc[0] += ll
            self.acc[3:3 + self.p] += score
            self.acc[3 + self.p:] += pack(info)

        def close(self, later):
            """Account for the time left unfinished by earlier rows."""
            if self.pending is None:
                return
            bucket, v = self.pending
            self.pending = None
            self.enter(bucket, later)
            head, s1, d1, _, s2, d2 = _split(v, self.p)
            self.s0 += head[1]
            self.s1 = self.s1 + s1
            self.s2 = self.s2 + unpack(s2, self.p)
            if head[2] > 0:
                ll, score, outer, wa, wb = _event_terms(
                    np.array([self.s0]), self.s1[None, :], head[2:3], head[3:4], head[4:5], d1[None, :], efron)
                self.add(ll, score, wa[0] * self.s2 - wb[0] * unpack(d2, self.p) - outer)

        def run(self, bucket, rows, sums, lengths, later):
            """Whole times of one bucket, latest first."""
            self.enter(bucket, later)
            part, ev, risk = rows
            head, s1, d1, _, _, _ = _split(sums, self.p)
            s0_at = self.s0 + np.cumsum(head[:, 1])
            s1_at = self.s1 + np.cumsum(s1, axis=0)
            hit = head[:, 2] > 0
            wa, wb = np.zeros(len(head)), np.zeros(len(head))
            if hit.any():
                ll, score, outer, wa[hit], wb[hit] = _event_terms(
                    s0_at[hit], s1_at[hit], head[hit, 2], head[hit, 3], head[hit, 4], d1[hit], efron)
                from_here = np.cumsum(wa[::-1])[::-1]
                per_row = np.repeat(from_here, lengths) - ev * np.repeat(wb, lengths)
                self.add(ll, score, wa.sum() * self.s2 + gram(part, risk * per_row) - outer)
            self.s0, self.s1 = s0_at[-1], s1_at[-1]
            self.s2 = self.s2 + gram(part, risk)

    def kernel(batches):
        streams = [Stream(m, plan) for m, plan in enumerate(plans)]
        last, sums_of_later, seen = None, {}, set()

        def rows_only():
            """The batches without ``later``, which is kept for the buckets at hand."""
            for batch in batches:
                later = batch.column(batch.num_columns - 1)
                for k in np.flatnonzero(later.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    sums_of_later.update((int(v[0]), v[1:]) for v in np.frombuffer(later[k].as_py()).reshape(-1, 1 + at[-1]))
                yield batch.select(list(range(batch.num_columns - 1)))

        for cols in chunks(rows_only()):
            t, event, w, bucket = cols[0], cols[1], cols[2], cols[3].astype(int)
            x = np.column_stack(cols[4:])
            starts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1])))
            ends = np.append(starts[1:], len(t))
            continues = last is not None and last == (bucket[0], t[0])
            before = np.concatenate([[-1 if last is None else last[0]], bucket])
            new = before[1:] != before[:-1]
            earlier = np.concatenate([[np.inf if last is None else last[1]], t])
            if (~new & (earlier[1:] > earlier[:-1])).any() or seen & set(bucket[new].tolist()):
                raise RuntimeError("rows of a bucket must come together, latest first")
            seen.update(bucket[new].tolist())
            for s in streams:
                part, ok, eta, risk, ev, many = _weights(s.plan, x, event, w)
                sums = _segment_sums(s.plan, part, ok, eta, risk, ev, many, w, starts)
                first = 0
                if continues:
                    s.pending = (s.pending[0], s.pending[1] + sums[0])
                    first = 1
                if first >= len(starts):
                    continue
                s.close(sums_of_later)
                stop = len(starts) - 1
                k = first
                while k < stop:
                    b = bucket[starts[k]]
                    e = k
                    while e < stop and bucket[starts[e]] == b:
                        e += 1
                    rows = slice(starts[k], ends[e - 1])
                    s.run(int(b), (part[rows], ev[rows], risk[rows]), sums[k:e], ends[k:e] - starts[k:e], sums_of_later)
                    k = e
                s.pending = (int(bucket[starts[stop]]), sums[stop])
            last = (bucket[-1], t[-1])
        for s in streams:
            s.close(sums_of_later)
        if last is not None:
            yield vector_batch([(RESULTS, np.concatenate([s.acc for s in streams]))])

    return kernel


class RiskLayout:
    """Rows projected to outcome, weight and base terms, laid out by time once for any number of batches.

    ``doubles`` is the state per time of the largest batch to come, which limits how many times are held as points.
    The buckets of many times depend on the rows alone. ``counts`` names a column of how many equal rows one stands for.
    """

    def __init__(self, df: DataFrame, time: str, event: str, design: Mapping[str, Column],
                 masks: Mapping[str, Column] | None = None, weight: str | None = None,
                 doubles: int = 1, max_points: int | None = None, rows_per_bucket: int | None = None,
                 counts: str | None = None):
        if counts:
            masks, weight = {**(masks or {}), counts: F.col(counts)}, weight or counts
        self.frame: Frame = build_frame(
            df, F.col(time), (F.col(event).cast("double") == 1).cast("double"), weight, design, masks)
        self.frame.counts = counts
        limit = min(MAX_POINTS if max_points is None else max_points, STATE_DOUBLES // max(1, doubles))
        self.times = None
        self.moved = None
        self.parted = None
        times = self.frame.df.agg(F.approx_count_distinct("a", 0.02)).first()[0]
        if times <= 1.1 * limit:
            found = self.frame.df.select("a").distinct().limit(limit + 1).toArrow()["a"].to_numpy()
            if len(found) <= limit:
                self.times = np.sort(found)
        if self.times is None:
            self._cut(ROWS_PER_BUCKET if rows_per_bucket is None else rows_per_bucket)

    def _cut(self, rows_per_bucket: int) -> None:
        base = self.frame.df
        cuts = cut_values(base, "a", self.frame.n_rows, rows_per_bucket)
        parted = with_bucket(base, "a", cuts, "bucket").select("a", "b", "w", "bucket", *base.columns[3:])
        self.buckets = 2 * len(cuts) + 1
        on_cut = F.col("bucket") % 2 == 0
        # only rows strictly between cuts move, neighbouring buckets together; no fewer partitions than a join of the
        # session makes, so that none is ever dealt anew for one
        most = max(math.ceil(self.frame.n_rows / ROWS_PER_TASK), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        pieces = min(most, max(len(cuts) + 1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        # a few strips a partition even out what hashing deals unevenly
        self.strip = 2 * max(1, (len(cuts) + 1) // (4 * pieces))
        latest = Window.partitionBy("strip").orderBy("bucket", F.col("a").desc())
        inner = (parted.where(~on_cut).withColumn("strip", self.strips(F.col("bucket"))).repartition(pieces, "strip")
                 .withColumn("lead", F.row_number().over(latest) == 1))
        self.moved = inner.persist(StorageLevel.MEMORY_AND_DISK)
        still = self.moved.drop("lead", "strip")
        self.points = None
        if cuts:
            # few but for hot times; held, so that an evaluation does not look for them among all rows
            self.points = parted.where(on_cut).persist(StorageLevel.MEMORY_AND_DISK)
        self.parted = self.points.unionByName(still) if cuts else still

    def strips(self, bucket: Column) -> Column:
        """The strip of neighbouring buckets that moves to one partition."""
        return F.floor(bucket / self.strip).cast("int")

    def ref(self, name: str) -> Column:
        return self.frame.ref(name)

    def release(self) -> None:
        if self.moved is not None:
            self.moved.unpersist()
            if self.points is not None:
                self.points.unpersist()
        self.frame.release()


class CoxBatch:
    """Models over one layout, evaluated together.

    ``extra`` adds terms computed from the layout's, on the scale of its term ``scale_of``.
    """

    def __init__(self, layout: RiskLayout, models: Sequence[Model], ties: str = "efron",
                 extra: Mapping[str, Column] | None = None, scale_of: str | None = None):
        if ties not in ("efron", "breslow"):
            raise ValueError(f"unknown ties method {ties}")
        self.efron = ties == "efron"
        self.models = list(models)
        extra = extra or {}
        self.frame = layout.frame.extended(extra, scale_of)
        self.times = layout.times
        added = extra_columns(len(layout.frame.names), extra)
        more = lambda df: df.select("*", *added) if added else df
        if self.times is None:
            self.parted, self.moved, self.buckets, self.strips = more(layout.parted), more(layout.moved), layout.buckets, layout.strips

    def evaluate(self, active: Sequence[int], betas: Sequence[np.ndarray]):
        """(loglik, score, information, n, events) of each active model at its coefficients."""
        plans = [model_plan(self.frame, self.models[i], b) for i, b in zip(active, betas)]
        if self.times is None:
            return self._evaluate_buckets(plans)
        size = sum(_size(plan.p) for plan in plans)
        stats = fold(self.frame.df, _point_kernel(plans, self.times), size * len(self.times), self.frame.pieces)
        per_model: list[list[tuple[int, np.ndarray]]] = [[] for _ in plans]
        for (m, b), v in stats.items():
            per_model[m].append((b, v))
        results = []
        for m, plan in enumerate(plans):
            p = plan.p
            # latest time first
            rows = sorted(per_model[m], key=lambda r: -r[0])
            if not rows:
                results.append([0.0, np.zeros(p), np.zeros((p, p)), 0, 0])
                continue
            head, s1, d1, ex, s2, d2 = _split(np.stack([v for _, v in rows]), p)
            s0_at, s1_at, s2_at = np.cumsum(head[:, 1]), np.cumsum(s1, axis=0), np.cumsum(s2, axis=0)
            ll, score, info = head[:, 5].sum(), ex.sum(axis=0), np.zeros((p, p))
            use = head[:, 2] > 0
            if use.any():
                part_ll, part_score, outer, wa, wb = _event_terms(
                    s0_at[use], s1_at[use], head[use, 2], head[use, 3], head[use, 4], d1[use], self.efron)
                ll, score = ll + part_ll, score + part_score
                info += unpack(wa @ s2_at[use] - wb @ d2[use], p) - outer
            results.append([ll, score, info, int(round(head[:, 0].sum())), int(round(head[:, 2].sum()))])
        return results

    def totals(self, plans: Sequence[ModelPlan]) -> DataFrame:
        """(bucket, stats): every bucket's vector."""
        return add_vectors(self.parted.mapInArrow(_total_kernel(plans), VECTORS), F.col("bucket"))

    def scanned(self, plans: Sequence[ModelPlan], totals: DataFrame | None = None) -> DataFrame:
        """(bucket, stats): the risk sums later than each open bucket, and rows of results."""
        totals = self.totals(plans) if totals is None else totals
        runs = _later_sums(totals, self.buckets).sortWithinPartitions("run", F.col("bucket").desc())
        return runs.mapInArrow(_scan_kernel(plans, self.efron), SCANNED)

    def streamed(self, plans: Sequence[ModelPlan], scanned: DataFrame) -> DataFrame:
        """Rows of results from inside the open buckets. The rows stay where they are; only the buckets' sums come to them."""
        later = scanned.where(F.col("bucket") >= 0).groupBy(self.strips(F.col("bucket")).alias("of")).agg(
            F.aggregate(F.collect_list("stats"), F.lit(bytearray()), lambda all_, one: F.concat(all_, one)).alias("later"))
        rows = self.moved.join(later, self.moved["strip"] == later["of"], "left")
        terms = [c for c in self.moved.columns if c not in ("strip", "lead")]
        return rows.select(*[self.moved[c] for c in terms], F.when(F.col("lead"), F.col("later")).alias("later")).mapInArrow(
            _open_kernel(plans, self.efron), VECTORS)

    def _evaluate_buckets(self, plans: Sequence[ModelPlan]):
        # the buckets' vectors are read for the runs' sums and for the scan
        totals = self.totals(plans).persist(StorageLevel.MEMORY_AND_DISK)
        scanned = self.scanned(plans, totals).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            totals.count()
            found = [np.frombuffer(v) for v in scanned.where(F.col("bucket") < 0).toArrow()["stats"].to_pylist()]
            inner = add_vectors(self.streamed(plans, scanned), F.spark_partition_id() % RESULT_PARTS)
            found += inner.toArrow()["stats"].to_pylist()
        finally:
            scanned.unpersist()
            totals.unpersist()
        at = _starts([_result_size(plan.p) for plan in plans])
        total = np.sum(np.array(found), axis=0) if found else np.zeros(at[-1])
        results = []
        for m, plan in enumerate(plans):
            p, r = plan.p, total[at[m]:at[m + 1]]
            results.append([r[0], r[3:3 + p], unpack(r[3 + p:], p), int(round(r[1])), int(round(r[2]))])
        return results

    def fit(self, max_iter: int = MAX_ITER, eps: float = EPS,
            start: Sequence[np.ndarray] | None = None) -> list[CoxFit]:
        """Newton-Raphson with step halving; converged models drop out of later passes.

        Starts from zero, or from given coefficients to save passes; ``loglik0`` is
        then the log-likelihood there.
        """
        n_models = len(self.models)
        beta = [np.zeros(len(m.terms)) for m in self.models]
        if start is not None:
            beta = [np.nan_to_num(b) * self._scale(m) for b, m in zip(start, self.models)]
        trial = [b.copy() for b in beta]
        state: list = [None] * n_models
        keep: list = [None] * n_models
        loglik0 = [0.0] * n_models
        iterations = [0] * n_models
        converged = [False] * n_models
        active = list(range(n_models))
        for sweep in range(max_iter + 1):
            if not active:
                break
            still = []
            for i, r in zip(active, self.evaluate(active, [trial[i] for i in active])):
                ll, score, info = r[0], r[1], r[2]
                if state[i] is None:
                    loglik0[i] = ll
                    state[i] = r
                    keep[i] = independent_columns(info)
                    if r[4] == 0 or not keep[i].any():
                        converged[i] = r[4] > 0
                        continue
                else:
                    iterations[i] = sweep
                    old = state[i][0]
                    usable = np.isfinite(ll) and np.isfinite(info).all()
                    if usable and abs(1 - old / ll) <= eps:
                        # a last step from sums already at hand; it matters when the
                        # log-likelihood is so large that a relative limit stops early
                        last, _ = solve_kept(info, score, keep[i])
                        beta[i], state[i], converged[i] = trial[i] + last, r, True
                        continue
                    if not usable or ll < old:
                        trial[i] = (trial[i] + beta[i]) / 2
                        still.append(i)
                        continue
                    beta[i], state[i] = trial[i], r
                    # exp() can make a column degenerate on the way
                    keep[i] = keep[i] & independent_columns(np.where(
                        np.outer(keep[i], keep[i]), info, 0.0))
                step, _ = solve_kept(info, score, keep[i])
                trial[i] = beta[i] + step
                still.append(i)
            active = still
        return [self._result(i, beta[i], state[i], keep[i], loglik0[i], iterations[i], converged[i])
                for i in range(n_models)]

    def _scale(self, model: Model) -> np.ndarray:
        return np.array([self.frame.scaling.scale[self.frame.index[t]] for t in model.terms])

    def _result(self, i, beta, state, keep, loglik0, iterations, converged) -> CoxFit:
        model = self.models[i]
        scale = self._scale(model)
        ll, _, info, n, events = state
        if events == 0:
            keep = np.zeros(len(model.terms), bool)
        _, cov = solve_kept(info, np.zeros(len(beta)), keep)
        coef = np.where(keep, beta / scale, np.nan)
        return CoxFit(model.key, list(model.terms), coef, cov / np.outer(scale, scale), float(loglik0), float(ll),
                      n, events, iterations, converged)


# doubles of one bucket's or time's vector in one batch
BATCH_DOUBLES = STATE_DOUBLES // 128


def model_groups(models: Sequence[Model]) -> list[list[Model]]:
    """Models split into batches within the per-task state limit."""
    groups: list[list[Model]] = [[]]
    used = 0
    for m in models:
        need = _size(len(m.terms))
        if groups[-1] and used + need > BATCH_DOUBLES:
            groups.append([])
            used = 0
        groups[-1].append(m)
        used += need
    return groups


def batch_doubles(groups: Sequence[Sequence[Model]]) -> int:
    return max(sum(_size(len(m.terms)) for m in g) for g in groups)


def cox_fits(df: DataFrame, time: str, event: str, design: Mapping[str, Column], models: Sequence[Model],
             masks: Mapping[str, Column] | None = None, ties: str = "efron", **kw) -> list[CoxFit]:
    """Fit all models, as many per pass as the per-task state allows."""
    groups = model_groups(models)
    layout = RiskLayout(df, time, event, design, masks, doubles=batch_doubles(groups), **kw)
    try:
        return [f for g in groups for f in CoxBatch(layout, g, ties).fit()]
    finally:
        layout.release()


def cox_fit(df: DataFrame, time: str, event: str, design: Mapping[str, Column], **kw) -> CoxFit:
    """One model with every term of ``design``."""
    return cox_fits(df, time, event, design, [Model("model", tuple(design))], **kw)[0]


SUMMARY_SCHEMA = ("model string, term_order int, term string, coef double, hr double, se double, z double, "
                  "p_value double, ci_lower double, ci_upper double")
FIT_SCHEMA = ("model string, loglik0 double, loglik double, n long, events long, iterations int, "
              "converged boolean")


def summary_rows(fit: CoxFit) -> list[tuple]:
    rows = []
    for j, term in enumerate(fit.terms):
        b = float(fit.coef[j])
        if math.isnan(b):
            rows.append((fit.key, j + 1, term) + (None,) * 7)
            continue
        se = math.sqrt(fit.cov[j, j])
        z = b / se
        rows.append((fit.key, j + 1, term, b, _exp(b), se, z, normal_two_sided(z),
                     _exp(b - Z_975 * se), _exp(b + Z_975 * se)))
    return rows


def _exp(x: float) -> float:
    return math.exp(x) if x < 709 else math.inf


def cox_summary(spark: SparkSession, fits: Sequence[CoxFit]) -> DataFrame:
    """Coefficient table; aliased terms have nulls."""
    return spark.createDataFrame([r for f in fits for r in summary_rows(f)], SUMMARY_SCHEMA)


def fit_statistics(spark: SparkSession, fits: Sequence[CoxFit]) -> DataFrame:
    return spark.createDataFrame(
        [(f.key, f.loglik0, f.loglik, f.n, f.events, f.iterations, f.converged) for f in fits], FIT_SCHEMA)


def wald_test(fit: CoxFit, terms: Sequence[str]) -> tuple[float, int]:
    """Joint Wald chi-square of some terms and its degrees of freedom (aliased terms left out)."""
    at = [fit.at(t) for t in terms if not math.isnan(fit.coef[fit.at(t)])]
    if not at:
        return float("nan"), 0
    b = fit.coef[at]
    return float(b @ np.linalg.solve(fit.cov[np.ix_(at, at)], b)), len(at)
