"""Shared machinery for fitting many models in one pass over the rows.

A batch of models shares one numeric frame. Each pass, every task folds its rows
into one small vector per (model, bucket) with numpy, and Spark adds those vectors
up. Nothing row-shaped leaves the tasks, and a hot time or a hot group is just
a larger partial sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL_SCHEMA = "model int, bucket int, stats array<double>"
# doubles one task may hold for all its partial vectors (32 MB)
STATE_DOUBLES = 4_000_000
CHUNK_ROWS = 50_000


@dataclass(frozen=True)
class Model:
    """One fit of a batch: its terms by name, and the rows it uses.

    ``rows`` names a 0/1 mask column; rows where any of the model's terms is
    missing are left out as well.
    """

    key: str
    terms: tuple[str, ...]
    rows: str | None = None


@dataclass
class Scaling:
    center: np.ndarray
    scale: np.ndarray


@dataclass
class Frame:
    """A projected, persisted numeric frame: two outcome columns, weight, then terms and masks."""

    df: DataFrame
    names: list[str]
    scaling: Scaling
    n_rows: int
    first_mean: float
    index: dict[str, int] = field(default_factory=dict)
    pieces: int | None = None  #: partitions of a persisted frame
    counts: str | None = None  #: the column that tells how many rows one stands for

    def ref(self, name: str) -> Column:
        """A term's column, to build further terms from."""
        return F.col(f"x{self.index[name]}")

    def extended(self, extra: Mapping[str, Column], scale_of: str) -> "Frame":
        """The frame with further terms computed on the fly, scaled like the term they come from."""
        if not extra:
            return self
        k = len(self.names)
        df = self.df.select(*self.df.columns, *extra_columns(k, extra))
        center = np.zeros(len(extra))
        scale = np.full(len(extra), self.scaling.scale[self.index[scale_of]])
        names = [*self.names, *extra]
        scaling = Scaling(np.append(self.scaling.center, center), np.append(self.scaling.scale, scale))
        return Frame(df, names, scaling, self.n_rows, self.first_mean,
                     {n: i for i, n in enumerate(names)}, self.pieces, self.counts)

    def release(self) -> None:
        self.df.unpersist()


def extra_columns(k: int, extra: Mapping[str, Column]) -> list[Column]:
    return [c.cast("double").alias(f"x{k + i}") for i, c in enumerate(extra.values())]


def _column_scales(df: DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Centre and spread of every x column, rows, and the mean of the first outcome; one pass.

    They only condition the fits, so plain sums do.
    """

    def kernel(batches):
        total = np.zeros(2 + 3 * columns)
        for cols in chunks(batches):
            total[0] += len(cols[0])
            total[1] += cols[0].sum()
            if columns:
                x = np.column_stack(cols[3:])
                ok = ~np.isnan(x)
                x = np.where(ok, x, 0.0)
                total[2:] += np.concatenate([ok.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)])
        yield from emit({(0, 0): total})

    v = fold(df, kernel, 2 + 3 * columns).get((0, 0), np.zeros(2 + 3 * columns))
    n, s, ss = v[2:2 + columns], v[2 + columns:2 + 2 * columns], v[2 + 2 * columns:]
    center = s / np.maximum(n, 1)
    var = ss / np.maximum(n, 1) - center**2
    usable = np.isfinite(var) & (var > 1e-10 * center**2) & (var > 0)
    scale = np.sqrt(np.where(usable, var, 1.0))
    return center, scale, int(v[0]), float(v[1] / v[0]) if v[0] else 0.0


def build_frame(df: DataFrame, first: Column, second: Column, weight: str | None,
                design: Mapping[str, Column], masks: Mapping[str, Column] | None = None,
                persist: bool = True) -> Frame:
    """Project to (a, b, w, x0..) doubles and learn each column's centre and scale in one pass."""
    everything = {**design, **(masks or {})}
    names = list(everything)
    num = lambda c: c.cast("double")
    cols = [num(everything[n]).alias(f"x{i}") for i, n in enumerate(names)]
    w = num(F.col(weight)) if weight else F.lit(1.0)
    out = df.select(num(first).alias("a"), num(second).alias("b"), w.alias("w"), *cols)
    out = out.where(F.col("a").isNotNull() & ~F.isnan("a") & F.col("b").isNotNull() & ~F.isnan("b")
                    & (F.col("w") > 0) & ~F.isnan("w"))
    if persist:
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    center, scale, rows, mean = _column_scales(out, len(names))
    for i, n in enumerate(names):
        if n in (masks or {}):
            center[i], scale[i] = 0.0, 1.0
    if persist:
        out = _spread(out, rows)
    # persisted and read by now, so asking for the partitions runs nothing
    pieces = out.rdd.getNumPartitions() if persist else None
    return Frame(out, names, Scaling(center, scale), rows, mean, {n: i for i, n in enumerate(names)}, pieces)


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """Give every core a share when the input came in fewer pieces than there are cores.

    Inputs of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # the frame is persisted and has been read by now, so asking for its partitions runs nothing
    if rows < 20_000 or df.rdd.getNumPartitions() >= cores:
        return df
    wider = df.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    wider.count()
    df.unpersist()
    return wider


@dataclass
class ModelPlan:
    """What a task needs to evaluate one model at its current coefficients (scaled)."""

    cols: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    mask: int | None
    beta: np.ndarray
    counts: int | None = None

    @property
    def p(self) -> int:
        return len(self.cols)

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled design (missing as 0) and which rows count."""
        part = (x[:, self.cols] - self.center) / self.scale
        ok = ~np.isnan(part).any(axis=1)
        if self.mask is not None:
            ok &= x[:, self.mask] == 1.0
        part[~ok] = 0.0
        return part, ok


def model_plan(frame: Frame, model: Model, beta: np.ndarray) -> ModelPlan:
    cols = np.array([frame.index[t] for t in model.terms], dtype=int)
    return ModelPlan(cols, frame.scaling.center[cols], frame.scaling.scale[cols],
                     None if model.rows is None else frame.index[model.rows], beta,
                     None if frame.counts is None else frame.index[frame.counts])


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[list[np.ndarray]]:
    """Arrow batches as float64 columns (null -> NaN), joined up to about ``rows`` rows."""
    held, size = [], 0

    def columns():
        table = pa.Table.from_batches(held)
        return [np.asarray(c.to_numpy(), dtype=np.float64) for c in table.columns]

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= rows:
            yield columns()
            held, size = [], 0
    if held:
        yield columns()


def emit(stats: Mapping[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    items = [(m, b, v) for (m, b), v in stats.items() if v.any()]
    for start in range(0, len(items), 2000):
        part = items[start:start + 2000]
        values = pa.array(np.concatenate([v for *_, v in part]))
        offsets = pa.array(np.cumsum([0] + [len(v) for *_, v in part]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([m for m, *_ in part], pa.int32()), pa.array([b for _, b, _ in part], pa.int32()),
             pa.ListArray.from_arrays(offsets, values)], ["model", "bucket", "stats"])


def fold(df: DataFrame, kernel: Callable, doubles: int, pieces: int | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Run ``kernel`` over every partition and add its vectors up per (model, bucket).

    ``doubles`` bounds one task's vectors, and so the result. When all tasks' vectors
    together are within the same bound they are added on the driver, which saves a
    shuffle; otherwise, and where the number of tasks (``pieces``) is not known, Spark adds them first.
    """
    partial = df.mapInArrow(kernel, PARTIAL_SCHEMA)
    if pieces is None or doubles * pieces > STATE_DOUBLES:
        partial = partial.groupBy("model", "bucket").agg(
            vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("stats"))
    table = partial.toArrow()
    out: dict = {}
    if table.num_rows:
        keys = zip(table["model"].to_pylist(), table["bucket"].to_pylist())
        stats = table["stats"].combine_chunks()
        flat, off = stats.values.to_numpy(), stats.offsets.to_numpy()
        for i, key in enumerate(keys):
            v = flat[off[i]:off[i + 1]]
            out[key] = out[key] + v if key in out else v
    return out


# --- packed symmetric matrices ---------------------------------------------

def packed_size(p: int) -> int:
    return p * (p + 1) // 2


def pack(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(m.shape[0])]


def unpack(v: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = v
    return m + np.triu(m, 1).T


def gram(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x * w[:, None]).T @ x


# --- small solves ------------------------------------------------------------

ALIAS_TOLERANCE = 1e-9


def independent_columns(h: np.ndarray, tol: float = ALIAS_TOLERANCE) -> np.ndarray:
    """Which columns of a Gram-type matrix are not combinations of earlier ones, in column order."""
    h = h.copy()
    start = np.diag(h).copy()
    keep = np.zeros(len(h), bool)
    for j in range(len(h)):
        if start[j] > 0 and h[j, j] > tol * start[j]:
            keep[j] = True
            h = h - np.outer(h[:, j], h[j, :]) / h[j, j]
    return keep


def solve_kept(h: np.ndarray, u: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton step and inverse on the kept columns; dropped ones get 0 and NaN variance."""
    step = np.zeros(len(u))
    cov = np.full(h.shape, np.nan)
    if keep.any():
        inv = np.linalg.inv(h[np.ix_(keep, keep)])
        step[keep] = inv @ u[keep]
        cov[np.ix_(keep, keep)] = inv
    return step, cov
