"""Ordered running sums without a one-task sort.

A value range is cut at approximate quantiles into an alternation of *points*
(the cut values themselves) and the *open* intervals between them. A value held
by a large share of the rows is always a cut value, so an open interval never
holds more than about one bucket's worth of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 65_536
SKETCHES = 32


def cut_values(df: DataFrame, col: str, rows: int, rows_per_bucket: int | None = None) -> list[float]:
    """Sorted distinct cut values; empty when everything fits one bucket.

    Cuts need to be roughly even only. The input's partitions are summarised in ``SKETCHES`` keyed groups, so no single
    task merges them all; each group sends its own grid, and the grids are merged by weight on the driver, which
    holds at most ``SKETCHES`` times the number of cuts.
    """
    n = min(MAX_BUCKETS, math.ceil(rows / (rows_per_bucket or ROWS_PER_BUCKET)))
    if n <= 1:
        return []
    grid = [i / n for i in range(1, n)]
    found = (df.where(F.col(col).isNotNull()).groupBy((F.spark_partition_id() % SKETCHES).alias("k"))
             .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(col, grid, max(10_000, 8 * n)).alias("at")).collect())
    return merged_cuts(sorted((float(v), r["n"] / len(r["at"])) for r in found for v in r["at"]), n)


def merged_cuts(points: Sequence[tuple[float, float]], n: int) -> list[float]:
    """Cuts into ``n`` parts of about the same weight, from sorted (value, weight)."""
    step = sum(w for _, w in points) / n
    cuts, passed = set(), 0.0
    for value, weight in points:
        # a value that spans a whole step is always a cut
        if math.floor(passed / step + 1e-9) != math.floor((passed + weight) / step + 1e-9):
            cuts.add(value)
        passed += weight
    return sorted(cuts)


def with_bucket(df: DataFrame, col: str, cuts: Sequence[float], out: str = "bucket") -> DataFrame:
    """Order-preserving bucket: even = exactly a cut value, odd = between two cuts.

    The bucket is a function of the value alone, so a recomputed task agrees with
    the first run.
    """
    if not cuts:
        return df.withColumn(out, F.lit(1))
    splits = [-math.inf, *cuts, math.inf]
    at = "__at"
    df = Bucketizer(splits=splits, inputCol=col, outputCol=at, handleInvalid="keep").transform(df)
    index = F.col(at).cast("int")
    on_cut = F.when(index > 0, F.col(col) == F.element_at(F.lit(list(cuts)), F.greatest(index, F.lit(1))))
    return df.withColumn(out, F.when(on_cut, 2 * index).otherwise(2 * index + 1)).drop(at)


def order_cuts(df: DataFrame, order: str, rows_per_bucket: int | None = None) -> tuple[DataFrame, list[float]]:
    """``df`` persisted, and the cut values its size calls for."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, cut_values(df, order, df.count(), rows_per_bucket)


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str],
                 descending: bool = False, prefix: str = "cum_",
                 rows_per_bucket: int | None = None, cuts: Sequence[float] | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` over ``order`` within ``keys``.

    ``df`` holds one row per (keys, order). Small inputs use one window per key;
    larger ones sum inside value buckets and add the totals of the buckets before.
    ``cuts`` from an earlier :func:`order_cuts` on the same rows save the sizing pass.
    """
    if cuts is None:
        df, cuts = order_cuts(df, order, rows_per_bucket)
    elif cuts:
        # read for the bucket totals and again for the sums
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    along = F.col(order).desc() if descending else F.col(order).asc()
    if not cuts:
        w = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(along)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.select("*", *[F.sum(c).over(w).alias(prefix + c) for c in sums])

    # keys travel as one struct: equal structs match even where a field is null
    parted = with_bucket(df, order, cuts, "__bucket").withColumn(
        "__key", F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__all")))
    part = ["__key", "__bucket"]
    # at most 2*MAX_BUCKETS rows per key
    totals = parted.groupBy(*part).agg(*[F.sum(c).alias("__t_" + c) for c in sums])
    before = (Window.partitionBy("__key")
              .orderBy(F.col("__bucket").desc() if descending else F.col("__bucket").asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*part, *[F.coalesce(F.sum("__t_" + c).over(before), F.lit(0)).alias("__o_" + c)
                                     for c in sums])
    w = (Window.partitionBy(*part).orderBy(along)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the join and the window share one exchange on (key, bucket)
    return parted.join(offsets, part).select(
        *df.columns, *[(F.sum(c).over(w) + F.col("__o_" + c)).alias(prefix + c) for c in sums])
