"""Kaplan-Meier curves, risk tables and the log-rank test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskset.functions.tails import chi2_tail
from riskset.operators.cox import VECTORS, add_vectors, vector_batch
from riskset.operators.ordering import order_cuts, running_sums, with_bucket


def _followup(df: DataFrame, time: str, event: str, group: str | None) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit("All")
    t = F.col(time).cast("double")
    out = df.select(g.alias("stratum"), F.when(~F.isnan(t), t).alias("time"),
                    (F.col(event) == 1).cast("int").alias("event"))
    return out.dropna()


def kaplan_meier(df: DataFrame, time: str, event: str, group: str | None = None,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """(stratum, time, n_risk, n_event, n_censor, surv), one row per distinct time.

    Events at a time come before censorings at the same time.
    """
    table = _followup(df, time, event, group).groupBy("stratum", "time").agg(
        F.sum("event").alias("n_event"), F.sum(1 - F.col("event")).alias("n_censor"))
    table, cuts = order_cuts(table.withColumn("left", F.col("n_event") + F.col("n_censor")), "time", rows_per_bucket)
    at_risk = running_sums(table, ["stratum"], "time", ["left"], descending=True, cuts=cuts)
    # log1p is null at -1, where everyone left has the event and the curve drops to 0
    step = F.coalesce(F.log1p(-F.col("n_event") / F.col("cum_left")), F.lit(float("-inf")))
    at_risk = at_risk.select("stratum", "time", F.col("cum_left").alias("n_risk"), "n_event", "n_censor",
                             step.alias("step"))
    curve = running_sums(at_risk, ["stratum"], "time", ["step"], cuts=cuts)
    return curve.select("stratum", "time", "n_risk", "n_event", "n_censor", F.exp("cum_step").alias("surv"))


def risk_table(df: DataFrame, time: str, event: str, group: str | None = None,
               breaks: tuple[float, ...] = (0, 5, 10, 15, 20, 25, 30)) -> DataFrame:
    """(stratum, time, n_risk): subjects whose time is at or after each break; one map-side-combined pass."""
    rows = _followup(df, time, event, group)
    wide = rows.groupBy("stratum").agg(
        *[F.count_if(F.col("time") >= float(b)).alias(f"b{i}") for i, b in enumerate(breaks)])
    entries = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("time"), F.col(f"b{i}").alias("n_risk"))
                                  for i, b in enumerate(breaks)]))
    return wide.select("stratum", entries.alias("__cell")).select("stratum", "__cell.time", "__cell.n_risk")


def censor_marks(curve: DataFrame) -> DataFrame:
    """(stratum, time, surv) where someone is censored."""
    return curve.where(F.col("n_censor") > 0).select("stratum", "time", "surv")


# groups whose counts are columns; the covariance then has a column for each pair
GROUPS_AS_COLUMNS = 30


def logrank_parts(df: DataFrame, time: str, event: str, group: str, rows_per_bucket: int | None = None,
                  groups_as_columns: int = GROUPS_AS_COLUMNS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Groups, observed, expected, covariance and sizes.

    The driver gets the covariance, a number for each pair of groups. Up to ``groups_as_columns`` groups it is one row of
    sums over the times; for more, tasks add up its rows over time buckets.
    """
    rows = _followup(df, time, event, group)
    groups = sorted(r[0] for r in rows.select("stratum").distinct().collect())
    k = len(groups)
    if not k:
        return [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), []
    if k > groups_as_columns:
        return _many_groups(rows, groups, rows_per_bucket)

    def of(i: int, c: Column) -> Column:
        return F.sum(F.when(F.col("stratum") == groups[i], c).otherwise(0))

    per_time = rows.groupBy("time").agg(
        *[of(i, F.lit(1)).alias(f"n{i}") for i in range(k)],
        *[of(i, F.col("event")).alias(f"d{i}") for i in range(k)])
    risk = running_sums(per_time, [], "time", [f"n{i}" for i in range(k)], descending=True,
                        rows_per_bucket=rows_per_bucket)
    n_g = [F.col(f"cum_n{i}").cast("double") for i in range(k)]
    n = sum(n_g[1:], n_g[0])
    d_g = [F.col(f"d{i}").cast("double") for i in range(k)]
    d = sum(d_g[1:], d_g[0])
    spread = F.when(n > 1, d * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    one = risk.agg(
        *[F.sum(d_g[i]).alias(f"o{i}") for i in range(k)],
        *[F.sum(d * n_g[i] / n).alias(f"e{i}") for i in range(k)],
        *[F.sum(spread * n_g[i] * ((n if i == j else F.lit(0.0)) - n_g[j])).alias(f"v{i}_{j}") for i, j in cells],
        *[F.sum(f"n{i}").alias(f"size{i}") for i in range(k)],
    ).first()
    v = np.zeros((k, k))
    for i, j in cells:
        v[i, j] = v[j, i] = one[f"v{i}_{j}"] or 0.0
    obs = np.array([one[f"o{i}"] for i in range(k)], float)
    exp = np.array([one[f"e{i}"] for i in range(k)], float)
    return groups, obs, exp, v, [int(one[f"size{i}"]) for i in range(k)]


def _pair_kernel(k: int):
    """Rows sorted by (bucket, falling time), the first of a bucket with the numbers at risk after it. Yields for each group
    [observed, size, expected, sum of c n n_g] + [sum of c n_g n_h for every h], with c the variance factor of a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, pairs = np.zeros((4, k)), np.zeros((k, k))
        bucket, risk, last, held = None, None, None, []

        def close():
            """Adds up the whole times held, latest first."""
            nonlocal held, risk
            if not held:
                return
            time, who, left, died = (np.concatenate(x) for x in zip(*held))
            held = []
            at = np.cumsum(np.append(0, time[1:] != time[:-1]))
            for lo in range(0, int(at[-1]) + 1, max(1, BLOCK_CELLS // k)):
                part = (at >= lo) & (at < lo + max(1, BLOCK_CELLS // k))
                row = at[part] - lo
                moved = np.zeros((int(row[-1]) + 1, k))
                np.add.at(moved, (row, who[part]), left[part])
                n_g = risk + np.cumsum(moved, axis=0)
                risk = n_g[-1].copy()
                d = np.bincount(row, died[part])
                alone[0] += np.bincount(who[part], died[part], minlength=k)
                alone[1] += moved.sum(axis=0)
                n_g, d = n_g[d > 0], d[d > 0]
                n = n_g.sum(axis=1)
                c = np.where(n > 1, d * (n - d) / (n * n * np.maximum(n - 1, 1)), 0.0)
                alone[2] += (d / n) @ n_g
                alone[3] += (c * n) @ n_g
                pairs[:] += (n_g * c[:, None]).T @ n_g

        for batch in batches:
            of, time, who, left, died = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            first = np.flatnonzero(batch.column(5).is_valid().to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for s, e in zip(cuts, np.append(cuts[1:], len(of)) if len(of) else []):
                if of[s] != bucket:
                    close()
                    bucket, last = of[s], None
                    risk = np.frombuffer(batch.column(5)[int(first[(first >= s) & (first < e)][0])].as_py()).copy()
                # the last time may go on in the next batch
                stop = s + int(np.flatnonzero(np.append(True, time[s + 1:e] != time[s:e - 1]))[-1])
                if last is not None and time[s] != last and stop == s:
                    close()
                if stop > s:
                    held.append(tuple(x[s:stop] for x in (time, who, left, died)))
                    close()
                held.append(tuple(x[stop:e] for x in (time, who, left, died)))
                last = time[e - 1]
        close()
        if bucket is not None:
            rows = np.concatenate([alone.T, pairs], axis=1)
            for lo in range(0, k, 500):
                yield vector_batch([(g, rows[g]) for g in range(lo, min(k, lo + 500))])

    return run


#: numbers at risk, times by groups, that a task holds at once
BLOCK_CELLS = 2_000_000


def _many_groups(rows: DataFrame, groups: list[str], rows_per_bucket: int | None):
    """As :func:`logrank_parts` for any number of groups: each time bucket gets the numbers at risk after it, and adds up its own times."""
    k, spark = len(groups), rows.sparkSession
    number = spark.createDataFrame(list(enumerate(groups)), "who int, stratum string")
    per_time = rows.groupBy("time", "stratum").agg(F.count(F.lit(1)).cast("double").alias("left"), F.sum("event").cast("double").alias("died"))
    per_time = per_time.join(F.broadcast(number), "stratum").select("time", "who", "left", "died")  # one row per group
    per_time, cuts = order_cuts(per_time, "time", rows_per_bucket)
    parted = with_bucket(per_time, "time", cuts, "bucket")
    totals = parted.groupBy("bucket", "who").agg(F.sum("left").alias("left"))
    by_bucket = totals.repartition(1).sortWithinPartitions(F.col("bucket").desc()).mapInArrow(_risk_kernel(k), "of int, later binary")
    pieces = max(2 * len(cuts) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    latest = Window.partitionBy("bucket").orderBy(F.col("time").desc())
    moved = parted.repartition(pieces, "bucket").withColumn("lead", F.row_number().over(latest) == 1)
    fed = moved.join(F.broadcast(by_bucket) if 8 * k * (2 * len(cuts) + 1) <= RISK_BYTES else by_bucket, moved["bucket"] == by_bucket["of"])
    fed = fed.select("bucket", "time", "who", "left", "died", F.when(F.col("lead"), F.col("later")).alias("later"))
    fed = fed.sortWithinPartitions("bucket", F.col("time").desc(), F.col("later").isNull())
    found = add_vectors(fed.mapInArrow(_pair_kernel(k), VECTORS), F.col("bucket")).toArrow()
    table = np.zeros((k, k + 4))
    table[found["bucket"].to_numpy()] = found["stats"].combine_chunks().flatten().to_numpy().reshape(-1, k + 4)
    per_time.unpersist()
    return groups, np.rint(table[:, 0]), table[:, 2], np.diag(table[:, 3]) - table[:, 4:], [round(n) for n in table[:, 1].tolist()]


#: numbers at risk of all buckets that are broadcast at most
RISK_BYTES = 64_000_000


def _risk_kernel(k: int):
    """(bucket, the numbers at risk after it) from each bucket's rows per group, latest bucket first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, after, own = None, np.zeros(k), np.zeros(k)
        for batch in batches:
            out = []
            of, who, left = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for s, e in zip(cuts, np.append(cuts[1:], len(of)) if len(of) else []):
                if of[s] != bucket:
                    bucket, after, own = of[s], after + own, np.zeros(k)
                    out.append((int(bucket), after.tobytes()))
                own += np.bincount(who[s:e], left[s:e], minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], ["of", "later"])

    return run


def logrank(df: DataFrame, time: str, event: str, group: str, rows_per_bucket: int | None = None) -> DataFrame:
    """One row: chisq, df, p_value."""
    groups, obs, exp, v, _ = logrank_parts(df, time, event, group, rows_per_bucket)
    use = [i for i in range(len(groups)) if exp[i] > 0][1:]
    dev = (obs - exp)[use]
    chisq = float(dev @ np.linalg.pinv(v[np.ix_(use, use)]) @ dev) if use else None
    return df.sparkSession.createDataFrame(
        [(chisq, len(use), chi2_tail(chisq, len(use)))], "chisq double, df int, p_value double")


def logrank_table(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Per group: n, observed, expected."""
    groups, obs, exp, _, size = logrank_parts(df, time, event, group)
    return df.sparkSession.createDataFrame(
        [(g, size[i], int(obs[i]), float(exp[i])) for i, g in enumerate(groups)],
        "stratum string, n long, observed long, expected double")
