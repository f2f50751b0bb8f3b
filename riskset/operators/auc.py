"""Area under the ROC curve for many predictors per job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.functions.columns import nan_to_null
from riskset.operators.ordering import running_sums


def auc(df: DataFrame, predictors: Mapping[str, Column], outcome: str,
        rows_per_bucket: int | None = None) -> DataFrame:
    """(model_order, Model, C_index, direction, n_cases, n_controls).

    Cases are taken to score higher when the controls' median is at most the cases'
    median, else lower; ties between a case and a control count one half. Rows with a
    missing predictor or outcome are left out, per predictor. Every predictor is
    a key of one counting job, so none is ranked in a single task.
    """
    names = list(predictors)

    def cell(c: Column) -> Column:
        c = c.cast("double")
        return F.when(~F.isnan(c), c)

    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), cell(predictors[n]).alias("value"))
                                  for i, n in enumerate(names)]))
    y = F.col(outcome).cast("int")
    counts = (df.select(y.alias("y"), entries.alias("__cell")).select("y", "__cell.*")
              .where(F.col("y").isin(0, 1) & F.col("value").isNotNull())
              .groupBy("k", "value").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")))
    ranked = running_sums(counts, ["k"], "value", ["n0", "n1"], rows_per_bucket=rows_per_bucket).persist(
        StorageLevel.MEMORY_AND_DISK)
    total = ranked.groupBy("k").agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
    joined = ranked.join(F.broadcast(total), "k")  # one row per predictor

    def holding(n: str, rank: Column) -> Column:
        cum = F.col("cum_" + n)
        return F.max(F.when((cum >= rank) & (cum - F.col(n) < rank), F.col("value")))

    def median(n: str, all_: str) -> Column:
        low = F.floor((F.col(all_) + 1) / 2)
        high = F.floor(F.col(all_) / 2) + 1
        return (holding(n, low) + holding(n, high)) / 2

    below = F.col("cum_n0") - F.col("n0")
    wins = F.sum(F.col("n1") * (below + F.col("n0") / 2))
    pairs = F.nullif(F.col("all0").cast("double") * F.col("all1"), F.lit(0.0))
    one = joined.groupBy("k", "all0", "all1").agg(
        wins.alias("wins"), median("n0", "all0").alias("med0"), median("n1", "all1").alias("med1"))
    higher = F.col("med0") <= F.col("med1")
    area = F.col("wins") / pairs
    return one.select(
        (F.col("k") + 1).alias("model_order"), F.element_at(F.lit(names), F.col("k") + 1).alias("Model"),
        F.when(higher, area).otherwise(1 - area).alias("C_index"),
        F.when(higher, "<").otherwise(">").alias("direction"),
        F.col("all1").alias("n_cases"), F.col("all0").alias("n_controls"))


def roc_points(df: DataFrame, predictor: Column, outcome: str) -> DataFrame:
    """(threshold, sensitivity, specificity) at every distinct predictor value, cases at or above it."""
    y = F.col(outcome).cast("int")
    counts = (df.select(y.alias("y"), nan_to_null(predictor.cast("double")).alias("threshold"))
              .where(F.col("y").isin(0, 1) & F.col("threshold").isNotNull())
              .groupBy("threshold").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")))
    above = running_sums(counts, [], "threshold", ["n1", "n0"], descending=True)
    cases, controls = counts.agg(F.sum("n1"), F.sum("n0")).first()
    return above.select("threshold", (F.col("cum_n1") / F.lit(cases)).alias("sensitivity"),
                        (1 - F.col("cum_n0") / F.lit(controls)).alias("specificity"))
