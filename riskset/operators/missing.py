"""Missing-data profile, complete-case filters and the outlier fence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.operators.quantiles import quantile_values

_FLOATING = (T.DoubleType, T.FloatType)


def is_missing(df: DataFrame, name: str):
    """Null, or NaN in a floating-point column."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, _FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def require_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Complete cases on ``cols`` (NaN counts as missing)."""
    return df.dropna(how="any", subset=list(cols))


complete_cases = require_present


def fence_bounds(df: DataFrame, col: str, k: float = 3.0) -> tuple[float, float]:
    q1, q3 = quantile_values(df, col, [0.25, 0.75])
    if q1 is None:
        raise ValueError(f"{col} has no values")
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def iqr_fence(df: DataFrame, col: str, k: float = 3.0,
              bounds: tuple[float, float] | None = None) -> DataFrame:
    """Remove rows strictly outside [Q1 - k*IQR, Q3 + k*IQR].

    The bounds come back to the driver as two numbers and enter the plan as
    literals, so the filter reaches the file scan. A row whose value is missing
    (null or NaN) cannot be outside and is kept; only a column found to hold NaN
    pays for that with a filter the file reader cannot use.
    """
    low, high = bounds or fence_bounds(df, col, k)
    keep = F.col(col).between(low, high) | F.col(col).isNull()
    if isinstance(df.schema[col].dataType, _FLOATING) and not df.where(F.isnan(col)).isEmpty():
        keep = keep | F.isnan(col)
    return df.where(keep)


def fence_report(df: DataFrame, col: str, k: float = 3.0,
                 bounds: tuple[float, float] | None = None) -> DataFrame:
    """One row: bounds to 2 decimals, rows before, removed and left."""
    low, high = bounds or fence_bounds(df, col, k)
    outside = ((F.col(col) < low) | (F.col(col) > high)) & ~is_missing(df, col)
    return df.agg(
        F.lit(round(low, 2)).alias("lower_bound"),
        F.lit(round(high, 2)).alias("upper_bound"),
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(outside).alias("n_removed"),
        (F.count(F.lit(1)) - F.count_if(outside)).alias("n_left"),
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """(variable, n_miss, pct_miss), most missing first; one pass for all columns."""
    counts = [F.count_if(is_missing(df, c)).alias(c) for c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *counts)
    long = wide.unpivot("__n", list(df.columns), "variable", "n_miss")
    return long.select(
        "variable",
        F.col("n_miss").cast("long").alias("n_miss"),
        (100.0 * F.col("n_miss") / F.nullif(F.col("__n"), F.lit(0))).alias("pct_miss"),
    ).orderBy(F.desc("n_miss"), "variable")


def sparse_columns(df: DataFrame, share: float = 0.2) -> list[str]:
    """Names whose missing share is above ``share``, in column order."""
    rows = {r.variable: r for r in missing_profile(df).collect()}
    total = df.columns
    return [c for c in total if (rows[c].pct_miss or 0.0) > 100.0 * share + 1e-9]


def drop_sparse_columns(df: DataFrame, share: float = 0.2) -> tuple[DataFrame, list[str]]:
    """Keep columns with a missing share of at most ``share``; also the dropped names."""
    dropped = sparse_columns(df, share)
    return df.drop(*dropped), dropped


def filter_p(df: DataFrame, alpha: float = 0.05, p: str = "P_Value") -> DataFrame:
    return df.where(F.col(p) < alpha)


def significant_names(df: DataFrame, alpha: float = 0.05, p: str = "P_Value",
                      name: str = "Variable", order: str | None = None) -> list[str]:
    """Distinct variable names with any p below ``alpha``, in result order.

    One row per fitted coefficient, so the list is as long as the design is wide.
    """
    rows = filter_p(df, alpha, p)
    rows = rows.orderBy(order) if order else rows
    return list(dict.fromkeys(r[0] for r in rows.select(name).collect()))


def open_interval(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Distinct values strictly between the bounds."""
    return df.select(col).where((F.col(col) > low) & (F.col(col) < high)).distinct()


def closed_interval(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(col) >= low) & (F.col(col) <= high))
