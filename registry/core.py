"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double so that results hash alike on both engines; -0 becomes 0."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, special.get(name, digits)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def lineitem(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Line items as follow-up data: time l_quantity, event = returned."""
    df = table(spark, sf_dir, "lineitem")
    event = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("ev")
    return df.select(*extra, event) if extra else df.select("*", event)


def cdf_gamma(a: str, x: str, terms: int = 400) -> str:
    """DuckDB expression for the regularised lower incomplete gamma, by its power series."""
    x = f"greatest({x}, 1e-300)"
    return (f"list_sum(list_transform(range(0, {terms}), lambda i: "
            f"exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1))))")


def chi2_p(x: str, df: str) -> str:
    """DuckDB expression for the chi-square upper tail."""
    series = cdf_gamma(f"({df}) / 2.0", f"(({x}) / 2.0)")
    # far in the tail the series is long and the answer 0 to every printed place
    return f"CASE WHEN ({x}) > 250 + 2 * ({df}) THEN 0.0 ELSE greatest(0.0, 1 - {series}) END"


def normal_p(z: str) -> str:
    """DuckDB expression for the two-sided normal tail."""
    return chi2_p(f"({z}) * ({z})", "1.0")


def f_p(f: str, d1: str, d2: str, terms: int = 400) -> str:
    """DuckDB expression for the F upper tail, by the series of the incomplete beta."""
    a, b = f"(({d1}) / 2.0)", f"(({d2}) / 2.0)"
    x = f"greatest((({d1}) * ({f})) / (({d1}) * ({f}) + ({d2})), 1e-300)"
    lead = f"{a} * ln({x}) + {b} * ln(1 - {x})"
    series = (f"list_sum(list_transform(range(0, {terms}), lambda i: exp({lead} + i * ln({x}) "
              f"+ lgamma({a} + {b} + i) - lgamma({a} + i + 1) - lgamma({b}))))")
    return f"CASE WHEN ({d1}) * ({f}) > 250 THEN 0.0 ELSE greatest(0.0, 1 - {series}) END"


