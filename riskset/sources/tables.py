"""Reading cohorts and reading and writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_cohort(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """Read a cohort: Parquet, ORC, JSON, or CSV with a header row.

    The format is ``fmt``; without it the path's extension, else CSV.

    Text formats need a declared ``schema``: letting the reader infer one costs a
    pass over all the data. ``columns`` narrows the scan.
    """
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind in ("parquet", "orc"):
        df = reader.format(kind).load(path)
    else:
        if schema is None:
            raise ValueError(f"a schema is needed to read {path}")
        df = reader.json(path) if kind == "json" else reader.option("header", True).csv(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, row_order: Sequence[str] = (), fmt: str = "csv") -> None:
    """Write a result table; missing cells are empty.

    Files have no row order of their own, so ``row_order`` columns are kept in the
    data and also used to sort the files by range, without gathering them in one task.
    """
    if row_order:
        df = df.orderBy(*row_order)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)
    else:
        writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Read back a table written by :func:`write_table`."""
    reader = spark.read.schema(schema)
    if fmt != "csv":
        return reader.format(fmt).load(path)
    return reader.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def with_nan_as_null(df: DataFrame) -> DataFrame:
    """One projection that turns NaN into null in every floating-point column."""
    out = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name, metadata=f.metadata)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*out)
