"""Column selection, naming, levels and labels, with strict name checks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.functions.columns import blank_missing
from riskset.functions.columns import factor_code as _code


def _check(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop by name; an unknown name is an error."""
    _check(df, names)
    return df.drop(*names)


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    _check(df, names)
    return df.select(*names)


def select_dynamic(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the columns a computed list names; repeats collapse to the first."""
    return select_columns(df, list(dict.fromkeys(names)))


def rename_suffix(df: DataFrame, pattern: str = "_first$") -> DataFrame:
    """Remove a regex from every column name; colliding results are an error."""
    new = {c: re.sub(pattern, "", c, count=1) for c in df.columns}
    if len(set(new.values())) < len(new):
        raise ValueError("names collide once the suffix is removed")
    return df.withColumnsRenamed({a: b for a, b in new.items() if a != b})


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename old -> new; an unknown name is an error."""
    _check(df, list(mapping))
    return df.withColumnsRenamed(dict(mapping))


def set_levels(df: DataFrame, col: str, levels: Sequence, labels: Sequence[str] | None = None) -> DataFrame:
    """Impose a level order, kept in the column's metadata.

    Values outside ``levels`` become missing. With ``labels`` the values are also
    replaced by their labels and the labels become the levels.
    """
    _check(df, [col])
    names = list(labels) if labels is not None else [str(v) for v in levels]
    if len(names) != len(levels):
        raise ValueError("levels and labels differ in number")
    code = _code(F.col(col), levels)
    value = F.when(code.isNotNull(), F.element_at(F.lit(names), code))
    return df.withColumn(col, value.alias(col, metadata={"levels": names}))


def levels_of(df: DataFrame, col: str) -> list[str]:
    levels = df.schema[col].metadata.get("levels")
    if levels is None:
        raise ValueError(f"{col} carries no levels; call set_levels first")
    return list(levels)


def factor_code(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """The 1-based level code of a levelled column."""
    return df.withColumn(out or col, _code(F.col(col), levels_of(df, col)))


def as_factor(df: DataFrame, col: str, levels: Sequence) -> DataFrame:
    """Turn a coded number into a levelled category."""
    return set_levels(df, col, levels)


def label_rows(df: DataFrame, labels: Mapping[str, str], on: str = "variable", out: str = "label") -> DataFrame:
    """Display label per row; rows without one show their own name.

    The labels are a literal written in the caller's code, so a map expression
    serves and no join is planned.
    """
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.col(on))
    return df.withColumn(out, F.coalesce(found, F.col(on)))


def blank_table(df: DataFrame, blank: str = " ") -> DataFrame:
    """Every column as text, missing cells as ``blank``."""
    return df.select(*[blank_missing(F.col(c), blank).alias(c) for c in df.columns])
