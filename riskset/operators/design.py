"""Design columns: dummies, splines and hinges, as Column expressions.

A design is an ordered ``{term name: Column}``; models refer to terms by name, so
one projection serves every model fitted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.operators.clean import levels_of
from riskset.operators.quantiles import quantile_values

Design = dict[str, Column]


def numeric_terms(*names: str) -> Design:
    return {n: F.col(n).cast("double") for n in names}


def dummy_code(col: str, levels: Sequence, prefix: str | None = None) -> Design:
    """Treatment contrasts against the first level; term name = column + level."""
    prefix = col if prefix is None else prefix
    c = F.col(col).cast("string")
    known = c.isin([str(v) for v in levels])
    return {f"{prefix}{v}": F.when(c == str(v), 1.0).when(known, 0.0) for v in list(levels)[1:]}


def variable_terms(df: DataFrame, name: str) -> Design:
    """Dummies for a column that carries levels, else the number itself."""
    if df.schema[name].metadata.get("levels"):
        return dummy_code(name, levels_of(df, name))
    if dict(df.dtypes)[name] == "string":
        raise ValueError(f"{name} is text without levels; call set_levels first")
    return numeric_terms(name)


def design_for(df: DataFrame, names: Sequence[str]) -> Design:
    out: Design = {}
    for n in names:
        out.update(variable_terms(df, n))
    return out


# default spline knot quantiles by number of knots (fixed values)
KNOT_PROBS = {
    3: (0.10, 0.50, 0.90),
    4: (0.05, 0.35, 0.65, 0.95),
    5: (0.05, 0.275, 0.50, 0.725, 0.95),
    6: (0.05, 0.23, 0.41, 0.59, 0.77, 0.95),
    7: (0.025, 0.1833, 0.3417, 0.50, 0.6583, 0.8167, 0.975),
}


def rcs_knots(df: DataFrame, col: str, knots: int = 3) -> list[float]:
    return [float(v) for v in quantile_values(df, col, KNOT_PROBS[knots])]


def rcs_basis(col: str | Column, knots: Sequence[float], name: str | None = None) -> Design:
    """Restricted cubic spline: the linear term and one truncated-cubic term per inner interval.

    term_j = [(x-t_j)+^3 - (x-t_{k-1})+^3 (t_k-t_j)/(t_k-t_{k-1})
              + (x-t_k)+^3 (t_{k-1}-t_j)/(t_k-t_{k-1})] / (t_k-t_1)^2
    """
    x = F.col(col) if isinstance(col, str) else col
    name = name or str(col)
    t = [float(k) for k in knots]
    first, last, before = t[0], t[-1], t[-2]

    def cube(k: float) -> Column:
        d = F.when(x > k, x - k).when(x.isNotNull(), 0.0)
        return d * d * d

    out: Design = {name: x.cast("double")}
    for j in range(len(t) - 2):
        term = (cube(t[j]) - cube(before) * ((last - t[j]) / (last - before))
                + cube(last) * ((before - t[j]) / (last - before)))
        out[name + "'" * (j + 1)] = term / (last - first) ** 2
    return out


def rcs_values(x: float, knots: Sequence[float]) -> list[float]:
    """The same basis for one number."""
    t = list(knots)
    first, last, before = t[0], t[-1], t[-2]
    cube = lambda k: max(x - k, 0.0) ** 3
    return [x] + [
        (cube(t[j]) - cube(before) * (last - t[j]) / (last - before)
         + cube(last) * (before - t[j]) / (last - before)) / (last - first) ** 2
        for j in range(len(t) - 2)]


def _x(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def hinge_above(c: str | Column, cut: float) -> Column:
    """(x > cut) * (x - cut)."""
    x = _x(c)
    return F.when(x > cut, x - cut).when(x.isNotNull(), 0.0)


def hinge_below(c: str | Column, cut: float) -> Column:
    """(x <= cut) * (x - cut)."""
    x = _x(c)
    return F.when(x <= cut, x - cut).when(x.isNotNull(), 0.0)


MAX_LEVELS = 1000


def with_levels(df: DataFrame, names: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """Give text columns that carry no levels their sorted distinct values as levels.

    Every level becomes a model column, so a text with more than ``max_levels`` values is refused.
    """
    for n in names:
        if dict(df.dtypes)[n] == "string" and not df.schema[n].metadata.get("levels"):
            found = df.select(n).where(F.col(n).isNotNull()).distinct().take(max_levels + 1)
            if len(found) > max_levels:
                raise ValueError(f"{n} has more than {max_levels} distinct texts; it is not a category")
            levels = sorted(r[0] for r in found)
            df = df.withColumn(n, F.col(n).alias(n, metadata={"levels": levels}))
    return df
