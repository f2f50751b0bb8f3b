"""Group-comparison tests from counts and moments, many variables per job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.functions.tails import chi2_tail_column, f_tail_column
from riskset.operators.ordering import order_cuts, running_sums
from riskset.operators.small import join_checked


def _long(df: DataFrame, cols: Sequence[str], group: str, as_text: bool) -> DataFrame:
    def cell(c):
        v = F.col(c)
        if as_text:
            return v.cast("string")
        v = v.cast("double")
        return F.when(~F.isnan(v), v)

    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), cell(c).alias("value")) for c in cols]))
    return (df.where(F.col(group).isNotNull()).select(F.col(group).alias("stratum"), entries.alias("__cell"))
            .select("stratum", "__cell.*").where(F.col("value").isNotNull()))


NEAR_ROWS = 1000


def near_values(df: DataFrame, cols: Sequence[str], rows: int = NEAR_ROWS) -> dict[str, float]:
    """A value from the middle of each variable, as the first rows at hand have it; 0 where they hold none.

    Sums are taken about it, so any value of the variable does; only the last digits depend on which.
    """
    clean = [F.when(~F.isnan(v), v) for v in (F.col(c).cast("double") for c in cols)]
    row = df.select(*[c.alias(f"x{i}") for i, c in enumerate(clean)]).limit(rows).agg(
        *[F.percentile_approx(f"x{i}", 0.5) for i in range(len(cols))]).first()
    return {c: v if v is not None and math.isfinite(v) else 0.0 for c, v in zip(cols, row)}


def one_way_anova(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """Equal-variance F test per variable (variable, f_stat, df1, df2, p_value); missing values and NaN left out.

    One pass gives each group's count, mean and variance, from which both sums of squares follow without
    subtracting large numbers: every variable is first moved by a value near its own, so that what is summed is as small as
    the variable's spread, however far from zero it lies.
    """
    return anova_from_moments(group_moments(df, cols, group))


def group_moments(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """(variable, stratum, n, near, m, v, sd): count, and mean, population variance and standard deviation about ``near``, from one pass."""
    near = near_values(df, cols)
    clean = [F.when(~F.isnan(v), v) for v in (F.col(c).cast("double") - F.lit(near[c]) for c in cols)]
    wide = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("stratum")).agg(
        *[x for i, c in enumerate(clean) for x in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"), F.stddev_samp(c).alias(f"s{i}"))])
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n"), F.lit(near[c]).alias("near"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"),
                 F.col(f"s{i}").alias("sd")) for i, c in enumerate(cols)]))
    return wide.select("stratum", entries.alias("__cell")).select("__cell.variable", "stratum", "__cell.n", "__cell.near", "__cell.m", "__cell.v", "__cell.sd")


def anova_from_moments(moments: DataFrame) -> DataFrame:
    """:func:`one_way_anova` from the result of :func:`group_moments`."""
    per_group = moments.where("n > 0")
    whole = per_group.groupBy("variable").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    away = F.col("m") - F.col("mean")
    tot = (per_group.join(F.broadcast(whole), "variable")  # one row per variable
           .groupBy("variable").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
                                    F.sum(F.col("n") * away * away).alias("between"),
                                    F.sum(F.col("n") * F.col("v")).alias("within")))
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = (F.col("between") / F.nullif(df1, F.lit(0))) / F.nullif(F.col("within") / F.nullif(df2, F.lit(0)), F.lit(0.0))
    return tot.select("variable", f.alias("f_stat"), df1.alias("df1"), df2.alias("df2")).withColumn(
        "p_value", f_tail_column(F.col("f_stat"), F.col("df1"), F.col("df2")))


# groups whose counts travel as columns beside each value
GROUPS_AS_COLUMNS = 50


def kruskal_wallis(df: DataFrame, cols: Sequence[str], group: str,
                   rows_per_bucket: int | None = None, groups_as_columns: int = GROUPS_AS_COLUMNS) -> DataFrame:
    """Tie-corrected rank test per variable (variable, h_stat, df, p_value).

    Counts per (variable, value) and group give mid-ranks by a running sum over the
    distinct values; no row is ever ranked alone.
    """
    long = _long(df, cols, group, False)
    groups = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().take(groups_as_columns + 1)]
    wide = 0 < len(groups) <= groups_as_columns
    per_group = ranked_groups(df, cols, group, groups, (), rows_per_bucket) if wide else _rank_sums_long(long, groups, rows_per_bucket)
    return kruskal_from_ranks(per_group)


def kruskal_from_ranks(per_group: DataFrame) -> DataFrame:
    """:func:`kruskal_wallis` from (variable, n, r, tie): each group's size and rank sum, and the variable's ties."""
    # deviations from the mean rank avoid subtracting two huge sums
    per_group, total = per_group.select("variable", "n", "r", "tie"), F.col("total")
    whole = per_group.groupBy("variable").agg(F.sum("n").alias("total"))
    away = F.col("r") / F.col("n") - (total + 1) / 2
    n_all = (per_group.join(F.broadcast(whole), "variable")  # one row per variable
             .groupBy("variable", "total").agg(F.count(F.lit(1)).alias("k"), F.max("tie").alias("tie"),
                                               F.sum(F.col("n") * away * away).alias("spread")))
    h = (12.0 / (total * (total + 1)) * F.col("spread")) / F.nullif(
        1 - F.col("tie") / (total * total * total - total), F.lit(0.0))
    return n_all.select("variable", h.alias("h_stat"), (F.col("k") - 1).alias("df")).withColumn(
        "p_value", chi2_tail_column(F.col("h_stat"), F.col("df")))


def _midranks(ranked: DataFrame, *keep: str) -> DataFrame:
    t = F.col("t").cast("double")
    return ranked.select("variable", "value", *keep, (F.col("cum_t") - t + (t + 1) / 2).alias("midrank"),
                         (t * t * t - t).alias("tie"))


def ranked_groups(df: DataFrame, cols: Sequence[str], group: str, groups: Sequence, probs: Sequence[float] = (),
                  rows_per_bucket: int | None = None) -> DataFrame:
    """(variable, stratum, n, r, tie, q0, q1, ...): each group's size, rank sum among all, and exact interpolated quantiles.

    One structure gives them all: counts per (variable, value) with a column for each group, and their running sums over the
    values. ``groups`` are few; groups without values of a variable are left out.
    """
    long = _long(df, cols, group, False)
    size = range(len(groups))
    counts = [F.count_if(F.col("stratum") == g).alias(f"n{i}") for i, g in enumerate(groups)]
    values = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("t"), *counts)
    along = ["t", *[f"n{i}" for i in size]] if probs else ["t"]
    values, cuts = order_cuts(values, "value", rows_per_bucket)
    ranked = running_sums(values, ["variable"], "value", along, cuts=cuts)
    t = F.col("t").cast("double")
    ranked = ranked.withColumns({"midrank": F.col("cum_t") - t + (t + 1) / 2, "ties": t * t * t - t})
    wanted = []
    if probs:
        totals = values.groupBy("variable").agg(*[F.sum(f"n{i}").alias(f"all{i}") for i in size])
        ranked = ranked.join(F.broadcast(totals), "variable")  # one row per variable
        for i in size:
            for k, p in enumerate(probs):
                h = (F.col(f"all{i}") - 1) * F.lit(float(p))
                holding = lambda r: F.min(F.when(F.col(f"cum_n{i}") >= r + 1, F.col("value")))  # noqa: B023, E731
                wanted += [holding(F.floor(h)).alias(f"lo{i}_{k}"), holding(F.ceil(h)).alias(f"hi{i}_{k}"), F.max(h - F.floor(h)).alias(f"part{i}_{k}")]
    sums = ranked.groupBy("variable").agg(
        F.sum("ties").alias("tie"), *wanted,
        *[x for i in size for x in (F.sum(F.col(f"n{i}").cast("double")).alias(f"n{i}"), F.sum(F.col(f"n{i}") * F.col("midrank")).alias(f"r{i}"))])

    def quantile(i, k):
        a, b = F.col(f"lo{i}_{k}"), F.col(f"hi{i}_{k}")
        return F.when(a == b, a).otherwise(a + F.col(f"part{i}_{k}") * (b - a)).alias(f"q{k}")

    parts = F.explode(F.array(*[F.struct(F.lit(str(g)).alias("stratum"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"),
                                         *[quantile(i, k) for k in range(len(probs))]) for i, g in enumerate(groups)]))
    return sums.select("variable", "tie", parts.alias("__cell")).select("variable", "tie", "__cell.*").where("n > 0")


def _rank_sums_long(long: DataFrame, groups: Sequence, rows_per_bucket: int | None) -> DataFrame:
    """The same for any number of groups, through a join on the value."""
    # used for the ranks and again for the rank sums
    cells = long.groupBy("variable", "value", "stratum").agg(
        F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    values = cells.groupBy("variable", "value").agg(F.sum("n").alias("t"))
    ranked = _midranks(running_sums(values, ["variable"], "value", ["t"], rows_per_bucket=rows_per_bucket))
    ties = ranked.groupBy("variable").agg(F.sum("tie").alias("tie"))
    sums = cells.join(ranked.drop("tie"), ["variable", "value"]).groupBy("variable", "stratum").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("midrank")).alias("r"))
    return sums.join(F.broadcast(ties), "variable").select("variable", "n", "r", "tie")  # one row per variable


def chi_square_independence(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """Pearson chi-square per variable (variable, chi2, df, p_value).

    The continuity correction applies to 2x2 tables only: min(0.5, |O-E|) is taken
    off each deviation.
    """
    cells = _long(df, cols, group, True).groupBy("variable", "value", "stratum").agg(
        F.count(F.lit(1)).alias("n"))
    return chi_square_from_counts(cells)


def chi_square_from_counts(cells: DataFrame) -> DataFrame:
    """The same test from (variable, value, stratum, n) counts.

    Only observed cells are visited: the expected counts of the empty ones add up to
    the rows minus the expected counts of the observed ones.
    """
    cells = cells.where(F.col("n") > 0)
    total = cells.groupBy("variable").agg(F.sum("n").cast("double").alias("total"))
    o = F.col("n").cast("double")
    # a stratum may hold a quarter of all cells: its margin is summed in parts and comes back by a checked broadcast
    rows = cells.groupBy("variable", "value").agg(F.sum(o).alias("rn"))
    columns = cells.groupBy("variable", "stratum").agg(F.sum(o).alias("cn"))
    with_margins = (join_checked(cells.join(rows, ["variable", "value"]), columns, ["variable", "stratum"])
                    .join(F.broadcast(total), "variable"))  # one row per variable
    e = F.col("rn") * F.col("cn") / F.col("total")
    # the cells of a row hold its whole margin, so these sums count rows and add 1/margin once per row
    seen = with_margins.groupBy("variable", "total").agg(
        F.sum((o - e) * (o - e) / e).alias("part"), F.sum(e).alias("covered"), F.max(F.abs(o - e)).alias("gap"),
        F.round(F.sum(o / F.col("rn"))).cast("long").alias("r"), F.round(F.sum(o / F.col("cn"))).cast("long").alias("c"),
        F.sum(o / F.col("rn") / F.col("rn")).alias("r_inv"), F.sum(o / F.col("cn") / F.col("cn")).alias("c_inv"))
    plain = F.col("part") + F.greatest(F.col("total") - F.col("covered"), F.lit(0.0))
    # in a 2x2 table every cell deviates by the same amount
    left = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    corrected = left * left * F.col("total") * F.col("r_inv") * F.col("c_inv")
    stat = F.when((F.col("r") == 2) & (F.col("c") == 2), corrected).otherwise(plain)
    return seen.select("variable", stat.alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("df")).withColumn(
        "p_value", chi2_tail_column(F.col("chi2"), F.col("df")))
