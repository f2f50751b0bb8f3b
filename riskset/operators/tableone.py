"""Baseline characteristics table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskset.functions.columns import format_p_floor, round_n
from riskset.operators.nonparam import (
    GROUPS_AS_COLUMNS, anova_from_moments, chi_square_from_counts, group_moments, kruskal_from_ranks, kruskal_wallis, ranked_groups,
)
from riskset.operators.quantiles import quantile7

OVERALL = "Overall"


def continuous_moments(df: DataFrame, cols: Sequence[str], stratum: str) -> DataFrame:
    """(variable, stratum, n, mean, sd)."""
    return _means(group_moments(df, cols, stratum))


def _means(moments: DataFrame) -> DataFrame:
    return moments.select("variable", "stratum", "n", (F.col("near") + F.col("m")).alias("mean"), "sd")


def continuous_medians(df: DataFrame, cols: Sequence[str], stratum: str) -> DataFrame:
    """(variable, stratum, median, q1, q3)."""
    keyed = df.withColumn("__stratum", F.col(stratum).cast("string"))
    q = quantile7(keyed, cols, [0.25, 0.5, 0.75], ["__stratum"])

    def at(p, name):
        return F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)

    return q.groupBy("variable", F.col("__stratum").alias("stratum")).agg(
        at(0.5, "median"), at(0.25, "q1"), at(0.75, "q3"))


def _levels(df: DataFrame, cols: Sequence[str], cells: DataFrame) -> DataFrame:
    """(variable, level, level_order): the column's own levels in their order, also those no row has; then, or for
    columns without levels, the other values found, by text."""
    known = [(c, str(v), i) for c in cols for i, v in enumerate(df.schema[c].metadata.get("levels") or [], 1)]
    spec = df.sparkSession.createDataFrame(known, "variable string, level string, level_order int")
    found = cells.select("variable", "level").distinct().join(F.broadcast(spec), ["variable", "level"], "left_anti")
    own = {c: len(df.schema[c].metadata.get("levels") or []) for c in cols}
    after = F.element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.col("variable"))
    # result rows: one for each level
    rank = F.row_number().over(Window.partitionBy("variable").orderBy("level"))
    return spec.unionByName(found.select("variable", "level", (after + rank).cast("int").alias("level_order")))


def category_counts(df: DataFrame, cols: Sequence[str], stratum: str) -> DataFrame:
    """(variable, level, stratum, n, percent of the non-missing, level_order); one pass, empty cells as 0.

    Levels come in the order the column's metadata gives, else by text.
    """
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols]))
    cells = (df.select(F.col(stratum).cast("string").alias("stratum"), entries.alias("__cell"))
             .select("stratum", "__cell.*").where(F.col("level").isNotNull())
             .groupBy("variable", "level", "stratum").agg(F.count(F.lit(1)).alias("n")))
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)  # counts: one row per level and stratum
    names = F.explode(F.lit(list(cols))).alias("variable")
    strata = cells.select("stratum").distinct().select("stratum", names)
    # the grid is the result itself: every level by every stratum, per variable
    grid = _levels(df, cols, cells).join(strata, "variable")
    full = grid.join(cells, ["variable", "level", "stratum"], "left").fillna(0, ["n"])
    share = Window.partitionBy("variable", "stratum")
    total = F.sum("n").over(share)
    return full.select("variable", "level", "stratum", "n",
                       (100.0 * F.col("n") / F.nullif(total, F.lit(0))).alias("percent"), "level_order")


def baseline_table(df: DataFrame, variables: Sequence[str], strata: str | None = None,
                   cat_vars: Sequence[str] = (), nonnormal: Sequence[str] = (), test: bool | None = None) -> DataFrame:
    """Long baseline table.

    Columns: row_order, variable, level_order, level, stratum, n, center, spread_low, spread_high,
    percent, summary, p_value, test. Row 0 is the row count. Continuous variables
    give mean (SD), or median [Q1, Q3] when listed in ``nonnormal``; categorical ones
    one row per level with n (%), in level order, levels without rows included. With ``strata`` the p-value is that of the F test,
    the rank test or the chi-square test respectively.
    """
    cats = [v for v in variables if v in set(cat_vars) or dict(df.dtypes)[v] == "string"]
    skewed = [v for v in variables if v not in cats and v in set(nonnormal)]
    normal = [v for v in variables if v not in cats and v not in skewed]
    test = strata is not None if test is None else test
    data = df.where(F.col(strata).isNotNull()) if strata else df.withColumn("__all", F.lit(OVERALL))
    by = strata or "__all"
    # several passes follow; keep the columns they need rather than redo what led here
    data = data.select(by, *[v for v in variables if v != by]).persist(StorageLevel.MEMORY_AND_DISK)
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    parts = [data.groupBy(F.col(by).cast("string").alias("stratum")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("n").alias("variable"), null("string", "level"), "stratum", "n", null("double", "center"),
        null("double", "spread_low"), null("double", "spread_high"), null("double", "percent"),
        F.col("n").cast("string").alias("summary"), null("int", "level_order"))]
    if normal:
        moments = group_moments(data, normal, by).persist()  # one row per variable and stratum, wanted again by the test
        parts.append(_means(moments).select(
            "variable", null("string", "level"), "stratum", "n", F.col("mean").alias("center"),
            F.col("sd").alias("spread_low"), F.col("sd").alias("spread_high"), null("double", "percent"),
            F.format_string("%.2f (%.2f)", round_n("mean", 2), round_n("sd", 2)).alias("summary"), null("int", "level_order")))
    if skewed:
        groups = [r[0] for r in data.select(by).distinct().take(GROUPS_AS_COLUMNS + 1)]
        if 0 < len(groups) <= GROUPS_AS_COLUMNS:
            # medians, quartiles and rank sums from one structure: one row per variable and stratum
            ranks = ranked_groups(data, skewed, by, groups, [0.25, 0.5, 0.75]).persist()
            cells = data.sparkSession.createDataFrame([(v, str(g)) for v in skewed for g in groups], "variable string, stratum string")
            medians = cells.join(ranks, ["variable", "stratum"], "left").select(
                "variable", "stratum", F.col("q1").alias("median"), F.col("q0").alias("q1"), F.col("q2").alias("q3"))
        else:
            ranks, medians = None, continuous_medians(data, skewed, by)
        parts.append(medians.select(
            "variable", null("string", "level"), "stratum", null("bigint", "n"), F.col("median").alias("center"),
            F.col("q1").alias("spread_low"), F.col("q3").alias("spread_high"), null("double", "percent"),
            F.format_string("%.2f [%.2f, %.2f]", round_n("median", 2), round_n("q1", 2), round_n("q3", 2)).alias("summary"), null("int", "level_order")))
    if cats:
        # one row per level and stratum, wanted again by the test
        counted = category_counts(data, cats, by).persist()
        parts.append(counted.select(
            "variable", "level", "stratum", "n", null("double", "center"), null("double", "spread_low"),
            null("double", "spread_high"), "percent", F.format_string("%d (%.1f)", "n", round_n("percent", 1)).alias("summary"), "level_order"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if test and strata:
        tests = []
        if normal:
            tests.append(anova_from_moments(moments).select("variable", "p_value", F.lit("anova").alias("test")))
        if skewed:
            ranked = kruskal_wallis(data, skewed, by) if ranks is None else kruskal_from_ranks(ranks)
            tests.append(ranked.select("variable", "p_value", F.lit("kruskal").alias("test")))
        if cats:
            cells = counted.where(F.col("n") > 0).select(
                "variable", F.col("level").alias("value"), "stratum", "n")
            tests.append(chi_square_from_counts(cells).select(
                "variable", "p_value", F.lit("chisq").alias("test")))
        p = tests[0]
        for t in tests[1:]:
            p = p.unionByName(t)
        out = out.join(F.broadcast(p), "variable", "left")  # one row per variable
    else:
        out = out.withColumn("p_value", F.lit(None).cast("double")).withColumn("test", F.lit(None).cast("string"))
    order = F.array_position(F.lit(["n", *variables]), F.col("variable")).cast("int") - 1
    return out.select(order.alias("row_order"), "variable", "level_order", "level", "stratum", "n", "center", "spread_low",
                      "spread_high", "percent", "summary", "p_value", "test")


def baseline_text(table: DataFrame, strata_values: Sequence[str]) -> DataFrame:
    """Print form: one row per variable or level, one column per stratum, p as text."""
    p = format_p_floor(F.col("p_value"), 3)
    return (table.groupBy("row_order", "variable", "level_order", "level")
            .pivot("stratum", [str(s) for s in strata_values])
            .agg(F.first("summary"))
            .join(table.groupBy("row_order", "variable").agg(F.first(p).alias("p")), ["row_order", "variable"])
            .orderBy("row_order", "level_order"))
