"""Turning typed results into printed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskset.functions.columns import (
    format_estimate, format_interval, format_p_floor, number_text, round_n, strip_parenthesised,
)
from riskset.operators.clean import label_rows


def append_results(tables: Sequence[DataFrame], order: str | None = None) -> DataFrame:
    """Bind result tables row by row; ``order`` is renumbered to run on across them."""
    if order is None:
        return reduce(lambda a, b: a.unionByName(b), tables)
    numbered = [t.withColumn("__part", F.lit(i)) for i, t in enumerate(tables)]
    both = reduce(lambda a, b: a.unionByName(b), numbered)
    # result tables: one row per model
    w = Window.partitionBy(F.lit(0)).orderBy("__part", order)
    return both.withColumn(order, F.row_number().over(w)).drop("__part")


def format_pval(df: DataFrame, p: str, out: str, digits: int = 3, eps: float = 0.001) -> DataFrame:
    """``<eps`` below the floor; other values share one number of decimals.

    That number is the most any of them needs to show ``digits`` significant digits
    without trailing zeros.
    """
    c = F.col(p).cast("double")
    # rounded at its own significant digits on the stored value, so that the text below has nothing left to round
    power = F.floor(F.log10(F.nullif(F.abs(c), F.lit(0.0))))
    near = F.coalesce(*[F.when(power == -k, round_n(c, digits - 1 + k)) for k in range(1, 16)], c)
    sci = F.format_string(f"%.{digits - 1}e", near)
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^([0-9.]+)e", 1), r"\.?0+$", "")
    places = F.greatest(F.greatest(F.length(mantissa) - 2, F.lit(0)) - exponent, F.lit(0))
    shared = df.agg(F.max(F.when(c >= eps, places))).first()[0] or 0
    return df.withColumn(out, F.when(c < eps, F.lit(f"<{eps:g}")).when(
        c.isNotNull(), F.format_string(f"%.{shared}f", round_n(c, shared))).otherwise(F.lit("NA")))


def cox_results_pretty(sweep: DataFrame) -> DataFrame:
    """(row_order, Variable, Levels, Coef, HR, HR_95CI, P_Value) with the last two as text."""
    typed = sweep.withColumns({
        "HR_95CI": format_interval("HR_CI_Lower", "HR_CI_Upper", 3),
        "HR_rounded": round_n("HR", 3),
    })
    return format_pval(typed, "P_Value", "p_text").select(
        "row_order", "Variable", "Levels", "Coef", F.col("HR_rounded").alias("HR"), "HR_95CI",
        F.col("p_text").alias("P_Value"))


def forest_table(subgroups: DataFrame, labels: Mapping[str, str] | None = None, low: str = "Low",
                 high: str = "High", digits: int = 2) -> DataFrame:
    """Printed subgroup table: row_order, Subgroup, low arm, high arm, blank, HR text, P for interaction.

    Level rows are indented under their factor; missing cells are one blank; arm
    columns read ``events/total``.
    """
    blank = F.lit(" ")
    table = label_rows(subgroups, labels, "variable", "label") if labels else subgroups.withColumn(
        "label", F.col("variable"))
    name = F.when(F.col("level").isNull(), F.col("label")).otherwise(F.concat(F.lit("  "), F.col("level")))

    def arm(side):
        share = F.format_string("%.1f", 100.0 * F.col(f"events_{side}") / F.nullif(
            F.col(f"total_{side}"), F.lit(0).cast("long")))
        full = F.concat(F.col(f"events_{side}").cast("string"), F.lit("/"), F.col(f"total_{side}").cast("string"),
                        F.lit(" ("), share, F.lit("%)"))
        return F.coalesce(strip_parenthesised(full), blank)

    return table.select(
        "row_order", name.alias("Subgroup"), arm("low").alias(low), arm("high").alias(high),
        F.lit(" " * 20).alias(" "),
        format_estimate("estimate", "lower", "upper", digits).alias("Hazard Ratio (95% CI)"),
        F.coalesce(number_text(round_n("estimate", digits), digits), blank).alias("Point Estimate"),
        F.coalesce(format_p_floor("p_value", 3), blank).alias("P value"),
        F.coalesce(format_p_floor("p_interaction", 3), blank).alias("P for interaction"),
    ).orderBy("row_order")
