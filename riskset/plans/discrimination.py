"""ROC comparisons of risk scores, alone and combined with an exposure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.functions.columns import format_p_fixed
from riskset.operators.auc import auc
from riskset.operators.frame import Model
from riskset.operators.glm import GlmFit, linear_predictor, logistic_fits
from riskset.operators.report import append_results


def auc_single_table(df: DataFrame, predictors: Mapping[str, str], outcome: str, **kw) -> DataFrame:
    """(model_order, Model, C_index) for each {label: column}, in one counting job."""
    table = auc(df, {label: F.col(c) for label, c in predictors.items()}, outcome, **kw)
    return table.select("model_order", "Model", "C_index")


def combined_fits(df: DataFrame, exposure: str, scores: Mapping[str, str], outcome: str) -> dict[str, GlmFit]:
    """Logistic models ``outcome ~ exposure + score`` for every {label: score}, fitted together."""
    design = {c: F.col(c).cast("double") for c in [exposure, *scores.values()]}
    models = [Model(label, (exposure, c)) for label, c in scores.items()]
    return {f.key: f for f in logistic_fits(df, outcome, design, models)}


def auc_combined_table(df: DataFrame, exposure: str, scores: Mapping[str, str], outcome: str,
                       prefix: str | None = None, **kw) -> DataFrame:
    """(model_order, Model, C_index) of the fitted two-predictor models, scored in-sample.

    The linear predictor ranks rows exactly as the fitted probability does.
    """
    prefix = exposure if prefix is None else prefix
    fits = combined_fits(df, exposure, scores, outcome)
    design = {c: F.col(c).cast("double") for c in [exposure, *scores.values()]}
    predictors = {f"{prefix} + {label}": linear_predictor(fits[label], design) for label in scores}
    return auc(df, predictors, outcome, **kw).select("model_order", "Model", "C_index")


def auc_table(df: DataFrame, exposure: str, scores: Mapping[str, str], outcome: str, label: str | None = None,
              combined_prefix: str | None = None, **kw) -> DataFrame:
    """Exposure and scores alone, then exposure with each score, bound row by row."""
    label = exposure if label is None else label
    single = auc_single_table(df, {label: exposure, **scores}, outcome, **kw)
    both = auc_combined_table(df, exposure, scores, outcome, combined_prefix or label, **kw)
    return append_results([single, both], "model_order")


def score_comparison(table: DataFrame, exposure_label: str, score_labels: Sequence[str],
                     combined_prefix: str | None = None, alone: str | None = None,
                     both: str | None = None) -> DataFrame:
    """(row_order, Group, Subgroup, C_index, label): per score the exposure alone, the score alone and both."""
    prefix = combined_prefix or exposure_label
    alone = alone or f"{exposure_label} Alone"
    both = both or f"Score+{exposure_label}"
    spec = []
    for s in score_labels:
        for sub, model in ((alone, exposure_label), ("Score Alone", s), (both, f"{prefix} + {s}")):
            spec.append((len(spec) + 1, s, sub, model))
    rows = table.sparkSession.createDataFrame(spec, "row_order int, Group string, Subgroup string, Model string")
    # three rows per score
    return (F.broadcast(rows).join(table.select("Model", "C_index"), "Model", "left")
            .select("row_order", "Group", "Subgroup", "C_index",
                    format_p_fixed("C_index", 3).alias("label"))
            .orderBy("row_order"))
