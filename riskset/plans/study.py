"""A whole retrospective cohort study as a chain of DataFrame steps.

Everything study-specific is a field of :class:`StudyConfig`; its defaults describe a
nutritional-index cohort of intensive-care stays. The operators underneath take their
columns by name and know nothing of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.functions import columns as C
from riskset.operators import clean, km, missing, nonparam, quantiles, report, tableone, threshold
from riskset.operators.design import design_for, with_levels
from riskset.operators.impute import Imputer
from riskset.operators.small import cut_lineage
from riskset.plans import coxflows, discrimination
from riskset.sources.tables import with_nan_as_null, write_table

# The columns, spellings, groupings and labels of the study.

DROPPED = [
    "subject_id", "hadm_id", "stay_id", "marital_status", "insurance", "language", "dischtime", "admittime",
    "icu_intime", "icu_outtime", "careunit", "dod", "hospital_expire_flag", "icu_expire_flag", "survival_days",
    "smoker", "alcohol_abuse", "mild_liver_disease", "peripheral_vascular_disease", "dementia",
    "peptic_ulcer_disease", "paraplegia", "metastatic_solid_tumor", "aids", "diagnosis_long_title1", "meld", "sepsis",
    "sepsis_time", "aki", "aki_time", "lvef_min", "microbiology", "sbp_ni_first", "dbp_ni_first", "mbp_ni_first",
    "ph_first", "po2_first", "pco2_first", "so2_first", "aado2_first", "aado2_calc_first", "baseexcess_first",
    "totalco2_first", "methemoglobin_first", "carboxyhemoglobin_first", "calcium_free_first", "nrbc_first",
    "eosinophils_abs_first", "basophils_abs_first", "eosinophils_first", "monocytes_first", "basophils_first",
    "monocytes_abs_first", "lymphocytes_first", "metamyelocytes_first", "immature_granulocytes_first",
    "atypical_lymphocytes_first", "hematocrit_first", "mch_first", "mcv_first", "mchc_first", "rdw_first",
    "rdwsd_first", "rbc_first", "crp_first", "total_protein_first", "globulin_first", "fibrinogen_first",
    "thrombin_first", "d_dimer_first", "ck_mb_first", "troponin_t_first", "ntprobnp_first", "alp_first", "ggt_first",
    "ck_cpk_first", "amylase_first", "ld_ldh_first", "glucose_first", "hemoglobin_a1c_first", "HDL_first",
    "LDL_first", "antibiotic_first", "cam_icu_first", "heart_rhythm_first", "invasiveVent_hours_first",
    "non_invasiveVent_hours_first", "HFNC_hours_first", "input_rbc_sum", "input_plt_sum", "input_plasma_sum",
]

WHOLE_NUMBERS = ["admission_age", "los_hospital", "los_icu", "height"]
NUMBERS = ["temperature_first", "lymphocytes_abs_first", "neutrophils_abs_first", "CVP_first"]

RACE = {
    "WHITE": "White",
    "WHITE - RUSSIAN": "White",
    "WHITE - EASTERN EUROPEAN": "White",
    "WHITE - OTHER EUROPEAN": "White",
    "WHITE - BRAZILIAN": "White",
    "BLACK/AFRICAN AMERICAN": "Black",
    "BLACK/CARIBBEAN ISLAND": "Black",
    "BLACK/AFRICAN": "Black",
    "BLACK/CAPE VERDEAN": "Black",
    "ASIAN": "Asian",
    "ASIAN - CHINESE": "Asian",
    "ASIAN - KOREAN": "Asian",
    "ASIAN - ASIAN INDIAN": "Asian",
    "ASIAN - SOUTH EAST ASIAN": "Asian",
    "HISPANIC/LATINO - CENTRAL AMERICAN": "Hispanic",
    "HISPANIC/LATINO - COLUMBIAN": "Hispanic",
    "HISPANIC/LATINO - CUBAN": "Hispanic",
    "HISPANIC/LATINO - DOMINICAN": "Hispanic",
    "HISPANIC/LATINO - GUATEMALAN": "Hispanic",
    "HISPANIC/LATINO - HONDURAN": "Hispanic",
    "HISPANIC/LATINO - MEXICAN": "Hispanic",
    "HISPANIC/LATINO - PUERTO RICAN": "Hispanic",
    "HISPANIC/LATINO - SALVADORAN": "Hispanic",
    "HISPANIC OR LATINO": "Hispanic",
    "OTHER": "Other",
}
RACE_LEVELS = ["White", "Black", "Asian", "Hispanic", "Other"]

RENAMED = {
    "admission_age": "age",
    "custom_IMMUINHIB": "immunity_inhibitor",
    "custom_GC": "glucocorticoid",
    "custom_Albtaken": "albumin_infusion",
    "aki_score": "AKI_stage",
    "InvasiveVent": "MV",
    "gcs_dynamic": "GCS",
    "sofa_dynamic": "SOFA",
    "apsiii": "APS_III",
    "sapsii": "SAPS_II",
    "sirs": "SIRS",
}
VASOACTIVE = ["custom_VP", "custom_EPIs", "custom_DOPA", "custom_DOBU"]

NONNORMAL = [
    "age", "los_hospital", "los_icu", "weight", "APS_III", "SAPS_II", "SIRS", "lods", "charlson", "oasis", "GCS",
    "SOFA", "temperature", "heart_rate", "resp_rate", "sbp", "dbp", "mbp", "spo2", "wbc", "lymphocytes_abs",
    "neutrophils_abs", "neutrophils", "platelet", "albumin", "creatinine", "bun", "aniongap", "calcium_total", "pt",
    "ptt", "inr", "alt", "ast", "bilirubin_total", "chloride", "potassium", "sodium", "bicarbonate", "hemoglobin",
    "magnesium", "phosphate", "input_all_sum", "output_all_sum", "output_urine_sum", "PNI",
]
CATEGORICAL = [
    "gender", "race", "mortality_28", "mortality_30", "mortality_90", "mortality_365", "hypertension", "diabetes",
    "myocardial_infarct", "congestive_heart_failure", "severe_liver_disease", "renal_disease",
    "chronic_pulmonary_disease", "cerebrovascular_disease", "malignant_cancer", "rheumatic_disease", "AKI_stage",
    "MV", "cpr", "crrt", "immunity_inhibitor", "glucocorticoid", "albumin_infusion", "vasoactive_agent",
]

NOT_CANDIDATES = ["los_icu", "mortality_28", "mortality_90", "mortality_365", *VASOACTIVE]
MODEL2 = [
    "age", "weight", "myocardial_infarct", "congestive_heart_failure", "severe_liver_disease", "malignant_cancer",
    "cpr", "crrt",
]
MODEL3 = [
    *MODEL2,
    "platelet", "hemoglobin", "creatinine", "bun", "aniongap", "calcium_total", "pt", "ptt", "inr", "ast",
    "bilirubin_total", "potassium", "bicarbonate", "magnesium", "phosphate", "SOFA", "GCS", "charlson", "AKI_stage",
]
SPLINE = [c for c in MODEL3 if c != "GCS"]

SUBGROUPS = {
    "age_group": "Age",
    "hypertension": "Hypertension",
    "diabetes": "Diabetes",
    "renal_disease": "Renal disease",
    "myocardial_infarct": "Myocardial infarct",
    "congestive_heart_failure": "Congestive heart failure",
    "chronic_pulmonary_disease": "Chronic pulmonary disease",
    "cerebrovascular_disease": "Cerebrovascular disease",
    "rheumatic_disease": "Rheumatic disease",
    "severe_liver_disease": "Severe liver disease",
    "malignant_cancer": "Malignant cancer",
    "cpr": "CPR",
    "crrt": "CRRT",
    "AKI_stage": "AKI stage",
}
SCORES = {
    "OASIS": "oasis",
    "SOFA": "SOFA",
    "APSIII": "APS_III",
    "SAPSII": "SAPS_II",
    "SIRS": "SIRS",
    "LODS": "lods",
    "Charlson": "charlson",
}


@dataclass
class StudyConfig:
    key: str = "id"
    dropped: Sequence[str] = tuple(DROPPED)
    whole_numbers: Sequence[str] = tuple(WHOLE_NUMBERS)
    numbers: Sequence[str] = tuple(NUMBERS)
    race: Mapping[str, str] = field(default_factory=lambda: dict(RACE))
    race_levels: Sequence[str] = tuple(RACE_LEVELS)
    index: str = "PNI"
    index_weights: Mapping[str, float] = field(
        default_factory=lambda: {"albumin_first": 10.0, "lymphocytes_abs_first": 5.0})
    fence: float = 3.0
    sparse_share: float = 0.2
    imputation_rounds: int = 10
    seed: int = 123
    renamed: Mapping[str, str] = field(default_factory=lambda: dict(RENAMED))
    vasoactive: Sequence[str] = tuple(VASOACTIVE)
    nonnormal: Sequence[str] = tuple(NONNORMAL)
    categorical: Sequence[str] = tuple(CATEGORICAL)
    not_candidates: Sequence[str] = tuple(NOT_CANDIDATES)
    time: str = "los_hospital"
    event: str = "mortality_30"
    km_cap: float = 30.0
    box_cap: float = 95.0
    model2: Sequence[str] = tuple(MODEL2)
    model3: Sequence[str] = tuple(MODEL3)
    spline: Sequence[str] = tuple(SPLINE)
    subgroups: Mapping[str, str] = field(default_factory=lambda: dict(SUBGROUPS))
    age_cut: float = 65.0
    scores: Mapping[str, str] = field(default_factory=lambda: dict(SCORES))


class CohortStudy:
    """Prepare a raw cohort once, then read each analysis off it."""

    def __init__(self, raw: DataFrame, config: StudyConfig | None = None, **changes):
        self.raw = raw
        self.config = replace(config or StudyConfig(), **changes)
        self._cohort: DataFrame | None = None
        self.dropped_sparse: list[str] = []
        self.fence: tuple[float, float] | None = None

    # --- preparation -------------------------------------------------------------------

    def typed(self) -> DataFrame:
        """Unused columns gone, text typed, gender and race recoded."""
        c = self.config
        df = clean.drop_columns(self.raw, [n for n in c.dropped if n != c.key])
        df = df.withColumn("gender", C.recode_binary("gender", "F", 0, 1))
        df = clean.set_levels(df, "gender", [0, 1], ["female", "male"])
        df = df.withColumns({n: C.round_even(C.to_numeric(n)) for n in c.whole_numbers})
        df = df.withColumns({n: C.to_numeric(n) for n in c.numbers})
        race = C.lump_other(C.recode_map(C.normalise_text("race"), c.race),
                            [v for v in c.race_levels if v != "Other"])
        return with_nan_as_null(clean.set_levels(df.withColumn("race", race), "race", list(c.race_levels)))

    def fenced(self) -> DataFrame:
        """Complete on the index inputs, index added, outliers of the index removed."""
        c = self.config
        df = missing.require_present(self.typed(), list(c.index_weights))
        df = df.withColumn(c.index, C.weighted_index(c.index_weights))
        self.fence = self.fence or missing.fence_bounds(df, c.index, c.fence)
        return missing.iqr_fence(df, c.index, c.fence, self.fence)

    def fence_report(self) -> DataFrame:
        c = self.config
        df = missing.require_present(self.typed(), list(c.index_weights))
        df = df.withColumn(c.index, C.weighted_index(c.index_weights))
        self.fence = self.fence or missing.fence_bounds(df, c.index, c.fence)
        return missing.fence_report(df, c.index, c.fence, self.fence)

    def missing_profile(self) -> DataFrame:
        return missing.missing_profile(self.fenced().drop(self.config.key))

    @property
    def cohort(self) -> DataFrame:
        """The analysis table: imputed, renamed, flagged, grouped; computed once and checkpointed."""
        if self._cohort is None:
            c = self.config
            df = cut_lineage(self.fenced())
            self.dropped_sparse = [n for n in missing.sparse_columns(df.drop(c.key), c.sparse_share)]
            df = df.drop(*self.dropped_sparse)
            df = Imputer(df, c.key, seed=c.seed).run(c.imputation_rounds)
            df = clean.rename_columns(clean.rename_suffix(df, "_first$"), c.renamed)
            df = df.withColumn("vasoactive_agent", C.flag_any(list(c.vasoactive)))
            df = cut_lineage(df)
            self._cohort = quantiles.quantile_group(df, c.index, out="group")
        return self._cohort

    # --- description -----------------------------------------------------------------------

    def baseline(self, by_group: bool = True) -> DataFrame:
        c, df = self.config, self.cohort
        out = {"group", c.key, *c.vasoactive}
        variables = [n for n in df.columns if n not in out]
        return tableone.baseline_table(df, variables, "group" if by_group else None, list(c.categorical),
                                       list(c.nonnormal))

    def _capped(self, cap: float) -> DataFrame:
        return self.cohort.withColumn("capped", C.cap_upper(self.config.time, cap))

    def kaplan_meier(self) -> DataFrame:
        return km.kaplan_meier(self._capped(self.config.km_cap), "capped", self.config.event, "group")

    def risk_table(self) -> DataFrame:
        return km.risk_table(self._capped(self.config.km_cap), "capped", self.config.event, "group")

    def logrank(self) -> DataFrame:
        """Test of the capped curves, with the annotation text."""
        t = km.logrank(self._capped(self.config.km_cap), "capped", self.config.event, "group")
        text = F.when(F.col("p_value") < 0.001, "Log-rank test \n p<0.001").otherwise(
            F.concat(F.lit("Log-rank test\np="), C.format_p_fixed("p_value")))
        return t.withColumn("text", text)

    def box(self) -> DataFrame:
        return quantiles.box_stats(self._capped(self.config.box_cap), "capped", "group")

    def box_test(self) -> DataFrame:
        t = nonparam.kruskal_wallis(self._capped(self.config.box_cap), ["capped"], "group")
        return t.withColumn("symbol", C.significance_symbol("p_value"))

    # --- Cox models --------------------------------------------------------------------------

    def _cox_frame(self) -> DataFrame:
        c = self.config
        df = self.cohort.drop(c.key, *c.not_candidates)
        df = clean.as_factor(df, "group", [1, 2, 3, 4])
        return clean.as_factor(df.withColumn("AKI_stage", F.col("AKI_stage").cast("int")), "AKI_stage", [1, 2, 3])

    def univariable(self) -> DataFrame:
        return coxflows.cox_univariable_sweep(self._cox_frame(), self.config.time, self.config.event)

    def screened(self, sweep: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
        c = self.config
        sweep = self.univariable() if sweep is None else sweep
        return coxflows.cox_screened_multivariable(self._cox_frame(), c.time, c.event, sweep, alpha)

    def trend(self) -> DataFrame:
        c = self.config
        return coxflows.p_for_trend(self._cox_frame(), c.time, c.event, "group",
                                    {"model 2": list(c.model2), "model 3": list(c.model3)})

    def adjusted(self, model: int = 2) -> dict[str, DataFrame]:
        c = self.config
        names = list(c.model2 if model == 2 else c.model3)
        return coxflows.cox_adjusted(self._cox_frame(), c.time, c.event, names, c.index, "group", [1, 2, 3, 4])

    def spline(self, knots: int = 3) -> coxflows.SplineFit:
        c = self.config
        return coxflows.cox_spline_fit(self._cox_frame(), c.time, c.event, c.index, list(c.spline), knots)

    def threshold(self, cutpoint: float | None = None) -> DataFrame:
        c = self.config
        df = with_levels(self._cox_frame(), list(c.spline))
        return threshold.threshold_effect(df, c.index, "cox", design_for(df, list(c.spline)), cutpoint,
                                          time=c.time, event=c.event)

    def subgroups(self, cut: float) -> DataFrame:
        """Effect of a high index (at or above ``cut``) within each subgroup."""
        c = self.config
        df = self.cohort.withColumns({
            "index_high": C.flag_threshold(c.index, cut),
            "age_group": F.when(F.col("age") < c.age_cut, "<65 years").when(F.col("age").isNotNull(), "≥65 years")})
        levels: dict[str, list] = {}
        for name in c.subgroups:
            if name == "age_group":
                levels[name] = ["<65 years", "≥65 years"]
                continue
            coded = [1, 2, 3] if name == "AKI_stage" else [0, 1]
            labels = ["Stage 1", "Stage 2", "Stage 3"] if name == "AKI_stage" else ["No", "Yes"]
            df = clean.set_levels(df.withColumn(name, F.col(name).cast("int")), name, coded, labels)
            levels[name] = labels
        return coxflows.subgroup_cox(df, c.time, c.event, "index_high", levels)

    def forest(self, cut: float) -> DataFrame:
        c = self.config
        return report.forest_table(self.subgroups(cut), c.subgroups, f"Low {c.index}", f"High {c.index}")

    # --- discrimination ------------------------------------------------------------------------

    def auc_tables(self) -> dict[str, DataFrame]:
        """AUC tables with the exposure as a number and as its quartile code."""
        c, df = self.config, self.cohort
        return {
            "continuous": discrimination.auc_table(df, c.index, c.scores, c.event),
            "quartile": discrimination.auc_table(df.withColumn(f"{c.index}_group", F.col("group")),
                                                 f"{c.index}_group", c.scores, c.event,
                                                 combined_prefix=f"{c.index} group"),
        }

    def score_comparison(self, form: str = "continuous", table: DataFrame | None = None) -> DataFrame:
        c = self.config
        table = self.auc_tables()[form] if table is None else table
        if form == "continuous":
            return discrimination.score_comparison(table, c.index, list(c.scores))
        return discrimination.score_comparison(
            table, f"{c.index}_group", list(c.scores), f"{c.index} group", f"{c.index} Quartile Alone",
            f"Score+{c.index} Quartile")

    # --- everything ------------------------------------------------------------------------------

    def write_all(self, folder: str) -> dict[str, str]:
        """Write every result table under ``folder``; returns name -> path."""
        index = self.config.index
        sweep = self.univariable()
        two_piece = self.threshold()
        cut = two_piece.where(F.col("row") == "cutpoint").first()["estimate"]
        tables = {
            "table1_overall": (self.baseline(False), ["row_order", "level_order"]),
            "table1_strata": (self.baseline(True), ["row_order", "level_order", "stratum"]),
            "table1_print": (tableone.baseline_text(self.baseline(True), [1, 2, 3, 4]), ["row_order", "level_order"]),
            "missing_profile": (self.missing_profile(), []),
            "fence_report": (self.fence_report(), []),
            "box_statistics": (self.box(), ["group"]),
            "box_test": (self.box_test(), []),
            "kaplan_meier_30d": (self.kaplan_meier(), ["stratum", "time"]),
            "risk_table_30d": (self.risk_table(), ["stratum", "time"]),
            "logrank_30d": (self.logrank(), []),
            "univariable_cox": (sweep, ["row_order"]),
            "univariable_cox_pretty": (report.cox_results_pretty(sweep), ["row_order"]),
            "multivariable_cox": (self.screened(sweep), ["row_order"]),
            "trend": (self.trend(), ["model"]),
            "threshold": (threshold.cut_table(two_piece), ["row_order"]),
            "forest": (self.forest(cut), ["row_order"]),
        }
        for model in (2, 3):
            for form, t in self.adjusted(model).items():
                tables[f"cox_model{model}_{form}"] = (t, ["row_order"])
        for form, t in self.auc_tables().items():
            tables[f"auc_{index}_{form}"] = (t, ["model_order"])
            tables[f"score_comparison_{form}"] = (self.score_comparison(form, t), ["row_order"])
        paths = {}
        for name, (t, order) in tables.items():
            paths[name] = f"{folder.rstrip('/')}/{name}"
            write_table(t, paths[name], order)
        return paths
