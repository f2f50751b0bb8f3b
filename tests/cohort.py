"""A seeded raw cohort in the study's input schema, with planted effects."""

import numpy as np
import pandas as pd

from riskset.plans import study

LABS = ("wbc neutrophils platelet creatinine bun aniongap calcium_total pt ptt inr alt ast bilirubin_total chloride "
        "potassium sodium bicarbonate hemoglobin magnesium phosphate").split()
VITALS = "weight heart_rate resp_rate sbp dbp mbp spo2".split()
FLAGS = ("hypertension diabetes myocardial_infarct congestive_heart_failure severe_liver_disease renal_disease "
         "chronic_pulmonary_disease cerebrovascular_disease malignant_cancer rheumatic_disease InvasiveVent cpr crrt "
         "custom_IMMUINHIB custom_GC custom_Albtaken custom_VP custom_EPIs custom_DOPA custom_DOBU").split()
SCORES = "gcs_dynamic sofa_dynamic apsiii sapsii sirs lods oasis charlson".split()


def raw_cohort(n=600, seed=1, gaps=True) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    d = {"id": np.arange(n)}
    d.update({c: ["x"] * n for c in study.DROPPED})
    d["gender"] = r.choice(["F", "M"], n)
    d["race"] = r.choice(["WHITE", "white  - russian", "BLACK/AFRICAN", "ASIAN - KOREAN", "HISPANIC OR LATINO",
                          "UNKNOWN"], n)
    age = r.normal(66, 14, n).clip(18, 95)
    d["admission_age"] = [f"{x:.1f}" for x in age]
    d["height"] = [f"{x:.1f}" for x in r.normal(170, 10, n)]
    d["los_icu"] = [f"{x:.1f}" for x in r.exponential(5, n)]
    albumin, lymph = r.normal(3, 0.6, n), r.lognormal(0, 0.4, n)
    d["albumin_first"] = albumin.round(2)
    d["lymphocytes_abs_first"] = [f"{x:.2f}" for x in lymph]
    d["neutrophils_abs_first"] = [f"{x:.2f}" for x in r.lognormal(2, 0.4, n)]
    d["temperature_first"] = [f"{x:.1f}" for x in r.normal(37, 0.8, n)]
    d["CVP_first"] = [f"{x:.1f}" if u > 0.4 else "" for x, u in zip(r.normal(10, 3, n), r.uniform(size=n))]
    for c in LABS + VITALS:
        d[c + "_first" if c != "weight" else c] = r.normal(50, 10, n).round(2)
    for c in SCORES:
        d[c] = r.integers(0, 20, n).astype(float)
    for c in FLAGS:
        d[c] = r.integers(0, 2, n)
    d["aki_score"] = r.integers(1, 4, n)
    for c in ("input_all_sum", "output_all_sum", "output_urine_sum"):
        d[c] = r.normal(2000, 400, n).round(1)
    pni = 10 * albumin + 5 * lymph
    risk = -0.08 * np.minimum(pni - 35, 0) + 0.03 * (age - 65) + 0.05 * d["sofa_dynamic"]
    t = r.exponential(25 * np.exp(-(risk - risk.mean())), n) + 1
    c = r.exponential(30, n) + 1
    d["los_hospital"] = [f"{x:.2f}" for x in np.minimum(t, c)]
    event = (t <= c).astype(int)
    for m in (28, 30, 90, 365):
        d[f"mortality_{m}"] = event
    df = pd.DataFrame(d)
    if gaps:
        for c in ("platelet_first", "bun_first"):
            df.loc[r.uniform(size=n) < 0.1, c] = np.nan
        df.loc[r.uniform(size=n) < 0.05, "albumin_first"] = np.nan
    return df
