import pytest

from riskset.plans.study import CohortStudy
from tests.cohort import raw_cohort


@pytest.fixture(scope="module")
def study(spark):
    return CohortStudy(spark.createDataFrame(raw_cohort(400)), imputation_rounds=1)


def test_preparation(study):
    df = study.cohort
    assert study.dropped_sparse == ["CVP_first"]
    assert df.where("platelet is null or bun is null or PNI is null").count() == 0
    assert {r.group for r in df.select("group").distinct().collect()} == {1, 2, 3, 4}
    assert "vasoactive_agent" in df.columns and "AKI_stage" in df.columns and "age" in df.columns
    assert {r.gender for r in df.select("gender").distinct().collect()} == {"female", "male"}
    assert {r.race for r in df.select("race").distinct().collect()} <= {"White", "Black", "Asian", "Hispanic", "Other"}
    r = study.fence_report().first()
    assert r.n_before - r.n_removed == r.n_left == df.count()


def test_planted_effects_are_found(study):
    hr = {r.Variable: r.HR for r in study.univariable().collect() if r.Levels is None}
    assert hr["PNI"] < 1 < hr["age"]
    assert study.logrank().first().p_value < 0.2
    assert study.trend().collect()[0].hr < 1


def test_threshold_and_forest(study):
    forest = study.forest(35.0).collect()
    assert forest[0].Subgroup == "Overall" and len(forest) == 1 + 14 + 13 * 2 + 3
    assert forest[1]["Hazard Ratio (95% CI)"] == " " and "/" in forest[2]["Low PNI"]


def test_comparison_has_three_rows_per_score(study):
    rows = study.score_comparison("quartile").collect()
    assert len(rows) == 21 and all(r.C_index is not None for r in rows)
    assert rows[2].Subgroup == "Score+PNI Quartile"
