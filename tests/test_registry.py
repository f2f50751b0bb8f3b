"""Every kind of registered query against its SQL on the smallest tables."""

import os

import pytest

from registry import load
from registry.check import canonical, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()
SAMPLE = ["s3_read_table", "p4_to_numeric", "p21_format_estimate", "p22_format_p", "f3_fence_report", "f8_filter_p",
          "a0_rate_by_quartile", "a2_quantile7_grouped", "a5d_one_way_anova", "a7_box_stats", "a10_data_distribution",
          "v1_kaplan_meier", "v4_logrank", "v5_cox_fit", "v13_aliased_terms", "v18_wald_anova", "v21_forest_table",
          "t5_exhaustive_search", "t8_two_piece_logistic", "t1_cut_table", "g1_logistic_fit", "g7_score_comparison",
          "f7_complete_imputation"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_operator_of_the_inventory_is_registered():
    ids = {name.split("_")[0] for name in QUERIES}
    wanted = ([f"s{i}" for i in range(1, 4)] + [f"p{i}" for i in range(1, 26)] + [f"f{i}" for i in range(1, 11)]
              + [f"a{i}" for i in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12)] + [f"a5{c}" for c in "abcdef"]
              + [f"v{i}" for i in range(1, 22)] + [f"t{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13)]
              + [f"g{i}" for i in range(1, 8)])
    assert [w for w in wanted if w not in ids] == []
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
