import pytest
from pyspark.sql import functions as F

from riskset.sources import read_cohort, read_table, write_table


def test_round_trip_keeps_missing_cells(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, None, 0.5), (3, "", 1.5)], "row_order int, name string, x double")
    path = str(tmp_path / "t")
    write_table(df, path, ["row_order"])
    back = {r.row_order: (r.name, r.x) for r in
            read_table(spark, path, "row_order int, name string, x double").collect()}
    assert back[1] == (None, 0.5) and back[2] == ("b", None) and back[3][1] == 1.5
    text = "".join(r[0] for r in spark.read.text(path).collect())
    assert "null" not in text.lower()


def test_read_cohort_narrows_the_scan(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.range(10).select("id", F.lit(1).alias("a"), F.lit(2).alias("b")).write.parquet(path)
    df = read_cohort(spark, path, columns=["id", "a"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "b:int" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError):
        read_cohort(spark, str(tmp_path / "c.csv"))
