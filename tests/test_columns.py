import math

import pytest
from pyspark.sql import functions as F

from riskset.functions import columns as C
from riskset.operators import clean, report
from riskset.operators.threshold import number, p_floor


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_to_numeric_and_half_even(spark):
    df = spark.createDataFrame([("0.5",), ("1.5",), ("2.5",), ("-0.5",), ("abc",), ("NaN",), (None,), (" 7 ",), ("1d",)], "x string")
    assert values(df, C.to_numeric("x")) == [0.5, 1.5, 2.5, -0.5, None, None, None, 7.0, None]
    assert values(df, C.round_even(C.to_numeric("x")))[:4] == [0.0, 2.0, 2.0, -0.0]


def test_race_recode(spark):
    df = spark.createDataFrame([("WHITE",), ("white  - russian",), (" asian",), ("MARTIAN",), (None,)], "x string")
    mapped = C.recode_map(C.normalise_text("x"), {"WHITE": "White", "WHITE - RUSSIAN": "White", "ASIAN": "Asian"})
    assert values(df, C.lump_other(mapped, ["White", "Asian"])) == ["White", "White", "Asian", "Other", None]


def test_flags_keep_missing(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (None, 0)], "a int, b int")
    assert values(df, C.flag_any(["a", "b"])) == [0, 1, None]
    assert values(df, C.recode_binary(F.col("a").cast("string"), "0")) == [0, 1, None]
    assert values(df, C.cap_upper("a", 0.5)) == [0.0, 0.5, None]
    assert values(df, C.flag_threshold("a", 1)) == [0, 1, None]


def test_round_to_nearest_stored_value(spark):
    df = spark.createDataFrame([(2.675, ), (0.0045,), (0.125,), (-1.5,), (None,)], "x double")
    assert values(df, C.round_n("x", 2))[0] == 2.67
    assert values(df, C.round_n("x", 3))[1] == 0.004
    assert values(df, C.round_n("x", 2))[2] == 0.12
    assert values(df, C.round_n("x", 0))[3:] == [-2.0, None]
    assert values(df, C.format_p_fixed("x"))[1] == "0.004"


def test_number_text(spark):
    cases = [(1.0, "1"), (1.25, "1.25"), (100000.0, "1e+05"), (1200000.0, "1200000"), (123456.0, "123456"), (0.0, "0"),
             (-0.5, "-0.5"), (12000000.0, "1.2e+07")]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x double").coalesce(1)
    assert values(df, C.number_text("x")) == [t for _, t in cases]
    assert [number(x) for x, _ in cases] == [t for _, t in cases]


def test_estimates_and_p_text(spark):
    df = spark.createDataFrame([(1.0234, 0.9, 1.2, 0.04), (None, None, None, None)], "e double, l double, h double, p double").coalesce(1)
    assert values(df, C.format_estimate("e", "l", "h")) == ["1.023 (0.9-1.2)", " "]
    assert values(df, C.format_p_floor("p")) == ["0.040", None]
    assert (p_floor(0.0004), p_floor(0.5, 2), p_floor(None)) == ("<0.001", "0.50", "NA")
    assert values(df, C.strip_parenthesised(F.lit("12/40 (30%) (x)"))) == ["12/40  "] * 2


def test_common_decimals(spark):
    df = spark.createDataFrame([(1, 0.0123), (2, 0.5), (3, 0.00001), (4, None)], "i int, p double")
    out = {r.i: r.t for r in report.format_pval(df, "p", "t").collect()}
    assert out == {1: "0.0123", 2: "0.5000", 3: "<0.001", 4: "NA"}


def test_strict_names(spark):
    df = spark.createDataFrame([(1, 2)], "a_first int, b int")
    with pytest.raises(ValueError):
        clean.drop_columns(df, ["zzz"])
    with pytest.raises(ValueError):
        clean.rename_columns(df, {"zzz": "a"})
    assert clean.rename_suffix(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        clean.rename_suffix(spark.createDataFrame([(1, 2)], "a_first int, a int"))


def test_levels(spark):
    df = spark.createDataFrame([("x",), ("y",), ("q",), (None,)], "v string").coalesce(1)
    out = clean.set_levels(df, "v", ["y", "x"], ["why", "ex"])
    assert values(out, "v") == ["ex", "why", None, None]
    assert clean.levels_of(out, "v") == ["why", "ex"]
    assert values(clean.factor_code(out, "v", "code"), "code") == [2, 1, None, None]


def test_symbols(spark):
    df = spark.createDataFrame([(0.01,), (0.011,), (0.05,), (0.051,), (None,)], "p double").coalesce(1)
    assert values(df, C.significance_symbol("p")) == ["P<0.01", "P<0.05", "P<0.05", "ns", None]
    assert math.isclose(values(df, C.weighted_index({"p": 10}))[0], 0.1)
