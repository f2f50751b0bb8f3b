"""The Cox analyses at the study's width, over line items joined with their order, customer, part and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import chi2_p, normal_p, query, rounded, table
from registry.newton import cox_ctes
from registry.survival import Z
from riskset.plans import coxflows

_JOINED = """lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey"""


def joined(spark, d):
    """Line items with the columns of their order, customer, part and supplier; the orders alone are not small."""
    t = lambda name: table(spark, d, name)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return (t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
            .join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
            .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
            .withColumn("ev", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
            .withColumn("arm", F.when(10.0 * F.col("l_tax") + 5.0 * F.col("l_discount") < 0.63, 0).otherwise(1)))


#: fourteen factors: an expression that both engines read, and the levels
FACTORS = {
    "status": ("l_linestatus", ["F", "O"]),
    "line": ("CASE WHEN l_linenumber <= 3 THEN 'a' WHEN l_linenumber <= 5 THEN 'b' ELSE 'c' END", ["a", "b", "c"]),
    "ordered": ("o_orderstatus", ["F", "O", "P"]),
    "priority": ("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'mid' WHEN '4' THEN 'low' WHEN '5' THEN 'low' END",
                 ["high", "mid", "low"]),
    "segment": ("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    "size": ("CASE WHEN p_size <= 15 THEN 's' WHEN p_size <= 35 THEN 'm' WHEN p_size > 35 THEN 'l' END", ["s", "m", "l"]),
    "price": ("CASE WHEN l_extendedprice < 40000 THEN 'lo' ELSE 'hi' END", ["lo", "hi"]),
    "total": ("CASE WHEN o_totalprice < 250000 THEN 'lo' WHEN o_totalprice >= 250000 THEN 'hi' END", ["lo", "hi"]),
    "balance": ("CASE WHEN c_acctbal < 2000 THEN 'lo' WHEN c_acctbal < 6000 THEN 'mid' WHEN c_acctbal >= 6000 THEN 'hi' END", ["lo", "mid", "hi"]),
    "supplier": ("CASE WHEN s_acctbal < 5000 THEN 'lo' WHEN s_acctbal >= 5000 THEN 'hi' END", ["lo", "hi"]),
    "half": ("CASE WHEN month(o_orderdate) <= 6 THEN 'h1' WHEN month(o_orderdate) > 6 THEN 'h2' END", ["h1", "h2"]),
    "shipped": ("CASE WHEN month(l_shipdate) <= 6 THEN 'h1' WHEN month(l_shipdate) > 6 THEN 'h2' END", ["h1", "h2"]),
    "kind": ("CASE WHEN p_type = 'ECONOMY' THEN 'eco' WHEN p_type IS NOT NULL THEN 'other' END", ["eco", "other"]),
    "nation": ("CASE c_nationkey % 3 WHEN 0 THEN 'n0' WHEN 1 THEN 'n1' WHEN 2 THEN 'n2' END", ["n0", "n1", "n2"]),
}


def _subgroup_sql() -> str:
    columns = ", ".join(f"{e} AS f{i}" for i, (e, _) in enumerate(FACTORS.values()))
    places = [(i, f, j, v) for i, (f, (_, levels)) in enumerate(FACTORS.items()) for j, v in enumerate(levels)]
    spec = ", ".join(f"({i}, '{f}', {j}, '{v}')" for i, f, j, v in places)
    cells = " UNION ALL ".join(f"SELECT {i} AS i, f{i} AS v, t, ev, arm, count(*) AS n FROM base WHERE f{i} IS NOT NULL GROUP BY ALL" for i in range(len(FACTORS)))
    widths = sorted({len(levels) for _, levels in FACTORS.values()})

    def fitted(width: int, crossed: bool) -> str:
        dummies = [f"(j = {j})::INT::DOUBLE" for j in range(1, width)]
        xs = ["arm::DOUBLE", *dummies, *([f"(arm * (j = {j})::INT)::DOUBLE" for j in range(1, width)] if crossed else [])]
        source = (f"SELECT f AS k, t, ev AS e, {', '.join(f'{x} AS x{k}' for k, x in enumerate(xs, 1))}, n::DOUBLE AS n "
                  f"FROM cells WHERE i IN ({', '.join(str(i) for i, (_, lv) in enumerate(FACTORS.values()) if len(lv) == width)})")
        return cox_ctes(source, len(xs), f"{'x' if crossed else 'm'}{width}", steps=5)

    tests = []
    for width in widths:
        if width == 2:
            tests.append(f"SELECT k, {normal_p('b3 / sqrt(v_3_3)')} AS p FROM x2")
        else:
            tests.append(f"SELECT k, {chi2_p('greatest(2 * (x.ll - m.ll), 0)', str(width - 1))} AS p FROM x{width} x JOIN m{width} m USING (k)")
    fits = ",\n".join([*[fitted(w, True) for w in widths], *[fitted(w, False) for w in widths if w > 2]])
    levels = ("SELECT 'Overall' AS k, t, ev AS e, arm::DOUBLE AS x1, count(*)::DOUBLE AS n FROM base GROUP BY ALL "
              "UNION ALL SELECT f || '=' || v AS k, t, ev AS e, arm::DOUBLE AS x1, n::DOUBLE AS n FROM cells")
    return f"""WITH base AS MATERIALIZED (SELECT l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ev,
        CASE WHEN 10.0 * l_tax + 5.0 * l_discount < 0.63 THEN 0 ELSE 1 END AS arm, {columns} FROM {_JOINED}),
    spec(i, f, j, v) AS (VALUES {spec}),
    cells AS MATERIALIZED (SELECT i, f, j, v, t, ev, arm, n FROM ({cells}) JOIN spec USING (i, v)),
    {cox_ctes(levels, 1, 'lv')},
    {fits},
    tests AS ({' UNION ALL '.join(tests)}),
    c AS (SELECT f, j, v, sum(n * ev)::BIGINT AS events, sum(n)::BIGINT AS total, sum(n * ev * (1 - arm))::BIGINT AS events_low,
            sum(n * (1 - arm))::BIGINT AS total_low, sum(n * ev * arm)::BIGINT AS events_high, sum(n * arm)::BIGINT AS total_high
          FROM (SELECT f, j, v, ev, arm, n FROM cells UNION ALL SELECT 'Overall', 0, NULL, ev, arm, 1 FROM base) GROUP BY ALL),
    shown AS (SELECT c.*, 100.0 * total / sum(total) OVER (PARTITION BY f) AS percent,
                     CASE WHEN v IS NULL THEN f ELSE f || '=' || v END AS k FROM c)
    SELECT f AS variable, v AS level, events, total, events_low, total_low, events_high, total_high, round(percent, 6) AS percent,
           round(exp(b1), 6) AS estimate, round(exp(b1 - {Z} * sqrt(v_1_1)), 5) AS lower, round(exp(b1 + {Z} * sqrt(v_1_1)), 5) AS upper,
           round({normal_p('b1 / sqrt(v_1_1)')}, 5) AS p_value, NULL::DOUBLE AS p_interaction
    FROM shown JOIN lv USING (k)
    UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(p, 5) FROM tests"""


@query("v20_subgroup_cox_14_factors", _subgroup_sql())
def v20_wide(spark, d):
    df = joined(spark, d).select("l_quantity", "ev", "arm", *[F.expr(e).alias(f) for f, (e, _) in FACTORS.items()])
    t = coxflows.subgroup_cox(df, "l_quantity", "ev", "arm", {f: levels for f, (_, levels) in FACTORS.items()})
    return rounded(t.drop("row_order"), 6, lower=5, upper=5, p_value=5, p_interaction=5)


#: eight covariates, numbers and factors: an expression that both engines read, and the levels
COVARIATES = {
    "l_linenumber": ("CAST(l_linenumber AS DOUBLE)", None),
    "status": ("l_linestatus", ["F", "O"]),
    "ordered": ("o_orderstatus", ["F", "O", "P"]),
    "size": ("p_size / 10.0", None),
    "balance": ("c_acctbal / 1000.0", None),
    "credit": ("s_acctbal / 1000.0", None),
    "total": ("o_totalprice / 100000.0", None),
    "priority": ("CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)", None),
}


def _adjusted_sql() -> str:
    named = [(f"{c}{v}" if v else c, f"({e} = '{v}')::INT::DOUBLE" if v else e) for c, (e, lv) in COVARIATES.items() for v in (lv[1:] if lv else [None])]
    named.append(("l_extendedprice", "l_extendedprice / 10000.0"))
    xs = ", ".join(f"({e}) AS x{k}" for k, (_, e) in enumerate(named, 1))
    cells = (f"SELECT 'm' AS k, l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e, {xs}, 1.0::DOUBLE AS n FROM {_JOINED} "
             f"WHERE {' AND '.join(f'({e}) IS NOT NULL' for _, e in named)}")
    parts = [f"SELECT '{name}' AS variable, round(b{k}, 6) AS coefficient, round(exp(b{k}), 6) AS \"HR\", "
             f"round(exp(b{k} - {Z} * sqrt(v_{k}_{k})), 5) AS \"CI_lower\", round(exp(b{k} + {Z} * sqrt(v_{k}_{k})), 5) AS \"CI_upper\", "
             f"round({normal_p(f'b{k} / sqrt(v_{k}_{k})')}, 5) AS p_value FROM fit" for k, (name, _) in enumerate(named, 1)]
    return f"WITH {cox_ctes(cells, len(named), 'fit', steps=4)} {' UNION ALL '.join(parts)}"


@query("v14_adjusted_8_covariates", _adjusted_sql())
def v14_wide(spark, d):
    from riskset.operators.clean import set_levels

    df = joined(spark, d).select("l_quantity", "ev", (F.col("l_extendedprice") / 10000.0).alias("l_extendedprice"),
                                 *[F.expr(e).alias(c) for c, (e, _) in COVARIATES.items()])
    for c, (_, levels) in COVARIATES.items():
        if levels:
            df = set_levels(df, c, levels)
    t = coxflows.cox_multivariable(df, "l_quantity", "ev", [*COVARIATES, "l_extendedprice"])
    return rounded(t.drop("row_order"), 6, CI_lower=5, CI_upper=5, p_value=5)
