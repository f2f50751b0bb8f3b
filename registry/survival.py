"""Kaplan-Meier, log-rank and Cox queries (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import chi2_p, lineitem, normal_p, query, rounded
from registry.describe import _GROUPED, grouped
from registry.newton import cox_ctes
from riskset.functions.columns import weighted_index
from riskset.operators import clean, cox, design, km, missing, report
from riskset.plans import coxflows

Z = "1.959963984540054"
_LI = "(SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ev FROM lineitem)"

# --- Kaplan-Meier and log-rank ---------------------------------------------------


def _km_ctes(time: str, group: str, src: str) -> str:
    return f"""c AS (SELECT {group}::VARCHAR AS stratum, {time}::DOUBLE AS time, sum(ev) AS d, count(*) - sum(ev) AS c
                     FROM {src} GROUP BY 1, 2),
      r AS (SELECT *, sum(d + c) OVER (PARTITION BY stratum ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n FROM c),
      km AS (SELECT stratum, time, n::BIGINT AS n_risk, d::BIGINT AS n_event, c::BIGINT AS n_censor,
        round(exp(sum(CASE WHEN d >= n THEN '-inf'::DOUBLE ELSE ln(1 - d / n) END)
              OVER (PARTITION BY stratum ORDER BY time ROWS UNBOUNDED PRECEDING)), 8) AS surv FROM r)"""


def _km_frame(spark, d):
    return lineitem(spark, d, "l_quantity", "l_linestatus", "l_extendedprice", "l_linenumber", "l_returnflag")


@query("v1_kaplan_meier", f"WITH {_km_ctes('l_quantity', 'l_linestatus', _LI)} SELECT * FROM km")
def v1(spark, d):
    return rounded(km.kaplan_meier(_km_frame(spark, d), "l_quantity", "ev", "l_linestatus"), 8)


@query("v1_kaplan_meier_many_times",
       f"WITH {_km_ctes('l_extendedprice', 'l_linestatus', _LI)} SELECT * FROM km")
def v1_many(spark, d):
    return rounded(km.kaplan_meier(_km_frame(spark, d), "l_extendedprice", "ev", "l_linestatus"), 8)


@query("v2_risk_table", " UNION ALL ".join(
    f"SELECT l_linenumber::VARCHAR AS stratum, {b}::DOUBLE AS time, count(*) FILTER (WHERE least(l_quantity, 30) >= {b}) AS n_risk "
    f"FROM lineitem GROUP BY l_linenumber" for b in range(0, 31, 5)))
def v2(spark, d):
    capped = _km_frame(spark, d).withColumn("t30", F.least(F.col("l_quantity"), F.lit(30.0)))
    return km.risk_table(capped, "t30", "ev", "l_linenumber")


@query("v3_censor_marks",
       f"WITH {_km_ctes('l_quantity', 'l_linestatus', _LI)} SELECT stratum, time, surv FROM km WHERE n_censor > 0")
def v3(spark, d):
    curve = km.kaplan_meier(_km_frame(spark, d), "l_quantity", "ev", "l_linestatus")
    return rounded(km.censor_marks(curve), 8)


def _logrank_ctes(time, group, src):
    return f"""t AS (SELECT {time} AS t, sum(ev)::DOUBLE AS d, count(*) AS m FROM {src} GROUP BY 1),
      n AS (SELECT t, d, sum(m) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS n FROM t),
      g AS (SELECT DISTINCT {group}::VARCHAR AS g FROM {src}),
      tg AS (SELECT {time} AS t, {group}::VARCHAR AS g, sum(ev)::DOUBLE AS d, count(*) AS m FROM {src} GROUP BY 1, 2),
      ng AS (SELECT n.t, g.g, n.d, n.n, coalesce(tg.d, 0) AS dg,
               sum(coalesce(tg.m, 0)) OVER (PARTITION BY g.g ORDER BY n.t DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS ng
             FROM n CROSS JOIN g LEFT JOIN tg ON tg.t = n.t AND tg.g = g.g),
      oe AS (SELECT g, sum(dg) AS o, sum(d * ng / n) AS e FROM ng GROUP BY g),
      vv AS (SELECT a.g AS g, b.g AS h, sum(CASE WHEN a.n > 1 THEN a.d * (a.n - a.d) / (a.n * a.n * (a.n - 1))
                * a.ng * (CASE WHEN a.g = b.g THEN a.n ELSE 0 END - b.ng) ELSE 0 END) AS v
             FROM ng a JOIN ng b ON a.t = b.t GROUP BY ALL)"""


# three groups: the 2x2 inverse of the covariance written out
@query("v4_logrank", f"""
    WITH {_logrank_ctes('l_quantity', 'l_returnflag', "(SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS ev FROM lineitem)")},
    s AS (SELECT (SELECT o - e FROM oe WHERE g = 'N') AS x, (SELECT o - e FROM oe WHERE g = 'R') AS y,
                 (SELECT v FROM vv WHERE g = 'N' AND h = 'N') AS a, (SELECT v FROM vv WHERE g = 'N' AND h = 'R') AS b,
                 (SELECT v FROM vv WHERE g = 'R' AND h = 'R') AS c),
    q AS (SELECT (c * x * x - 2 * b * x * y + a * y * y) / (a * c - b * b) AS chisq FROM s)
    SELECT round(chisq, 6) AS chisq, 2 AS df, round({chi2_p('chisq', '2')}, 6) AS p_value FROM q""")
def v4(spark, d):
    li = lineitem(spark, d, "l_quantity", "l_linestatus", "l_returnflag").withColumn(
        "open", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(km.logrank(li, "l_quantity", "open", "l_returnflag"))


@query("v4_logrank_table", f"""
    WITH {_logrank_ctes('l_extendedprice', 'l_linenumber', _LI)}
    SELECT g AS stratum, (SELECT count(*) FROM lineitem WHERE l_linenumber::VARCHAR = g) AS n, o::BIGINT AS observed,
           round(e, 5) AS expected FROM oe""")
def v4_table(spark, d):
    return rounded(km.logrank_table(_km_frame(spark, d), "l_extendedprice", "ev", "l_linenumber"), 5)


# --- Cox: cells for the SQL side ------------------------------------------------------


def _cells(key: str, time: str, xs: list[str], src: str = _LI, where: str = "") -> str:
    cols = ", ".join(f"({x})::DOUBLE AS x{i}" for i, x in enumerate(xs, 1))
    return f"SELECT {key} AS k, {time}::DOUBLE AS t, ev AS e, {cols}, count(*)::DOUBLE AS n FROM {src} {where} GROUP BY ALL"


def _terms(name: str, p: int, labels: list[str], where: str = "") -> str:
    """One row per coefficient of the fits in CTE ``name``."""
    parts = []
    for i in range(1, p + 1):
        z = f"b{i} / sqrt(v_{i}_{i})"
        parts.append(
            f"SELECT k, {i} AS term_order, '{labels[i - 1]}' AS term, round(b{i}, 6) AS coef, round(exp(b{i}), 6) AS hr, "
            f"round(exp(b{i} - {Z} * sqrt(v_{i}_{i})), 5) AS lower, round(exp(b{i} + {Z} * sqrt(v_{i}_{i})), 5) AS upper, "
            f"round({normal_p(z)}, 5) AS p_value FROM {name} {where}")
    return " UNION ALL ".join(parts)


def _flat(t):
    """Spark side of the same columns, from a coefficient summary."""
    return rounded(t.select(F.col("model").alias("k"), "term_order", "term", "coef", "hr",
                            F.col("ci_lower").alias("lower"), F.col("ci_upper").alias("upper"), "p_value"),
                   6, lower=5, upper=5, p_value=5)


def _cox_frame(spark, d):
    li = lineitem(spark, d, "l_quantity", "l_linenumber", "l_discount", "l_tax", "l_extendedprice", "l_linestatus",
                  "l_returnflag")
    return li.withColumn("idx", weighted_index({"l_tax": 10, "l_discount": 5}))


@query("v5_cox_fit", f"""WITH {cox_ctes(_cells("'model'", 'l_quantity', ['l_discount', 'l_tax']), 2)}
    {_terms('fit', 2, ['l_discount', 'l_tax'])}""")
def v5(spark, d):
    df = _cox_frame(spark, d)
    fit = cox.cox_fit(df, "l_quantity", "ev", design.numeric_terms("l_discount", "l_tax"))
    return _flat(cox.cox_summary(spark, [fit]))


@query("v5_cox_fit_many_times", f"""
    WITH {cox_ctes(_cells("'model'", 'l_extendedprice', ['l_discount', 'l_tax']), 2)}
    {_terms('fit', 2, ['l_discount', 'l_tax'])}""")
def v5_many(spark, d):
    """Times in buckets: there are more of them than are held one by one."""
    df = _cox_frame(spark, d)
    fit = cox.cox_fit(df, "l_extendedprice", "ev", design.numeric_terms("l_discount", "l_tax"))
    return _flat(cox.cox_summary(spark, [fit]))


@query("v6_cox_breslow", f"""
    WITH {cox_ctes(_cells("'model'", 'l_quantity', ['l_discount', 'l_tax']), 2, efron=False)}
    SELECT k AS model, round(ll0, 4) AS loglik0, round(ll, 4) AS loglik, (SELECT count(*) FROM lineitem) AS n,
           (SELECT sum(ev)::BIGINT FROM {_LI}) AS events, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM fit""")
def v6(spark, d):
    fit = cox.cox_fit(_cox_frame(spark, d), "l_quantity", "ev", design.numeric_terms("l_discount", "l_tax"),
                      ties="breslow")
    stats = cox.fit_statistics(spark, [fit]).select("model", "loglik0", "loglik", "n", "events")
    return rounded(stats.withColumns({"b1": F.lit(float(fit.coef[0])), "b2": F.lit(float(fit.coef[1]))}),
                   6, loglik0=4, loglik=4)


@query("v7_dummy_code", """
    SELECT l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS flagN,
           CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS flagR, count(*) AS n FROM lineitem GROUP BY ALL""")
def v7(spark, d):
    terms = design.dummy_code("l_returnflag", ["A", "N", "R"], "flag")
    li = lineitem(spark, d, "l_linenumber", "l_returnflag")
    return li.groupBy("l_linenumber", "l_returnflag", *[c.alias(n) for n, c in terms.items()]).agg(
        F.count(F.lit(1)).alias("n"))


@query("v8_cox_summary", f"""
    WITH {cox_ctes(_cells("'model'", 'l_linenumber', ['l_discount', 'idx'], f'(SELECT *, 10.0 * l_tax AS idx FROM {_LI})'), 2)}
    SELECT t AS term, round(b, 6) AS coef, round(exp(b), 6) AS hr, round(se, 6) AS se, round(b / se, 5) AS z,
           round({normal_p('b / se')}, 5) AS p_value, round(exp(b - {Z} * se), 5) AS ci_lower, round(exp(b + {Z} * se), 5) AS ci_upper
    FROM (SELECT 'l_discount' AS t, b1 AS b, sqrt(v_1_1) AS se FROM fit UNION ALL
          SELECT 'tax10', b2, sqrt(v_2_2) FROM fit)""")
def v8(spark, d):
    terms = {**design.numeric_terms("l_discount"), "tax10": 10.0 * F.col("l_tax")}
    t = cox.cox_summary(spark, [cox.cox_fit(_cox_frame(spark, d), "l_linenumber", "ev", terms)])
    return rounded(t.select("term", "coef", "hr", "se", "z", "p_value", "ci_lower", "ci_upper"), 6, z=5, p_value=5,
                   ci_lower=5, ci_upper=5)


_SWEEP = [("l_discount", "l_discount"), ("l_tax", "l_tax"), ("l_linenumber", "l_linenumber"), ("idx", "10.0 * l_tax + 5.0 * l_discount"),
          ("l_linestatus", "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END")]
_SWEEP_SQL = (
    "WITH " + cox_ctes(" UNION ALL ".join(_cells(f"'{n}'", "l_quantity", [x]) for n, x in _SWEEP), 1, "one") + ",\n"
    + cox_ctes(_cells("'grp'", "l_quantity", [f"(grp = {g})::INT" for g in (2, 3, 4)], _GROUPED), 3, "many") + f""",
    sweep AS (
      SELECT k AS "Variable", NULL AS "Levels", b1 AS b, sqrt(v_1_1) AS se FROM one
      UNION ALL SELECT k, 'grp2', b1, sqrt(v_1_1) FROM many UNION ALL SELECT k, 'grp3', b2, sqrt(v_2_2) FROM many
      UNION ALL SELECT k, 'grp4', b3, sqrt(v_3_3) FROM many),
    sweep_p AS (SELECT *, {normal_p('b / se')} AS p FROM sweep)""")


def _sweep(spark, d):
    g = grouped(spark, d, "l_quantity", "l_linenumber", "l_discount", "l_tax", "l_linestatus")
    g = clean.as_factor(g, "grp", [1, 2, 3, 4])
    return coxflows.cox_univariable_sweep(
        g, "l_quantity", "ev", ["l_discount", "l_tax", "l_linenumber", "idx", "l_linestatus", "grp"])


@query("v9_univariable_sweep", _SWEEP_SQL + f"""
    SELECT "Variable", "Levels", round(b, 6) AS "Coef", round(exp(b), 6) AS "HR", round(exp(b - {Z} * se), 5) AS "HR_CI_Lower",
           round(exp(b + {Z} * se), 5) AS "HR_CI_Upper", round(p, 5) AS "P_Value" FROM sweep_p""")
def v9(spark, d):
    return rounded(_sweep(spark, d).drop("row_order"), 6, HR_CI_Lower=5, HR_CI_Upper=5, P_Value=5)


def _num(x, k=3):
    return (f"regexp_replace(regexp_replace(format('{{:.{k}f}}', round({x}, {k})), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')")


@query("v10_pretty_results", _SWEEP_SQL + f"""
    SELECT "Variable", "Levels", round(b, 6) AS "Coef", round(exp(b), 3) AS "HR",
           {_num(f'exp(b - {Z} * se)')} || '-' || {_num(f'exp(b + {Z} * se)')} AS "HR_95CI",
           CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.' || (SELECT max(greatest(greatest(length(regexp_replace(
             split_part(format('{{:.2e}}', p), 'e', 1), '\\.?0+$', '')) - 2, 0) - split_part(format('{{:.2e}}', p), 'e', 2)::INT, 0))
             FROM sweep_p WHERE p >= 0.001) || 'f', p) END AS "P_Value" FROM sweep_p""")
def v10(spark, d):
    return rounded(report.cox_results_pretty(_sweep(spark, d)).drop("row_order"))


_TREND_SRC = f"(SELECT *, grp::DOUBLE AS g FROM {_GROUPED})"


@query("v11_p_for_trend", "WITH "
       + cox_ctes(_cells("'unadjusted'", "l_quantity", ["g"], _TREND_SRC), 1, "a") + ",\n"
       + cox_ctes(_cells("'adjusted'", "l_quantity", ["l_linenumber", "(l_linestatus = 'O')::INT", "g"], _TREND_SRC), 3, "b") + f""",
    r AS (SELECT k, b1 AS b, sqrt(v_1_1) AS se FROM a UNION ALL SELECT k, b3, sqrt(v_3_3) FROM b)
    SELECT k AS model, round(b, 6) AS coef, round(exp(b), 6) AS hr, round(exp(b - {Z} * se), 5) AS ci_lower,
           round(exp(b + {Z} * se), 5) AS ci_upper, round({normal_p('b / se')}, 5) AS p_value FROM r""")
def v11(spark, d):
    g = grouped(spark, d, "l_quantity", "l_linenumber", "l_linestatus")
    t = coxflows.p_for_trend(g, "l_quantity", "ev", "grp", {"adjusted": ["l_linenumber", "l_linestatus"]})
    return rounded(t, 6, ci_lower=5, ci_upper=5, p_value=5)


def _multi(t):
    return rounded(t.drop("row_order"), 6, CI_lower=5, CI_upper=5, p_value=5)


def _multi_sql(name, labels, extra=""):
    parts = []
    for i, label in enumerate(labels, 1):
        z = f"b{i} / sqrt(v_{i}_{i})"
        parts.append(f"SELECT '{label}' AS variable, round(b{i}, 6) AS coefficient, round(exp(b{i}), 6) AS \"HR\", "
                     f"round(exp(b{i} - {Z} * sqrt(v_{i}_{i})), 5) AS \"CI_lower\", "
                     f"round(exp(b{i} + {Z} * sqrt(v_{i}_{i})), 5) AS \"CI_upper\", round({normal_p(z)}, 5) AS p_value FROM {name}")
    return " UNION ALL ".join(parts) + extra


_NULL_ROW = "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
_SHIP_LI = """(SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS lo FROM """ + _LI + ")"


_CANDIDATES = ["l_discount", "lo", "l_tax"]


# every variable of the sweep below 0.7 enters; the SQL zeroes the others
@query("v12_screened_multivariable", "WITH "
       + cox_ctes(" UNION ALL ".join(_cells(f"'{n}'", "l_quantity", [n], _SHIP_LI) for n in _CANDIDATES), 1, "u") + f""",
    kept AS (SELECT k FROM u WHERE {normal_p('b1 / sqrt(v_1_1)')} < 0.7),
    flags AS (SELECT {', '.join(f"(SELECT count(*) FROM kept WHERE k = '{n}') AS k_{n}" for n in _CANDIDATES)}),
    """ + cox_ctes(_cells("'m'", "l_quantity", [f"{n} * k_{n}" for n in _CANDIDATES], f"{_SHIP_LI}, flags"), 3, "m") + f"""
    SELECT r.*, (SELECT string_agg(k, ',' ORDER BY k) FROM kept) AS kept FROM ({_multi_sql('m', _CANDIDATES)}) r
    WHERE variable IN (SELECT k FROM kept)""")
def v12(spark, d):
    df = _cox_frame(spark, d).withColumn("lo", (F.col("l_linestatus") == "O").cast("int"))
    sweep = coxflows.cox_univariable_sweep(df, "l_quantity", "ev", ["l_discount", "lo", "l_tax"]).persist()
    t = coxflows.cox_screened_multivariable(df, "l_quantity", "ev", sweep, 0.7)
    kept = ",".join(sorted(missing.significant_names(sweep, 0.7)))
    return _multi(t).withColumn("kept", F.lit(kept))


@query("v13_aliased_terms", "WITH " + cox_ctes(_cells("'m'", "l_quantity", ["l_discount", "l_tax"]), 2, "m")
       + _multi_sql("m", ["l_discount", "l_tax"], f" UNION ALL SELECT 'idx', {_NULL_ROW}"))
def v13(spark, d):
    return _multi(coxflows.cox_multivariable(_cox_frame(spark, d), "l_quantity", "ev", ["l_discount", "l_tax", "idx"]))


_M2 = ["l_linenumber", "(l_linestatus = 'O')::INT"]
_M2_LABELS = ["l_linenumber", "l_linestatusO"]


def _adjusted_sql(covs, labels):
    grp = [f"(grp = {g})::INT" for g in (2, 3, 4)]
    p = len(covs)
    return ("WITH " + cox_ctes(_cells("'c'", "l_quantity", [*covs, "idx"], _GROUPED), p + 1, "c") + ",\n"
            + cox_ctes(_cells("'t'", "l_quantity", [*covs, "grp"], _GROUPED), p + 1, "t") + ",\n"
            + cox_ctes(_cells("'f'", "l_quantity", [*covs, *grp], _GROUPED), p + 3, "f", steps=5)
            + f" SELECT 'continuous' AS form, * FROM ({_multi_sql('c', [*labels, 'idx'])})"
            + f" UNION ALL SELECT 'trend', * FROM ({_multi_sql('t', [*labels, 'grp'])})"
            + f" UNION ALL SELECT 'factor', * FROM ({_multi_sql('f', [*labels, 'grp2', 'grp3', 'grp4'])})")


def _adjusted(spark, d, covariates, *extra):
    g = grouped(spark, d, "l_quantity", "l_linenumber", "l_linestatus", *extra)
    forms = coxflows.cox_adjusted(g, "l_quantity", "ev", covariates, "idx", "grp", [1, 2, 3, 4])
    return _multi(report.append_results([t.withColumn("form", F.lit(k)) for k, t in forms.items()]))


@query("v14_adjusted_model2", _adjusted_sql(_M2, _M2_LABELS))
def v14(spark, d):
    return _adjusted(spark, d, ["l_linenumber", "l_linestatus"])


@query("v15_adjusted_model3", _adjusted_sql([*_M2, "l_tax"], [*_M2_LABELS, "l_tax"]))
def v15(spark, d):
    return _adjusted(spark, d, ["l_linenumber", "l_linestatus", "l_tax"])


# --- spline ------------------------------------------------------------------------------

_KNOTS = """(SELECT quantile_cont(l_quantity, 0.1) AS t1, quantile_cont(l_quantity, 0.5) AS t2,
             quantile_cont(l_quantity, 0.9) AS t3 FROM lineitem)"""


def _rcs(x):
    return (f"(greatest({x} - t1, 0) ** 3 - greatest({x} - t2, 0) ** 3 * (t3 - t1) / (t3 - t2) "
            f"+ greatest({x} - t3, 0) ** 3 * (t2 - t1) / (t3 - t2)) / (t3 - t1) ** 2")


@query("v16_rcs_basis", f"""
    SELECT l_quantity AS x, round({_rcs('l_quantity')}, 8) AS x2, count(*) AS n FROM lineitem, {_KNOTS} GROUP BY ALL""")
def v16(spark, d):
    li = lineitem(spark, d, "l_quantity")
    basis = design.rcs_basis("l_quantity", design.rcs_knots(li, "l_quantity", 3))
    return rounded(li.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).select(
        basis["l_quantity"].alias("x"), basis["l_quantity'"].alias("x2"), "n"), 8)


_SPLINE_SRC = f"(SELECT *, {_rcs('l_quantity')} AS s2 FROM {_LI}, {_KNOTS})"
_SPLINE_CTES = cox_ctes(_cells("'spline'", "l_linenumber", ["l_quantity", "s2", "l_tax"], _SPLINE_SRC), 3)


def _spline(spark, d):
    return coxflows.cox_spline_fit(_cox_frame(spark, d), "l_linenumber", "ev", "l_quantity", ["l_tax"])


@query("v17_cox_spline", f"WITH {_SPLINE_CTES} {_terms('fit', 3, ['l_quantity', 'l_quantity.', 'l_tax'])}".replace(
    "l_quantity.'", "l_quantity'''"))
def v17(spark, d):
    return _flat(_spline(spark, d).table())


@query("v18_wald_anova", f"""WITH {_SPLINE_CTES},
    q AS (SELECT (v_2_2 * b1 * b1 - 2 * v_1_2 * b1 * b2 + v_1_1 * b2 * b2) / (v_1_1 * v_2_2 - v_1_2 * v_1_2) AS o,
                 b2 * b2 / v_2_2 AS nl, b3 * b3 / v_3_3 AS tx,
                 (b1 * b1 * (v_2_2 * v_3_3 - v_2_3 * v_2_3) + b2 * b2 * (v_1_1 * v_3_3 - v_1_3 * v_1_3)
                  + b3 * b3 * (v_1_1 * v_2_2 - v_1_2 * v_1_2) + 2 * b1 * b2 * (v_1_3 * v_2_3 - v_1_2 * v_3_3)
                  + 2 * b1 * b3 * (v_1_2 * v_2_3 - v_1_3 * v_2_2) + 2 * b2 * b3 * (v_1_2 * v_1_3 - v_1_1 * v_2_3))
                 / (v_1_1 * (v_2_2 * v_3_3 - v_2_3 * v_2_3) - v_1_2 * (v_1_2 * v_3_3 - v_2_3 * v_1_3)
                    + v_1_3 * (v_1_2 * v_2_3 - v_2_2 * v_1_3)) AS al FROM fit)
    SELECT 'l_quantity' AS term, round(o, 5) AS chisq, 2 AS df, round({chi2_p('o', '2')}, 5) AS p_value FROM q
    UNION ALL SELECT ' Nonlinear', round(nl, 5), 1, round({chi2_p('nl', '1')}, 5) FROM q
    UNION ALL SELECT 'l_tax', round(tx, 5), 1, round({chi2_p('tx', '1')}, 5) FROM q
    UNION ALL SELECT 'TOTAL', round(al, 5), 3, round({chi2_p('al', '3')}, 5) FROM q""")
def v18(spark, d):
    return rounded(_spline(spark, d).wald_anova().drop("row_order"), 5)


@query("v19_hr_curve", f"""WITH {_SPLINE_CTES},
    x AS (SELECT DISTINCT l_quantity AS x FROM lineitem),
    c AS (SELECT x, x - t2 AS c1, {_rcs('x')} - {_rcs('t2')} AS c2 FROM x, {_KNOTS}),
    e AS (SELECT x, b1 * c1 + b2 * c2 AS eta, sqrt(greatest(v_1_1 * c1 * c1 + 2 * v_1_2 * c1 * c2 + v_2_2 * c2 * c2, 0)) AS se FROM c, fit)
    SELECT x, round(exp(eta), 6) AS hr, round(exp(eta - {Z} * se), 6) AS lower, round(exp(eta + {Z} * se), 6) AS upper FROM e""")
def v19(spark, d):
    xs = lineitem(spark, d, "l_quantity").select(F.col("l_quantity").alias("x")).distinct()
    return rounded(_spline(spark, d).hr_curve(xs))


# --- subgroups -----------------------------------------------------------------------------

_ARM = f"(SELECT *, CASE WHEN 10.0 * l_tax + 5.0 * l_discount < 0.63 THEN 0 ELSE 1 END AS arm FROM {_LI})"


def _subgroup_sql():
    half = (f"(SELECT *, CASE WHEN l_linenumber <= 3 THEN 'a' WHEN l_linenumber <= 5 THEN 'b' ELSE 'c' END AS half "
            f"FROM {_ARM})")
    keyed = [_cells("'Overall'", "l_quantity", ["arm"], _ARM),
             _cells("'l_linestatus=' || l_linestatus", "l_quantity", ["arm"], _ARM),
             _cells("'half=' || half", "l_quantity", ["arm"], half)]
    o = "(l_linestatus = 'O')::INT"
    b, c = "(half = 'b')::INT", "(half = 'c')::INT"
    return ("WITH " + cox_ctes(" UNION ALL ".join(keyed), 1, "lv") + ",\n"
            + cox_ctes(_cells("'i'", "l_quantity", ["arm", o, f"arm * {o}"], half), 3, "s1", steps=5) + ",\n"
            + cox_ctes(_cells("'i'", "l_quantity", ["arm", b, c], half), 3, "h0", steps=5) + ",\n"
            + cox_ctes(_cells("'i'", "l_quantity", ["arm", b, c, f"arm * {b}", f"arm * {c}"], half), 5, "h1", steps=5) + f""",
    n AS (SELECT key, sum(ev)::BIGINT AS events, count(*) AS total, sum(ev * (1 - arm))::BIGINT AS events_low, sum(1 - arm)::BIGINT AS total_low,
            sum(ev * arm)::BIGINT AS events_high, sum(arm)::BIGINT AS total_high FROM (
            SELECT *, unnest(['Overall', 'l_linestatus=' || l_linestatus, 'half=' || half]) AS key FROM {half}) GROUP BY key)
    SELECT CASE WHEN key = 'Overall' THEN key ELSE split_part(key, '=', 1) END AS variable,
           CASE WHEN key <> 'Overall' THEN split_part(key, '=', 2) END AS level, events, total, events_low, total_low,
           events_high, total_high, round(100.0 * total / (SELECT count(*) FROM lineitem), 6) AS percent,
           round(exp(b1), 6) AS estimate, round(exp(b1 - {Z} * sqrt(v_1_1)), 5) AS lower, round(exp(b1 + {Z} * sqrt(v_1_1)), 5) AS upper,
           round({normal_p('b1 / sqrt(v_1_1)')}, 5) AS p_value, NULL::DOUBLE AS p_interaction
    FROM n JOIN lv ON lv.k = n.key
    UNION ALL SELECT 'l_linestatus', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
           (SELECT round({normal_p('b3 / sqrt(v_3_3)')}, 5) FROM s1)
    UNION ALL SELECT 'half', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
           (SELECT round({chi2_p('2 * (h1.ll - h0.ll)', '2')}, 5) FROM h0, h1)""")


def _subgroups(spark, d):
    df = _cox_frame(spark, d).withColumns({
        "arm": F.when(F.col("idx") < 0.63, 0).otherwise(1),
        "half": F.when(F.col("l_linenumber") <= 3, "a").when(F.col("l_linenumber") <= 5, "b").otherwise("c")})
    return coxflows.subgroup_cox(df, "l_quantity", "ev", "arm", {"l_linestatus": ["F", "O"], "half": ["a", "b", "c"]})


@query("v20_subgroup_cox", _subgroup_sql())
def v20(spark, d):
    return rounded(_subgroups(spark, d).drop("row_order"), 6, lower=5, upper=5, p_value=5, p_interaction=5)


@query("v21_forest_table", f"""WITH g AS ({_subgroup_sql()})
    SELECT CASE WHEN level IS NULL THEN CASE variable WHEN 'half' THEN 'Line part' WHEN 'l_linestatus' THEN 'Status' ELSE variable END
                ELSE '  ' || level END AS "Subgroup",
           coalesce(events_low || '/' || total_low || ' ', ' ') AS "Low", coalesce(events_high || '/' || total_high || ' ', ' ') AS "High",
           CASE WHEN estimate IS NULL THEN ' ' ELSE {_num('estimate', 2)} || ' (' || {_num('lower', 2)} || '-' || {_num('upper', 2)} || ')' END AS "Hazard Ratio (95% CI)",
           CASE WHEN estimate IS NULL THEN ' ' ELSE {_num('estimate', 2)} END AS "Point Estimate",
           CASE WHEN p_value IS NULL THEN ' ' WHEN p_value < 0.001 THEN '<0.001' ELSE format('{{:.3f}}', p_value) END AS "P value",
           CASE WHEN p_interaction IS NULL THEN ' ' WHEN p_interaction < 0.001 THEN '<0.001' ELSE format('{{:.3f}}', p_interaction) END AS "P for interaction"
    FROM g""")
def v21(spark, d):
    t = report.forest_table(_subgroups(spark, d), {"half": "Line part", "l_linestatus": "Status"})
    return t.select("Subgroup", "Low", "High", "Hazard Ratio (95% CI)", "Point Estimate", "P value", "P for interaction")
