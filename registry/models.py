"""Threshold regression, logistic and linear models, ROC comparisons, imputation (T, G, F6-F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import chi2_p, f_p, lineitem, normal_p, query, rounded, table
from registry.newton import _jordan, cox_ctes, linear_ctes, logit_ctes, profile_ctes
from registry.survival import Z, _LI, _cells, _cox_frame
from riskset.operators import auc, cox, design, glm, impute, threshold
from riskset.operators.frame import Model
from riskset.plans import discrimination

COARSE = [round(0.05 * k, 2) for k in range(1, 20)]
_TP = ("(SELECT unnest(quantile_cont(l_quantity, [" + ", ".join(str(p) for p in COARSE)
       + "])) AS cut, unnest(range(1, 20)) AS i FROM lineitem)")


def _hinged(cand: str, cols: str = "i") -> str:
    """Rows crossed with candidate cuts (cut, ``cols``)."""
    return f"(SELECT l.*, {cols}, cut, CASE WHEN l_quantity > cut THEN l_quantity - cut ELSE 0 END AS hinge FROM {_LI} l, {cand})"


def _frame(spark, d):
    return lineitem(spark, d, "l_quantity", "l_linenumber", "l_tax", "l_discount", "l_extendedprice", "l_returnflag")


def _tax():
    return {"l_tax": F.col("l_tax").cast("double")}


def _y_cells(key, y, xs, src):
    cols = ", ".join(f"({x})::DOUBLE AS x{i}" for i, x in enumerate(xs, 1))
    return f"SELECT {key} AS k, ({y})::DOUBLE AS y, {cols}, count(*)::DOUBLE AS n FROM {src} GROUP BY ALL"


# --- search ---------------------------------------------------------------------------


@query("t2_coarse_scan", "WITH "
       + cox_ctes(_cells("i", "l_linenumber", ["l_quantity", "l_tax", "hinge"], _hinged(_TP)), 3, efron=False, steps=4)
       + f""" SELECT k::INT AS candidate, round(0.05 * k, 2)::DOUBLE AS prob, round(cut, 6) AS cut, round(ll, 4) AS loglik
    FROM fit JOIN {_TP} ON k = i""")
def t2(spark, d):
    t = threshold.coarse_scan(_frame(spark, d), "l_quantity", "cox", _tax(), time="l_linenumber", event="ev")
    return rounded(t, 6, loglik=4)


@query("t3_refinement_window", """
    WITH w AS (SELECT quantile_cont(l_extendedprice, 0.36) AS low, quantile_cont(l_extendedprice, 0.44) AS high FROM lineitem)
    SELECT DISTINCT l_extendedprice AS value, round(low, 6) AS low, round(high, 6) AS high FROM lineitem, w
    WHERE l_extendedprice > low AND l_extendedprice < high""")
def t3(spark, d):
    return rounded(threshold.refinement_window(lineitem(spark, d, "l_extendedprice"), "l_extendedprice", 0.40))


def _narrowing_sql() -> str:
    """The trace of the search in closed form.

    With the base terms made orthogonal (u the centred price, v the tax without it, e the residual of the outcome), a
    cut's fit needs sums over the rows beyond it only, which running sums hold for every value.
    """
    sums = ["sum(1.0)", "sum(u)", "sum(u * u)", "sum(v)", "sum(v * u)", "sum(e)", "sum(e * u)"]
    names = ["n", "u", "uu", "v", "vu", "e", "eu"]
    h = {"h": "(s_u - c * s_n)", "hh": "(s_uu - 2 * c * s_u + c * c * s_n)", "hu": "(s_uu - c * s_u)",
         "hv": "(s_vu - c * s_v)", "he": "(s_eu - c * s_e)"}
    rss = (f"(ee - {h['he']} ** 2 / ({h['hh']} - {h['h']} ** 2 / n - {h['hu']} ** 2 / uu - {h['hv']} ** 2 / vv))")
    ll = f"-n / 2 * (ln(2 * pi()) + ln({rss} / n) + 1)"
    rank = lambda p: f"""(first - 1 + least(greatest(CASE WHEN (last - first + 1) * {p} - 0.5 = floor((last - first + 1) * {p} - 0.5)
        AND floor((last - first + 1) * {p} - 0.5)::BIGINT % 2 = 0 THEN floor((last - first + 1) * {p} - 0.5)
        ELSE floor((last - first + 1) * {p} - 0.5) + 1 END, 1), last - first + 1))::BIGINT"""  # noqa: E731
    return f"""WITH RECURSIVE
    r0 AS (SELECT l_extendedprice AS x, l_tax AS t, l_quantity AS y FROM lineitem),
    m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(t) AS mt, avg(y) AS my FROM r0),
    r1 AS (SELECT x, (x - mx) / 1e4 AS u, t - mt AS t, y - my AS y FROM r0, m),
    b1 AS (SELECT sum(u * u) AS uu, sum(t * u) / sum(u * u) AS tu, sum(y * u) / sum(u * u) AS yu FROM r1),
    r2 AS (SELECT x, u, t - tu * u AS v, y - yu * u AS y FROM r1, b1),
    b2 AS (SELECT sum(v * v) AS vv, sum(y * v) / sum(v * v) AS yv FROM r2),
    rr AS MATERIALIZED (SELECT x, u, v, y - yv * v AS e FROM r2, b2),
    b AS MATERIALIZED (SELECT n, mx, uu, vv, (SELECT sum(e * e) FROM rr) AS ee FROM m, b1, b2),
    cc AS (SELECT unnest(range(19)) AS i, unnest(quantile_cont(x, {COARSE})) AS cut FROM r0),
    cs AS (SELECT i, cut, (cut - any_value(mx)) / 1e4 AS c, {', '.join(f'{s} AS s_{n}' for s, n in zip(sums, names))}
           FROM cc JOIN rr ON x > cut, b GROUP BY i, cut),
    coarse AS MATERIALIZED (SELECT i, cut, {ll} AS ll FROM cs, b),
    top AS (SELECT arg_max(i, ll) AS i FROM coarse),
    ends AS (SELECT unnest(range(19)) AS i, unnest(quantile_cont(x, {[max(p - 0.04, 0.05) for p in COARSE]})) AS lo,
                    unnest(quantile_cont(x, {[min(p + 0.04, 0.95) for p in COARSE]})) AS hi FROM r0),
    win AS (SELECT lo, hi FROM ends JOIN top USING (i)),
    dv AS (SELECT x, {', '.join(f'{s} AS d_{n}' for s, n in zip(sums, names))} FROM rr GROUP BY x),
    beyond AS (SELECT x, {', '.join(f'coalesce(sum(d_{n}) OVER w, 0) AS s_{n}' for n in names)} FROM dv
               WINDOW w AS (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    fits AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cut) AS r, cut, {ll} AS ll
             FROM (SELECT x AS cut, (x - mx) / 1e4 AS c, {', '.join(f's_{n}' for n in names)} FROM beyond, b), b, win WHERE cut > lo AND cut < hi),
    narrow AS (
      SELECT 0 AS step, 1::BIGINT AS first, (SELECT count(*) FROM fits) AS last, NULL::BIGINT AS r1, NULL::BIGINT AS r2, NULL::BIGINT AS r3, NULL::INT AS best
      UNION ALL
      SELECT step + 1, CASE best WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END, CASE best WHEN 0 THEN q2 WHEN 1 THEN q3 ELSE q4 END, q1, q2, q3, best
      FROM (SELECT step, q0, q1, q2, q3, q4, CASE WHEN f1.ll >= f2.ll AND f1.ll >= f3.ll THEN 0 WHEN f2.ll >= f3.ll THEN 1 ELSE 2 END AS best
            FROM (SELECT step, {rank('0.0')} AS q0, {rank('0.25')} AS q1, {rank('0.5')} AS q2, {rank('0.75')} AS q3, {rank('1.0')} AS q4
                  FROM narrow WHERE last - first + 1 > 5) s
            JOIN fits f1 ON f1.r = q1 JOIN fits f2 ON f2.r = q2 JOIN fits f3 ON f3.r = q3)),
    fin AS (SELECT f.r, f.cut, f.ll FROM fits f, (SELECT first, last FROM narrow ORDER BY step DESC LIMIT 1) WHERE f.r BETWEEN first AND last),
    trace AS (
      SELECT 0 AS part, i AS k, 'coarse' AS stage, cut, ll, i = (SELECT i FROM top) AS best FROM coarse
      UNION ALL SELECT step, k, 'narrow' || step, cut, ll, k = best
        FROM (SELECT step, best, unnest([0, 1, 2]) AS k, unnest([r1, r2, r3]) AS pos FROM narrow WHERE step > 0) JOIN fits ON fits.r = pos
      UNION ALL SELECT 1000, r, 'final', cut, ll, r = (SELECT arg_max(r, ll) FROM fin) FROM fin)
    SELECT (row_number() OVER (ORDER BY part, k))::INT AS step, stage, round(cut, 6) AS cut, round(ll, 4) AS loglik, best,
           (SELECT round(arg_max(cut, ll), 3) FROM fin) AS found
    FROM trace"""


@query("t4_narrowing", _narrowing_sql())
def t4(spark, d):
    trace: list = []
    found = threshold.threshold_search(_frame(spark, d), "l_extendedprice", "gaussian", _tax(),
                                       outcome="l_quantity", trace=trace)
    rows = [(i, stage, float(c), float(ll), bool(b)) for i, (stage, c, ll, b) in enumerate(trace, 1)]
    t = spark.createDataFrame(rows, "step int, stage string, cut double, loglik double, best boolean")
    return rounded(t.withColumn("found", F.lit(float(found))), 6, loglik=4)


_WINDOW_VALUES = """(SELECT DISTINCT l_quantity AS cut FROM lineitem,
    (SELECT quantile_cont(l_quantity, 0.46) AS lo, quantile_cont(l_quantity, 0.54) AS hi FROM lineitem)
    WHERE l_quantity > lo AND l_quantity < hi)"""


@query("t5_exhaustive_search", "WITH "
       + cox_ctes(_cells("cut", "l_linenumber", ["l_quantity", "l_tax", "hinge"], _hinged(_WINDOW_VALUES, "1 AS one")), 3, steps=4)
       + " SELECT round(arg_max(k, ll), 3)::DOUBLE AS cutpoint, round(max(ll), 4) AS loglik FROM fit")
def t5(spark, d):
    trace: list = []
    found = threshold.threshold_search(_frame(spark, d), "l_quantity", "cox", _tax(), low_p=0.46, high_p=0.54,
                                       trace=trace, time="l_linenumber", event="ev")
    best = max(ll for stage, _, ll, _ in trace if stage == "final")
    return rounded(spark.createDataFrame([(float(found), float(best))], "cutpoint double, loglik double"), 4)


@query("t6_hinge_basis", """
    SELECT l_quantity AS x, CASE WHEN l_quantity <= 25 THEN l_quantity - 25 ELSE 0.0 END AS "X1",
           CASE WHEN l_quantity > 25 THEN l_quantity - 25 ELSE 0.0 END AS "X2", count(*) AS n FROM lineitem GROUP BY ALL""")
def t6(spark, d):
    li = lineitem(spark, d, "l_quantity")
    return li.groupBy(F.col("l_quantity").alias("x"), design.hinge_below("l_quantity", 25).alias("X1"),
                      design.hinge_above("l_quantity", 25).alias("X2")).agg(F.count(F.lit(1)).alias("n"))


# --- two-piece models ---------------------------------------------------------------------

_CUT = f"(SELECT *, CASE WHEN l_quantity <= 25 THEN l_quantity - 25 ELSE 0 END AS x1h, CASE WHEN l_quantity > 25 THEN l_quantity - 25 ELSE 0 END AS x2h FROM {_LI})"


def _piece_rows(est, lo, hi, p, cut="25.0"):
    """Six result rows from the CTEs f0, f1, f2."""
    rows = []
    for o, name in ((1, "single"), (3, "below"), (4, "above")):
        i = {1: 0, 3: 1, 4: 2}[o]
        rows.append(f"SELECT {o} AS row_order, '{name}' AS row, round({est[i]}, 6) AS estimate, round({lo[i]}, 5) AS lower, "
                    f"round({hi[i]}, 5) AS upper, round({p[i]}, 5) AS p_value FROM f{i}")
    rows.append(f"SELECT 2, 'cutpoint', {cut}, NULL, NULL, NULL")
    rows.append("SELECT 5, 'loglik', round(2 * (f2.ll - f0.ll), 4), round(f0.ll, 4), round(f2.ll, 4), NULL FROM f0, f2")
    rows.append(f"SELECT 6, 'lrt', NULL, NULL, NULL, round({chi2_p('greatest(2 * (f2.ll - f0.ll), 0.0)', '1')}, 5) FROM f0, f2")
    return " UNION ALL ".join(rows)


def _wald(fits):
    """(estimate, lower, upper, p) expressions on the ratio scale for (fit, coefficient number) pairs."""
    b = [f"b{i}" for i in fits]
    se = [f"sqrt(v_{i}_{i})" for i in fits]
    return ([f"exp({x})" for x in b], [f"exp({x} - {Z} * {s})" for x, s in zip(b, se)],
            [f"exp({x} + {Z} * {s})" for x, s in zip(b, se)], [normal_p(f"{x} / {s}") for x, s in zip(b, se)])


def _two_piece(t):
    """Rounded like the SQL: limits and p to 5 places, log-likelihoods to 4."""
    row = F.col("row") == "loglik"
    return t.select("row_order", "row",
                    F.round(F.when(row, F.round("estimate", 4)).otherwise(F.col("estimate")), 6).alias("estimate"),
                    F.when(row, F.round("lower", 4)).otherwise(F.round("lower", 5)).alias("lower"),
                    F.when(row, F.round("upper", 4)).otherwise(F.round("upper", 5)).alias("upper"),
                    F.round("p_value", 5).alias("p_value"))


@query("t7_two_piece_cox", "WITH "
       + cox_ctes(_cells("'f0'", "l_linenumber", ["l_quantity", "l_tax"], _CUT), 2, "f0", steps=5) + ",\n"
       + cox_ctes(_cells("'f1'", "l_linenumber", ["l_quantity", "l_tax", "x2h"], _CUT), 3, "f1", steps=5) + ",\n"
       + cox_ctes(_cells("'f2'", "l_linenumber", ["l_tax", "x1h", "x2h"], _CUT), 3, "f2", steps=5) + "\n"
       + _piece_rows(*_wald([1, 1, 3])))
def t7(spark, d):
    t = threshold.threshold_effect(_frame(spark, d), "l_quantity", "cox", _tax(), cutpoint=25.0,
                                   time="l_linenumber", event="ev")
    return _two_piece(t)


_F0 = _y_cells("'f0'", "ev", ["1", "l_quantity", "l_tax"], _CUT)
_F1 = _y_cells("'f1'", "ev", ["1", "l_quantity", "l_tax", "x2h"], _CUT)
_F2 = _y_cells("'f2'", "ev", ["1", "l_tax", "x1h", "x2h"], _CUT)


def _side(n, j, s):
    return f"(SELECT exp(b{j}) FROM p{n} WHERE side = {s})"


_LOGIT_SQL = ("WITH " + profile_ctes(_F0, 3, 2, "p0") + ",\n" + profile_ctes(_F1, 4, 2, "p1") + ",\n"
              + profile_ctes(_F2, 4, 4, "p2") + ", f0 AS (SELECT * FROM p0_f), f1 AS (SELECT * FROM p1_f), f2 AS (SELECT * FROM p2_f)\n"
              + _piece_rows(["exp(b2)", "exp(b2)", "exp(b4)"], [_side(0, 2, -1), _side(1, 2, -1), _side(2, 4, -1)],
                            [_side(0, 2, 1), _side(1, 2, 1), _side(2, 4, 1)],
                            [normal_p("b2 / sqrt(v_2_2)"), normal_p("b2 / sqrt(v_2_2)"), normal_p("b4 / sqrt(v_4_4)")]))


@query("t8_two_piece_logistic", _LOGIT_SQL)
def t8(spark, d):
    return _two_piece(threshold.threshold_effect(_frame(spark, d), "l_quantity", "binomial", _tax(), cutpoint=25.0,
                                                 outcome="ev"))


@query("t10_two_piece_lrm", _LOGIT_SQL)
def t10(spark, d):
    return _two_piece(threshold.threshold_effect(_frame(spark, d), "l_quantity", "lrm", _tax(), cutpoint=25.0,
                                                 outcome="ev"))


# the whole linear analysis: scan, window, values one by one, then the three fits
_PRICE = "l_extendedprice / 1000"


def _bounds(sign):
    ps = ", ".join(str(round(min(max(p + sign * 0.04, 0.05), 0.95), 2)) for p in COARSE)
    return f"(SELECT quantile_cont(l_quantity, [{ps}])[(SELECT i FROM best)] FROM lineitem)"


_SRC = "(SELECT l.*, CASE WHEN l_quantity <= c THEN l_quantity - c ELSE 0 END AS x1h, CASE WHEN l_quantity > c THEN l_quantity - c ELSE 0 END AS x2h FROM lineitem l, cut)"
_T_STAT = ["b2 / sqrt(v_2_2)", "b2 / sqrt(v_2_2)", "b4 / sqrt(v_4_4)"]
_LINEAR_SEARCH = (
    "WITH " + linear_ctes(_y_cells("i", _PRICE, ["1", "l_quantity", "l_tax", "hinge"], _hinged(_TP)), 4, "scan")
    + ", best AS (SELECT arg_max(k, ll) AS i FROM scan), vals AS (SELECT DISTINCT l_quantity AS cut FROM lineitem WHERE l_quantity > "
    + _bounds(-1) + " AND l_quantity < " + _bounds(1) + "),\n"
    + linear_ctes(_y_cells("cut", _PRICE, ["1", "l_quantity", "l_tax", "hinge"], _hinged("vals", "1 AS one")), 4, "fine")
    + ", cut AS (SELECT round(arg_max(k, ll), 3) AS c FROM fine),\n"
    + linear_ctes(_y_cells("'f0'", _PRICE, ["1", "l_quantity", "l_tax"], _SRC), 3, "f0") + ",\n"
    + linear_ctes(_y_cells("'f1'", _PRICE, ["1", "l_quantity", "l_tax", "x2h"], _SRC), 4, "f1") + ",\n"
    + linear_ctes(_y_cells("'f2'", _PRICE, ["1", "l_tax", "x1h", "x2h"], _SRC), 4, "f2"))


@query("t9_two_piece_linear", _LINEAR_SEARCH + "\n" + _piece_rows(
    ["b2", "b2", "b4"], [f"b{i} - {Z} * sqrt(v_{i}_{i})" for i in (2, 2, 4)],
    [f"b{i} + {Z} * sqrt(v_{i}_{i})" for i in (2, 2, 4)],
    [f_p(f"({t}) * ({t})", "1", f"(n - {k})") for t, k in zip(_T_STAT, (3, 4, 4))], "(SELECT c FROM cut)::DOUBLE"))
def t9(spark, d):
    df = _frame(spark, d).withColumn("price", F.col("l_extendedprice") / 1000)
    return _two_piece(threshold.threshold_effect(df, "l_quantity", "gaussian", _tax(), outcome="price"))


def _txt(x):
    return (f"CASE WHEN round({x}, 3) = 0 THEN '0' ELSE regexp_replace(regexp_replace(format('{{:.3f}}', round({x}, 3)), "
            f"'(\\.\\d*?)0+$', '\\1'), '\\.$', '') END")


def _effect_text(i, k):
    b, s = f"b{i}", f"sqrt(v_{i}_{i})"
    p = f_p(f"({b} / {s}) * ({b} / {s})", "1", f"(n - {k})")
    return (f"{_txt(b)} || '(' || {_txt(f'{b} - {Z} * {s}')} || '-' || {_txt(f'{b} + {Z} * {s}')} || ')' || {_txt(p)}")


@query("t1_cut_table", _LINEAR_SEARCH + f""",
    tx AS (SELECT regexp_replace(regexp_replace(c::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS c FROM cut)
    SELECT 1 AS row_order, 'Model 1 Fitting model by standard linear regression' AS "Outcome", {_effect_text(2, 3)} AS "the effect size, 95%CI, P value" FROM f0
    UNION ALL SELECT 2, 'Model 2 Fitting model by two-piecewise linear regression', ''
    UNION ALL SELECT 3, 'Inflection point', c FROM tx
    UNION ALL SELECT 4, '<' || c, {_effect_text(2, 4)} FROM f1, tx
    UNION ALL SELECT 5, '>' || c, {_effect_text(4, 4)} FROM f2, tx
    UNION ALL SELECT 6, 'P for likelihood ratio test', CASE WHEN p < 0.001 THEN '<0.001' ELSE format('{{:.3f}}', p) END
      FROM (SELECT {chi2_p('greatest(2 * (f2.ll - f0.ll), 0.0)', '1')} AS p FROM f0, f2)""")
def t1(spark, d):
    df = _frame(spark, d).withColumn("price", F.col("l_extendedprice") / 1000)
    return threshold.cut_table(threshold.threshold_effect(df, "l_quantity", "gaussian", _tax(), outcome="price"))


@query("t12_nested_model_test", "WITH "
       + cox_ctes(_cells("'a'", "l_quantity", ["l_discount"]), 1, "a") + ",\n"
       + cox_ctes(_cells("'b'", "l_quantity", ["l_discount", "l_linenumber"]), 2, "b")
       + f""" SELECT 'a' AS small, 'b' AS large, round(2 * (b.ll - a.ll), 4) AS stat, round({chi2_p('2 * (b.ll - a.ll)', '1')}, 5) AS p_value FROM a, b""")
def t12(spark, d):
    terms = design.numeric_terms("l_discount", "l_linenumber")
    fits = cox.cox_fits(_cox_frame(spark, d), "l_quantity", "ev", terms,
                        [Model("a", ("l_discount",)), Model("b", ("l_discount", "l_linenumber"))])
    t = threshold.nested_model_test(cox.fit_statistics(spark, fits), [("a", "b")])
    return rounded(t, 4, p_value=5)


_WEIGHTED = _cells("'w'", "l_quantity", ["l_discount", "l_tax"]).replace("count(*)::DOUBLE", "sum(l_linenumber)::DOUBLE")


@query("t13_case_weights", "WITH " + cox_ctes(_WEIGHTED, 2, "w", efron=False)
       + " SELECT round(b1, 6) AS b1, round(b2, 6) AS b2, round(sqrt(v_1_1), 6) AS se1, round(sqrt(v_2_2), 6) AS se2, round(ll, 4) AS loglik FROM w")
def t13(spark, d):
    fit = cox.cox_fit(_cox_frame(spark, d), "l_quantity", "ev", design.numeric_terms("l_discount", "l_tax"),
                      ties="breslow", weight="l_linenumber")
    row = (float(fit.coef[0]), float(fit.coef[1]), float(fit.cov[0, 0] ** 0.5), float(fit.cov[1, 1] ** 0.5), fit.loglik)
    return rounded(spark.createDataFrame([row], "b1 double, b2 double, se1 double, se2 double, loglik double"), 6,
                   loglik=4)


# --- logistic and linear ----------------------------------------------------------------------


def _coef_rows(name, labels, p_of):
    return " UNION ALL ".join(
        f"SELECT '{t}' AS term, round(b{i}, 6) AS coef, round(sqrt(v_{i}_{i}), 6) AS se, "
        f"round({p_of(i)}, 5) AS p_value, round(ll, 3) AS loglik FROM {name}" for i, t in enumerate(labels, 1))


@query("g1_logistic_fit", "WITH " + logit_ctes(_y_cells("'m'", "ev", ["1", "l_quantity", "l_tax"], _LI), 3)
       + _coef_rows("fit", ["(Intercept)", "l_quantity", "l_tax"], lambda i: normal_p(f"b{i} / sqrt(v_{i}_{i})")))
def g1(spark, d):
    fit = glm.logistic_fit(_frame(spark, d), "ev", design.numeric_terms("l_quantity", "l_tax"))
    t = glm.glm_summary(spark, [fit]).select("term", "coef", "se", "p_value", "loglik")
    return rounded(t, 6, p_value=5, loglik=3)


@query("g2_linear_fit", "WITH " + linear_ctes(_y_cells("'m'", "l_extendedprice / 1000", ["1", "l_quantity", "l_discount"], _LI), 3)
       + _coef_rows("fit", ["(Intercept)", "l_quantity", "l_discount"],
                    lambda i: f_p(f"(b{i} * b{i} / v_{i}_{i})", "1", "(n - 3)")))
def g2(spark, d):
    df = _frame(spark, d).withColumn("price", F.col("l_extendedprice") / 1000)
    fit = glm.linear_fit(df, "price", design.numeric_terms("l_quantity", "l_discount"))
    t = glm.glm_summary(spark, [fit]).select("term", "coef", "se", "p_value", "loglik")
    return rounded(t, 6, p_value=5, loglik=3)


# --- ROC -------------------------------------------------------------------------------------


def _auc_sql(parts: list[tuple[str, str, str]]) -> str:
    """CTEs ending in ``areas`` (Model, C_index) from (label, source with x and y) parts."""
    union = " UNION ALL ".join(f"SELECT '{label}' AS m, ({x})::DOUBLE AS x, y FROM {src} WHERE ({x}) IS NOT NULL" for label, x, src in parts)
    return f"""s AS ({union}),
      v AS (SELECT m, x, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM s GROUP BY ALL),
      cu AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY m ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
      u AS (SELECT m, sum(n1 * (below + n0 / 2)) / (sum(n1) * sum(n0)) AS a FROM cu GROUP BY m),
      md AS (SELECT m, median(x) FILTER (WHERE y = 0) <= median(x) FILTER (WHERE y = 1) AS up FROM s GROUP BY m),
      areas AS (SELECT m AS "Model", CASE WHEN up THEN a ELSE 1 - a END AS "C_index" FROM u JOIN md USING (m))"""


_LAB = "(SELECT n_chars, quality AS y, length(lang) AS ln, source FROM labels JOIN documents USING (doc_id))"


@query("g3_auc", f"""WITH {_auc_sql([('n_chars', 'n_chars', _LAB), ('minus', '-n_chars', _LAB), ('source', "replace(source, 'src', '')", _LAB)])}
    SELECT "Model", round("C_index", 6) AS "C_index" FROM areas""")
def g3(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    t = auc.auc(df, {"n_chars": F.col("n_chars"), "minus": -F.col("n_chars"),
                     "source": F.regexp_replace("source", "src", "")}, "quality")
    return rounded(t.select("Model", "C_index"))


_SCORES = {"TAX": "l_tax", "LINE": "l_linenumber", "PRICE": "l_extendedprice"}
_SL = "(SELECT *, ev AS y FROM " + _LI + ")"
_SINGLE = [("l_quantity", "l_quantity", _SL), *[(k, v, _SL) for k, v in _SCORES.items()]]


@query("g4_auc_single", f"""WITH {_auc_sql(_SINGLE)} SELECT "Model", round("C_index", 6) AS "C_index" FROM areas""")
def g4(spark, d):
    t = discrimination.auc_single_table(_frame(spark, d), {"l_quantity": "l_quantity", **_SCORES}, "ev")
    return rounded(t.select("Model", "C_index"))


def _combined_sql():
    ctes, parts = [], []
    for k, v in _SCORES.items():
        x = f"{v} / 100000" if v == "l_extendedprice" else v
        ctes.append(logit_ctes(_y_cells(f"'{k}'", "ev", ["1", "l_quantity", x], _LI), 3, f"m{k}", steps=6))
        parts.append((f"l_quantity + {k}", f"b1 + b2 * l_quantity + b3 * ({x})", f"(SELECT *, ev AS y FROM {_LI}, m{k})"))
    return ",\n".join(ctes), parts


_CTES, _PARTS = _combined_sql()


@query("g5_auc_combined", f"""WITH {_CTES}, {_auc_sql(_PARTS)} SELECT "Model", round("C_index", 6) AS "C_index" FROM areas""")
def g5(spark, d):
    t = discrimination.auc_combined_table(_frame(spark, d), "l_quantity", _SCORES, "ev")
    return rounded(t.select("Model", "C_index"))


_BOTH = f"WITH {_CTES}, {_auc_sql(_SINGLE + _PARTS)}"


@query("g6_append_results", _BOTH + """ SELECT "Model", round("C_index", 6) AS "C_index", CASE "Model"
    WHEN 'l_quantity' THEN 1 WHEN 'TAX' THEN 2 WHEN 'LINE' THEN 3 WHEN 'PRICE' THEN 4 WHEN 'l_quantity + TAX' THEN 5
    WHEN 'l_quantity + LINE' THEN 6 ELSE 7 END AS model_order FROM areas""")
def g6(spark, d):
    return rounded(discrimination.auc_table(_frame(spark, d), "l_quantity", _SCORES, "ev"))


@query("g7_score_comparison", _BOTH + """, g AS (SELECT unnest(['TAX', 'LINE', 'PRICE']) AS s, unnest([0, 3, 6]) AS o)
    SELECT o + 1 AS row_order, s AS "Group", 'l_quantity Alone' AS "Subgroup", round("C_index", 6) AS "C_index", format('{:.3f}', "C_index") AS label FROM g JOIN areas ON "Model" = 'l_quantity'
    UNION ALL SELECT o + 2, s, 'Score Alone', round("C_index", 6), format('{:.3f}', "C_index") FROM g JOIN areas ON "Model" = s
    UNION ALL SELECT o + 3, s, 'Score+l_quantity', round("C_index", 6), format('{:.3f}', "C_index") FROM g JOIN areas ON "Model" = 'l_quantity + ' || s""")
def g7(spark, d):
    t = discrimination.auc_table(_frame(spark, d), "l_quantity", _SCORES, "ev")
    return rounded(discrimination.score_comparison(t, "l_quantity", list(_SCORES)))


# --- imputation ---------------------------------------------------------------------------------


def _customers(spark, d):
    """Customers with their order figures; gaps planted by value."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    df = c.join(o, "c_custkey", "left")
    return df.select("c_custkey", "mean_price", "n_orders",
                     F.when(F.col("c_nationkey") != 3, F.col("c_acctbal")).alias("balance"),
                     F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("segment"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


@query("f6_impute_pmm", """
    WITH o AS (SELECT o_custkey, avg(o_totalprice) AS mean_price, count(*)::DOUBLE AS n_orders FROM orders GROUP BY 1),
    t AS (SELECT c_custkey, mean_price, n_orders, CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS balance
          FROM customer JOIN o ON c_custkey = o_custkey),
    m AS (SELECT avg(mean_price) AS m1, stddev_samp(mean_price) AS s1, avg(n_orders) AS m2, stddev_samp(n_orders) AS s2,
                 avg(balance) AS my, stddev_samp(balance) AS sy FROM t),
    z AS (SELECT t.*, (mean_price - m1) / s1 AS a, (n_orders - m2) / s2 AS b, (balance - my) / sy AS y FROM t, m),
    g AS (SELECT count(*) * 1.00001 AS cc, sum(a) AS ca, sum(b) AS cb, sum(a * a) * 1.00001 AS aa, sum(a * b) AS ab,
                 sum(b * b) * 1.00001 AS bb, sum(y) AS cy, sum(a * y) AS ay, sum(b * y) AS byy FROM z WHERE y IS NOT NULL),
    f AS (SELECT (cy * (aa * bb - ab * ab) - ca * (ay * bb - ab * byy) + cb * (ay * ab - aa * byy)) / det AS b0,
                 (cc * (ay * bb - ab * byy) - cy * (ca * bb - ab * cb) + cb * (ca * byy - ay * cb)) / det AS b1,
                 (cc * (aa * byy - ay * ab) - ca * (ca * byy - ay * cb) + cy * (ca * ab - aa * cb)) / det AS b2
          FROM (SELECT *, cc * (aa * bb - ab * ab) - ca * (ca * bb - ab * cb) + cb * (ca * ab - aa * cb) AS det FROM g)),
    p AS (SELECT z.*, b0 + b1 * a + b2 * b AS yhat FROM z, f),
    near AS (SELECT w.c_custkey, arg_min(d.balance, abs(d.yhat - w.yhat)) AS balance
             FROM p w, p d WHERE w.balance IS NULL AND d.balance IS NOT NULL GROUP BY 1)
    SELECT c_custkey, round(mean_price, 6) AS mean_price, n_orders, round(coalesce(t.balance, near.balance), 6) AS balance, 1 AS imp
    FROM t LEFT JOIN near USING (c_custkey)""")
def f6(spark, d):
    """One donor and fitted coefficients leave nothing to chance, so SQL can follow all ten rounds."""
    df = _customers(spark, d).drop("segment").where(F.col("mean_price").isNotNull())
    return rounded(impute.impute_pmm(df, "c_custkey", donors=1, match="fitted"))


def _chained_sql(columns: list[str], rounds: int) -> str:
    """Every round over every column with gaps, written out: regression on the others, then the nearest donor's value."""
    zs = ", ".join(f"coalesce(({c} - m_{c}) / s_{c}, (l_{c} - m_{c}) / s_{c}) AS {c}, {c} IS NULL AS g_{c}" for c in columns)
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, min({c}) AS l_{c}" for c in columns)
    ctes = ["""o AS (SELECT o_custkey, avg(o_totalprice) AS mean_price, count(*)::DOUBLE AS n_orders FROM orders GROUP BY 1),
    t AS MATERIALIZED (SELECT c_custkey, mean_price, n_orders, CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS balance
          FROM customer LEFT JOIN o ON c_custkey = o_custkey)""",
            f"m AS MATERIALIZED (SELECT {moments} FROM t)", f"z0 AS MATERIALIZED (SELECT c_custkey, {zs} FROM t, m)"]
    at = 0
    for _ in range(rounds):
        for c in columns:
            xs = ["1.0::DOUBLE", *[x for x in columns if x != c]]
            sums = [f"sum({x} * {y})" + (" * 1.00001" if i == j else "") + f" AS h_{i}_{j}" for i, x in enumerate(xs, 1) for j, y in enumerate(xs, 1)]
            sums += [f"sum({x} * {c}) AS u_{i}" for i, x in enumerate(xs, 1)]
            ctes.append(f"g{at} AS (SELECT 1 AS k, {', '.join(sums)} FROM z{at} WHERE NOT g_{c})")
            ctes.append(_jordan(f"g{at}", len(xs), f"j{at}", "k"))
            fitted = " + ".join(f"d_{i} * {x}" for i, x in enumerate(xs, 1))
            ctes.append(f"p{at} AS MATERIALIZED (SELECT z{at}.*, {fitted} AS yhat FROM z{at}, j{at})")
            ctes.append(f"near{at} AS (SELECT w.c_custkey, arg_min(d.{c}, abs(d.yhat - w.yhat)) AS new FROM p{at} w, p{at} d "
                        f"WHERE w.g_{c} AND NOT d.g_{c} GROUP BY 1)")
            kept = ", ".join([f"coalesce(new, {c}) AS {c}", *[x for x in columns if x != c], *[f"g_{x}" for x in columns]])
            ctes.append(f"z{at + 1} AS MATERIALIZED (SELECT c_custkey, {kept} FROM z{at} LEFT JOIN near{at} USING (c_custkey))")
            at += 1
    out = ", ".join(f"round(coalesce(t.{c}, z.{c} * s_{c} + m_{c}), 6) AS {c}" for c in columns)
    return f"WITH {', '.join(ctes)} SELECT c_custkey, {out}, 1 AS imp FROM t JOIN z{at} z USING (c_custkey), m"


@query("f6_impute_chained", _chained_sql(["mean_price", "n_orders", "balance"], 3))
def f6_chained(spark, d):
    """Three columns with gaps, each predicted from the others' imputed values, over three rounds."""
    return rounded(impute.impute_pmm(_customers(spark, d).drop("segment"), "c_custkey", maxit=3, donors=1, match="fitted", start="least"))


@query("f6_impute_sets", """
    WITH o AS (SELECT o_custkey, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1)
    SELECT unnest(range(1, 6))::INT AS imp, count(*) AS n, 0 AS gaps,
           round(sum(c_acctbal) FILTER (WHERE c_nationkey <> 3), 2) AS kept_balance,
           count(*) FILTER (WHERE c_nationkey = 3) AS drawn_balances, count(*) FILTER (WHERE o_custkey IS NULL) AS drawn_prices
    FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def f6_sets(spark, d):
    """Five sets: no gap left, observed cells as they were, filled ones among the observed values."""
    src = _customers(spark, d).persist()
    full = impute.impute_pmm(src, "c_custkey", levels={"segment": _SEGMENTS}, m=5)
    seen = {c: src.where(F.col(c).isNotNull()).select(F.col(c).alias(f"seen_{c}")).distinct() for c in ("balance", "mean_price")}
    both = full.join(src.select("c_custkey", F.col("balance").alias("b"), F.col("mean_price").alias("p")), "c_custkey")
    both = both.join(seen["balance"], F.col("balance") == F.col("seen_balance"), "left")
    both = both.join(seen["mean_price"], F.col("mean_price") == F.col("seen_mean_price"), "left")
    gap = F.col("balance").isNull() | F.col("segment").isNull() | F.col("mean_price").isNull() | F.col("n_orders").isNull()
    return both.groupBy("imp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gap).cast("int").alias("gaps"),
        F.round(F.sum(F.when(F.col("b") == F.col("balance"), F.col("balance"))), 2).alias("kept_balance"),
        F.count_if(F.col("b").isNull() & F.col("seen_balance").isNotNull()).alias("drawn_balances"),
        F.count_if(F.col("p").isNull() & F.col("seen_mean_price").isNotNull()).alias("drawn_prices"))


@query("f7_complete_imputation", """
    SELECT count(*) AS n, 0 AS gaps, round(sum(c_acctbal) FILTER (WHERE c_nationkey <> 3), 2) AS kept_balance,
           count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS filled_segments FROM customer""")
def f7(spark, d):
    src = _customers(spark, d)
    full = impute.complete_imputation(impute.impute_pmm(src, "c_custkey", levels={"segment": _SEGMENTS}, m=2), action=2)
    gaps = F.count_if(F.col("f.balance").isNull() | F.col("f.segment").isNull() | F.col("f.mean_price").isNull())
    both = full.alias("f").join(src.alias("s"), F.col("f.c_custkey") == F.col("s.c_custkey"))
    return both.agg(F.count(F.lit(1)).alias("n"), gaps.cast("int").alias("gaps"),
                    F.round(F.sum(F.when(F.col("s.balance") == F.col("f.balance"), F.col("f.balance"))), 2).alias("kept_balance"),
                    F.count_if(F.col("s.segment").isNull() & F.col("f.segment").isin(_SEGMENTS)).alias("filled_segments"))
