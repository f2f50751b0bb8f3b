"""Frequencies, quantiles, baseline tables and group tests (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import chi2_p, f_p, lineitem, query, rounded, table
from registry.prep import _INDEX, _gaps, _GAPS
from riskset.functions.columns import significance_symbol, weighted_index
from riskset.operators import missing, nonparam, quantiles, tableone
from riskset.operators.clean import set_levels


@query("a1_freq_table", """
    SELECT o.i::INT AS level_order, o.v AS level, count(o_orderkey) AS n FROM
      (SELECT unnest(['1-URGENT', '2-HIGH', '0-NEVER', '5-LOW']) AS v, unnest(range(1, 5)) AS i) o
      LEFT JOIN orders ON o_orderpriority = o.v GROUP BY ALL""")
def a1(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority")
    return quantiles.freq_table(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "0-NEVER", "5-LOW"])


def _q7(by, src):
    parts = []
    for p in (0.05, 0.25, 0.5, 0.95):
        for name, s in (("l_extendedprice", "lineitem"), ("quantity", src)):
            parts.append(f"SELECT {by + ', ' if by else ''}'{name}' AS variable, {p}::DOUBLE AS prob, "
                         f"round(quantile_cont({name}, {p}), 6) AS value FROM {s} {'GROUP BY ' + by if by else ''}")
    return " UNION ALL ".join(parts)


@query("a2_quantile7", _q7("", _GAPS))
def a2(spark, d):
    return rounded(quantiles.quantile7(_gaps(spark, d), ["l_extendedprice", "quantity"], [0.05, 0.25, 0.5, 0.95]))


@query("a2_quantile7_grouped", _q7("l_linestatus", _GAPS))
def a2_grouped(spark, d):
    return rounded(quantiles.quantile7(_gaps(spark, d), ["l_extendedprice", "quantity"], [0.05, 0.25, 0.5, 0.95], ["l_linestatus"]))


@query("a3_quantile3", """
    WITH v AS (SELECT DISTINCT l_extendedprice AS x FROM lineitem),
    r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM v),
    p AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS prob),
    j AS (SELECT prob, n, n * prob - 0.5 AS t, floor(n * prob - 0.5) AS j FROM p, (SELECT count(*) AS n FROM v))
    SELECT prob::DOUBLE AS prob, x AS value FROM j JOIN r
      ON r.i = greatest(1, least(j.n, CASE WHEN t = j AND j::BIGINT % 2 = 0 THEN j ELSE j + 1 END))""")
def a3(spark, d):
    return quantiles.quantile3(lineitem(spark, d, "l_extendedprice"), "l_extendedprice")


_GROUPED = f"""(SELECT *, {_INDEX} AS idx, 1 + ((10.0 * l_tax + 5.0 * l_discount) > q1)::INT
     + ((10.0 * l_tax + 5.0 * l_discount) > q2)::INT + ((10.0 * l_tax + 5.0 * l_discount) > q3)::INT AS grp,
     CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ev
   FROM lineitem, (SELECT quantile_cont({_INDEX}, 0.25) AS q1, quantile_cont({_INDEX}, 0.5) AS q2,
                          quantile_cont({_INDEX}, 0.75) AS q3 FROM lineitem))"""


def grouped(spark, d, *extra):
    """Line items with the index and its quartile group."""
    li = lineitem(spark, d, *dict.fromkeys(["l_tax", "l_discount", "l_returnflag", *extra]))
    return quantiles.quantile_group(li.withColumn("idx", weighted_index({"l_tax": 10, "l_discount": 5})), "idx",
                                    out="grp")


@query("a4_quantile_group", f"SELECT grp::BIGINT AS grp, count(*) AS n, sum(ev)::BIGINT AS events, "
                            f"round(min(idx), 6) AS low, round(max(idx), 6) AS high FROM {_GROUPED} GROUP BY grp")
def a4(spark, d):
    return rounded(grouped(spark, d).groupBy(F.col("grp").cast("long").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ev").alias("events"), F.min("idx").alias("low"),
        F.max("idx").alias("high")))


_FENCED = f"""(SELECT l.*, {_INDEX} AS idx FROM lineitem l, (
    SELECT quantile_cont({_INDEX}, 0.25) AS b1, quantile_cont({_INDEX}, 0.75) AS b3 FROM lineitem)
    WHERE {_INDEX} BETWEEN b1 - 3 * (b3 - b1) AND b3 + 3 * (b3 - b1))"""


@query("a0_rate_by_quartile", f"""
    WITH f AS {_FENCED}, q AS (SELECT quantile_cont(idx, 0.25) AS q1, quantile_cont(idx, 0.5) AS q2, quantile_cont(idx, 0.75) AS q3 FROM f)
    SELECT 1 + (idx > q1)::INT + (idx > q2)::INT + (idx > q3)::INT AS grp, count(*) AS n,
           count(*) FILTER (WHERE l_returnflag = 'R') AS events,
           round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS event_rate,
           round(quantile_cont(l_quantity, 0.5), 6) AS median_time
    FROM f, q GROUP BY 1""")
def a0(spark, d):
    li = lineitem(spark, d, "l_tax", "l_discount", "l_returnflag", "l_quantity")
    indexed = li.withColumn("idx", weighted_index({"l_tax": 10, "l_discount": 5}))
    kept = quantiles.quantile_group(missing.iqr_fence(indexed, "idx"), "idx", out="grp")
    rates = kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("ev").alias("events"),
                                    F.avg("ev").alias("event_rate"))
    medians = quantiles.quantile7(kept, ["l_quantity"], [0.5], ["grp"])
    return rounded(rates.join(medians.select("grp", F.col("value").alias("median_time")), "grp"))


# --- baseline table ------------------------------------------------------------------

_BASE = """(SELECT l_linenumber, l_tax, l_extendedprice, l_returnflag, l_linestatus, o_orderpriority
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _base(spark, d):
    li = lineitem(spark, d, "l_orderkey", "l_linenumber", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey)


_KW = """
  {n}_v AS (SELECT {col} AS v, {grp}::VARCHAR AS g FROM {src} WHERE {col} IS NOT NULL),
  {n}_r AS (SELECT g, avg_rank FROM (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS avg_rank FROM {n}_v)),
  {n}_t AS (SELECT sum(c * c * c - c)::DOUBLE AS tie FROM (SELECT count(*)::DOUBLE AS c FROM {n}_v GROUP BY v)),
  {n}_n AS (SELECT count(*)::DOUBLE AS n FROM {n}_v),
  {n} AS (SELECT 12.0 / (n * (n + 1)) * sum(cnt * (mr - (n + 1) / 2) ** 2) / (1 - tie / (n * n * n - n)) AS h,
                 count(*) - 1 AS df
          FROM (SELECT g, count(*) AS cnt, avg(avg_rank) AS mr FROM {n}_r GROUP BY g), {n}_n, {n}_t GROUP BY n, tie)"""

_ANOVA = """
  {n}_g AS (SELECT {grp} AS g, count(*) AS c, avg({col}) AS m FROM {src} GROUP BY 1),
  {n}_a AS (SELECT count(*) AS c, avg({col}) AS m FROM {src}),
  {n}_w AS (SELECT sum(({col} - m) ** 2) AS w FROM {src} JOIN {n}_g ON {grp} = g),
  {n} AS (SELECT sum(g.c * (g.m - a.m) ** 2) / (count(*) - 1) / (w / (a.c - count(*))) AS f,
                 count(*) - 1 AS d1, a.c - count(*) AS d2 FROM {n}_g g, {n}_a a, {n}_w GROUP BY w, a.c)"""


def _chisq(n, col, grp, src):
    return f"""
  {n}_c AS (SELECT {col}::VARCHAR AS v, {grp}::VARCHAR AS g, count(*) AS c FROM {src} GROUP BY ALL),
  {n}_r AS (SELECT v, sum(c) AS rn FROM {n}_c GROUP BY v), {n}_k AS (SELECT g, sum(c) AS cn FROM {n}_c GROUP BY g),
  {n}_x AS (SELECT abs(coalesce(c, 0) - rn * cn / t) AS gap, rn * cn / t AS e FROM {n}_r CROSS JOIN {n}_k
           CROSS JOIN (SELECT sum(c) AS t FROM {n}_c) LEFT JOIN {n}_c USING (v, g)),
  {n}_d AS (SELECT (SELECT count(*) FROM {n}_r) AS r, (SELECT count(*) FROM {n}_k) AS k, (SELECT min(gap) FROM {n}_x) AS least),
  {n} AS (SELECT sum((gap - CASE WHEN r = 2 AND k = 2 THEN least(0.5, least) ELSE 0 END) ** 2 / e) AS chi2,
                 (r - 1) * (k - 1) AS df FROM {n}_x, {n}_d GROUP BY r, k)"""


@query("a5_baseline_table", f"""
    WITH {_ANOVA.format(n='an', col='l_tax', grp='l_linestatus', src=_BASE)},
    {_KW.format(n='kw', col='l_extendedprice', grp='l_linestatus', src=_BASE)},
    {_chisq('ch', 'l_returnflag', 'l_linestatus', _BASE)},
    {_chisq('cp', 'o_orderpriority', 'l_linestatus', _BASE)}
    SELECT 0 AS row_order, 'n' AS variable, NULL::INT AS level_order, NULL AS level, l_linestatus AS stratum, count(*) AS n,
           NULL::DOUBLE AS center, NULL::DOUBLE AS spread_low, NULL::DOUBLE AS spread_high, NULL::DOUBLE AS percent,
           count(*)::VARCHAR AS summary, NULL::DOUBLE AS p_value, NULL AS test
      FROM {_BASE} GROUP BY l_linestatus
    UNION ALL SELECT 1, 'l_tax', NULL, NULL, l_linestatus, count(*), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6),
           round(stddev_samp(l_tax), 6), NULL, format('{{:.2f}} ({{:.2f}})', avg(l_tax), stddev_samp(l_tax)),
           (SELECT round({f_p('f', 'd1', 'd2')}, 6) FROM an), 'anova' FROM {_BASE} GROUP BY l_linestatus
    UNION ALL SELECT 2, 'l_extendedprice', NULL, NULL, l_linestatus, NULL, round(quantile_cont(l_extendedprice, 0.5), 6),
           round(quantile_cont(l_extendedprice, 0.25), 6), round(quantile_cont(l_extendedprice, 0.75), 6), NULL,
           format('{{:.2f}} [{{:.2f}}, {{:.2f}}]', quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.25),
                  quantile_cont(l_extendedprice, 0.75)),
           (SELECT round({chi2_p('h', 'df')}, 6) FROM kw), 'kruskal' FROM {_BASE} GROUP BY l_linestatus
    UNION ALL SELECT 3, 'l_returnflag', (dense_rank() OVER (ORDER BY l_returnflag))::INT, l_returnflag, l_linestatus, count(*), NULL, NULL, NULL,
           round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6),
           format('{{}} ({{:.1f}})', count(*), 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus)),
           (SELECT round({chi2_p('chi2', 'df')}, 6) FROM ch), 'chisq' FROM {_BASE} GROUP BY l_returnflag, l_linestatus
    UNION ALL SELECT 4, 'o_orderpriority', (dense_rank() OVER (ORDER BY o_orderpriority))::INT, o_orderpriority, l_linestatus, count(*), NULL, NULL, NULL,
           round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6),
           format('{{}} ({{:.1f}})', count(*), 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus)),
           (SELECT round({chi2_p('chi2', 'df')}, 6) FROM cp), 'chisq' FROM {_BASE} GROUP BY o_orderpriority, l_linestatus""")
def a5(spark, d):
    t = tableone.baseline_table(
        _base(spark, d), ["l_tax", "l_extendedprice", "l_returnflag", "o_orderpriority"], "l_linestatus",
        ["l_returnflag", "o_orderpriority"], ["l_extendedprice"])
    return rounded(t)


@query("a5_baseline_print", """
    WITH t AS (SELECT l_linestatus AS g, (l_linenumber - 4) / 8.0 AS tie, l_returnflag AS flag FROM lineitem),
    cells AS (SELECT level_order, level, stratum, count(flag) AS n
              FROM (SELECT unnest(['R', 'never', 'N', 'A']) AS level, unnest([1, 2, 3, 4]) AS level_order)
              CROSS JOIN (SELECT DISTINCT g AS stratum FROM t) LEFT JOIN t ON flag = level AND g = stratum GROUP BY ALL),
    lines AS (
      SELECT 0 AS row_order, 'n' AS variable, NULL::INT AS level_order, NULL AS level, g, count(*)::VARCHAR AS summary FROM t GROUP BY g
      UNION ALL SELECT 1, 'tie', NULL, NULL, g, format('{:.2f} [{:.2f}, {:.2f}]', quantile_cont(tie, 0.5), quantile_cont(tie, 0.25),
             quantile_cont(tie, 0.75)) FROM t GROUP BY g
      UNION ALL SELECT 2, 'flag', level_order::INT, level, stratum,
             format('{} ({:.1f})', n, 100.0 * n / sum(n) OVER (PARTITION BY stratum)) FROM cells)
    SELECT row_order, variable, level_order, level, max(summary) FILTER (g = 'F') AS "F", max(summary) FILTER (g = 'O') AS "O"
    FROM lines GROUP BY ALL""")
def a5_print(spark, d):
    """The printed table over exact ties, with a level no row has; levels in the order given, not by text."""
    df = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("g"), ((F.col("l_linenumber") - 4) / 8.0).alias("tie"), F.col("l_returnflag").alias("flag"))
    df = set_levels(df, "flag", ["R", "never", "N", "A"])
    t = tableone.baseline_table(df, ["tie", "flag"], "g", ["flag"], ["tie"], test=False)
    return tableone.baseline_text(t, ["F", "O"]).drop("p")


@query("a5_baseline_overall", f"""
    SELECT 'n' AS variable, NULL AS level, 'Overall' AS stratum, count(*)::VARCHAR AS summary FROM {_BASE}
    UNION ALL SELECT 'l_tax', NULL, 'Overall', format('{{:.2f}} ({{:.2f}})', avg(l_tax), stddev_samp(l_tax)) FROM {_BASE}
    UNION ALL SELECT 'l_returnflag', l_returnflag, 'Overall',
        format('{{}} ({{:.1f}})', count(*), 100.0 * count(*) / sum(count(*)) OVER ()) FROM {_BASE} GROUP BY l_returnflag""")
def a5_overall(spark, d):
    t = tableone.baseline_table(_base(spark, d), ["l_tax", "l_returnflag"], None, ["l_returnflag"])
    return t.select("variable", "level", "stratum", "summary")


@query("a5a_mean_sd", """
    SELECT 'l_tax' AS variable, o_orderpriority AS stratum, count(*) AS n, round(avg(l_tax), 6) AS mean,
           round(stddev_samp(l_tax), 6) AS sd FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2
    UNION ALL SELECT 'l_extendedprice', o_orderpriority, count(*), round(avg(l_extendedprice), 6),
           round(stddev_samp(l_extendedprice), 6) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2""")
def a5a(spark, d):
    return rounded(tableone.continuous_moments(_base(spark, d), ["l_tax", "l_extendedprice"], "o_orderpriority"))


@query("a5b_median_iqr", f"""
    SELECT 'l_extendedprice' AS variable, o_orderpriority AS stratum, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
           round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3
    FROM {_BASE} GROUP BY 2""")
def a5b(spark, d):
    return rounded(tableone.continuous_medians(_base(spark, d), ["l_extendedprice"], "o_orderpriority"))


@query("a5c_category_counts", f"""
    SELECT 'l_returnflag' AS variable, l_returnflag AS level, (dense_rank() OVER (ORDER BY l_returnflag))::INT AS level_order,
           o_orderpriority AS stratum, count(*) AS n,
           round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS percent
    FROM {_BASE} GROUP BY l_returnflag, o_orderpriority""")
def a5c(spark, d):
    return rounded(tableone.category_counts(_base(spark, d), ["l_returnflag"], "o_orderpriority"))


@query("a5d_one_way_anova", f"""
    WITH {_ANOVA.format(n='a', col='l_tax', grp='o_orderpriority', src=_BASE)},
    {_ANOVA.format(n='b', col='l_extendedprice', grp='o_orderpriority', src=_BASE)}
    SELECT 'l_tax' AS variable, round(f, 6) AS f_stat, d1 AS df1, d2 AS df2, round({f_p('f', 'd1', 'd2')}, 6) AS p_value FROM a
    UNION ALL SELECT 'l_extendedprice', round(f, 6), d1, d2, round({f_p('f', 'd1', 'd2')}, 6) FROM b""")
def a5d(spark, d):
    return rounded(nonparam.one_way_anova(_base(spark, d), ["l_tax", "l_extendedprice"], "o_orderpriority"))


@query("a5e_kruskal_wallis", f"""
    WITH {_KW.format(n='a', col='l_tax', grp='o_orderpriority', src=_BASE)},
    {_KW.format(n='b', col='l_extendedprice', grp='o_orderpriority', src=_BASE)}
    SELECT 'l_tax' AS variable, round(h, 6) AS h_stat, df, round({chi2_p('h', 'df')}, 6) AS p_value FROM a
    UNION ALL SELECT 'l_extendedprice', round(h, 6), df, round({chi2_p('h', 'df')}, 6) FROM b""")
def a5e(spark, d):
    return rounded(nonparam.kruskal_wallis(_base(spark, d), ["l_tax", "l_extendedprice"], "o_orderpriority"))


@query("a5f_chi_square", f"""
    WITH {_chisq('a', 'l_returnflag', 'l_linestatus', 'lineitem')}, {_chisq('b', 'ev', 'l_linestatus', _GROUPED)}
    SELECT 'l_returnflag' AS variable, round(chi2, 6) AS chi2, df, round({chi2_p('chi2', 'df')}, 6) AS p_value FROM a
    UNION ALL SELECT 'ev', round(chi2, 6), df, round({chi2_p('chi2', 'df')}, 6) FROM b""")
def a5f(spark, d):
    return rounded(nonparam.chi_square_independence(
        lineitem(spark, d, "l_returnflag", "l_linestatus"), ["l_returnflag", "ev"], "l_linestatus"))


# --- plots' tables ----------------------------------------------------------------------

_BOXQ = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
    f AS (SELECT e.event_type, value, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM events e JOIN q USING (event_type))"""


@query("a7_box_stats", f"""
    WITH {_BOXQ} SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      min(value) FILTER (WHERE inside) AS whisker_low, max(value) FILTER (WHERE inside) AS whisker_high,
      count(*) FILTER (WHERE NOT inside) AS n_outliers, count(*) AS n FROM f GROUP BY event_type, f.q1, f.median, f.q3""")
def a7(spark, d):
    return rounded(quantiles.box_stats(table(spark, d, "events").select("event_type", "value"), "value", "event_type"))


@query("a7_box_outliers", f"WITH {_BOXQ} SELECT event_type, value FROM f WHERE NOT inside")
def a7_outliers(spark, d):
    return quantiles.box_outliers(table(spark, d, "events").select("event_type", "value"), "value", "event_type")


@query("a8_kruskal_test", f"""
    WITH {_KW.format(n='a', col='value', grp='event_type', src='events')}
    SELECT 'value' AS variable, round(h, 6) AS h_stat, df, round({chi2_p('h', 'df')}, 6) AS p_value,
           CASE WHEN {chi2_p('h', 'df')} <= 0.01 THEN 'P<0.01' WHEN {chi2_p('h', 'df')} <= 0.05 THEN 'P<0.05' ELSE 'ns' END AS symbol
    FROM a""")
def a8(spark, d):
    t = nonparam.kruskal_wallis(table(spark, d, "events").select("event_type", "value"), ["value"], "event_type")
    return rounded(t.withColumn("symbol", significance_symbol("p_value")))


@query("a9_histogram", "SELECT floor(value / 3) * 3 AS bin_start, count(*) AS n FROM events GROUP BY 1")
def a9(spark, d):
    return quantiles.histogram(table(spark, d, "events").select("value"), "value", 3)


@query("a10_data_distribution", """
    WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM events),
    n AS (SELECT (count(*) - 1) * (10.0::DOUBLE / count(*)) AS h, (count(*) - 1) * (1 - 10.0::DOUBLE / count(*)) AS g FROM events),
    r AS (SELECT h, g, (SELECT value FROM s, n WHERE i = floor(h)) AS v1, (SELECT value FROM s, n WHERE i = ceil(h)) AS v2,
                 (SELECT value FROM s, n WHERE i = floor(g)) AS w1, (SELECT value FROM s, n WHERE i = ceil(g)) AS w2 FROM n)
    SELECT 'value' AS variable, round(quantile_cont(value, 0.25), 6) AS low_effect, round(quantile_cont(value, 0.5), 6) AS adjust_to,
      round(quantile_cont(value, 0.75), 6) AS high_effect,
      round((SELECT v1 + (v2 - v1) * (h - floor(h)) FROM r), 6) AS low_prediction,
      round((SELECT w1 + (w2 - w1) * (g - floor(g)) FROM r), 6) AS high_prediction,
      min(value) AS low, max(value) AS high, NULL AS adjust_level FROM events
    UNION ALL SELECT 'event_type', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)""")
def a10(spark, d):
    e = table(spark, d, "events").select("value", "event_type")
    return rounded(quantiles.data_distribution(e, ["value"], ["event_type"]))


@query("a11_arg_max", """
    SELECT l_linestatus, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (
      PARTITION BY l_linestatus ORDER BY l_extendedprice DESC, l_partkey) AS i FROM lineitem) WHERE i = 1""")
def a11(spark, d):
    return quantiles.arg_max(lineitem(spark, d, "l_linestatus", "l_partkey", "l_extendedprice"), "l_extendedprice",
                             "l_partkey", ["l_linestatus"])


@query("a12_row_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_flag FROM lineitem")
def a12(spark, d):
    return quantiles.row_counts(lineitem(spark, d, "l_returnflag"), F.col("ev") == 1)
