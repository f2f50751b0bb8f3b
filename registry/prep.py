"""Sources, typing and recoding, filters and missing data (S, P, F)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry.core import chi2_p, lineitem, query, rounded, table
from riskset.functions import columns as C
from riskset.operators import clean, missing, nonparam, report
from riskset.operators.small import shared_folder
from riskset.sources import read_cohort, read_table, write_table

# --- sources and sinks ---------------------------------------------------------


@query("s1_read_cohort", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def s1(spark, d):
    return read_cohort(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_totalprice",
                                                              "o_orderpriority"])


def _segment_table(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"),
        F.round(F.min(F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal"))
                      ).cast("double"), 2).alias("least_machinery"),
    ).withColumn("least_machinery", F.when(F.col("least_machinery") >= 0, F.col("least_machinery")))


_SEGMENTS = """
    SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance,
           CASE WHEN min(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END) >= 0
                THEN round(min(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 2) END AS least_machinery
    FROM customer GROUP BY c_nationkey"""


@query("s2_write_table", f"""
    SELECT count(*) AS n_rows, sum(n)::BIGINT AS n, count(*) FILTER (WHERE least_machinery IS NULL) AS n_blank
    FROM ({_SEGMENTS})""")
def s2(spark, d):
    path = f"{shared_folder(spark)}/riskset-tables/{uuid.uuid4().hex}"
    write_table(_segment_table(spark, d), path, ["c_nationkey"])
    raw = read_table(spark, path, "c_nationkey string, n string, balance string, least_machinery string")
    return raw.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n").cast("long")).alias("n"),
                   F.count_if(F.col("least_machinery").isNull()).alias("n_blank"))


@query("s3_read_table", _SEGMENTS)
def s3(spark, d):
    path = f"{shared_folder(spark)}/riskset-tables/{uuid.uuid4().hex}"
    write_table(_segment_table(spark, d), path, ["c_nationkey"])
    return read_table(spark, path, "c_nationkey int, n long, balance double, least_machinery double")


# --- columns ---------------------------------------------------------------------


@query("p1_drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def p1(spark, d):
    return clean.drop_columns(table(spark, d, "orders"), ["o_custkey", "o_orderdate", "o_orderpriority"])


@query("p2_select_columns", "SELECT o_orderpriority, o_orderkey FROM orders")
def p2(spark, d):
    return clean.select_columns(table(spark, d, "orders"), ["o_orderpriority", "o_orderkey"])


@query("p3_select_dynamic", "SELECT o_totalprice, o_orderkey FROM orders")
def p3(spark, d):
    return clean.select_dynamic(table(spark, d, "orders"), ["o_totalprice", "o_orderkey", "o_totalprice"])


@query("p4_to_numeric", """
    SELECT p_partkey, try_cast(CASE WHEN p_size < 25 THEN ' ' || regexp_replace(p_brand, 'Brand#', '') || ' '
                                    ELSE p_type END AS DOUBLE) AS x FROM part""")
def p4(spark, d):
    p = table(spark, d, "part")
    text = F.when(F.col("p_size") < 25, F.concat(F.lit(" "), F.regexp_replace("p_brand", "Brand#", ""), F.lit(" "))
                  ).otherwise(F.col("p_type"))
    return p.select("p_partkey", C.to_numeric(text).alias("x"))


@query("p5_round_even", "SELECT p_partkey, round_even(p_size / 2.0, 0) AS half FROM part")
def p5(spark, d):
    return table(spark, d, "part").select("p_partkey", C.round_even(F.col("p_size") / 2.0).alias("half"))


@query("p6_recode_binary", """
    SELECT o_orderkey, CASE WHEN s = 'F' THEN 0 WHEN s IS NOT NULL THEN 1 END AS code,
           CASE WHEN s = 'F' THEN 'finished' WHEN s IS NOT NULL THEN 'other' END AS label
    FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)""")
def p6(spark, d):
    s = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return table(spark, d, "orders").select(
        "o_orderkey", C.recode_binary(s, "F").alias("code"),
        C.recode_binary(s, "F", "finished", "other").alias("label"))


@query("p7_normalise_text", """
    SELECT p_partkey, trim(regexp_replace(upper(concat('  ', replace(p_name, ' ', '   '), ' ')), '\\s+', ' ', 'g')) AS name
    FROM part""")
def p7(spark, d):
    messy = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", C.normalise_text(messy).alias("name"))


@query("p8_recode_map", """
    SELECT p_type, kind, count(*) AS n FROM (
      SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN 'Cheap' WHEN 'PROMO' THEN 'Cheap'
             WHEN 'STANDARD' THEN 'Plain' ELSE p_type END AS kind FROM part) GROUP BY ALL""")
def p8(spark, d):
    kind = C.recode_map("p_type", {"ECONOMY": "Cheap", "PROMO": "Cheap", "STANDARD": "Plain"})
    return table(spark, d, "part").groupBy("p_type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p9_lump_other", """
    SELECT o_orderkey, CASE WHEN s IN ('1-URGENT', '2-HIGH') THEN s WHEN s IS NOT NULL THEN 'Other' END AS priority
    FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS s FROM orders)""")
def p9(spark, d):
    s = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return table(spark, d, "orders").select("o_orderkey", C.lump_other(s, ["1-URGENT", "2-HIGH"]).alias("priority"))


@query("p10_set_levels", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'low' WHEN '3-MEDIUM' THEN 'medium'
                       WHEN '1-URGENT' THEN 'urgent' END AS o_orderpriority FROM orders""")
def p10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return clean.set_levels(o, "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"], ["low", "medium", "urgent"])


@query("p11_factor_code", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END AS code,
           CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'P' THEN '2' END AS status FROM orders""")
def p11(spark, d):
    o = table(spark, d, "orders")
    o = clean.set_levels(o, "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"])
    o = clean.factor_code(o, "o_orderpriority", "code")
    o = clean.set_levels(o, "o_orderstatus", ["O", "P"])
    o = clean.as_factor(clean.factor_code(o, "o_orderstatus", "status"), "status", [1, 2])
    return o.select("o_orderkey", "code", "status")


_INDEX = "10.0 * l_tax + 5.0 * l_discount"


@query("p12_derive_index", f"""
    SELECT l_orderkey, l_linenumber, round({_INDEX}, 6) AS idx FROM lineitem""")
def p12(spark, d):
    li = lineitem(spark, d, "l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return rounded(li.select("l_orderkey", "l_linenumber", C.weighted_index({"l_tax": 10, "l_discount": 5}).alias("idx")))


@query("p13_flag_any", """
    SELECT flag, count(*) AS n FROM (
      SELECT CASE WHEN a + b + c + e = 0 THEN 0 WHEN a + b + c + e IS NOT NULL THEN 1 END AS flag FROM (
        SELECT (l_tax > 0.06)::INT AS a, (l_discount > 0.08)::INT AS b, (l_linestatus = 'F')::INT AS c,
               CASE WHEN l_quantity < 40 THEN (l_quantity > 30)::INT END AS e FROM lineitem)) GROUP BY flag""")
def p13(spark, d):
    li = lineitem(spark, d, "l_tax", "l_discount", "l_linestatus", "l_quantity")
    flags = [(F.col("l_tax") > 0.06).cast("int"), (F.col("l_discount") > 0.08).cast("int"),
             (F.col("l_linestatus") == "F").cast("int"),
             F.when(F.col("l_quantity") < 40, (F.col("l_quantity") > 30).cast("int"))]
    return li.groupBy(C.flag_any(flags).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_cap_upper", """
    SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 300000.0 ELSE o_totalprice END AS capped FROM orders""")
def p14(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.cap_upper("o_totalprice", 300000).alias("capped"))


@query("p15_flag_threshold", """
    SELECT o_orderkey, CASE WHEN o_totalprice < 34850.5 THEN 0 WHEN o_totalprice IS NOT NULL THEN 1 END AS flag
    FROM orders""")
def p15(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.flag_threshold("o_totalprice", 34850.5).alias("flag"))


@query("p16_rename_suffix", "SELECT c_custkey AS custkey, c_acctbal AS acctbal, c_mktsegment FROM customer")
def p16(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("custkey_first"), F.col("c_acctbal").alias("acctbal_first"), "c_mktsegment")
    return clean.rename_suffix(c, "_first$")


@query("p17_rename_columns", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
def p17(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return clean.rename_columns(c, {"c_custkey": "id", "c_acctbal": "balance"})


@query("p18_label_rows", """
    SELECT event_type AS variable, CASE event_type WHEN 'click' THEN 'Clicks' WHEN 'error' THEN 'Failures'
           ELSE event_type END AS label, count(*) AS n FROM events GROUP BY event_type""")
def p18(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("variable")).agg(F.count(F.lit(1)).alias("n"))
    return clean.label_rows(n, {"click": "Clicks", "error": "Failures"})


@query("p19_blank_missing", """
    SELECT coalesce(s_suppkey::VARCHAR, ' ') AS s_suppkey, coalesce(nullif(s_nationkey, 3)::VARCHAR, ' ') AS nation
    FROM supplier""")
def p19(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(3)).alias("nation"))
    return clean.blank_table(s)


@query("p20_strip_parenthesised", """
    SELECT o_orderpriority, regexp_replace(sum((o_orderstatus = 'F')::INT) || '/' || count(*) || ' (a) of (b)',
           '\\(.*?\\)', '', 'g') AS share FROM orders GROUP BY o_orderpriority""")
def p20(spark, d):
    text = F.concat(F.sum((F.col("o_orderstatus") == "F").cast("int")).cast("string"), F.lit("/"),
                    F.count(F.lit(1)).cast("string"), F.lit(" (a) of (b)"))
    return (table(spark, d, "orders").groupBy("o_orderpriority").agg(text.alias("t"))
            .select("o_orderpriority", C.strip_parenthesised("t").alias("share")))


_TEXT = "regexp_replace(regexp_replace(format('{{:.{k}f}}', round({x}, {k})), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def _num(x: str, k: int = 3) -> str:
    return _TEXT.format(x=x, k=k)


@query("p21_format_estimate", f"""
    SELECT c_nationkey, CASE WHEN m IS NULL THEN ' ' ELSE {_num('m')} || ' (' || {_num('lo')} || '-' || {_num('hi')} || ')' END AS est,
           {_num('lo')} || '-' || {_num('hi')} AS band
    FROM (SELECT c_nationkey, avg(CASE WHEN c_nationkey <> 7 THEN c_acctbal END) / 7000 AS m,
                 min(c_acctbal) / 7000 AS lo, max(c_acctbal) / 7000 AS hi FROM customer GROUP BY c_nationkey)""")
def p21(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(
        (F.avg(F.when(F.col("c_nationkey") != 7, F.col("c_acctbal"))) / 7000).alias("m"),
        (F.min("c_acctbal") / 7000).alias("lo"), (F.max("c_acctbal") / 7000).alias("hi"))
    return g.select("c_nationkey", C.format_estimate("m", "lo", "hi").alias("est"),
                    C.format_interval("lo", "hi").alias("band"))


@query("p22_format_p", """
    WITH p AS (SELECT s_suppkey, abs(s_acctbal) / 1000000.0 AS p FROM supplier),
    e AS (SELECT *, format('{:.2e}', p) AS sci FROM p),
    w AS (SELECT *, greatest(greatest(length(regexp_replace(split_part(sci, 'e', 1), '\\.?0+$', '')) - 2, 0)
                    - split_part(sci, 'e', 2)::INT, 0) AS places FROM e),
    k AS (SELECT max(places) FILTER (WHERE p >= 0.001) AS places FROM w)
    SELECT s_suppkey, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.' || k.places || 'f', p) END AS significant,
           format('{:.3f}', p) AS fixed, CASE WHEN p < 0.001 THEN '<0.001' ELSE format('{:.3f}', p) END AS floored
    FROM w, k""")
def p22(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 1000000.0).alias("p"))
    return report.format_pval(p, "p", "significant").select(
        "s_suppkey", "significant", C.format_p_fixed("p").alias("fixed"), C.format_p_floor("p").alias("floored"))


@query("p23_text_to_number", """
    SELECT s_suppkey, try_cast(CASE WHEN s_nationkey < 12 THEN s_acctbal::VARCHAR ELSE ' ' END AS DOUBLE) AS x
    FROM supplier""")
def p23(spark, d):
    text = F.when(F.col("s_nationkey") < 12, F.col("s_acctbal").cast("string")).otherwise(" ")
    return table(spark, d, "supplier").select("s_suppkey", C.text_to_number(text).alias("x"))


@query("p24_significance_symbol", """
    SELECT sym, count(*) AS n FROM (SELECT CASE WHEN l_tax <= 0.01 THEN 'P<0.01' WHEN l_tax <= 0.05 THEN 'P<0.05'
      WHEN l_tax IS NOT NULL THEN 'ns' END AS sym FROM (SELECT nullif(l_tax, 0.08) AS l_tax FROM lineitem)) GROUP BY sym""")
def p24(spark, d):
    p = F.nullif(F.col("l_tax"), F.lit(0.08))
    return lineitem(spark, d, "l_tax").groupBy(C.significance_symbol(p).alias("sym")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p25_round_n", "SELECT s_suppkey, round(s_acctbal / 7, 3) AS r FROM supplier")
def p25(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", C.round_n(F.col("s_acctbal") / 7, 3).alias("r"))


# --- filters and missing data ------------------------------------------------------

_GAPS = """(SELECT l_orderkey, l_linenumber, l_linestatus, l_quantity, l_extendedprice,
            nullif(l_tax, 0.0) AS tax, nullif(l_discount, 0.0) AS discount,
            CASE WHEN l_quantity > 38 THEN NULL ELSE l_quantity END AS quantity FROM lineitem)"""


def _gaps(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_extendedprice",
                     F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
                     F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
                     F.when(F.col("l_quantity") <= 38, F.col("l_quantity")).alias("quantity"))


@query("f1_require_present", f"""
    SELECT l_linestatus, count(*) AS n, round(sum(tax), 4) AS tax FROM {_GAPS}
    WHERE tax IS NOT NULL AND discount IS NOT NULL GROUP BY l_linestatus""")
def f1(spark, d):
    df = missing.require_present(_gaps(spark, d), ["tax", "discount"])
    return df.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tax"), 4).alias("tax"))


_BOUNDS = """b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents)"""


@query("f2_iqr_fence", f"""
    WITH {_BOUNDS} SELECT doc_id, n_chars FROM documents, b
    WHERE n_chars >= q1 - 3 * (q3 - q1) AND n_chars <= q3 + 3 * (q3 - q1)""")
def f2(spark, d):
    return missing.iqr_fence(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars")


@query("f3_fence_report", f"""
    WITH {_BOUNDS}, r AS (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM b)
    SELECT round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound, count(*) AS n_before,
           count(*) FILTER (WHERE n_chars < lo OR n_chars > hi) AS n_removed,
           count(*) FILTER (WHERE NOT (n_chars < lo OR n_chars > hi)) AS n_left
    FROM documents, r GROUP BY lo, hi""")
def f3(spark, d):
    return missing.fence_report(table(spark, d, "documents").select("n_chars"), "n_chars")


def _profile_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_miss, "
        f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS pct_miss FROM {_GAPS}" for c in cols)


_GAP_COLS = ["l_orderkey", "l_linenumber", "l_linestatus", "l_quantity", "l_extendedprice", "tax", "discount",
             "quantity"]


@query("f4_missing_profile", _profile_sql(_GAP_COLS))
def f4(spark, d):
    return rounded(missing.missing_profile(_gaps(spark, d)))


@query("f5_drop_sparse_columns", f"""
    SELECT l_linestatus, count(*) AS n, round(avg(tax), 6) AS tax, round(avg(discount), 6) AS discount,
           'quantity' AS dropped FROM {_GAPS} GROUP BY l_linestatus""")
def f5(spark, d):
    kept, dropped = missing.drop_sparse_columns(_gaps(spark, d), 0.2)
    assert "quantity" not in kept.columns
    return rounded(kept.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("tax").alias("tax"), F.avg("discount").alias("discount"),
        F.lit(",".join(dropped)).alias("dropped")))


def _chi2_cells(cols, group, src):
    """SQL for Pearson chi-square without the 2x2 correction, per variable."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c}::VARCHAR AS v, {group}::VARCHAR AS g, count(*) AS n "
                               f"FROM {src} GROUP BY ALL" for c in cols)
    return f"""c AS ({cells}),
      r AS (SELECT variable, v, sum(n) AS rn FROM c GROUP BY ALL), k AS (SELECT variable, g, sum(n) AS cn FROM c GROUP BY ALL),
      t AS (SELECT variable, sum(n) AS total FROM c GROUP BY ALL),
      x AS (SELECT r.variable, sum((coalesce(n, 0) - rn * cn / total) ** 2 / (rn * cn / total)) AS chi2,
                   (count(DISTINCT r.v) - 1) * (count(DISTINCT k.g) - 1) AS df
            FROM r JOIN k ON r.variable = k.variable JOIN t ON t.variable = r.variable
            LEFT JOIN c ON c.variable = r.variable AND c.v = r.v AND c.g = k.g GROUP BY r.variable)"""


@query("f8_filter_p", f"""
    WITH {_chi2_cells(['l_returnflag', 'l_tax', 'l_discount', 'l_linestatus'], 'l_linenumber', 'lineitem')}
    SELECT variable, round(p, 6) AS p_value FROM (SELECT variable, {chi2_p('chi2', 'df')} AS p FROM x) WHERE p < 0.8""")
def f8(spark, d):
    li = lineitem(spark, d, "l_returnflag", "l_tax", "l_discount", "l_linestatus", "l_linenumber")
    tests = nonparam.chi_square_independence(li, ["l_returnflag", "l_tax", "l_discount", "l_linestatus"], "l_linenumber")
    return rounded(missing.filter_p(tests, 0.8, "p_value").select("variable", "p_value"))


@query("f9_complete_cases", f"""
    SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS price FROM {_GAPS}
    WHERE tax IS NOT NULL AND discount IS NOT NULL AND quantity IS NOT NULL""")
def f9(spark, d):
    df = missing.complete_cases(_gaps(spark, d), ["tax", "discount", "quantity"])
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query("f10_open_interval", """
    SELECT DISTINCT l_extendedprice AS value, l_extendedprice <= 52000.5 AS low FROM lineitem
    WHERE l_extendedprice > 50000 AND l_extendedprice < 55000""")
def f10(spark, d):
    inside = missing.open_interval(lineitem(spark, d, "l_extendedprice"), "l_extendedprice", 50000, 55000)
    closed = missing.closed_interval(inside, "l_extendedprice", 50000, 52000.5).withColumn("low", F.lit(True))
    rest = inside.where(F.col("l_extendedprice") > 52000.5).withColumn("low", F.lit(False))
    return closed.unionByName(rest).withColumnRenamed("l_extendedprice", "value")
