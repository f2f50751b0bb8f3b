"""Exact quantiles and the tables built on them.

Reported values are always exact order statistics. Columns with few distinct
values use the built-in ``percentile``, whose state is one entry per distinct
value; wider columns are counted in value bins that narrow, pass by pass, until the
rows around the wanted ranks are few enough to count one by one. No pass shuffles rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.operators.ordering import running_sums
from riskset.operators.small import join_checked

# distinct values `percentile` may hold per group and column, and over all of them in one task
DISTINCT_IN_MEMORY = 200_000
ENTRIES_IN_MEMORY = 2_000_000
GROUPS_IN_DRIVER = 2_000
# value ranges searched at once from the driver; each sends at most a few thousand counts per pass, a million in all
SPANS_IN_DRIVER = 10_000
_BINS = 4096


def _clean(c: str) -> Column:
    c = F.col(c).cast("double")
    return F.when(~F.isnan(c), c)


def quantile7(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              distinct_limit: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles (by..., variable, prob, value), missing ignored."""
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    limit = DISTINCT_IN_MEMORY if distinct_limit is None else distinct_limit
    spark = df.sparkSession
    sizes = [F.count(_clean(c)).alias(f"n_{i}") for i, c in enumerate(cols)]
    wide = [F.approx_count_distinct(_clean(c)).alias(f"d_{i}") for i, c in enumerate(cols)]
    ends = [f(_clean(c)).alias(f"{n}_{i}") for i, c in enumerate(cols) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    profile = df.groupBy(*by).agg(*sizes, *wide, *ends).limit(GROUPS_IN_DRIVER + 1).collect()
    if len(profile) > GROUPS_IN_DRIVER:
        return _by_running_count(df, cols, probs, by)
    few, entries_kept = [], 0
    for i in sorted(range(len(cols)), key=lambda i: sum(r[f"d_{i}"] for r in profile)):
        entries_kept += sum(r[f"d_{i}"] for r in profile)
        if entries_kept <= ENTRIES_IN_MEMORY and all(r[f"d_{i}"] <= limit for r in profile):
            few.append(i)
    many = [i for i in range(len(cols)) if i not in few]
    parts = []
    if few:
        grid = F.array(*[F.lit(p) for p in probs])
        agg = df.groupBy(*by).agg(*[F.percentile(_clean(cols[i]), grid).alias(f"q_{i}") for i in few])
        entries = F.explode(F.array(*[
            F.struct(F.lit(cols[i]).alias("variable"), F.lit(p).alias("prob"),
                     F.element_at(F.col(f"q_{i}"), j + 1).alias("value"))
            for i in few for j, p in enumerate(probs)]))
        parts.append(agg.select(*by, entries.alias("__cell")).select(*by, "__cell.*"))
    if many and len(profile) * len(many) * 2 * len(probs) > SPANS_IN_DRIVER:
        parts.append(_by_running_count(df, [cols[i] for i in many], probs, by).select(*by, "variable", "prob", "value"))
    elif many:
        sizes_at = {(tuple(r[b] for b in by), cols[i]): (r[f"n_{i}"], r[f"lo_{i}"], r[f"hi_{i}"])
                    for r in profile for i in many}
        rows = _narrowed(df, [cols[i] for i in many], probs, by, sizes_at, limit)
        schema = df.select(*by).schema.add("variable", "string").add("prob", "double").add("value", "double")
        parts.append(spark.createDataFrame(rows, schema))
    out = parts[0]
    for extra in parts[1:]:
        out = out.unionByName(extra)
    return out


def quantile_values(df: DataFrame, col: str, probs: Sequence[float],
                    distinct_limit: int | None = None) -> list[float | None]:
    """Quantiles of one column as plain numbers."""
    found = {r.prob: r.value for r in quantile7(df, [col], probs, (), distinct_limit).collect()}
    return [found[float(p)] for p in probs]


def _by_running_count(df, cols, probs, by) -> DataFrame:
    """For very many groups: exact ranks from running counts, nothing on the driver."""
    long = _unpivot(df, cols, by)
    keys = [*by, "variable"]
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, keys, "value", ["n"])
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = totals.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob"))
    h = (F.col("total") - 1) * F.col("prob")
    wanted = wanted.select("*", h.alias("h"), (F.floor(h) + 1).alias("lo"), (F.ceil(h) + 1).alias("hi"))
    joined = join_checked(ranked, wanted, keys)
    first = F.col("cum_n") - F.col("n") + 1

    def holding(rank):
        return F.when((first <= F.col(rank)) & (F.col("cum_n") >= F.col(rank)), F.col("value"))

    picked = joined.groupBy(*keys, "prob", "h").agg(
        F.max(holding("lo")).alias("a"), F.max(holding("hi")).alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a")))
    return picked.select(*keys, "prob", value.alias("value"))


def _unpivot(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), _clean(c).alias("value"))
                                  for c in cols]))
    return (df.select(*by, entries.alias("__cell")).select(*by, "__cell.*").where(F.col("value").isNotNull()))


def _narrowed(df, cols, probs, by, sizes, limit) -> list[tuple]:
    """Exact order statistics by counting in ever narrower value bins.

    ``sizes`` gives (rows, least, greatest) per (group, column).

    Each round cuts every live span into equal bins and keeps, per wanted rank, the one
    bin that holds it, with that bin's exact least and greatest value. A few thousand
    bins per round leave a handful of rounds even for the largest tables. Only counts
    per bin come back; wanted ranks are as many as result cells, checked by the caller.
    """
    spark = df.sparkSession
    long = _unpivot(df, cols, by)
    by_schema = df.select(*by).schema
    found: dict = {}
    wanted: dict = {}
    for (group, col), (n, _, _) in sizes.items():
        for p in probs if n else ():
            for rank in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                wanted.setdefault((group, col), {})[rank] = None
    # a live span: (group, column, lo, hi) -> how many rows lie below it and in it, and its ranks
    live = {(*k, *sizes[k][1:]): dict(below=0, inside=sizes[k][0], ranks=list(ranks)) for k, ranks in wanted.items()}
    while live:
        schema = _copy(by_schema).add("variable", "string").add("lo", "double").add("hi", "double")
        narrow = {k: s for k, s in live.items() if s["inside"] <= limit}
        wide = {k: s for k, s in live.items() if s["inside"] > limit}
        live = {}
        if narrow:
            spans = spark.createDataFrame([(*k[0], *k[1:]) for k in narrow], schema)
            counts = _inside(long, spans, by).groupBy(*by, "variable", "lo", "hi", "value").agg(
                F.count(F.lit(1)).alias("n"))
            w = (Window.partitionBy(*by, "variable", "lo", "hi").orderBy("value")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
            ranked = counts.withColumn("upto", F.sum("n").over(w))
            offsets = spark.createDataFrame(
                [(*k[0], *k[1:], r - s["below"], r) for k, s in narrow.items() for r in s["ranks"]],
                _copy(schema).add("offset", "long").add("rank", "long"))
            hit = ranked.join(F.broadcast(offsets), _same(ranked, offsets, [*by, "variable", "lo", "hi"])).where(
                (F.col("upto") > F.col("offset")) & (F.col("upto") - F.col("n") <= F.col("offset")))
            for r in hit.select(*[ranked[b] for b in by], ranked["variable"], "rank", "value").collect():
                found[(tuple(r[:len(by)]), r["variable"], r["rank"])] = r["value"]
        if wide:
            bins = max(64, min(_BINS, 1_000_000 // len(wide)))
            spans = spark.createDataFrame([(*k[0], *k[1:]) for k in wide], schema)
            width = F.col("hi") - F.col("lo")
            inner = F.floor((F.col("value") - F.col("lo")) / width * bins)
            # the ends apart; a span too wide for a double, or unbounded, is first split at zero
            at = (F.when(F.col("value") == F.col("lo"), -1).when(F.col("value") == F.col("hi"), bins)
                  .when(width == float("inf"), (F.col("value") >= 0).cast("long")).otherwise(inner))
            counted = _inside(long, spans, by).groupBy(*by, "variable", "lo", "hi", at.alias("bin")).agg(
                F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
            per_span: dict = {}
            for r in counted.collect():
                per_span.setdefault((tuple(r[:len(by)]), r["variable"], r["lo"], r["hi"]), []).append(
                    (r["bin"], r["n"], r["least"], r["most"]))
            for k, s in wide.items():
                below = s["below"]
                ranks = sorted(s["ranks"])
                for _, n, least, most in sorted(per_span[k]):
                    while ranks and ranks[0] < below + n:
                        rank = ranks.pop(0)
                        if rank == below or least == most:
                            found[(k[0], k[1], rank)] = least
                        elif rank == below + n - 1:
                            found[(k[0], k[1], rank)] = most
                        else:
                            span = live.setdefault((k[0], k[1], least, most), dict(below=below, inside=n, ranks=[]))
                            span["ranks"].append(rank)
                    below += n
    out = []
    for (group, col), (n, _, _) in sizes.items():
        for p in probs:
            value = None
            if n:
                h = (n - 1) * p
                a, b = found[(group, col, math.floor(h))], found[(group, col, math.ceil(h))]
                value = a if a == b else a + (h - math.floor(h)) * (b - a)
            out.append((*group, col, p, value))
    return out


def _copy(schema):
    from pyspark.sql.types import StructType

    return StructType(list(schema.fields))


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def _inside(long: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long rows within each live span; the spans are a checked, driver-made table."""
    joined = long.join(F.broadcast(spans), _same(long, spans, [*by, "variable"]))
    return joined.where(F.col("value").between(F.col("lo"), F.col("hi"))).select(
        *[long[b] for b in by], long["variable"], long["value"], spans["lo"], spans["hi"])


def quantile_group(df: DataFrame, col: str, cuts: Sequence[float] | None = None,
                   probs: Sequence[float] = (0.25, 0.5, 0.75), out: str = "group") -> DataFrame:
    """1 + how many cuts lie strictly below the value; a tie goes to the lower group, a missing value to none."""
    cuts = list(cuts) if cuts is not None else quantile_values(df, col, probs)
    value = _clean(col) if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)) else F.col(col)
    code = F.when(value.isNotNull(), F.lit(1))
    for c in cuts:
        code = code + (value > F.lit(c)).cast("int")
    return df.withColumn(out, code)


def type3_rank(n: int, p: float) -> int:
    """1-based nearest-even order statistic of ``n`` sorted values."""
    t = n * p - 0.5
    j = math.floor(t + 4 * 2.220446049250313e-16)
    exact = abs(t - j) <= 4 * 2.220446049250313e-16 * max(1.0, abs(t))
    return min(max(j if exact and j % 2 == 0 else j + 1, 1), n)


def distinct_ranks(df: DataFrame, col: str, out: str = "pos") -> DataFrame:
    """(value, pos, n): the distinct values with their 1-based rank and their number."""
    distinct = (df.select(F.col(col).alias("value")).where(F.col("value").isNotNull())
                .distinct().withColumn("one", F.lit(1)))
    ranked = running_sums(distinct, [], "value", ["one"])
    return ranked.select("value", F.col("cum_one").cast("long").alias(out), F.lit(distinct.count()).alias("n"))


def quantile3(df: DataFrame, col: str, probs: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """Nearest-even order statistics of the distinct values (prob, value)."""
    ranked = distinct_ranks(df, col).persist(StorageLevel.MEMORY_AND_DISK)
    n = ranked.agg(F.max("n")).first()[0] or 0
    wanted = [(float(p), type3_rank(n, p)) for p in probs] if n else []
    spec = df.sparkSession.createDataFrame(wanted, "prob double, pos long")
    return ranked.join(F.broadcast(spec), "pos").select("prob", "value")


def data_distribution(df: DataFrame, numeric: Sequence[str], factors: Sequence[str] = ()) -> DataFrame:
    """Per variable: low effect (Q1), adjust-to (median or most frequent level), high effect (Q3),
    low and high prediction limits, and the observed range.

    Numeric rows fill the number columns; factor rows fill ``adjust_level``. The
    prediction limits are the quantiles at q and 1 - q, q = 10 / max(n, 200), with n
    the variable's own number of values.
    """
    out = []
    if numeric:
        sizes = df.agg(*[F.count(_clean(c)).alias(f"n{i}") for i, c in enumerate(numeric)]).first()
        tails = {c: 10.0 / max(sizes[f"n{i}"], 200) for i, c in enumerate(numeric)}
        by_tail: dict[float, list[str]] = {}
        for c, tail in tails.items():
            by_tail.setdefault(tail, []).append(c)

        def at(p, name):
            return F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)

        for tail, names in by_tail.items():  # variables with as many values share a pass
            q = quantile7(df, names, sorted({0.0, tail, 0.25, 0.5, 0.75, 1 - tail, 1.0}))
            out.append(q.groupBy("variable").agg(
                at(0.25, "low_effect"), at(0.5, "adjust_to"), at(0.75, "high_effect"),
                at(tail, "low_prediction"), at(1 - tail, "high_prediction"),
                at(0.0, "low"), at(1.0, "high")).withColumn("adjust_level", F.lit(None).cast("string")))
    if factors:
        blank = [F.lit(None).cast("double").alias(c) for c in (
            "low_effect", "adjust_to", "high_effect", "low_prediction", "high_prediction", "low", "high")]
        entries = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"))
                                      for c in factors]))
        counts = (df.select(entries.alias("__cell")).select("__cell.*").where(F.col("level").isNotNull())
                  .groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n")))
        modal = counts.groupBy("variable").agg(
            F.max_by("level", F.struct("n", F.col("level"))).alias("unused"),
            F.max("n").alias("top"))
        # the first level among equally frequent ones
        first = (counts.join(modal, "variable").where(F.col("n") == F.col("top"))
                 .groupBy("variable").agg(F.min("level").alias("adjust_level")))
        out.append(first.select("variable", *blank, "adjust_level"))
    result = out[0]
    for extra in out[1:]:
        result = result.unionByName(extra)
    return result


def histogram(df: DataFrame, col: str, width: float = 3.0) -> DataFrame:
    """(bin_start, n) for bins of ``width`` aligned at zero."""
    value = _clean(col)
    bin_start = F.floor(value / F.lit(float(width))) * F.lit(float(width))
    return (df.where(value.isNotNull()).groupBy(bin_start.alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("n")))


def box_stats(df: DataFrame, value: str, group: str, reach: float = 1.5) -> DataFrame:
    """Per group: quartiles, whisker ends (furthest points within reach*IQR) and outlier count."""
    q = quantile7(df, [value], [0.25, 0.5, 0.75], [group]).groupBy(group).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
          for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    fence = reach * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = v.between(F.col("q1") - fence, F.col("q3") + fence)
    with_q = join_checked(df.select(group, v).where(_clean(value).isNotNull()), q, [group])
    return with_q.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def box_outliers(df: DataFrame, value: str, group: str, reach: float = 1.5) -> DataFrame:
    """The points beyond the whiskers."""
    q = quantile7(df, [value], [0.25, 0.75], [group]).groupBy(group).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    fence = reach * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return (join_checked(df.select(group, v).where(_clean(value).isNotNull()), q, [group])
            .where((v < F.col("q1") - fence) | (v > F.col("q3") + fence)).select(group, value))


def arg_max(df: DataFrame, value: str, pick: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group the ``pick`` of the largest ``value``; ties go to the smallest ``pick``.

    An aggregate, so partial maxima are merged map-side.
    """
    best = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min_by(F.struct(F.col(pick), F.col(value)),
                 F.struct((-F.col(value)).alias("v"), F.col(pick).alias("p"))).alias("best"))
    return best.select(*by, "best.*")


def row_counts(df: DataFrame, flag: Column) -> DataFrame:
    """One row: all rows and rows where ``flag`` holds."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flag"))


def freq_table(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """(level, n) in level order, empty levels as 0, missing left out."""
    spec = df.sparkSession.createDataFrame(
        [(i, str(v)) for i, v in enumerate(levels, 1)], "level_order int, level string")
    counts = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("level"))
              .agg(F.count(F.lit(1)).alias("n")))
    return spec.join(counts, "level", "left").select(
        "level_order", "level", F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy("level_order")
