"""URL filter: rules first, then gradient-boosted trees on lexical features.

*Rules* allow or block a host with all its subdomains where the path starts as the rule's does; the longest rule that fits
decides. *The model* judges the URLs that no rule fits. It is trained on labelled URLs (``labelled``: url, blocked). A feature row holds lengths, depth, shares of digits, letters and marks, entropy of the
characters, parameter counts, and for each of the host's last one, two and three labels and the whole host how many URLs end
so and which share of the labelled ones is blocked. Those shares leave out a training row's own fold, a fifth of all URLs, so
that no row sees its own label.

Features of a URL's text are numpy operations on slices; statistics of suffixes are added up by Spark over all rows; the
trees are Spark's ``GBTClassifier``. The trees alone are fitted on a bounded sample: about ``TRAIN_ROWS`` labelled URLs, never more,
drawn by a hash. A verdict is "block" where the model's probability is over ``LIMIT``.

Host statistics meet the rows by broadcast if there are few; else hosts that many rows share by broadcast, the rest by a
shuffle, so that a host of a third of all rows is not one task's.

Defined results: null or without ``://``: host and path are empty, no rule fits, and the model judges the features of what there
is. An empty URL likewise. Rows repeated are judged alike. Without labelled URLs every verdict of the model is "allow"; with
labels of one kind only, it is that kind. A null label does not count, and a URL with both labels is in the training rows with both. An empty table gives no rows. Very long URLs are read whole. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import small_enough, stored, text_slices

#: fixed values: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

TRAIN_ROWS = 100_000  #: labelled URLs that the trees are fitted on, at most
FOLDS = 5
TREES = 20
DEPTH = 4
STEP = 0.3
LIMIT = 0.5
PRIOR = 20.0  #: weight of the overall blocked share in a suffix's share
HOT_HOSTS = 1_000  #: hosts of more than one row in so many are joined by broadcast
BROADCAST_HOSTS = 20_000
LEVELS = 4  #: host suffixes of one, two and three labels, and the whole host

LEXICAL = ("url_chars", "host_chars", "path_chars", "query_chars", "labels", "depth", "longest_part", "parameters", "digit_share",
           "letter_share", "mark_share", "host_digit_share", "host_mark_share", "digit_run", "entropy", "host_entropy")
SUFFIX = tuple(f"{kind}_{k}" for k in range(1, LEVELS + 1) for kind in ("seen", "blocked"))


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, else null. The rules are a short list written into the plan."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last one tried first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out.cast("struct<rule:string,verdict:string>")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, the row of each, the number of bytes of each row)."""
    raw = [x or b"" for x in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()]
    sizes = np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.repeat(np.arange(len(raw)), sizes), sizes


def _entropy(flat: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits for each byte of a row under the row's own frequencies."""
    kinds, n = np.unique(row * 256 + flat, return_counts=True)
    of = kinds // 256
    share = n / sizes[of]
    return np.bincount(of, -share * np.log2(share), minlength=len(sizes))


def _longest(member: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The length of each row's longest stretch of members."""
    out = np.zeros(rows, np.int64)
    if len(member):
        edge = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (row[1:] != row[:-1]), [True]]))
        inside = member[edge[:-1]]
        np.maximum.at(out, row[edge[:-1]][inside], np.diff(edge)[inside])
    return out


def lexical_features(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """A row for each URL, a column for each name of ``LEXICAL``."""
    n = len(urls)
    flat, row, size = _bytes(urls)
    host, host_row, host_size = _bytes(hosts)
    path, path_row, path_size = _bytes(paths)
    digit, letter = (flat >= 48) & (flat <= 57), ((flat | 32) >= 97) & ((flat | 32) <= 122)
    count = lambda member, of: np.bincount(of[member], minlength=n)
    share = lambda k, of: k / np.maximum(of, 1)
    scheme = np.where(host_size > 0, 3, 0)
    columns = [
        size, host_size, path_size, np.maximum(size - host_size - path_size - scheme, 0),
        np.where(host_size > 0, count(host == 46, host_row) + 1, 0), count(path == 47, path_row),
        _longest(~np.isin(flat, np.frombuffer(b"/.?#&=-_", np.uint8)), row, n), count(flat == 61, row),
        share(count(digit, row), size), share(count(letter, row), size), share(size - count(digit | letter, row), size),
        share(count((host >= 48) & (host <= 57), host_row), host_size), share(count(host == 45, host_row), host_size),
        _longest(digit, row, n), _entropy(flat, row, size), _entropy(host, host_row, host_size)]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def _lexical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "url"):
        rows = lexical_features(part.column("url"), part.column("host"), part.column("path"))
        values = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(LEXICAL))]
        yield pa.RecordBatch.from_arrays([*part.columns, *values], [*part.schema.names, *LEXICAL])


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` with the lexical features; ``rows`` has url, host and path."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_lexical, f"{shape}, {', '.join(f'{c} double' for c in LEXICAL)}")


def _suffixes(host: Column) -> Column:
    """The host's last one, two and three labels, and the whole host, as far as there are."""
    parts = F.split(host, r"\.")
    return F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in range(1, LEVELS)], host)


def suffix_statistics(hosts: DataFrame) -> DataFrame:
    """(host, fold, seen_1, blocked_1, ...) for every host and fold -1 (nothing left out), 0, ... of ``hosts``.

    ``hosts``: (host, fold, n, labelled, blocked), a row for each host and fold of its URLs.
    """
    total = hosts.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    rate = (total.blocked or 0) / max(1, total.labelled or 0)
    one = hosts.groupBy("host").agg(F.sum("n").alias("n"))
    ends = hosts.select("fold", "n", "labelled", "blocked", F.posexplode(_suffixes(F.col("host"))).alias("level", "suffix")).filter("suffix is not null")
    by_fold = ends.groupBy("level", "suffix", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    # every suffix is small: a number for each fold, all of them, and what is left without the fold
    sums = by_fold.groupBy("level", "suffix").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("labelled", "blocked")))).alias("own"))
    every = F.array(*[F.lit(k) for k in range(-1, FOLDS)])
    share = F.transform(every, lambda k: (F.col("blocked") - F.coalesce(F.col("own")[k]["blocked"], F.lit(0)) + PRIOR * rate)
                        / (F.col("labelled") - F.coalesce(F.col("own")[k]["labelled"], F.lit(0)) + PRIOR))
    sums = stored(sums.select("level", "suffix", F.log1p("n").alias("seen"), share.alias("share")), "suffixes")
    out = one
    for k in range(LEVELS):
        level = sums.filter(F.col("level") == k).select(F.col("suffix").alias(f"s{k}"), F.col("seen").alias(f"seen_{k + 1}"), F.col("share").alias(f"share_{k + 1}"))
        out = keyed_join(out.withColumn(f"s{k}", _suffixes(F.col("host"))[k]), level, f"s{k}").drop(f"s{k}")
    out = out.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    values = [x for k in range(1, LEVELS + 1) for x in (F.coalesce(f"seen_{k}", F.lit(0.0)).alias(f"seen_{k}"),
                                                      F.coalesce(F.get(f"share_{k}", F.col("at")), F.lit(float(rate))).alias(f"blocked_{k}"))]
    return stored(out.select("host", (F.col("at") - 1).alias("fold"), "n", *values), "host_statistics")


def keyed_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (a row for each ``key``): few keys by broadcast; else the keys of many rows by broadcast, the rest by a shuffle."""
    if small_enough(table, BROADCAST_HOSTS):
        return rows.join(F.broadcast(table), key, "left")
    often = rows.groupBy(key).agg(F.count("*").alias("often"))
    total = rows.count()
    hot = stored(often.filter(F.col("often") * HOT_HOSTS > total).select(key), "hot")  # fewer than HOT_HOSTS
    first = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return first.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features").transform(rows)


def fit(rows: DataFrame, seed: int = 17) -> GBTClassificationModel:
    """The trees fitted on ``rows`` with the feature columns and ``label``."""
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=seed)
    return trees.fit(_assembled(rows))


def _parsed(df: DataFrame, url_col: str, *more: Column) -> DataFrame:
    rows = df.select(*more, F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return rows.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id",
          url_col: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    ``labelled``: (url, blocked). ``score``: the model's probability that the URL should be blocked, null where a rule decides.
    """
    rows = _parsed(pages, url_col, F.col(f"`{id_col}`").alias("page_id")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    rows = stored(rows.select("page_id", "url", "host", "path", "fold", "fit.rule", "fit.verdict"), "urls")
    known = _parsed(labelled, "url", F.col("blocked").cast("int").alias("label")).filter("label is not null")
    known = stored(known.select("url", "host", "path", "fold", "label"), "labelled")
    by_host = (rows.groupBy("host", "fold").agg(F.count("*").alias("n")).withColumns({"labelled": F.lit(0), "blocked": F.lit(0)})
               .unionByName(known.groupBy("host", "fold").agg(F.lit(0).alias("n"), F.count("*").alias("labelled"), F.sum("label").alias("blocked"))))
    hosts = suffix_statistics(by_host.groupBy("host", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])).drop("n")
    rest = rows.filter("rule is null")
    ruled = rows.filter("rule is not null").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    train = _sample(known, hosts, train_rows)
    kinds = train.groupBy("label").count().collect()
    if len(kinds) < 2:
        constant = float(kinds[0].label) if kinds else 0.0
        scored = rest.withColumn("score", F.lit(constant))
    else:
        model = fit(train)
        ready = keyed_join(_measured(rest.select("page_id", "url", "host", "path")), hosts.filter("fold = -1").drop("fold"), "host")
        scored = model.transform(_assembled(ready)).withColumn("score", vector_to_array("probability")[1])
    scored = scored.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.when(F.col("score") > LIMIT, "block").otherwise("allow").alias("verdict"), "score")
    return ruled.unionByName(scored)


def _sample(known: DataFrame, hosts: DataFrame, train_rows: int) -> DataFrame:
    """The feature rows of at most ``train_rows`` different labelled URLs, drawn by a hash; each without its fold's labels."""
    kinds = known.select("url", "host", "path", "fold", "label").distinct()
    draw = F.xxhash64(F.lit("train"), "url", "label")
    many = kinds.count()
    if many > train_rows:  # leaves a little under the bound, so that few rows are ever sorted
        kinds = kinds.filter(F.pmod(draw, F.lit(1 << 30)) < int(0.95 * train_rows / many * (1 << 30)))
    first = kinds.orderBy(draw, "url", "label").limit(train_rows)
    rows = stored(_measured(first), "training")
    wanted = rows.select("host", "fold").distinct()
    shares = hosts.join(F.broadcast(wanted), ["host", "fold"], "left_semi")
    full = rows.join(F.broadcast(shares), ["host", "fold"], "left").withColumn("label", F.col("label").cast("double"))
    # in an order of its own, so that the trees do not depend on how the rows lay
    return stored(full.repartition(8, "url").sortWithinPartitions("url", "label"), "training_rows")
