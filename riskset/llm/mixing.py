"""Mixing sources to target weights, with DataFrame functions only.

Words are summed by source and weights turned into a target for each source; the repetition rate is target over size.
Each document is emitted floor(rate) times, plus one copy if a hash of its id, read as a number from 0 to 1, is below the
fraction. No document is emitted more than ``MOST`` times.

Targets: sources share all words in proportion to their weights, but a source stops at ``MOST`` times its size and the
excess is shared again among the others. That is min(MOST * size, level * weight) with the one level at which the
targets add up, which running sums over the sources, in order of size over weight, give without repeating.

Defined results: a null or blank text has size 0. A null source is a source of its own, the last. A source of size 0 has
target 0, and its documents are emitted once, which adds no words. The draw hashes the id, so that reruns agree and rows
with one id are emitted alike; a null id is drawn as the text ``null``. An empty table stays empty.

Documents are shuffled nowhere; only (source, size) sums are. The table of rates has a row for each source: it is
broadcast if its counted size allows, else joined with a source's documents dealt over ``SPREAD`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskset.llm.common import BROADCAST_ROWS, WS, WS_CHARS, small_enough, stored

MOST = 3.0
SPREAD = 64


def word_count(text: Column) -> Column:
    """Words between white space (U+0020, U+0009 to U+000D)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WS))).cast("long")


def cycle_weights(n: int = 3) -> Column:
    """1, 2, ..., n, repeating, by the source's ``position`` (from 1)."""
    return F.pmod(F.col("position") - 1, F.lit(n)) + 1


def targets(sizes: DataFrame, weight: Column, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), a row for each source.

    ``weight`` may use ``source`` and ``position``, the source's place by code point, null last.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("position", F.row_number().over(place)).withColumn("weight", weight.cast("double"))
    # if the level stops all sources up to one (in this order), the rest share what is left by weight
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "position")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * F.lit(most)
    passed = F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    rows = (rows.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
            .withColumn("level", (F.col("total") - held) / (F.col("weights") - passed))
            .withColumn("stops", F.col("level") * F.col("weight") > F.lit(most) * F.col("source_size")))
    # the first source in the order that doesn't stop sets the level for itself and all after it
    rows = rows.withColumn("share", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "position", "level")))
                           .over(every)["level"])
    target = F.when(F.col("share").isNull() | (F.col("share") * F.col("weight") > F.lit(most) * F.col("source_size")),
                    F.lit(most) * F.col("source_size")).otherwise(F.col("share") * F.col("weight"))
    return (rows.withColumn("target", target.cast("double"))
            .withColumn("rate", F.when(F.col("source_size") == 0, 1.0).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(most))))
            .select("source", "source_size", "target", "rate"))


def draw(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the id: 32 bits of an md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None,
           most: float = MOST, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with size, source_size, target and copies, for every row."""
    named = F.col(f"`{source_col}`")
    own = [F.col(f"`{c}`") for c in (keep if keep is not None else [id_col])]
    rows = docs.select(F.struct(*own).alias("own"), F.col(f"`{id_col}`").alias("id"), named.alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    rates = stored(targets(sizes, cycle_weights() if weight is None else weight, most), "rates")
    key = F.struct(F.col("source")).alias("key")  # a struct, so that null matches null
    rates = rates.select(key, "source_size", "target", "rate")
    rows = rows.withColumn("key", F.struct("source"))
    if small_enough(rates, BROADCAST_ROWS):
        joined = rows.join(F.broadcast(rates), "key")
    else:
        spread = rates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        joined = rows.withColumn("part", F.pmod(F.xxhash64("id", "size"), F.lit(SPREAD)).cast("int")).join(spread, ["key", "part"])
    whole = F.floor("rate")
    n = whole + (draw("id", seed) < F.col("rate") - whole).cast("long")
    return joined.select("own", "size", "source_size", "target", n.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row emitted as often as its source's rate asks for."""
    counted = copies(docs, id_col, text_col, source_col, keep=docs.columns, **options).filter("copies > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("own.*")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row: the words the mix takes of it, repeats counted."""
    out = copies(docs, id_col, text_col, source_col, keep=[id_col], **options)
    return out.select(F.col(f"own.`{id_col}`").alias("doc_id"), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"))
