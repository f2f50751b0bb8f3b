"""Dropping lines that recur across documents, with DataFrame functions only.

Every text is split into lines; a line's key is the line stripped of white space at both ends, A-Z lower-cased. Lines
become (document, position, 128-bit hash) rows in a narrow table, counted per hash over distinct documents, and where a
key of at least ``MIN_CHARS`` code points is in at least ``MIN_DOCS`` documents all its lines go, but for those in the
document with the smallest id. What stays is put together again by position.

Defined results: a null or empty text is one empty line. Rows with one id are one document to the counts, and lose the
lines at the positions that rule names; a null id comes after all others. An empty table gives no rows. A very long text is
read whole. Other columns are carried along or
ignored, whatever their names.

A line that a third of all documents share is counted after a partial sum for each (hash, document); the table of
recurring hashes meets the lines by broadcast for its most frequent ``HOT_KEYS`` hashes at most, and by a shuffle for the
rest, each of which holds less than one in ``HOT_KEYS`` of the rows. Texts are shuffled once, by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import WS_CHARS, stored

MIN_CHARS = 10
MIN_DOCS = 2
HOT_KEYS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at both ends, with A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(WS_CHARS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, pos, h1, h2) of the lines long enough to count."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.posexplode(lines_of(F.col(f"`{text_col}`"))).alias("pos", "line"))
    rows = rows.select("doc", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return rows.select("doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, gone): the positions of the lines that each document loses; documents that lose none are left out."""
    rows = stored(line_rows(docs, id_col, text_col, min_chars), "lines")
    by_doc = rows.select("doc", "h1", "h2").distinct()
    often = (by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("keeper"))
             .filter(F.col("n") >= min_docs))
    often = stored(often, "recurring")
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_KEYS > total  # so that there are fewer than HOT_KEYS of them
    marked = rows.join(F.broadcast(often.filter(hot).select("h1", "h2", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("hot"))), ["h1", "h2"], "left")
    lost = (F.col("doc").isNull() | (F.col("doc") != F.col("keeper"))) & F.col("keeper").isNotNull()
    first = marked.filter("hot").withColumn("keeper", F.col("hot_keeper")).filter(lost).select("doc", "pos")
    rest = marked.filter("hot is null").join(often.filter(~hot).select("h1", "h2", "keeper"), ["h1", "h2"]).filter(lost).select("doc", "pos")
    return first.union(rest).groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _with_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(own struct, lines, gone, kept) for every row of ``docs``."""
    gone = dropped_positions(docs, id_col, text_col, min_chars, min_docs).select(F.struct("doc").alias("key"), "gone")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("own"), F.struct(F.col(f"`{id_col}`").alias("doc")).alias("key"))
    joined = rows.join(gone, "key", "left")
    lines = lines_of(F.col("own")[text_col])
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    stay = F.array_except(every, F.col("gone"))
    text = (F.when(F.col("gone").isNull(), F.coalesce(F.col("own")[text_col], F.lit("")))
            .otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")))
    return joined.select("own", F.size(lines).cast("long").alias("n_lines"), "gone", text.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines that other documents hold as well taken out of the text; all else is as it was."""
    rows = _with_positions(docs, id_col, text_col, min_chars, min_docs)
    out = [F.col("kept").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns]
    return rows.select(*out)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
           min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``."""
    rows = _with_positions(docs.select(id_col, text_col), id_col, text_col, min_chars, min_docs)
    return rows.select(F.col("own")[id_col].alias("doc_id"), "n_lines",
                       F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
                       F.sha2(F.col("kept"), 256).alias("kept_sha256"))
