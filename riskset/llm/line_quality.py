"""Quality rules: base counts of a text, and lines that recur across a host's documents.

Lines are normalised (white space squeezed, A-Z lower-cased), hashed, and counted over the distinct documents of each
host; exact copies of a text count as one document. Lines on more than ``MAX_DOCS`` documents are boilerplate where they
are on more than ``MAX_SHARE`` of the host's, and lines on more than ``MANY_DOCS`` whatever the host's size; they are removed; a document that loses more than ``DEPLETED`` of its words is rejected, and
so is one that fails the base rules (fewer than 50 words, or over half its words inside repeated three-word windows).
The host is the document's ``source``.

Defined results: a null or empty text has no words and fails. Rows repeated with one id are judged each. A null source
is a host of its own. An empty table gives no rows.

Very long texts are read whole, in slices of their own. Counting goes over (host, line, document) first, so that a line on a
third of the rows is summed in parts. Each text gets the boilerplate lines that it holds and no others, so that no row grows
with its host; frequent lines and texts with many copies are joined by broadcast, the rest by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import WS_CHARS, join_counted, left_counted, stored, text_slices

MAX_DOCS = 20
MAX_SHARE = 0.05
MANY_DOCS = 200
DEPLETED = 0.5
MIN_WORDS = 50
MAX_REPEAT = 50  #: percent of words in repeated windows
SYMBOLS = "#*$%&|<>"
BROADCAST_LINES = 200_000  #: places of boilerplate lines in texts that are broadcast at most

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside, until = 0, 0  # words before ``until`` are counted
    for i, w in enumerate(windows):
        if w in often:
            inside += i + 3 - max(i, until)
            until = i + 3
    return inside


def measure(text: str | None) -> tuple[tuple[int, ...], list[int], list[int]]:
    """(the base counts, a hash for each line with a word else 0, the number of words of each line)."""
    text = text or ""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    split = [x.split() for x in lines]  # bytes are split at U+0020 and U+0009 to U+000D only
    counts = [len(x) for x in split]
    words = [w for x in split for w in x]
    hashes = [xxhash.xxh3_64_intdigest(b" ".join(x).lower()) if x else 0 for x in split]
    worded = [x for x, n in zip(lines, counts) if n]
    base = (len(words), len(text) - sum(text.count(c) for c in WS_CHARS), sum(text.count(c) for c in SYMBOLS),
            len(worded) - len(set(worded)), _repeat_words(words))
    return base, hashes, counts


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT * n_words


def _signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, dtype=np.uint64).view(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        base, offsets, hashes, counts = [], [0], [], []
        for text in part.column("text"):
            text = text.as_py() or ""
            b, h, c = measure(text)
            base.append(b)
            hashes += h
            counts += c
            offsets.append(len(hashes))
        ends = pa.array(offsets, pa.int32())
        columns = [pa.array([b[i] for b in base], pa.int64()) for i in range(len(_BASE))]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("host"), *columns, part.column("same"),
             pa.ListArray.from_arrays(ends, pa.array(_signed(hashes))), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))],
            ["doc_id", "host", *_BASE, "same", "hashes", "counts"])


def _kept_words(hashes: np.ndarray, counts: np.ndarray, boilerplate: np.ndarray) -> tuple[np.ndarray, int]:
    """(which lines stay, their words)."""
    stay = ~np.isin(hashes, boilerplate)
    return stay, int(counts[stay].sum())


def _depleted(left: int, n_words: int) -> bool:
    return left < (1 - DEPLETED) * n_words


def _verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        failed, kept, boiler = [], [], []
        words, repeats = batch.column("n_words").to_pylist(), batch.column("n_repeat_words").to_pylist()
        for n, r, h, c, often in zip(words, repeats, batch.column("hashes"), batch.column("counts"), batch.column("often")):
            gone = often.values.to_numpy(zero_copy_only=False) if often.is_valid else np.zeros(0, np.int64)
            left = _kept_words(h.values.to_numpy(zero_copy_only=False), c.values.to_numpy(zero_copy_only=False), gone)[1]
            failed.append(base_failed(n, r))
            kept.append(not failed[-1] and not _depleted(left, n))
            boiler.append(n - left)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[batch.column(c) for c in _BASE], pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(boiler, pa.int64())],
            ["doc_id", *_BASE, "base_failed", "kept", "boilerplate_words"])


def _hash_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), text.alias("text"), _hash_of(text).alias("same"))
    schema = (f"doc_id {dict(docs.dtypes)[id_col]}, host string, {', '.join(f'{c} long' for c in _BASE)}, "
              "same long, hashes array<long>, counts array<int>")
    return stored(rows.mapInArrow(_measure, schema), "measured")


def boilerplate(measured: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """(key, often, n): for every text with boilerplate lines, by a struct of its host and hash, those lines and its copies."""
    lines = stored(measured.select("host", "same", F.explode(F.array_distinct("hashes")).alias("line")).filter("line <> 0").distinct(), "lines")
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    totals = measured.select("host", "same").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    many = counted.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    many = many.filter((F.col("n") > max_share * F.col("docs")) | (F.col("n") > many_docs))
    often = stored(many.select(F.struct("host", "line").alias("key"), "n"), "boilerplate")
    places = join_counted(lines.withColumn("key", F.struct("host", "line")), often, ["key"])
    held = places.groupBy(F.struct("host", "same").alias("key")).agg(F.collect_set("line").alias("often"))
    copies = measured.groupBy(F.struct("host", "same").alias("key")).agg(F.count("*").alias("n"))
    return stored(held.join(copies, "key"), "held")


def _with_boilerplate(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` with the array ``often`` of the boilerplate lines that the text holds, or null; they have the struct ``key``."""
    size = held.agg(F.coalesce(F.sum(F.size("often")), F.lit(0))).first()[0]
    if size <= BROADCAST_LINES:
        return rows.join(F.broadcast(held.drop("n")), "key", "left")
    return left_counted(rows, held, ["key"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS,
          max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, boilerplate_words) for every row of ``docs``."""
    measured = _measured(docs, id_col, text_col, host_col)
    held = boilerplate(measured, max_docs, max_share, many_docs)
    joined = _with_boilerplate(measured.withColumn("key", F.struct("host", "same")), held)
    schema = (f"doc_id {dict(docs.dtypes)[id_col]}, {', '.join(f'{c} long' for c in _BASE)}, base_failed boolean, kept boolean, "
              "boilerplate_words long")
    return joined.select("doc_id", *_BASE, "hashes", "counts", "often").mapInArrow(_verdict, schema)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        rows, texts = [], []
        for i, (text, often) in enumerate(zip(part.column("text"), part.column("often"))):
            text = text.as_py()
            base, hashes, counts = measure(text)
            if base_failed(base[0], base[4]):
                continue
            gone = often.values.to_numpy(zero_copy_only=False) if often.is_valid else np.zeros(0, np.int64)
            stay, left = _kept_words(_signed(hashes), np.array(counts), gone)
            if _depleted(left, base[0]):
                continue
            rows.append(i)
            texts.append(text if stay.all() else "\n".join(x for x, s in zip(text.split("\n"), stay.tolist()) if s))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("own").take(at), pa.array(texts, pa.string())], ["own", "kept_text"])


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS,
              max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """``docs`` without the rejected documents and without boilerplate lines in the others' texts."""
    held = boilerplate(_measured(docs, id_col, text_col, host_col), max_docs, max_share, many_docs)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("own"), F.col(f"`{text_col}`").alias("text"),
                       F.struct(F.col(f"`{host_col}`").cast("string").alias("host"), _hash_of(F.col(f"`{text_col}`")).alias("same")).alias("key"))
    joined = _with_boilerplate(rows, held).select("own", "text", "often")
    own = joined.schema["own"].dataType.simpleString()
    out = joined.mapInArrow(_clean, f"own {own}, kept_text string")
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])
