"""Ranked lexical search of a set of items in all documents, without an index of the documents.

The items are the stated query set. Their distinct terms become one Aho-Corasick automaton for each block of items, sent to
the tasks; a pattern is the term between two guards, and a text is scanned with every separator as a guard, so that only
whole terms count. One scan counts documents, terms and every term's documents. A second scan takes each document's
term counts from the automaton, maps them to the items that hold the terms, adds up the scores, and keeps the best ``TOP`` of
each item within the task; those rows alone are shuffled, and the best of them are the result.

Terms are runs of ASCII letters (A-Z lower-cased), digits and all characters from U+0080 on.

Score: with N the documents that have a term, L all their terms, n a document's terms, df a term's documents and tf its places in
the document, w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 100 - 25 + (25 n N) div L, and the sum over the item's terms, repeats
included, of w * ((1000000000 tf) div (1000 tf + 12 m)), in 64-bit integers.

Items are read by blocks of about ``BLOCK_ITEMS`` items or ``BLOCK_CHARS`` characters, so that what a task holds does not grow with
their number; every block scans the documents anew. A task holds ``TOP`` documents for each item of a block besides one slice of texts.

Defined results: a null, empty or termless text has no terms, counts nowhere and is not found. Every row of ``docs`` is a
document, also where ids repeat; a null id comes after all others on ties. Several texts under one item id are one item with
all their terms, and an item's repeated rows are one. An item without terms, or whose terms no document has, has no rows.
Items with a null id are an item. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskset.llm.common import stored, text_slices

TOP = 20
BLOCK_ITEMS = 2_000
BLOCK_CHARS = 4_000_000
SCORED_ROWS = 256  #: documents scored at once
SCORED_CELLS = 4_000_000  #: document and item-term pairs scored at once
NO_ID = np.iinfo(np.int64).max
_DOCS, _TERMS = -1, -2  #: numbers of the rows that count documents and terms

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_IS_TERM = np.array([_TERM[b] != 32 for b in range(256)])


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def _spelt(term: bytes) -> str:
    return f" {term.decode('latin-1')} "  # a character for each byte


@lru_cache(maxsize=1)
def automaton(terms: tuple[bytes, ...]) -> ahocorasick.Automaton:
    """Finds every whole term; its output is the term's number."""
    auto = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        auto.add_word(_spelt(term), k)
    auto.make_automaton()
    return auto


def counts(texts: pa.Array, terms: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, text, term number, places): the last three for each text and term that it holds, sorted."""
    raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(x) + 1 for x in raw], dtype=np.int64)  # the guard after each text
    joined = b" " + b" ".join(raw).translate(_TERM) + b" "
    inside = _IS_TERM[np.frombuffer(joined, np.uint8)]
    begins = np.flatnonzero(inside[1:] & ~inside[:-1])
    n = np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(raw))
    if not terms:
        return n, *[np.zeros(0, np.int64)] * 3
    hits = np.fromiter(chain.from_iterable(automaton(terms).iter(joined.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
    key = np.searchsorted(ends, hits[:, 0] - 1, side="left") * len(terms) + hits[:, 1]
    key, places = np.unique(key, return_counts=True)
    return n, key // len(terms), key % len(terms), places


def _statistics(terms: tuple[bytes, ...]):
    """A row (number, count) for each term's documents, one for the documents with terms and one for all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        df = np.zeros(len(terms), np.int64)
        for part in text_slices(batches):
            n, _, term, _ = counts(part.column("text"), terms)
            docs += int((n > 0).sum())
            total += int(n.sum())
            df += np.bincount(term, minlength=len(terms))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [_DOCS, _TERMS]])), pa.array(np.concatenate([df[held], [docs, total]]))],
                                         ["number", "count"])

    return run


class Best:
    """The best documents of each item so far, by falling score, then rising id."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = np.zeros((items, top), np.int64)
        self.doc = np.full((items, top), NO_ID)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: a row for each document, a column for each item."""
        worst, last = self.score[:, -1], self.doc[:, -1]
        better = (scores > worst) | ((scores == worst) & (scores > 0) & (docs[:, None] < last))
        for k in np.flatnonzero(better.any(axis=0)).tolist():
            rows = better[:, k]
            score = np.concatenate([self.score[k], scores[rows, k]])
            doc = np.concatenate([self.doc[k], docs[rows]])
            order = np.lexsort((doc, -score))[: self.top]
            self.score[k], self.doc[k] = score[order], doc[order]


def _scored(terms: tuple[bytes, ...], lists: list[list[int]], weights: list[int], n_docs: int, n_terms: int, top: int):
    """Rows (item, doc_id, score): the task's best documents for each item. ``lists``: the term numbers of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(lists), top)
        flat = np.array([t for x in lists for t in x], np.int64)
        begins = np.cumsum([0] + [len(x) for x in lists[:-1]])
        w = np.array(weights, np.int64)
        step = max(1, min(SCORED_ROWS, SCORED_CELLS // max(1, len(flat)), SCORED_CELLS // max(1, len(terms))))
        for part in text_slices(batches):
            n, text, term, tf = counts(part.column("text"), terms)
            ids = part.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            m = 100 - 25 + (25 * n.astype(np.int64) * n_docs) // max(1, n_terms)
            worth = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[text]))
            for at in range(0, len(n), step):
                lo, hi = np.searchsorted(text, [at, at + step])
                if lo == hi:
                    continue
                rows = np.zeros((min(step, len(n) - at), len(terms)), np.int64)
                rows[text[lo:hi] - at, term[lo:hi]] = worth[lo:hi]
                best.add(ids[at:at + step], np.add.reduceat(rows[:, flat], begins, axis=1))
        item, place = np.nonzero(best.score > 0)
        doc = best.doc[item, place]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == NO_ID), pa.array(best.score[item, place])],
                                         ["item", "doc_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, ranked from 1."""
    spark = docs.sparkSession
    wanted = stored(items.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).distinct(), "items")
    size, chars = wanted.agg(F.count_distinct(F.struct("item_id")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(items.dtypes)[item_col]
    found = None
    for block in range(blocks):
        block_rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        held: dict = {}
        for r in block_rows:
            held.setdefault(r.item_id, []).extend(terms_of(r.text))
        names = [x for x, ts in held.items() if ts]
        terms = tuple(sorted({t for x in names for t in held[x]}))
        if not terms:
            continue
        number = {t: k for k, t in enumerate(terms)}
        counted = rows.mapInArrow(_statistics(terms), "number long, count long").groupBy("number").agg(F.sum("count").alias("count"))
        df = {r.number: r["count"] for r in counted.collect()}
        n_docs, n_terms = df.get(_DOCS, 0), df.get(_TERMS, 0)
        weights = [weight(n_docs, df.get(k, 0)) for k in range(len(terms))]
        lists = [[number[t] for t in held[x]] for x in names]
        near = rows.mapInArrow(_scored(terms, lists, weights, n_docs, n_terms, top), "item long, doc_id long, score long")
        ids = spark.createDataFrame([(k, x) for k, x in enumerate(names)], f"item long, item_id {kind}")
        near = near.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")
        found = near if found is None else found.union(near)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
