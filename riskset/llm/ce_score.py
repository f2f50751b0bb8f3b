"""Cross-entropy difference of documents under matched target and background language models.

Both models are bigram models over the same words (A-Z lower-cased). The background counts every document of the corpus,
the target those named; the background's counts are scaled to the target's total, and both are smoothed alike, so that the
models differ by what they have seen only:

    p(w) = (c(w) + ADD) / (n + ADD * words),   p(w | v) = (c(v w) + PRIOR * p(w)) / (c(v) + PRIOR)

where ``words`` is the number of different words of the corpus. A document's score is the
mean over its words of target loss minus background loss (natural logarithms); the lower, the more it reads like the
target. Its own words are taken out of the counts first, out of the target's too if it belongs to it, so that no document
is scored by a model that has seen it.

Every word and word pair has its own count, by its 64-bit hash; the counts grow with the corpus and are never in one place:

1. Texts are cut into slices of bounded size, stored as numbers of the slice's own words.
2. Each slice sends its different words and pairs with their counts in it to buckets by hash, one row for each slice and
   bucket. A bucket adds up its keys and answers each slice with the sums. So a pair that is on every row comes once
   from each slice, and the number of buckets follows the words of the corpus.
3. The answers meet their slice, where each document is scored.

Only the totals and the number of different words pass the driver. Texts are not shuffled, save by their id if the
target's ids are too many for a broadcast; the slices are, as numbers.

Defined results: a null, empty or blank text has no words and a null score. Rows repeated with one id are counted and scored
each. With no target documents both models are even and scores 0; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import U64, hinted, mix, stored, text_slices, word_hashes

ADD = 0.1
PRIOR = 20.0
TARGET_IDS = 500_000  #: ids of target documents that are broadcast at most
BUCKETS = 64  #: at least
BUCKET_KEYS = 2_000_000  #: words of the corpus for each bucket of keys, which one task adds up in memory
_START = U64(0x27220A95FE1D83B5)
_FACTOR = U64(0x9FB21C651E98DF25)
_SINGLE, _PAIR = 0, 1  #: kinds of keys

_SLICE = "words binary, vocabulary binary, sizes binary, target binary, n_words long, n_target long, n_docs long, n_target_docs long"
_ASKED = "slice long, kind int, bucket long, keys binary, counts binary"
_ANSWER = "slice long, kind int, bucket long, counts binary, distinct long"


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of bytes, without the upper planes that are zero; they compress well."""
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 0
    return bytes([planes]) + x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:planes].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw[0]:
        return np.zeros(0, U64)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.view("<u8").ravel()


def _packed_sorted(keys: np.ndarray) -> bytes:
    return keys[:1].astype("<u8").tobytes() + _packed(np.diff(keys)) if len(keys) else b""


def _unpacked_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1), _unpacked(raw[8:])]), dtype=U64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        hashes, sizes = word_hashes(part.column("text"))
        target = part.column("target").to_numpy(zero_copy_only=False).astype(bool)
        vocabulary, words = np.unique(hashes, return_inverse=True)
        ids = part.column("doc_id")
        row = {"slice": [uuid.uuid4().int >> 65], "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
               "words": [_packed(words)], "vocabulary": [_packed_sorted(vocabulary)], "sizes": [_packed(sizes)], "target": [_packed(target)],
               "n_words": [int(sizes.sum())], "n_target": [int(sizes[target].sum())], "n_docs": [int((sizes > 0).sum())],
               "n_target_docs": [int((sizes[target] > 0).sum())]}
        yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in row.values()], list(row))


class _Slice:
    """A slice's words in order, and its different words and pairs in order of their keys."""

    def __init__(self, words: bytes, vocabulary: bytes, sizes: bytes, target: bytes):
        self.sizes = _unpacked(sizes).astype(np.int64)
        self.target = _unpacked(target).astype(bool)
        self.vocabulary = _unpacked_sorted(vocabulary)
        self.word = _unpacked(words).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.n = len(self.vocabulary)  # as a word before: the start of a text
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = self.n
        codes, pair = np.unique(self.before * (self.n + 1) + self.word, return_inverse=True)
        before, word = np.divmod(codes, self.n + 1)
        keys = mix(np.append(self.vocabulary, _START)[before] * _FACTOR + np.append(self.vocabulary, _START)[word])
        order = np.argsort(keys, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pairs, self.pair = keys[order], place[pair]


def _ask(buckets: int):
    """Rows (slice, kind, bucket, keys, counts); the counts are those in the background, then in the target."""
    edges = np.array([-(-(i << 64) // buckets) for i in range(1, buckets)], dtype=U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *raw in zip(*(batch.column(c).to_pylist() for c in ("slice", "words", "vocabulary", "sizes", "target"))):
                s = _Slice(*raw)
                inside = s.target[s.doc]
                count = lambda x, n: [np.bincount(x, minlength=n)[:n], np.bincount(x[inside], minlength=n)[:n]]
                rows: list[tuple] = []
                for kind, keys, counts in ((_SINGLE, s.vocabulary, count(s.word, s.n) + count(s.before, s.n)),
                                           (_PAIR, s.pairs, count(s.pair, len(s.pairs)))):
                    ends = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).tolist()
                    rows += [(name, kind, b, _packed_sorted(keys[i:j]), _packed(np.concatenate([c[i:j] for c in counts])))
                             for b, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _types(_ASKED))] if rows else [pa.array([], t) for t in _types(_ASKED)],
                                                 [c.split()[0] for c in _ASKED.split(", ")])

    return run


def _types(schema: str) -> list[pa.DataType]:
    return [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]


def _answered(key: tuple[int, int], names: list[str], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """A bucket's sums, a row for each slice in the order of its keys; the first also has the number of different keys."""
    different, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(back, weights=c).astype(np.int64)[back] for c in np.concatenate(counts, axis=1)]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    answers = [_packed(np.concatenate(c)) for c in zip(*(np.split(x, ends) for x in sums))]
    n = len(names)
    columns = [names, [key[0]] * n, [key[1]] * n, answers, [len(different)] + [0] * (n - 1)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _types(_ANSWER))], [c.split()[0] for c in _ANSWER.split(", ")])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (kind, bucket)."""
    held, names, keys, counts = None, [], [], []
    for batch in batches:
        for name, kind, bucket, raw, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "kind", "bucket", "keys", "counts"))):
            if (kind, bucket) != held:
                if names:
                    yield _answered(held, names, keys, counts)
                held, names, keys, counts = (kind, bucket), [], [], []
            names.append(name)
            keys.append(_unpacked_sorted(raw))
            counts.append(_unpacked(n).reshape(4 if kind == _SINGLE else 2, -1).astype(np.uint32))
    if names:
        yield _answered(held, names, keys, counts)


def _own(doc: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """How often each word's number is in its document."""
    _, back, n = np.unique(doc * size + numbers, return_inverse=True, return_counts=True)
    return n[back]


def losses(s: _Slice, single: np.ndarray, pair: np.ndarray, totals: dict[str, int], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean target loss, mean background loss) of every document by the counts of all others; NaN without words.

    ``single`` has the rows word and word before in the background, in the target and ``pair`` likewise.
    """
    own = [_own(s.doc, s.word, s.n + 1), _own(s.doc, s.before, s.n + 1), _own(s.doc, s.pair, len(s.pairs) + 1)]
    background_n = (totals["n_words"] - s.sizes).astype(np.float64)
    target_n = (totals["n_target"] - s.sizes * s.target).astype(np.float64)
    scale = np.divide(target_n, background_n, out=np.zeros(len(s.sizes)), where=background_n > 0)
    out = []
    for row, starts, minus, factor in ((1, totals["n_target_docs"], s.target.astype(np.int64), np.ones(len(s.sizes))),
                                       (0, totals["n_docs"], np.ones(len(s.sizes), np.int64), scale)):
        tables = (single[row], np.append(single[2 + row], starts), pair[row])
        c = [(table[numbers] - minus[s.doc] * n) * factor[s.doc] for table, numbers, n in zip(tables, (s.word, s.before, s.pair), own)]
        p = (c[0] + ADD) / (target_n[s.doc] + ADD * words)
        loss = -np.log((c[2] + PRIOR * p) / (c[1] + PRIOR))
        sums = np.bincount(s.doc, weights=loss, minlength=len(s.sizes))
        out.append(np.divide(sums, s.sizes, out=np.full(len(s.sizes), np.nan), where=s.sizes > 0))
    return out[0], out[1]


def _score(totals: dict[str, int], words: int):
    """Streams rows sorted by (slice, kind, bucket): first the slice (kind -1), then its answers."""

    def scored(ids: pa.Array, s: _Slice, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
        tables = [np.concatenate(a, axis=1) if a else np.zeros((r, 0), np.int64) for a, r in zip(answers, (4, 2))]
        if tables[0].shape[1] != s.n or tables[1].shape[1] != len(s.pairs):
            raise RuntimeError("a slice must get a count for every word and pair")
        target, background = losses(s, *tables, totals, words)
        return pa.RecordBatch.from_arrays([ids, pa.array(s.sizes), *[pa.array(x, pa.float64(), from_pandas=True) for x in (target, background, target - background)]],
                                          ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, answers = None, None, [[], []]
        for batch in batches:
            raw = [batch.column(c).to_pylist() for c in ("kind", "words", "vocabulary", "sizes", "target", "counts")]
            for i, (kind, *of_slice, counts) in enumerate(zip(*raw)):
                if kind < 0:
                    if held is not None:
                        yield scored(ids, held, answers)
                    ids, held, answers = batch.column("doc_ids")[i].values, _Slice(*of_slice), [[], []]
                else:
                    answers[kind].append(_unpacked(counts).reshape(4 if kind == _SINGLE else 2, -1).astype(np.int64))
        if held is not None:
            yield scored(ids, held, answers)

    return run


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) for every row of ``docs``.

    ``target_ids`` has one column, the ids of the documents that stand for the target; others than those in ``docs`` are ignored.
    """
    id_type = dict(docs.dtypes)[id_col]
    named = target_ids.select(F.col(f"`{target_ids.columns[0]}`").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("named", F.lit(True))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = (rows.join(hinted(named, TARGET_IDS), "doc_id", "left")
            .select("doc_id", "text", F.coalesce("named", F.lit(False)).alias("target")))
    slices = stored(rows.mapInArrow(_slices, f"slice long, doc_ids array<{id_type}>, {_SLICE}"), "slices")
    sums = slices.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_target", "n_docs", "n_target_docs")]).first()
    totals = sums.asDict()
    buckets = max(BUCKETS, totals["n_words"] // BUCKET_KEYS + 1)
    asked = slices.select("slice", "words", "vocabulary", "sizes", "target").mapInArrow(_ask(buckets), _ASKED)
    answers = stored(asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_answer, _ANSWER), "answers")
    different = answers.filter(F.col("kind") == _SINGLE).agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("n")).first()["n"]
    texts = slices.select("slice", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "doc_ids", "words", "vocabulary", "sizes", "target")
    both = texts.unionByName(answers.drop("distinct"), allowMissingColumns=True)
    schema = f"doc_id {id_type}, n_words long, target_loss double, background_loss double, score double"
    return (both.repartition("slice").sortWithinPartitions("slice", "kind", "bucket")
            .mapInArrow(_score(totals, max(1, different)), schema))
