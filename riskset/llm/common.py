"""Helpers shared by the text operators: intermediate tables, checked broadcasts, word streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words everywhere in this package: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"

BROADCAST_ROWS = 100_000
HOT_KEYS = 1_000
SLICE_BYTES = 4_000_000
SLICE_ROWS = 2048

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a purely local session that names none gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskset-llm-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows, so that it may be broadcast. Reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted size allows; else as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, limit) else df


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and the number ``n`` of its rows.

    Keys of more than one row in ``HOT_KEYS``, of which there are fewer than that, are joined by broadcast, so that no
    task gets all rows of one; the rest by a shuffle. ``total``: the sum of ``n``, if it is known.
    """
    if total is None:
        total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.filter(F.col("n") * HOT_KEYS > total)
    rest = table.filter(F.col("n") * HOT_KEYS <= total)
    first = rows.join(F.broadcast(hot), keys)
    return first.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def left_counted(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`join_counted`, keeping rows whose key ``table`` lacks, and without ``n``."""
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.filter(F.col("n") * HOT_KEYS > total).drop("n")
    rest = table.filter(F.col("n") * HOT_KEYS <= total).drop("n")
    first = rows.join(F.broadcast(hot), keys)
    return first.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "left"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in slices of bounded text, so that arrays of a slice stay small whatever the rows' lengths."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text). Null texts have none; A-Z is lower-cased."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    code = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in code.dictionary.cast(pa.binary()).to_pylist()),
                        dtype=U64, count=len(code.dictionary))
    index = code.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0) if len(flat) else np.zeros(0, bool)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    seen = np.concatenate([[0], np.cumsum(real)])
    counts = seen[ends] - seen[ends - sizes]
    return (table[index[real]] if len(index) else np.zeros(0, U64)), counts


def task_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
