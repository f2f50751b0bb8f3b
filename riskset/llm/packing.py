"""Packing by powers of two: documents cut into pieces of binary lengths, equal lengths bucketed together.

A document's token ids, with an end id after them, are cut into pieces of ``limit`` ids and then of the lengths that the
binary digits of the rest name, longest first. Every piece is a sequence of its own: it needs no padding, since its length
is a power of two, and no sequence crosses documents. ``bucket`` is the length; a trainer draws a batch from one bucket.

Defined results: a null or empty text is the end id alone, one piece of length 1. Rows repeated with one id are packed each,
in sequences of their own. An empty table gives no rows. Nothing is shuffled: the sequence number joins the task's number and a count within the task, so it
is the same when a lost task runs again. The length of a text is limited by what one task holds, its ids (4 bytes each).
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import text_slices

LIMIT = 2048
END = 1
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

_PIECES = ("start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket long")

#: characters for which both tokenizer libraries cut words alike (tested one by one): up to Latin Extended-B and the
#: usual punctuation and signs
_SAME = re.compile("[\\t\\n\\r -~ -ɏ‐-‧‰-⁞₠-₿™]*")


class Tokens:
    """Token ids of texts by the vocabulary file ``name``.

    With ``ranks``, the same vocabulary as ranks for the faster library, it encodes the texts that both libraries cut
    alike. Others, and texts with a special token's string, are left to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and _SAME.fullmatch(text) and not (self.special and self.special.search(text)):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=4)
def tokens(name: str = TOKENIZER, ranks: str | None = RANKS) -> Tokens:
    """The tokenizer, read once in a worker. Names are those of the installed public vocabularies, or paths."""
    import os

    import public_tokenizers

    def place(x: str) -> str:
        return x if os.path.sep in x else public_tokenizers.path(x)

    return Tokens(place(name), place(ranks) if ranks else None)


def binary_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """``n`` as lengths: as many of ``limit`` as fit, then the powers of two of the rest, falling."""
    out = [limit] * (n // limit)
    rest, power = n % limit, limit
    while rest:
        power >>= 1
        if rest >= power:
            out.append(power)
            rest -= power
    return out


def _pack(limit: int, end: int | None, name: str, ranks: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, count = tokens(name, ranks), TaskContext.get().partitionId(), 0
        for part in text_slices(batches):
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "total", "seq")}
            pieces = []
            for row, text in enumerate(part.column("text")):
                ids = tok.encode(text.as_py() or "")
                if end is not None:
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                at = 0
                for n in binary_lengths(len(ids), limit):
                    piece = ids[at:at + n]
                    out["row"].append(row)
                    out["start"].append(at)
                    out["length"].append(n)
                    out["crc"].append(zlib.crc32(piece.tobytes()))
                    out["total"].append(len(ids))
                    out["seq"].append((task << 36) + count)
                    if with_ids:
                        pieces.append(piece)
                    count += 1
                    at += n
            n = len(out["row"])
            length = np.array(out["length"], dtype=np.int64)
            if with_ids:
                flat = np.concatenate(pieces).astype(np.int32) if pieces else np.zeros(0, np.int32)
                ids_column = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), pa.array(flat))
            else:
                ids_column = pa.nulls(n, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(out["row"], pa.int64())), pa.array(out["start"], pa.int64()), pa.array(length), ids_column,
                 pa.array(out["crc"], pa.int64()), pa.array(out["total"], pa.int64()), pa.array(out["seq"], pa.int64()),
                 pa.array(np.zeros(n, np.int64)), pa.array(length)],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end: int | None = END,
         tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = True) -> DataFrame:
    """A row for every piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    ``limit`` is a power of two. ``with_ids=False`` leaves ``ids`` null where only the layout is wanted.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, {_PIECES}"
    return rows.mapInArrow(_pack(limit, end, tokenizer, ranks, with_ids), schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as a table with a folder for every length, from which batches of one length are read."""
    pieces.write.partitionBy("bucket").parquet(path)
