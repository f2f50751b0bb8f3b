import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskset.llm.packing import LIMIT, binary_lengths, pack, tokens, write_buckets

SCHEMA = "doc_id long, text string"
TEXTS = ["", None, "one", "Hello, world! It's 42°.", "<|endoftext|> a", "汉字 🙂 ́x", "line\n\n  two \r\n\t", "x" * 5000, "word " * 5000]


def ids_of(text):
    return tokens().full.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 6150, 100_000])
def test_binary_lengths(n):
    got = binary_lengths(n)
    assert sum(got) == n and got == sorted(got, reverse=True)
    assert all(x & (x - 1) == 0 and x <= LIMIT for x in got)
    assert len({x for x in got if x < LIMIT}) == len([x for x in got if x < LIMIT])


def test_pieces_hold_every_id_once(spark):
    rows = list(enumerate(TEXTS)) + [(2, "one"), (None, "null id")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit(1)).withColumn("length", F.lit(2)).repartition(3)
    got = pack(df).collect()
    assert len({r.sequence_id for r in got}) == len(got)  # a sequence holds one piece
    for r in got:
        assert r.length == len(r.ids) == r.bucket and r.length & (r.length - 1) == 0 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for doc, text in rows:
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        want = ids_of(text)
        times = sum(d == doc for d, _ in rows)
        assert sum(r.length for r in pieces) == times * len(want) and {r.doc_tokens for r in pieces} == {len(want)}
        assert [t for r in pieces[::times] for t in r.ids] == want


def test_both_libraries_agree_where_the_fast_one_is_used():
    rng = random.Random(6)
    alphabet = list(" \n\t abXY01.,'é’ñßæ§…—€") + ["'s", "  ", "\n\n"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 25)))
        assert tokens().encode(text).tolist() == ids_of(text)[:-1], text


def test_empty_table_options_and_buckets(spark, tmp_path):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f g")], SCHEMA)
    assert [r.length for r in pack(df, limit=4, end=None, with_ids=False).orderBy("start").collect()] == [4, 2, 1]
    with pytest.raises(ValueError):
        pack(df, limit=100)
    write_buckets(pack(df), str(tmp_path / "b"))
    assert {r.bucket for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {8}
