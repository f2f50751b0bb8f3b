"""The pipeline against the stages written out plainly, and its contract."""

import importlib

import pytest
from pyspark.sql import functions as F

from riskset.llm.packing import tokens
from tests.llm.test_near_dup import brute_classes, corpus
from tests.llm.test_quality_mix_lines import SCHEMA, brute_lines, brute_mix, brute_quality

pipeline = importlib.import_module("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    texts = [t for _, t in corpus(seed=11, groups=30)]
    rows = [(i, t + "\nShared closing line of the site", "en", ["src0", "src0", "src1", None][i % 4], len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", "src0", 0), (902, "a b " * 60, "en", "src0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()

    judged = brute_quality(rows, 20, 0.05)
    left = [(r[0], t, *r[2:]) for r, (w, t) in zip(rows, judged) if w[-1]]
    left = [(d, t, *r[2:]) for r, (d, _, _, t) in zip(left, brute_lines(left))]
    classes = brute_classes([(r[0], r[1]) for r in left])
    left = [r for r in left if classes[r[0]] == r[0]]
    size, target = brute_mix(left)
    sources = {r[0]: r[3] for r in left}
    ids = {r[0]: tokens().full.encode(r[1], add_special_tokens=False).ids + [1] for r in left}
    copies = {}
    for r in out:
        assert ids[r.doc_id][r.start:r.start + r.length] == r.ids
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.length
    for doc, n in copies.items():
        rate = min(3.0, target[sources[doc]] / size[sources[doc]])
        assert n % len(ids[doc]) == 0 and n // len(ids[doc]) in (int(rate), int(rate) + 1)
    assert {d for d in ids if target[sources[d]] >= size[sources[d]]} <= set(copies)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "some words " * 3 + " ".join(f"w{i}" for i in range(80)), "en", "s", 0)], SCHEMA).withColumn("extra", F.lit(1))
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "packing"]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.first().doc_id == 1


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_lists_all_queries_and_lives_without_the_package(monkeypatch):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    monkeypatch.setattr(entry, "HAS_LLM", False)
    monkeypatch.setattr(entry, "HAS_PIPELINE", False)
    assert not [n for n in entry.queries() if n.startswith("op1_")] and "pipeline" not in entry.queries()


@pytest.mark.parametrize("n", [2, 4, 5, 6, 7, 10])
def test_queries_return_a_row_for_each_row(spark, n):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    name = next(q for q in entry.queries() if q.startswith(f"op{n}_"))
    out = entry.queries()[name](spark, sf)
    if n == 6:
        assert out.groupBy("query_id").count().filter("count <> 5").count() == 0
        return
    key, of = ("page_id", "pages") if n == 2 else ("doc_id", "documents")
    assert out.select(key).distinct().count() == spark.read.parquet(f"{sf}/{of}.parquet").count()
