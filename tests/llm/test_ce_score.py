import math
import random

import pytest
from pyspark.sql import functions as F

from riskset.llm import ce_score
from riskset.llm.common import WS_CHARS

SCHEMA = "doc_id long, text string"


def words(text):
    out = "".join(" " if c in WS_CHARS else c for c in (text or "")).split(" ")
    return [w.lower() for w in out if w]


def brute(rows, target):
    """Losses from plain dictionaries, other documents' counts only; None for a text without words."""
    out, different = [], len({w for _, t in rows for w in words(t)})
    for k, (doc, text) in enumerate(rows):
        own = words(text)
        if not own:
            out.append((doc, None))
            continue
        losses = []
        totals = [sum(len(words(t)) for i, (d, t) in enumerate(rows) if i != k and (g == 0 or d in target)) for g in (0, 1)]
        for group, factor in ((1, 1.0), (0, totals[1] / totals[0] if totals[0] else 0.0)):
            single, before, pair = {}, {}, {}
            for i, (d, t) in enumerate(rows):
                if i != k and (group == 0 or d in target):
                    last = None
                    for w in words(t):
                        single[w] = single.get(w, 0) + factor
                        before[last] = before.get(last, 0) + factor
                        pair[last, w] = pair.get((last, w), 0) + factor
                        last = w
            loss, last = 0.0, None
            for w in own:
                p = (single.get(w, 0) + ce_score.ADD) / (totals[1] + ce_score.ADD * different)
                loss -= math.log((pair.get((last, w), 0) + ce_score.PRIOR * p) / (before.get(last, 0) + ce_score.PRIOR))
                last = w
            losses.append(loss / len(own))
        out.append((doc, losses[0] - losses[1]))
    return out


def test_scores_against_plain_counts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(7 if i % 3 else 12)], k=rng.randint(1, 60)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \t"), (53, "only here"), (53, "only here")]
    target = {i for i in range(0, 40, 3)}
    ids = spark.createDataFrame([(i,) for i in target] + [(999,), (0,), (None,)], "doc_id long")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("target", F.lit("x")).withColumn("named", F.lit(1)).repartition(3)
    got = {(r.doc_id, r.score if r.score is None else round(r.score, 9)) for r in ce_score.score(df, ids).collect()}
    assert got == {(d, s if s is None else round(s, 9)) for d, s in brute(rows, target)}


def test_text_like_the_target_scores_lower(spark):
    """Held out: documents of neither training set."""
    rng = random.Random(4)
    kinds = [[f"a{j}" for j in range(60)], [f"b{j}" for j in range(60)]]
    rows = [(i, " ".join(rng.choices(kinds[i % 2], k=30) + rng.choices(["the", "of"], k=30))) for i in range(400)]
    ids = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")
    got = {r.doc_id: r.score for r in ce_score.score(spark.createDataFrame(rows, SCHEMA), ids).collect()}
    held = range(200, 400)
    pairs = [(got[i] < got[j]) for i in held if i % 2 == 0 for j in held if j % 2]
    assert sum(pairs) / len(pairs) > 0.99


def test_no_target_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    got = ce_score.score(spark.createDataFrame([(1, "a b"), (2, "b c")], SCHEMA), none).collect()
    assert [r.score for r in got] == pytest.approx([0.0, 0.0])
    assert ce_score.score(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_many_target_ids_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ce_score, "TARGET_IDS", 1)
    rows = [(i, f"w{i % 3} w{i % 2}") for i in range(20)]
    ids = spark.createDataFrame([(i,) for i in range(0, 20, 2)], "doc_id long")
    got = {r.doc_id: round(r.score, 9) for r in ce_score.score(spark.createDataFrame(rows, SCHEMA), ids).collect()}
    assert got == {d: round(s, 9) for d, s in brute(rows, set(range(0, 20, 2)))}


def test_every_word_and_pair_has_its_own_count(spark):
    """Thousands of words and pairs: none shares a count with another."""
    rng = random.Random(5)
    vocabulary = [f"word{j}" for j in range(6000)]
    rows = [(i, " ".join(rng.choices(vocabulary[:200], k=100) + rng.choices(vocabulary, k=300))) for i in range(40)]
    target = set(range(0, 40, 2))
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    got = {r.doc_id: r.score for r in ce_score.score(spark.createDataFrame(rows, SCHEMA).repartition(3), ids).collect()}
    assert got == pytest.approx(dict(brute(rows, target)), abs=1e-9)
