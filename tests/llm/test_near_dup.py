"""Near duplicates against all pairs by brute force, and the signatures' claims."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskset.llm import near_dup
from riskset.llm.bagminhash import REGISTERS, signatures
from riskset.llm.components import components
from riskset.llm.shingles import bags, overlap


def bag(text, n=5):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_classes(rows, limit=0.8):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, bag(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            either = sum((a | b).values())
            if sum((a & b).values()) >= limit * either - 1e-9:  # texts without words are equal
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def corpus(seed=1, groups=25, size=6, words=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocab, k=60))
    out = []
    for g in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 8, 40, words, 4 * words]))
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            out.append(" ".join(text) + (" " + passage if g % 5 == 0 else ""))
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def test_bags_and_overlap_against_counters():
    texts = ["a b c d e f a b c d e f a b c d e", "A b  c\td\ne", "one two", "", None, " \n ", "a b c d e f a b c d e x"]
    got = bags(pa.array(texts))
    assert [int(c.sum()) for _, c in got] == [sum(bag(t).values()) for t in texts]
    assert [len(h) for h, _ in got] == [len(bag(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = bag(a), bag(b)
            assert overlap(got[i], got[j]) == (sum((x & y).values()), sum((x | y).values()))


def test_signatures_are_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(5)
    gaps = []
    for _ in range(80):
        h = rng.integers(1, 2 ** 62, 200).astype(np.uint64)
        a = rng.integers(0, 9, 200)
        b = np.where(rng.random(200) < 0.6, a, rng.integers(0, 70, 200))
        sig = signatures(np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]).astype(float),
                         np.array([(a > 0).sum(), (b > 0).sum()]))
        gaps.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 4 * 0.044 / np.sqrt(len(gaps))
    assert np.std(gaps) < 0.06


def test_signature_depends_on_the_multiset_only():
    h = np.array([5, 9, 1 << 40], dtype=np.uint64)
    w = np.array([1.0, 7.0, 300.0])
    both = signatures(np.concatenate([h, h[::-1]]), np.concatenate([w, w[::-1]]), np.array([3, 3, 0]))
    assert (both[0] == both[1]).all()
    assert np.isinf(both[2].view(np.float64)).all() and both.shape == (3, REGISTERS)


def test_classes_against_all_pairs(spark):
    rows = corpus()
    got = near_dup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_divided_buckets_lose_nothing(spark, monkeypatch):
    """With parts of 8 members every large group is dealt to several tasks and put together again."""
    monkeypatch.setattr(near_dup, "CHUNK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, f"other{i} " * 3 + " ".join(rng.sample(base, 30))) for i in range(10)]
    got = near_dup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_links_of_followers_across_parts(spark, monkeypatch):
    """Every y is like its x only, and every x follows a leader that y is not like."""
    monkeypatch.setattr(near_dup, "CHUNK", 8)
    base = [f"w{i}" for i in range(300)]

    def changed(places, mark):
        return " ".join(f"{mark}{i}" if i in places else w for i, w in enumerate(base))

    rows = [(i, changed({299}, f"copy{i}-")) for i in range(200)]
    for k in range(10):
        at = [10 + 6 * k + 30 * j for j in range(7)]
        x = changed(at[:2], f"x{k}-")
        y = " ".join(f"y{k}-{i}" if i in at[2:] else w for i, w in enumerate(x.split()))
        rows += [(1000 + k, x), (2000 + k, y)]
    want = brute_classes(rows)
    assert set(want.values()) == {0}
    got = near_dup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_refuted_pairs_are_no_rows(spark, monkeypatch):
    """Texts that are all just below the limit to each other: rows sent grow with members times blocks, and no link comes out."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    sent = {}

    def counted(df, name, keep=near_dup.stored):
        out = keep(df, name)
        sent[name] = sent.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dup, "stored", counted)
    monkeypatch.setattr(near_dup, "CHUNK", 100)
    rows = []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(8), 5):  # about eleven changes in a hundred words, so that a pair is at 0.7 to 0.8
            text[50 * at + rng.randrange(45)] = f"x{i}-{at}"
        rows.append((i, " ".join(text)))
    got = near_dup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    bands = sent["open"] / 300
    assert sent["joined"] < 300 and sent["open"] <= 300 * near_dup.BANDS and bands > 1
    assert "pairs" not in sent or sent["pairs"] <= 300 * near_dup.BANDS * near_dup.BEST


def test_many_components_in_tiles_of_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK_SHINGLES", 900)
    rows = corpus(seed=4, groups=12, size=9)
    got = near_dup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    rows = [(4, None, 1), (2, "", 2), (7, " \n", 3), (9, "alpha beta", 4), (3, "ALPHA beta", 5), (3, "ALPHA beta", 5), (None, "alpha beta", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int").withColumn("weight", F.lit("x")).withColumn("root", F.lit(0))
    got = sorted(((r.doc_id, r.class_id) for r in near_dup.duplicate_classes(df).collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (7, 2), (9, 3), (3, 3), (3, 3), (None, None)], key=str)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, ""), (3, "ALPHA beta"), (None, "alpha beta")], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.duplicate_classes(df).collect() == []
    assert near_dup.keep_one(df).collect() == []
    with pytest.raises(ValueError):
        near_dup.duplicate_classes(df, similarity=0.3)


def test_one_very_long_text(spark):
    text = " ".join(str(i % 977) for i in range(300_000))
    rows = [(1, text), (2, text + " end"), (3, "short text")]
    got = near_dup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (3, 2)]
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(200, 260)}
