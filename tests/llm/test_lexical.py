import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from riskset.llm import lexical
from riskset.llm.lexical import counts, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    held = [(i, Counter(ts), len(ts)) for i, ts in ((i, plain_terms(t)) for i, t in docs)]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    of = {}
    for i, t in sorted(set(items), key=str):
        of.setdefault(i, []).extend(plain_terms(t))
    out = []
    for item, terms in of.items():
        scores = []
        for doc, c, n in held:
            m = 75 + (25 * n * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if gone else doc, -s) for k, (s, gone, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["É", "été", "x1", "CAPS", "a", "aa"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    return [(i, "".join(w + rng.choice([" ", "-", ". ", "\n", "\x7f", "_"]) for w in rng.choices(vocab, weights, k=rng.randint(0, 60)))) for i in range(n)], vocab, rng


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    for t in ["Ab-c1\x00d\x7fÉé’x", "", None, "a\xa0b", "🙂x y", "A_Z[z]{q}@9:8/7"]:
        assert [w.decode() for w in terms_of(t)] == plain_terms(t)


def test_whole_terms_are_counted_and_parts_are_not():
    texts = ["a aa a a-aa", None, "", "aaa", "A.a", "aa"]
    n, text, term, tf = counts(pa.array(texts), (b"a", b"aa"))
    assert n.tolist() == [5, 0, 0, 1, 2, 1]
    assert list(zip(text.tolist(), term.tolist(), tf.tolist())) == [(0, 0, 3), (0, 1, 2), (4, 0, 2), (5, 1, 1)]


def test_ranks_against_brute_force(spark):
    docs, vocab, rng = corpus(1, 400)
    docs += [(500, None), (501, ""), (502, "--"), (503, "w1 " * 50_000), (None, "w1 w2 été"), (None, "w1 w2 été"), (3, docs[3][1]), (504, docs[9][1]), (505, docs[9][1])]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 25)))) for i in range(30)]
    items += [items[4], (5, "extra w3"), (90, None), (91, ""), (92, "nowhere"), (None, "w7 w7 été"), (93, "É CAPS w1")]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1)).withColumn("score", F.lit("s")).withColumn("rank", F.lit(0)).repartition(5)
    asked = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(2))
    assert got(search(df, asked)) == brute(docs, items)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same text here") for i in range(200)] + [(i, "other") for i in range(200, 900)]
    random.Random(2).shuffle(docs)
    rows = got(search(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame([(1, "text"), (2, "other same")], ITEMS)))
    assert rows == brute(docs, [(1, "text"), (2, "other same")])
    assert [r[2] for r in sorted(rows)[:20]] == list(range(20))


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(lexical, "SCORED_CELLS", 500)
    docs, vocab, rng = corpus(3, 120)
    items = [(i, " ".join(rng.choices(vocab, k=9))) for i in range(25)]
    assert got(search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert got(search(docs, items)) == []
    assert got(search(spark.createDataFrame([(1, "a")], DOCS), items.limit(0))) == []
