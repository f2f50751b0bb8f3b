import numpy as np
import pytest
from pyspark.sql import functions as F

from riskset.llm import vptree
from riskset.llm.vptree import Index, TopTree, Tree, nearest, unit

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k=5):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    out = []
    for q in sorted(i for i in usable if asked(i)):
        a = np.array(usable[q], np.float32).astype(float)
        scored = []
        for i, v in usable.items():
            if i != q and len(v) == len(a):
                b = np.array(v, np.float32).astype(float)
                scored.append((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def near(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: r[:2])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-12)


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit(1)).withColumn("block", F.lit(1))
    near(nearest(df, F.col("vec_id") % 50 == 0, factor=1.0, shard=100).collect(), brute(rows, lambda i: i % 50 == 0))


def test_many_batches_of_queries(spark):
    """A part's tree and its queries may begin and end in different batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = np.random.default_rng(2)
        rows = [(int(i), rng.normal(size=4).tolist()) for i in range(200)]
        near(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, factor=1.0, shard=60).collect(), brute(rows, lambda i: i % 10 == 0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pruning_is_real_and_exact_in_low_dimension():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(4000, 3)))
    tree, order = Tree.over(x)
    own = np.argsort(order)[:50]
    dist = np.linalg.norm(x[None] - x[:50, None], axis=2)
    dist[np.arange(50), np.arange(50)] = np.inf
    q, rows, far = tree.nearest(x[:50], own, 5, 1.0)
    for i in range(50):
        at, d = rows[q == i], far[q == i]
        assert set(np.argsort(dist[i])[:5]) <= set(order[at].tolist())
        assert d == pytest.approx(dist[i][order[at]], abs=1e-7)
    assert tree.looked < 0.2 * 50 * 4000
    assert sorted(order.tolist()) == list(range(4000))


def clustered(n=6000, size=24, groups=40):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, size))
    return [(int(i), (centres[i % groups] + 0.15 * rng.normal(size=size)).tolist()) for i in range(n)]


def test_many_shards_at_the_production_factor(spark):
    """Clustered vectors: nearly all neighbours are found and most shards are left out; factor one finds all."""
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, lambda i: i % 50 == 0)
    got = {(r.query_id, r.vec_id) for r in nearest(df, F.col("vec_id") % 50 == 0, shard=200).collect()}
    assert len(got & {(r[0], r[2]) for r in want}) >= 0.95 * len(want)
    near(nearest(df, F.col("vec_id") % 50 == 0, shard=200, factor=1.0).collect(), want)
    index = Index(df, shard=200)
    top, x = index.top[24], unit(np.array([v for _, v in rows], np.float32).astype(float))
    assert top.shards >= 30
    asked = x[::50]
    reach = np.array([np.sqrt(2 - 2 * r[3]) for r in want[4::5]])
    visits = sum(len(q) for _, q in top.open(asked, index.factors(5)[24] * reach))
    assert visits < 0.3 * top.shards * len(asked)
    assert index.rows.groupBy("shard").count().count() == top.shards


def test_factors_follow_the_vectors():
    """Offsets between neighbours spread over the directions there are, so fewer directions need a larger factor."""
    rng = np.random.default_rng(8)
    got = [vptree.calibrated(unit(rng.normal(size=(2000, n))), 5, 0.97, 8) for n in (4, 16, 64)]
    assert got == sorted(got, reverse=True) and got[0] > got[-1] and got[-1] < 0.3
    assert vptree.calibrated(unit(np.ones((1, 4))), 5, 0.97, 8) == 1.0


def test_top_tree_leaves_nothing_nearer_out_at_factor_one():
    rng = np.random.default_rng(6)
    x = unit(rng.normal(size=(1500, 5)))
    top = TopTree(x[:600], 32)
    home, dist = top.deal(x), np.linalg.norm(x[None, :40] - x[:, None], axis=2)
    reach = np.sort(dist, axis=0)[5]
    opened = {(s, q) for s, rows in top.open(x[:40], reach) for q in rows.tolist()}
    assert all((home[i], q) in opened for q in range(40) for i in np.flatnonzero(dist[:, q] <= reach[q]).tolist())
    assert len(opened) < 40 * top.shards


def test_tiny_and_huge_components_count(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2.1e200]), (2, [1e-300, -1e-300]), (3, [3.0, 5.0])]
    got = nearest(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in got] == [1, 3, 2]
    plain = [(0, [1.0, 2.0]), (1, [1.0, 2.1]), (2, [1.0, -1.0]), (3, [3.0, 5.0])]
    assert [r.score for r in got] == pytest.approx([r.score for r in nearest(spark.createDataFrame(plain, schema), F.col("vec_id") == 0).collect()], abs=1e-14)


def test_recall_of_the_production_factor(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 64))
    rows = [(int(i), (centres[i % 30] * 0.6 + rng.normal(size=64)).tolist()) for i in range(3000)]
    got = {(r.query_id, r.vec_id) for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()}
    want = {(r[0], r[2]) for r in brute(rows, lambda i: i % 50 == 0)}
    assert len(got & want) / len(want) >= 0.95


def test_ties_copies_and_unusable_rows(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(0, 300)] + [(1000, [2.0, 4.0, 1.0]), (400, None), (450, [0.0, 0.0, 0.0]), (500, [1.0, float("nan"), 0.0]),
            (550, [float("inf"), 1.0, 1.0]), (600, [1.0, None, 1.0]), (650, []), (None, same), (700, [1.0, 1.0]), (7, same), (1500, [1e-30, 0.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, shard=64).collect()
    near(got, brute(rows, lambda i: i % 50 == 0))
    assert {r.query_id for r in got} == {0, 50, 100, 150, 200, 250, 1000, 1500}


def test_few_rows_and_none(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []
    got = nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0)]
    with pytest.raises(ValueError):
        nearest(spark.createDataFrame([], SCHEMA), F.lit(True), factor=0)
