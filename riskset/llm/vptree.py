"""Nearest neighbours by cosine from vantage-point trees, one for each shard.

Vectors are scaled to length one, where the distance |a - b| = sqrt(2 - 2 cos) is a metric. A top tree of vantage points,
fitted on ``SAMPLE`` vectors at most, drawn by a hash of the id, deals every vector to a shard, so that a shard holds
neighbours; shards of more than ``SHARD`` vectors are divided into parts by the hash. Every part has a tree of its own,
built once and kept as a table. A query is first looked up in its own shard; the distance of its k-th best there
is the bound with which it then visits the shards that the top tree leaves open.

In the top tree and in the parts' trees alike a side is left out if the query is farther from it than ``factor`` times the
distance of the k-th best so far: with factor one the triangle inequality proves that nothing nearer is there and the search is
exact; a smaller factor prunes more. Which factor does depends on the vectors (offsets between neighbours spread over
as many directions as the vectors have), so unless one is given the least of ``FACTORS`` is taken that finds ``RECALL`` of the true
neighbours in the sample. Found rows are scored on the original vectors in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null ids.
Vectors are compared with vectors of their own length only. Rows repeated with one id count once (the smallest vector).
Ties go to the smaller id. A query with fewer candidates gets all there are; no candidates, no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskset.llm.common import hinted, stored, task_batch

SHARD = 4096
SAMPLE = 8192  #: vectors at most that top trees and factors are fitted on (fewer of over 256 components)
TOP_LEAF = 8  #: sampled vectors below which the top tree is not split, so it has 1,024 to 2,048 leaves at most
LEAF = 32
FIRST = 8  #: leaves' worth of vectors that a query looks at before it begins to prune
FACTORS = (0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.17, 0.18, 0.2, 0.22, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.0)
RECALL = 0.97  #: of the sample's own neighbours; larger tables have deeper trees and lose a little more
CALIBRATION = 128  #: sampled vectors looked up to choose a factor
SAMPLE_DOUBLES = 1 << 21
K = 5
_EPS = 1e-9

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_VISIT = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())),
                    ("bound", pa.float64())])
_VISIT_DDL = "dim int, shard int, vec_id long, vector array<double>, bound double"


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one. Powers of two come off first, exactly, so tiny or huge components neither vanish nor overflow."""
    x = scaled(raw)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(raw: np.ndarray) -> np.ndarray:
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def arrange(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, split by position) of the vantage-point tree over ``points``, rows of length one.

    A node is a range of positions: its vantage point comes first, then the nearer half of the others, then the
    farther half, so the ranges follow from the number of rows alone. ``split`` is the distance of the farthest in the nearer half.
    """
    order, split = np.arange(len(points)), np.zeros(len(points))
    todo = [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            continue
        rows = order[lo:hi]
        centre = points[rows].mean(axis=0)
        first = int(np.argmax(((points[rows] - centre) ** 2).sum(axis=1)))  # far from the middle splits best
        rest = np.delete(rows, first)
        d = _distances(points[rest], points[rows[first]][None, :])[:, 0]
        by = np.argsort(d, kind="stable")
        order[lo:hi] = np.concatenate([rows[first:first + 1], rest[by]])
        mid = middle(lo, hi)
        split[lo] = d[by[mid - lo - 2]]
        todo += [(lo + 1, mid), (mid, hi)]
    return order, split


def middle(lo: int, hi: int) -> int:
    """Where the farther half of the node ``lo`` to ``hi`` begins."""
    return lo + 1 + (hi - lo) // 2


class Tree:
    """A vantage-point tree over ``points`` in the order that :func:`arrange` gives."""

    def __init__(self, points: np.ndarray, split: np.ndarray, leaf: int = LEAF):
        self.points, self.split, self.leaf, self.first = points, split, leaf, FIRST * leaf
        self.looked = 0  #: distances computed by searches

    @classmethod
    def over(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        order, split = arrange(points, leaf)
        return cls(points[order], split, leaf), order

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float,
                bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, distance) of all that may be among each query's ``k`` nearest, ties included.

        ``own``: the position to leave out, or -1. ``bound``: a distance within which ``k`` others are known.
        All queries that reach a node look at it together.
        """
        n = len(queries)
        best = np.full((n, k), np.inf) if bound is None else np.repeat(np.asarray(bound, float)[:, None], k, axis=1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(active: np.ndarray, lo: int, hi: int) -> np.ndarray:
            self.looked += len(active) * (hi - lo)
            d = _distances(queries[active], self.points[lo:hi])
            usable = np.where(np.arange(lo, hi)[None, :] == own[active, None], np.inf, d)
            hit = (usable <= best[active, -1][:, None] + _EPS) & np.isfinite(usable)
            rows = np.flatnonzero(hit.any(axis=1))
            if len(rows):
                q, at = np.nonzero(hit)
                found.append((active[q], at + lo, usable[q, at]))
                best[active[rows]] = np.sort(np.concatenate([best[active[rows]], usable[rows]], axis=1), axis=1)[:, :k]
            return d

        # first the small node that each query falls in, for a bound to begin with
        home = np.zeros(n, np.int64)
        todo = [(0, len(self.points), np.arange(n))]
        while todo:
            lo, hi, active = todo.pop()
            if not len(active):
                continue
            if hi - lo <= self.first:
                home[active] = lo
                look(active, lo, hi)
                continue
            mid, near = middle(lo, hi), _distances(queries[active], self.points[lo:lo + 1])[:, 0] <= self.split[lo]
            todo += [(lo + 1, mid, active[near]), (mid, hi, active[~near])]
        # then every node once, with all queries that it is open to
        todo = [(0, len(self.points), np.arange(n), np.zeros(n))]
        while todo:
            lo, hi, active, gap = todo.pop()
            on = gap <= factor * best[active, -1] + _EPS
            if hi - lo <= self.first:
                on &= home[active] != lo
            active, gap = active[on], gap[on]
            if not len(active) or hi <= lo:
                continue
            if hi - lo <= self.leaf:
                look(active, lo, hi)
                continue
            d = look(active, lo, lo + 1)[:, 0]
            mid, split = middle(lo, hi), self.split[lo]
            todo += [(mid, hi, active, np.maximum(gap, split - d)), (lo + 1, mid, active, np.maximum(gap, d - split))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, at, d = (np.concatenate(x) for x in zip(*found))
        on = d <= best[q, -1] + _EPS
        return q[on], at[on], d[on]


def calibrated(sample: np.ndarray, k: int, recall: float, leaf: int) -> float:
    """The least of ``FACTORS`` with which a tree over ``sample`` (rows of length one) finds ``recall`` of the ``k`` nearest."""
    asked = sample[:CALIBRATION]
    wanted = min(k, len(sample) - 1)
    if wanted < 1:
        return 1.0
    tree, order = Tree.over(sample, leaf)
    own = np.argsort(order)[:len(asked)]
    d = _distances(asked, tree.points)
    d[np.arange(len(asked)), own] = np.inf
    kth = np.partition(d, wanted - 1, axis=1)[:, wanted - 1]
    lo, hi = 0, len(FACTORS) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        q, _, near = tree.nearest(asked, own, k, FACTORS[mid])
        hits = np.minimum(np.bincount(q[near <= kth[q] + _EPS], minlength=len(asked)), wanted).sum()
        lo, hi = (lo, mid) if hits >= recall * wanted * len(asked) else (mid + 1, hi)
    return FACTORS[lo]


class TopTree:
    """The vantage points that deal vectors of one length to shards. Inner nodes: (vantage, split, inside, outside)."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list = [None]
        self.vantage: list[np.ndarray] = []
        self.shards = 0
        todo = [(0, np.arange(len(sample)), shards)]
        while todo:
            at, rows, wanted = todo.pop(0)
            if wanted < 2 or len(rows) < 2 * TOP_LEAF:
                self.nodes[at] = self.shards
                self.shards += 1
                continue
            centre = sample[rows].mean(axis=0)
            v = sample[rows[np.argmax(((sample[rows] - centre) ** 2).sum(axis=1))]]
            d = _distances(sample[rows], v[None, :])[:, 0]
            split = float(np.median(d))
            inside = d <= split
            if inside.all():  # many copies of one vector
                self.nodes[at] = self.shards
                self.shards += 1
                continue
            self.nodes[at] = (len(self.vantage), split, len(self.nodes), len(self.nodes) + 1)
            self.vantage.append(v)
            todo += [(len(self.nodes), rows[inside], -(-wanted // 2)), (len(self.nodes) + 1, rows[~inside], -(-wanted // 2))]
            self.nodes += [None, None]

    def deal(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for shard, rows, _ in self._walk(x, np.zeros(len(x)), both=False):
            out[rows] = shard
        return out

    def open(self, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, rows of ``x`` that it stays open to): no vantage point puts it farther than ``reach`` away."""
        for shard, rows, _ in self._walk(x, reach, both=True):
            yield shard, rows

    def _walk(self, x, reach, both):
        todo = [(0, np.arange(len(x)), np.zeros(len(x)))]
        while todo:
            at, rows, gap = todo.pop()
            node = self.nodes[at]
            if not len(rows):
                continue
            if not isinstance(node, tuple):
                yield node, rows, gap
                continue
            v, split, inside, outside = node
            d = _distances(x[rows], self.vantage[v][None, :])[:, 0]
            near = d <= split
            for child, over in ((inside, d - split), (outside, split - d)):
                on = (near if child == inside else ~near) | (both & (over <= reach[rows] + _EPS))
                todo.append((child, rows[on], np.maximum(gap[on], over[on])))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _by_length(part: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = part.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, part.take(pa.array(np.flatnonzero(dims == dim)))


def _dealt(top: dict[int, TopTree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch) if batch.num_rows else ():
                tree = top.get(dim)
                shard = np.zeros(part.num_rows, np.int32) if tree is None else tree.deal(unit(_matrix(part.column("vector"))))
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(shard), part.column("vec_id"), part.column("vector")],
                                                 ["dim", "shard", "vec_id", "vector"])
    return run


def _opened(top: dict[int, TopTree], factors: dict[int, float]):
    """The shards besides its own that a query has to visit; ``bound`` is null where fewer than k were found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch) if batch.num_rows else ():
                tree = top.get(dim)
                if tree is None:
                    continue
                bound = part.column("bound").to_numpy(zero_copy_only=False).astype(float)
                bound = np.where(np.isnan(bound), np.inf, bound)
                home = part.column("shard").to_numpy()
                for shard, rows in tree.open(unit(_matrix(part.column("vector"))), factors[dim] * bound):
                    rows = rows[home[rows] != shard]
                    if len(rows):
                        at = pa.array(rows)
                        yield task_batch({"dim": np.full(len(rows), dim, np.int32), "shard": np.full(len(rows), shard, np.int32),
                                          "vec_id": part.column("vec_id").take(at), "vector": part.column("vector").take(at),
                                          "bound": bound[rows]}, _VISIT)
    return run


def _arranged(rows: pd.DataFrame) -> pd.DataFrame:
    """One part's rows in the order of its tree."""
    raw = np.stack(rows["vector"].to_numpy())
    order, split = arrange(unit(raw), LEAF)
    out = rows.iloc[order].reset_index(drop=True)
    out["pos"], out["split"] = np.arange(len(order)), split
    return out[["dim", "shard", "part", "pos", "vec_id", "vector", "split"]]


_TREES_DDL = "dim int, shard int, part int, pos int, vec_id long, vector array<double>, split double"


def _streamed(k: int, factors: dict[int, float]):
    """Reads rows sorted by part, each part's tree before its queries, and lets the queries stream past it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "part")], axis=1)
            asks = batch.column("pos").to_numpy() < 0
            change = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if tuple(keys[lo]) != key:
                    key, pieces, tree = tuple(keys[lo]), [], None
                if not asks[lo]:
                    pieces.append((_matrix(part.column("vector")), part.column("vec_id").to_numpy(), part.column("split").to_numpy()))
                    continue
                if not pieces:  # no such part
                    continue
                if tree is None:
                    raw, ids, split = (np.concatenate(x) for x in zip(*pieces))
                    tree, at = Tree(unit(raw), split), {v: i for i, v in enumerate(ids.tolist())}
                asked, asked_ids = _matrix(part.column("vector")), part.column("vec_id").to_numpy()
                own = np.array([at.get(q, -1) for q in asked_ids.tolist()])
                q, rows, _ = tree.nearest(unit(asked), own, k, factors.get(key[0], 1.0), part.column("bound").to_numpy())
                score = cosines(raw[rows], asked[q])
                order = np.lexsort((ids[rows], -score, q))
                q, rows, score = q[order], rows[order], score[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                if len(q):
                    yield task_batch({"query_id": asked_ids[q[first]], "vec_id": ids[rows[first]], "score": score[first]}, _FOUND)
    return run


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, once for each id."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


class Index:
    """The stored trees: ``rows`` (vec_id, vector, dim, shard), ``trees`` (a row for each vector, by part and position), ``top`` by length."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD):
        rows = stored(usable_vectors(df, id_col, vector_col).withColumn("dim", F.size("vector")), "vectors")
        longest = rows.agg(F.max("dim")).first()[0] or 1
        drawn = (rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_DOUBLES // longest)))
                 .select("dim", "vec_id", "vector").toArrow().combine_chunks())
        #: a length that the sample lacks is rare: it has one shard, searched with factor one
        self.samples = {dim: unit(_matrix(part.column("vector"))) for batch in drawn.to_batches() for dim, part in _by_length(batch)}
        self.sizes = {r.dim: r.n for r in rows.filter(F.col("dim").isin(list(self.samples))).groupBy("dim").agg(F.count("*").alias("n")).collect()}
        self.top = {dim: TopTree(x, -(-self.sizes[dim] // shard)) for dim, x in self.samples.items()}
        dealt = rows.select("dim", "vec_id", "vector").mapInArrow(_dealt(self.top), "dim int, shard int, vec_id long, vector array<double>")
        self.rows = stored(dealt, "dealt")
        # a shard may be much larger than the others (copies of one vector): its parts have a tree each
        held = self.rows.groupBy("dim", "shard").agg(F.count("*").alias("n"))
        self.parts = hinted(stored(held.select("dim", "shard", F.ceil(F.col("n") / F.lit(shard)).cast("int").alias("parts")), "parts"))
        part = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")).cast("int")
        placed = self.rows.join(self.parts, ["dim", "shard"]).select("dim", "shard", part.alias("part"), "vec_id", "vector")
        self.trees = stored(placed.groupBy("dim", "shard", "part").applyInPandas(_arranged, _TREES_DDL), "trees")

    def factors(self, k: int, recall: float = RECALL) -> dict[int, float]:
        """The pruning factor by length of the vectors. The sample's tree is as deep as the whole one's, down to single vectors."""
        return {dim: calibrated(x, k, recall, max(1, LEAF * len(x) // self.sizes[dim])) for dim, x in self.samples.items()}

    def visit(self, asks: DataFrame, k: int, factors: dict[int, float]) -> DataFrame:
        """(query_id, vec_id, score) of the best that each of ``asks`` finds in every part of the shard it visits."""
        copies = asks.join(self.parts, ["dim", "shard"]).select(
            "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).alias("pos"), "vec_id", "vector",
            F.lit(0.0).alias("split"), "bound")
        both = self.trees.withColumn("bound", F.lit(0.0)).unionByName(copies)
        keys = ["dim", "shard", "part"]
        sort = [*keys, F.when(F.col("pos") < 0, 1).otherwise(0), "pos"]
        return (both.repartition(*keys).sortWithinPartitions(*sort)
                .mapInArrow(_streamed(k, factors), "query_id long, vec_id long, score double"))


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            factor: float | None = None, recall: float = RECALL, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``df`` to each of its rows chosen by ``queries``.

    ``queries`` is a condition on the column ``vec_id``. Without a ``factor`` it is chosen for ``recall`` on the sample.
    """
    if factor is not None and not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    index = Index(df, id_col, vector_col, shard)
    factors = index.factors(k, recall) if factor is None else dict.fromkeys(index.top, factor)
    asked = index.rows.filter(queries)
    first = stored(index.visit(asked.withColumn("bound", F.lit(float("inf"))), k, factors), "found")
    if all(t.shards == 1 for t in index.top.values()):
        return best(first, k)
    kth = best(first, k).filter(F.col("rank") == k)
    bound = kth.select(F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("bound"))
    bounded = asked.join(bound, "vec_id", "left").select("dim", "shard", "vec_id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    asks = bounded.mapInArrow(_opened(index.top, factors), _VISIT_DDL)
    return best(first.unionByName(index.visit(asks, k, factors)), k)
