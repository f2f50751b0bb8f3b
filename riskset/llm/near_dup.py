"""Near-duplicate documents: BagMinHash signatures, bands, and a check of the multiset overlap.

Steps, each of which leaves a narrow table in the shared folder:

1. Every text becomes the multiset of its five-word shingles (A-Z lower-cased), a BagMinHash signature of 256 registers
   and a hash of the multiset. Texts with equal multisets form a class; from here on only the class's smallest id goes on.
2. 32 bands of four registers give bucket keys. A link of similarity 0.8 is in no common bucket with probability 5e-8.
3. Inside a bucket, members are read in order of their id and compared by signature; each becomes a candidate partner
   of the two likeliest before it. The three likeliest partners of each document are checked on the shingle counts
   themselves, and the links found right joined to components.
4. Buckets that hold members of several components are read again, this time with the members' shingle counts. Every
   pair of different components whose estimate does not rule the similarity out (four standard deviations below it) is
   checked inside the task, which joins what it finds linked and sends out those links only that joined two of its
   components: fewer than it has members, however many pairs it refutes. No component misses a link to another.

Buckets of more than ``CHUNK`` members, or ``CHUNK_SHINGLES`` shingles in step 4, are dealt to several tasks. In step 3, members that are not almost surely similar to
one kept already lead their part, and the leaders meet again in buckets of one band more, until no bucket is divided. In
step 4, all members outside the bucket's largest component are compared, in blocks, with all others of the bucket, so that
a link is found whoever leads; the cost is the bucket's members times those outside its largest component.

A class is a connected component of the links found right.

Defined results: null, empty and blank texts have no shingles, which makes their multisets equal: they are one class. A null id stays a row with a
null class. Rows repeated with the same id and text are one document; rows that share an id but not the text are told
apart no further than the id. An empty table gives no rows. A very long text is read whole, in a slice of its own. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from riskset.llm.bagminhash import fingerprints, signatures
from riskset.llm.common import U64, hinted, join_counted, mix, small_enough, stored, task_batch, text_slices
from riskset.llm.components import components
from riskset.llm.shingles import WORDS, bags, overlap

SIMILARITY = 0.8
REGISTERS = 256
ROWS_PER_BAND = 4
BANDS = 32
CHUNK = 2048  #: members of a bucket that one task compares
CHUNK_SHINGLES = 4_000_000  #: shingles that one block of members holds
CHECK_GROUP = 64  #: partners whose shingles are compared at once
SLACK = 0.10  #: a signature's estimate this far below the limit, four standard deviations, ends a candidate
SURE = 0.90  #: by estimate, a member follows its leader
BEST = 2  #: partners from a bucket at first
CHECKED = 3  #: partners of a document checked at first
VERIFY_GROUP = 256  #: partners checked beside one copy of a document's shingles

_SIGNED = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("weight", pa.int64()),
                     ("prints", pa.binary())])
#: a candidate pair, or (bucket not null) a leader a
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("likely", pa.float32()), ("bucket", pa.int64()), ("band", pa.int32())])
_BAGS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("bag", pa.binary())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _digest(h: np.ndarray, c: np.ndarray) -> tuple[int, int]:
    """Two hashes of a multiset."""
    if not len(h):
        return 0, 0
    x = mix(h ^ (c.astype(U64) * U64(0x9E3779B97F4A7C15)))
    return int(x.sum(dtype=U64).view(np.int64)), int(mix(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64))


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = bags(part.column("text"), words)
            sizes = np.array([len(h) for h, _ in sets], dtype=np.int64)
            every = np.concatenate([h for h, _ in sets]) if sets else np.zeros(0, U64)
            counts = np.concatenate([c for _, c in sets]).astype(np.float64) if sets else np.zeros(0)
            prints = fingerprints(signatures(every, counts, sizes, REGISTERS))
            one, two = zip(*[_digest(h, c) for h, c in sets]) if sets else ((), ())
            yield task_batch({"doc_id": part.column("doc_id"), "h1": one, "h2": two,
                              "weight": [int(c.sum()) for _, c in sets], "prints": [p.tobytes() for p in prints]}, _SIGNED)

    return run


_HELD, _COMPARED, _BOTH = 0, 1, 2  #: roles of a row in a part


def _first_band(held: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The first band in which each row of ``held`` agrees with ``prints``; 0 if none."""
    banded = ROWS_PER_BAND * BANDS
    return (held[:, :banded] == prints[:banded]).reshape(len(held), BANDS, ROWS_PER_BAND).all(axis=2).argmax(axis=1)


class _Bucket:
    """The members of one part of a bucket, in the order read."""

    def __init__(self, limit: float, band: int | None):
        self.limit, self.ratio, self.band, self.n = limit - SLACK, limit, band, 0
        self.ids: list[int] = []
        self._room(16)

    def _room(self, size: int) -> None:
        grown = {"prints": np.zeros((size, REGISTERS), np.uint16), "weights": np.zeros(size),
                 "component": np.zeros(size, np.int64), "leads": np.zeros(size, bool)}
        for name, new in grown.items():
            if self.n:
                new[:self.n] = getattr(self, name)[:self.n]
            setattr(self, name, new)

    def add(self, doc: int, weight: int, component: int, prints: np.ndarray) -> list[tuple[int, float]]:
        """The ``BEST`` likeliest members to check ``doc`` against, with the estimates; it becomes a member.

        With ``band``, those only that agree in no band before it, so that a pair is found once; the likeliest of all
        buckets are never missed.
        """
        n, found, leads = self.n, [], True
        if n == len(self.prints):
            self._room(2 * n)
        if n:
            like = np.count_nonzero(self.prints[:n] == prints, axis=1) / REGISTERS
            w = self.weights[:n]
            like[np.minimum(w, weight) < self.ratio * np.maximum(w, weight) - 1e-9] = 0.0
            leads = not (self.leads[:n] & (like >= SURE)).any()
            near = np.flatnonzero((like >= self.limit) & (self.component[:n] != component))
            if len(near) > BEST:
                near = near[np.argsort(-like[near], kind="stable")[:BEST]]
            if self.band is not None and len(near):
                near = near[_first_band(self.prints[near], prints) == self.band]
            found = [(self.ids[i], float(like[i])) for i in near.tolist()]
        self.prints[n], self.weights[n], self.component[n], self.leads[n] = prints, weight, component, leads
        self.ids.append(doc)
        self.n = n + 1
        return found


_MEMBER = ("bucket", "part", "next", "parts", "doc_id", "weight", "component", "prints")


def _compare(limit: float, once: bool):
    """Streams rows sorted by (bucket, part, doc_id); yields candidate pairs, and the leaders of divided buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, divided = None, None, False
        rows: dict[str, list] = {f.name: [] for f in _PAIRS}

        def put(*row):
            for f, x in zip(_PAIRS, row):
                rows[f.name].append(x)

        def close():
            if divided:
                for k in np.flatnonzero(bucket.leads[:bucket.n]).tolist():
                    put(bucket.ids[k], None, None, held[0], held[2])

        for batch in batches:
            for key, part, band, parts, doc, weight, component, prints in zip(*(batch.column(c).to_pylist() for c in _MEMBER)):
                if (key, part, band) != held:
                    close()
                    held, divided, bucket = (key, part, band), parts > 1, _Bucket(limit, band if once else None)
                for other, rate in bucket.add(doc, weight, component, np.frombuffer(prints, np.uint16)):
                    if other != doc:
                        put(min(doc, other), max(doc, other), rate, None, None)
            if len(rows["a"]) >= 20_000:
                yield task_batch(rows, _PAIRS)
                rows = {f.name: [] for f in _PAIRS}
        close()
        if rows["a"]:
            yield task_batch(rows, _PAIRS)

    return run


def _shared(level: DataFrame) -> DataFrame:
    """(doc_id, bucket, next, n): the buckets of several members.

    ``level`` has (doc_id, prints, bucket, band); a row gets a key for every band from ``band`` on, joined to the
    bucket it is in already.
    """
    size = 2 * ROWS_PER_BAND
    keys = (level.filter(F.col("band") < BANDS)
            .withColumn("next", F.explode(F.sequence(F.col("band"), F.lit(BANDS - 1))))
            .select("doc_id", F.xxhash64("bucket", "next", F.expr(f"substring(prints, next * {size} + 1, {size})")).alias("bucket"), "next"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return keys.join(sizes, "bucket").select("doc_id", "bucket", "next", "n")


class _Tile:
    """The members held of one part, and which of the components seen there are joined by now."""

    def __init__(self, limit: float, band: int):
        self.limit, self.band, self.n = limit, band, 0
        self.ids: list[int] = []
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        self.prints, self.weights, self.label = np.zeros((16, REGISTERS), np.uint16), np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.root: dict[int, int] = {}

    def find(self, component: int) -> int:
        while (up := self.root.get(component, component)) != component:
            component = up
        return component

    def hold(self, doc: int, weight: int, component: int, prints: np.ndarray, bag) -> None:
        n = self.n
        if n == len(self.ids) and n == len(self.weights):
            self.prints, self.weights, self.label = (np.concatenate([x, np.zeros_like(x)]) for x in (self.prints, self.weights, self.label))
        self.prints[n], self.weights[n], self.label[n] = prints, weight, self.find(component)
        self.ids.append(doc)
        self.bags.append(bag)
        self.n = n + 1

    def links(self, doc: int, weight: int, component: int, prints: np.ndarray, bag) -> Iterator[tuple[int, int]]:
        """The links of ``doc`` to members that join two components."""
        n, mine = self.n, self.find(component)
        near = np.flatnonzero(self.label[:n] != mine)
        w = self.weights[near]
        near = near[np.minimum(w, weight) >= self.limit * np.maximum(w, weight) - 1e-9]
        like = np.count_nonzero(self.prints[near] == prints, axis=1) / REGISTERS
        near, like = near[like >= self.limit - SLACK], like[like >= self.limit - SLACK]
        if len(near):
            first = _first_band(self.prints[near], prints) == self.band  # a pair is checked in one bucket alone
            near = near[first][np.argsort(-like[first], kind="stable")]
        while len(near):
            group, near = near[:CHECK_GROUP], near[CHECK_GROUP:]
            for k in group[self._similar(group, weight, bag)].tolist():
                other = int(self.label[k])
                if other != mine:
                    yield self.ids[k], doc
                    joined = min(mine, other)
                    self.label[:n][(self.label[:n] == mine) | (self.label[:n] == other)] = joined
                    self.root[max(mine, other)] = joined
                    mine = joined
            near = near[self.label[near] != mine]

    def _similar(self, group: np.ndarray, weight: int, bag) -> np.ndarray:
        """Which members of ``group`` share enough of their multisets with ``bag``."""
        hashes, counts = bag
        sizes = np.array([len(self.bags[k][0]) for k in group])
        every = np.concatenate([self.bags[k][0] for k in group])
        at = np.minimum(np.searchsorted(hashes, every), len(hashes) - 1)
        common = np.where(hashes[at] == every, np.minimum(np.concatenate([self.bags[k][1] for k in group]), counts[at]), 0)
        both = np.add.reduceat(common, np.cumsum(sizes) - sizes)
        return both >= self.limit * (self.weights[group] + weight - both) - 1e-9


_HELD_ROW = ("bucket", "part", "next", "role", "doc_id", "weight", "component", "prints", "bag")


def _join_tiles(limit: float):
    """Streams rows sorted by (bucket, part, role is compared, doc_id); yields the true links that join components of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile, u, v = None, None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _HELD_ROW)):
                band, role, doc, weight, component = row[2:7]
                if row[:3] != key:
                    key, tile = row[:3], _Tile(limit, band)
                prints, bag = np.frombuffer(row[7], np.uint16), _unpack(row[8])
                if role != _HELD:
                    for x, y in tile.links(doc, weight, component, prints, bag):
                        u.append(x)
                        v.append(y)
                if role != _COMPARED:
                    tile.hold(doc, weight, component, prints, bag)
            if u:
                yield task_batch({"u": u, "v": v}, _LINKS)
                u, v = [], []

    return run


def _tiles(members: DataFrame) -> DataFrame:
    """``members`` with part and role: the rows of large buckets in pairs of blocks, those of others in one part.

    A block of members outside the bucket's largest component (``rest``) is held, and meets itself, every other such block
    once and every block of the largest component. Pairs inside the largest component are settled.
    ``members``: (doc_id, h1, bucket, next, component, weight).
    """
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("members"), F.sum("weight").alias("shingles"))
    sizes = parts.groupBy("bucket").agg(F.sum("members").alias("n"), F.sum("shingles").alias("shingles"),
                                        F.max(F.struct("members", "component", "shingles")).alias("main"))
    blocks = lambda n, w: F.greatest(F.ceil(n / CHUNK), F.ceil(w / CHUNK_SHINGLES)).cast("long")
    sizes = (sizes.withColumn("large", (F.col("n") > CHUNK) | (F.col("shingles") > CHUNK_SHINGLES))
             .withColumn("main_blocks", blocks(F.col("main.members"), F.col("main.shingles")))
             .withColumn("rest_blocks", blocks(F.col("n") - F.col("main.members"), F.col("shingles") - F.col("main.shingles"))))
    rows = join_counted(members, stored(sizes.select("bucket", "n", "large", "main", "main_blocks", "rest_blocks"), "sizes"), ["bucket"])
    rows = (rows.withColumn("rest", F.col("component") != F.col("main.component"))
            .withColumn("own", F.pmod(F.xxhash64("doc_id", "bucket"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("main_blocks")))))
    tile = F.expr(f"""CASE
        WHEN NOT large THEN array(struct(0L AS held, 0L AS other, {_BOTH} AS role))
        WHEN rest THEN concat(
          transform(sequence(0L, main_blocks - 1), m -> struct(own AS held, rest_blocks + m AS other, {_HELD} AS role)),
          transform(sequence(0L, rest_blocks - 1), x -> struct(least(x, own) AS held, greatest(x, own) AS other,
                    CASE WHEN x = own THEN {_BOTH} WHEN own < x THEN {_HELD} ELSE {_COMPARED} END AS role)))
        ELSE transform(sequence(0L, rest_blocks - 1), x -> struct(x AS held, rest_blocks + own AS other, {_COMPARED} AS role)) END""")
    return (rows.withColumn("tile", F.explode(tile))
            .select("doc_id", "h1", "bucket", "next", "component", "weight",
                    (F.col("tile.held") * (F.col("main_blocks") + F.col("rest_blocks")) + F.col("tile.other")).alias("part"),
                    F.col("tile.role").alias("role")))


def _links_across(source: DataFrame, shared: DataFrame, reps: DataFrame, limit: float, words: int) -> DataFrame:
    """True links (u, v) between components: enough of them to join all that any true link joins.

    ``shared``: the buckets of several components. ``reps``: (doc_id, h1, weight, component, prints).
    """
    members = stored(shared.select("doc_id", "bucket", "next").join(reps.select("doc_id", "h1", "component", "weight"), "doc_id"), "open")
    needed = members.select("doc_id").distinct()
    packed = source.join(hinted(needed), "doc_id", "left_semi").mapInArrow(_pack(words), "doc_id long, h1 long, bag binary")
    whole = stored(packed.dropDuplicates(["doc_id", "h1"]).join(reps.select("doc_id", "h1", "prints").dropDuplicates(["doc_id", "h1"]), ["doc_id", "h1"]), "bags")
    rows = _tiles(members).join(whole, ["doc_id", "h1"])
    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("role") == _COMPARED, "doc_id")
    return stored(dealt.select(*_HELD_ROW).mapInArrow(_join_tiles(limit), "u long, v long"), "joined")


def _candidates(shared: DataFrame, reps: DataFrame, limit: float) -> DataFrame:
    """Distinct pairs (a, b, likely) of likely members of one bucket. ``reps``: (doc_id, weight, component, prints)."""
    found, once = None, shared.filter(F.col("n") > CHUNK).isEmpty()  # members of a divided bucket may miss each other in it
    while True:
        rows = (shared.join(reps, "doc_id").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("long"))
                .withColumn("part", F.pmod(F.xxhash64("doc_id", "bucket"), "parts")))
        dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "doc_id")
        out = stored(dealt.select(*_MEMBER).mapInArrow(_compare(limit, once), "a long, b long, likely float, bucket long, band int"), "compared")
        pairs = out.filter("bucket is null").groupBy("a", "b").agg(F.max("likely").alias("likely"))
        found = pairs if found is None else found.union(pairs)
        leaders = out.filter("bucket is not null")
        if small_enough(leaders, 0):
            return stored(found.groupBy("a", "b").agg(F.max("likely").alias("likely")), "pairs")
        # the leaders of divided buckets meet again under one band more
        level = leaders.select(F.col("a").alias("doc_id"), "bucket", (F.col("band") + 1).alias("band")).join(reps, "doc_id")
        shared = _shared(level)


def _pack(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = bags(part.column("text"), words)
            packed = [h.tobytes() + c.astype(np.uint32).tobytes() for h, c in sets]
            yield task_batch({"doc_id": part.column("doc_id"), "h1": [_digest(h, c)[0] for h, c in sets], "bag": packed}, _BAGS)

    return run


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, U64, n), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


def _check(limit: float):
    """Streams rows sorted by (a, salt, b): first a's own bag (b null), then its partners' bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            u, v = [], []
            a, salt, b, bag = (batch.column(c) for c in ("a", "salt", "b", "bag"))
            for x, s, y, raw in zip(a.to_pylist(), salt.to_pylist(), b.to_pylist(), bag):
                if y is None:
                    key, own = (x, s), _unpack(raw.as_py())
                    continue
                if (x, s) != key:
                    raise RuntimeError("a document's own shingles must come before its partners'")
                both, either = overlap(own, _unpack(raw.as_py()))
                if either and both >= limit * either - 1e-9:
                    u.append(x)
                    v.append(y)
            yield task_batch({"u": u, "v": v}, _LINKS)

    return run


def _links(source: DataFrame, pairs: DataFrame, limit: float, words: int) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough, as (u, v)."""
    pairs = stored(pairs, "to_check")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFY_GROUP).cast("long").alias("salts"))
    salted = stored(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt")), "salted")
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    packed = stored(source.join(hinted(needed), "doc_id", "left_semi").mapInArrow(_pack(words), "doc_id long, h1 long, bag binary").drop("h1"), "bags")
    partners = salted.join(packed.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "bag")
    own = (salted.select("a", "salt").distinct().join(packed.withColumnRenamed("doc_id", "a"), "a")
           .select("a", "salt", F.lit(None).cast("long").alias("b"), "bag"))
    rows = own.union(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return stored(rows.mapInArrow(_check(limit), "u long, v long"), "verified")


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                      words: int = WORDS) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``: the smallest id of the row's class of near duplicates."""
    if not 0.7 <= similarity <= 1:
        raise ValueError("the bands are laid out for similarities from 0.7 to 1")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = stored(source.filter("doc_id is not null")
                    .mapInArrow(_sign(words), "doc_id long, h1 long, h2 long, weight long, prints binary"), "signed")
    real = signed.filter("weight > 0")
    owner = stored(signed.groupBy("h1", "h2", "weight").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    # several texts under one id are linked through the id
    same = join_counted(signed, owner, ["h1", "h2", "weight"]).select("doc_id", "rep").filter("doc_id <> rep")
    reps = stored(real.join(owner.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
                  .select("doc_id", "h1", "weight", "prints"), "representatives")
    shared = stored(_shared(reps.withColumn("bucket", F.lit(0).cast("long")).withColumn("band", F.lit(0))), "shared")
    alone = reps.withColumn("component", F.col("doc_id"))
    pairs = _candidates(shared, alone, similarity)
    best = Window.partitionBy("b").orderBy(F.desc("likely"), "a")
    first = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= CHECKED).select("a", "b")
    sure = _links(source, first, similarity, words)
    roots = components(sure)
    joined = (reps.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .select("doc_id", "h1", "weight", F.coalesce("root", "doc_id").alias("component"), "prints"))
    parts = shared.join(joined.select("doc_id", "component"), "doc_id")
    several = parts.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket")
    more = _links_across(source, shared.join(several, "bucket", "left_semi"), joined, similarity, words)
    links = sure.union(more).union(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    root = components(links)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    return (rows.join(root, rows.doc_id == root.node, "left")
            .select("doc_id", F.coalesce("root", "doc_id").alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not the first, by id, of their class.

    Rows without an id stay. Repeated rows of one id and text are reduced to one.
    """
    classes = duplicate_classes(docs, id_col, text_col, **options)
    gone = classes.filter("class_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    left = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    named = left.filter(F.col(f"`{id_col}`").isNotNull())
    repeated = named.groupBy(id_col).count().filter("count > 1").select(id_col)
    if small_enough(repeated, 0):
        return left
    once = left.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col]).select(*docs.columns)
    rest = left.join(repeated, id_col, "left_anti").select(*docs.columns)
    return rest.unionByName(once)
