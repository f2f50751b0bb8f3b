"""Periodic runs of words, found through a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that holds the period at least twice
and at least ``MIN_WORDS`` words, and that no neighbouring word extends keeping the period.

The dictionary names every stretch of 2^k words, for k = 0, 1, ...: equal stretches of one document have one name, made from
the names of their halves; stretches that occur once have none. It ends at the first k without a repeat. From it:

* *Successors.* A run of period q, 2^k <= q < 2^(k+1), starts with a named stretch of 2^k words that occurs again q words on. The
  occurrences of a name, in order, are joined to groups where the step to the successor is at most half the stretch; all
  steps of a name's groups are then equal (an arithmetic progression, whose difference p is the stretch's own period).
  Groups are more than 2^(k-1) words apart, so at most three groups begin within twice the stretch's length.
* *Proposals.* For an occurrence i and each of the three groups after its own: the distance to the group's first member,
  and the distance between the ends to which the progressions' period p carries on from both groups. If a run of period q
  starts at i, q is one of these: where p breaks before i + q, the break recurs q words on, which gives the second; where it
  does not, the words before i + q hold period p, and if i + q were not the group's first member, the two groups would share
  p words and be one.
* *Extension.* Only an i whose word before breaks the period is taken, so a run is found at its first word alone. The longest
  common extension of i and i + q is read from the dictionary, longest names first. Multiples of a run's period give the same
  stretch and go.

All steps are numpy operations over a slice of documents at once, in O(words log words) time and memory.

Defined results: a null, empty or blank text has no words and no runs, and its collapsed text is empty. Rows repeated with one
id are each read. An empty table gives no rows. Other columns are ignored, whatever their names. A text is read whole
however long; only the documents of one slice are in memory. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import WS, WS_CHARS, text_slices

MIN_WORDS = 12  #: words of a run, at least
GROUPS_AHEAD = 3  #: groups of a name that can begin within twice its length


class Factors:
    """Names of all stretches of 2^k words of a sequence, -1 where the stretch occurs once."""

    def __init__(self, codes: np.ndarray):
        """``codes``: a number for each word, below 0 where it is equal to no other."""
        self.n = len(codes)
        self.names: list[np.ndarray] = []
        #: by level: the positions that have names, sorted by name, then position
        self.places: list[np.ndarray] = []
        at = np.flatnonzero(codes >= 0)
        keys = codes[at]
        while len(at):
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            group = np.cumsum(first) - 1
            again = np.bincount(group)[group] > 1
            if not again.any():
                return
            at, group = at[again], group[again]
            names = np.full(self.n, -1, np.int64)
            names[at] = group
            half = 1 << len(self.names)
            self.names.append(names)
            self.places.append(at)
            # the next level's stretches: two named halves side by side
            left = np.flatnonzero(names[:-half] >= 0) if self.n > half else np.zeros(0, np.int64)
            right = names[left + half]
            at = left[right >= 0]
            keys = names[at] * self.n + right[right >= 0]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j (other than i) are equal, one after the other."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            x, y = i + length, j + length
            inside = (x < self.n) & (y < self.n)
            a = np.where(inside, names[np.minimum(x, self.n - 1)], -1)
            length += np.where((a >= 0) & (a == np.where(inside, names[np.minimum(y, self.n - 1)], -2)), 1 << k, 0)
        return length

    def proposals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) for every run start and period that level ``k`` allows, 2^k <= period < 2^(k+1)."""
        at = self.places[k]
        name = self.names[k][at]
        same = name[1:] == name[:-1]
        step = np.where(same, at[1:] - at[:-1], self.n)
        joined = 2 * step <= 1 << k
        group = np.concatenate([[0], np.cumsum(~joined)])
        firsts = np.flatnonzero(np.concatenate([[True], ~joined]))
        lasts = np.concatenate([firsts[1:] - 1, [len(at) - 1]])
        first, last, of = at[firsts], at[lasts], name[firsts]
        period = np.zeros(int(name.max()) + 1, np.int64)  # of the stretches' progressions
        period[name[:-1][joined]] = step[joined]
        p = period[of]
        end = np.full(len(firsts), -1, np.int64)
        known = np.flatnonzero(p > 0)
        end[known] = last[known] + p[known] + self.common(last[known], last[known] + p[known])
        starts, periods = [], []
        for ahead in range(1, GROUPS_AHEAD + 1):
            mine = np.flatnonzero(group + ahead < len(firsts))
            mine = mine[of[group[mine]] == of[group[mine] + ahead]]
            other = group[mine] + ahead
            i = at[mine]
            ends = np.where(end[other] >= 0, end[other] - end[group[mine]], 0)
            for q in (first[other] - i, ends):
                fits = (q >= 1 << k) & (q < 2 << k) & (i + q < self.n)
                starts.append(i[fits])
                periods.append(q[fits])
        return np.concatenate(starts), np.concatenate(periods)


def find_runs(codes: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, sorted by start, then period. ``codes`` as for ``Factors``."""
    factors = Factors(codes)
    found = []
    for k in range(len(factors.names)):
        i, q = factors.proposals(k)
        # the word before breaks the period; a word of its own is equal to none
        before, there = codes[np.maximum(i - 1, 0)], codes[np.maximum(i - 1, 0) + q]
        starts = (i == 0) | (before != there) | (before < 0)
        i, q = i[starts], q[starts]
        more = factors.common(i, i + q)
        whole = (more >= q) & (q + more >= min_words)
        found.append(np.stack([i[whole], (q + more)[whole], q[whole]], axis=1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # the smallest period of a stretch
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, the number of words of each text)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0 if len(flat) else np.zeros(0, bool)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    seen, ends = np.concatenate([[0], np.cumsum(real)]), np.cumsum(sizes)
    return flat.filter(pa.array(real)), seen[ends] - seen[ends - sizes]


def runs_of_texts(texts: pa.Array, min_words: int = MIN_WORDS) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """(words of each text, each text's runs as rows of (start, length, period), the collapsed texts)."""
    words, counts = _words(texts)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    doc = np.repeat(np.arange(len(counts)), counts)
    code = words.dictionary_encode()
    kinds = max(1, len(code.dictionary))
    number = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # a place between texts that is equal to nothing; words are named within their text
    codes = np.full(len(doc) + len(counts), -1, np.int64)
    place = np.arange(len(doc)) + doc
    codes[place] = doc * kinds + number
    start, length, period = find_runs(codes, min_words)
    owner = np.searchsorted(begin + np.arange(len(begin)), start, side="right") - 1
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1][place] == 0
    left = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(counts)))])
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept))), " ")
    rows = np.stack([start - begin[owner] - owner, length, period], axis=1) if len(start) else np.zeros((0, 3), np.int64)
    cut = np.searchsorted(owner, np.arange(len(counts) + 1))
    return counts, [rows[cut[d]:cut[d + 1]] for d in range(len(counts))], collapsed


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            counts, rows, collapsed = runs_of_texts(part.column("text"), min_words)
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
            runs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(offsets, runs), collapsed],
                ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``.

    ``runs``: structs of start (word number), length and period, by start, then period. ``collapsed``: the words that no run
    holds after its first period, joined by one space.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scan(min_words), f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, "
                                             "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def report(runs: DataFrame) -> DataFrame:
    """The result of ``periodic_runs`` as counts, the longest run and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (runs.withColumn("top", longest)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
                    (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): about one text in ten, chosen by its id, repeats a stretch of its own words to the end."""
    words: Column = F.split(F.btrim("text", F.lit(WS_CHARS)), WS)
    draw = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    chosen = (draw % 10 == 0) & (F.length(F.btrim("text", F.lit(WS_CHARS))) > 0)
    rows = (rows.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words").cast("long"))
            .withColumn("g", F.floor(draw / 10)).withColumn("a", F.expr("g % n"))
            .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)")))
    repeated = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[int(CASE WHEN i < a THEN i ELSE a + (i - a) % p END)]), ' ')")
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))
