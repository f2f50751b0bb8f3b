import hashlib
import random
import time
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from riskset.llm.periods import periodic_runs, report, runs_of_texts, with_repeats

WS = " \t\n\x0b\x0c\r"


def plain_words(text):
    for c in WS[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_runs(words, least=12):
    """Every period in turn; of one stretch, the smallest."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs(words)
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{i},{length},{q}\n" for i, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kind, size = rng.random(), rng.randint(0, 90)
        if kind < 0.3:
            words = rng.choices("ab", k=size)
        elif kind < 0.45:
            words = fibonacci(size)
        elif kind < 0.5:
            words = ["a"] * size
        else:
            words = []
            while len(words) < size:
                part = rng.choices("abc", k=rng.randint(1, 12)) if rng.random() < 0.5 or not words else words[-rng.randint(1, 30):]
                words += part * rng.randint(1, 5)
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = "x"
        yield rng.choice(WS).join(words)


def test_all_runs_against_every_period():
    every = list(texts(1, 1500))
    for at in range(0, len(every), 7):
        part = every[at:at + 7]
        counts, rows, _ = runs_of_texts(pa.array(part))
        for text, n, got in zip(part, counts, rows):
            assert [tuple(r) for r in got.tolist()] == plain_runs(plain_words(text)) and n == len(plain_words(text))


def test_short_runs_too():
    for text in texts(2, 400):
        assert [tuple(r) for r in runs_of_texts(pa.array([text]), 2)[1][0].tolist()] == plain_runs(plain_words(text), 2)


def test_digests_of_a_table(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 120)))) for i in range(150)]
    rows += list(enumerate(texts(3, 60), 1000)) + [(None, "a b " * 20), (7, "x y z " * 9), (7, "x y z " * 9), (9, None), (10, ""), (11, " \n "), (12, "é\xa0é " * 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("runs", F.lit(2)).withColumn("n", F.lit(3))

    def altered(doc, words):
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 or not n:
            return words
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]

    got = report(periodic_runs(with_repeats(df))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key((i, *plain_row(altered(i, plain_words(t))))) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 10


def test_empty_table(spark):
    assert report(periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_very_long_texts_take_time_in_proportion():
    rng = random.Random(7)
    took = []
    for n in (100_000, 400_000):
        text = " ".join(rng.choices(["a", "b", "c"], k=n // 2) + ["d", "e", "f"] * (n // 6))
        start = time.time()
        _, rows, collapsed = runs_of_texts(pa.array([text]))
        took.append(time.time() - start)
        assert max(rows[0].tolist(), key=lambda r: r[1])[1:] == [n // 6 * 3, 3] and len(collapsed[0].as_py()) < len(text) // 2 + 100
    assert took[1] < 12 * took[0] + 1
