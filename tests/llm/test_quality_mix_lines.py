import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskset.llm import line_dedup, line_quality, mixing
from riskset.llm.common import WS_CHARS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["#", "é|x", "a<b>", "Ünï", "\x85", "\xa0q"]
    common = ["Shared LINE over many documents of one host", "  shared line over many\tdocuments of one host "]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), common[i % 4 // 2])
        if i % 7 == 0:
            lines += lines[:2]
        rows.append((i, "\n".join(lines), "en", rng.choice(["src0"] * 3 + ["src1", "Ärc", None]), 0))
    rows += [(500, None, None, "src0", None), (501, "", "en", None, 0), (502, " \n\t\n", "en", "none", 0), (503, "a b c " * 40, "en", "src0", 0),
             (503, "a b c " * 40, "en", "src0", 0), (504, common[0], "en", "src0", 0), (505, "x\n" * 3000, "en", "src1", 0), (None, "null id\nshared line over many documents of one host", "en", "src0", 0)]
    rows += [(600 + i, rows[3][1], "en", rows[3][3], 0) for i in range(30)]  # exact copies
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("h")).withColumn("key", F.lit(1)).withColumn("own", F.lit(2)).withColumn("copies", F.lit(0))


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def normal(line):
    return " ".join(WORD.findall(line)).translate(LOWER)


def brute_quality(rows, max_docs, share, many):
    texts, docs = {}, {}
    for _, text, _, host, _ in rows:
        docs.setdefault(host, set()).add(text or "")
        for line in (text or "").split("\n"):
            if normal(line):
                texts.setdefault((host, normal(line)), set()).add(text)
    often = {k for k, v in texts.items() if len(v) > max_docs and (len(v) > share * len(docs[k[0]]) or len(v) > many)}
    out = []
    for doc, text, _, host, _ in rows:
        n, *rest = base(text)
        left = [x for x in (text or "").split("\n") if (host, normal(x)) not in often]
        failed = n < 50 or 100 * rest[-1] > 50 * n
        out.append(((doc, n, *rest, failed, not failed and sum(len(WORD.findall(x)) for x in left) >= 0.5 * n), "\n".join(left)))
    return out


@pytest.mark.parametrize("limit", [line_quality.BROADCAST_LINES, 0])
def test_quality_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(line_quality, "BROADCAST_LINES", limit)
    notice = " ".join(f"n{i}" for i in range(55))
    rows = corpus() + [(800 + i, f"{notice}\nown words {i}" + " more" * (i % 3) + f" z{i}" * (i % 5 > 3) * 90, "en", "long", 0) for i in range(30)]
    # in a large host, a notice on 25 documents of 230 is above the absolute limit alone, another on 18 is below it
    rows += [(900 + i, f"{notice if i < 25 else 'other ' + notice if i < 43 else ''}\nlarge host {i}" + f" q{i}" * 30, "en", "large", 0) for i in range(230)]
    df = frame(spark, rows).repartition(4)
    want = brute_quality(rows, 15, 0.2, 20)
    assert not any(w[-1] for (w, _), r in zip(want, rows) if r[3] == "large" and r[0] < 925) and all(w[-1] for (w, _), r in zip(want, rows) if r[3] == "large" and 925 <= r[0] < 943)
    got = line_quality.judge(df, max_docs=15, max_share=0.2, many_docs=20)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == sorted((w for w, _ in want), key=str)
    kept = line_quality.keep_good(df, max_docs=15, max_share=0.2, many_docs=20)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((w[0], t) for w, t in want if w[-1]), key=str)
    assert any(w[-1] for w, _ in want) and any(not w[-1] and not w[-2] for w, _ in want)


def brute_mix(rows):
    size = {}
    for _, text, _, source, _ in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(size.values()))
    while free:
        share = rest / sum(weight[s] for s in free)
        stop = {s for s in free if share * weight[s] > 3 * size[s]}
        if not stop:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in stop}
        rest -= sum(3 * size[s] for s in stop)
        free -= stop
    return size, target


@pytest.mark.parametrize("limit", [mixing.BROADCAST_ROWS, 0])
def test_mix_targets_and_draws(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    rows = corpus(n=400) + [(700, "word " * 3, "en", "tiny", 0), (701, "word", "en", "small", 0)]
    size, target = brute_mix(rows)
    df = frame(spark, rows)
    got = mixing.report(df).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
    by = {}
    for r in got:
        assert (r.source_size, r.target) == (size[r.source], pytest.approx(target[r.source]))
        assert r.size * 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        rate = min(3.0, target[r.source] / size[r.source]) if size[r.source] else 1.0
        assert not r.size or r.taken // r.size in (int(rate), int(rate) + (rate > int(rate)))
        by[r.source] = by.get(r.source, 0) + r.taken
    assert by["src0"] == pytest.approx(target["src0"], rel=0.25)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.report(df.repartition(5)).join(df.select("doc_id", "source").distinct(), "doc_id").collect()), key=str)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text or ""))
    whole = mixing.copies(df, keep=["doc_id", "source"]).groupBy("own.source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert {r.source: r.n for r in whole if r.n} == {k: v for k, v in taken.items() if v}


def brute_lines(rows, min_chars=10, min_docs=2):
    held = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            held.setdefault(line.strip(WS_CHARS).translate(LOWER), set()).add(doc)
    first = {k: min((d for d in v if d is not None), default=None) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if (k := x.strip(WS_CHARS).translate(LOWER)) not in first or first[k] == doc]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("hot", [line_dedup.HOT_KEYS, 20])
def test_line_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    rows = [r for r in corpus(seed=9) if r[0] != 503] + [(503, "Only one\nreally only one", "en", "src0", 0)]
    df = frame(spark, rows).repartition(4)
    want = brute_lines(rows)
    got = line_dedup.report(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in want), key=str)
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((d, t) for d, _, _, t in want), key=str)


def test_rows_with_one_id_are_one_document(spark):
    rows = [(1, "a repeated line", "en", "s", 0), (1, "a repeated line", "en", "s", 0)]
    assert [r.n_dropped for r in line_dedup.report(frame(spark, rows)).collect()] == [0, 0]


def test_empty_tables(spark):
    df = frame(spark, [])
    for out in (line_quality.judge(df), line_quality.keep_good(df), mixing.report(df), mixing.mix(df), line_dedup.report(df), line_dedup.drop_repeated_lines(df)):
        assert out.collect() == []


def test_native_operators_run_no_python(spark):
    df = frame(spark, corpus(n=10))
    for out in (mixing.report(df), mixing.mix(df), line_dedup.report(df), line_dedup.drop_repeated_lines(df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_many_lines_of_one_text(spark):
    rows = [(1, "\n".join(f"line number {i}" for i in range(30_000)), "en", "s", 0), (2, "\n".join(f"Line number {i}" for i in range(0, 60_000, 2)), "en", "s", 0)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.report(frame(spark, rows)).collect()}
    assert got == {1: (30_000, 0), 2: (30_000, 15_000)}
