import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskset.llm import url_filter
from riskset.llm.url_filter import LEXICAL, RULES, judge, lexical_features

PAGES = "page_id long, url string"


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules=RULES):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "http://acom/", "http://xexample.com/en/1", "http://example.com/en/1",
        "http://m.example.com/en/1", "http://www.example.com/en/1", "http://m.www.example.com/en/", "http://example.com/en", "http://a.net/es/1?x=/", "http://a.net?/es/",
        "http://a.net#/fr/", "http://net/fr/", "http://É.net/es/É", "x://y://z.com/a", "http://ex ample.com/\n/en", "http://a.org/" + "p/" * 30_000,
        "http://[::1]/x", "http://a.net/ES/", "://com/"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] * 2 + [(None, URLS[6])]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1)).withColumn("rule", F.lit("x")).withColumn("label", F.lit("y"))
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = judge(df, none).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *plain(u), *(plain_rule(*plain(u)) or (None, "allow"))) for i, u in rows)
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == sorted(want, key=lambda r: r[:3])
    assert {r.score for r in got if r.rule is None} == {0.0} and {r.score for r in got if r.rule} == {None}


def test_labels_of_one_kind_and_empty_table(spark):
    one = spark.createDataFrame([("http://a.org/1", True), ("http://b.org/1", True), ("http://b.org/1", None)], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://c.org/")], PAGES)
    assert [r.verdict for r in judge(pages, one).collect()] == ["block"]
    assert judge(pages.limit(0), one).collect() == []


def test_features_against_their_definitions():
    urls = ["http://a1b.example.com/x/yy/12345?q=1&r=22", "", "no scheme 77", "http://é--.org", "http://h.net/" + "7" * 50_000]
    hosts, paths = zip(*[plain(u) for u in urls])
    got = lexical_features(pa.array(urls), pa.array(hosts), pa.array(paths))

    def entropy(raw):
        n = np.bincount(np.frombuffer(raw, np.uint8)) if raw else np.zeros(0)
        p = n[n > 0] / max(1, len(raw))
        return float(-(p * np.log2(p)).sum())

    for row, u, h, p in zip(got, urls, hosts, paths):
        f = dict(zip(LEXICAL, row))
        raw = u.encode()
        digits = [48 <= b <= 57 for b in raw]
        runs = "".join("d" if x else " " for x in digits).split()
        assert f["url_chars"] == len(raw) and f["host_chars"] == len(h.encode()) and f["path_chars"] == len(p.encode())
        assert f["depth"] == p.count("/") and f["parameters"] == u.count("=") and f["labels"] == (h.count(".") + 1 if h else 0)
        assert f["digit_share"] == pytest.approx(sum(digits) / max(1, len(raw)))
        assert f["digit_run"] == max(map(len, runs), default=0)
        assert f["entropy"] == pytest.approx(entropy(raw), abs=1e-9) and f["host_entropy"] == pytest.approx(entropy(h.encode()), abs=1e-9)
        assert f["host_mark_share"] == pytest.approx(h.count("-") / max(1, len(h.encode())))


def web(n, seed):
    """(url, bad): bad ones have many digits and parameters, or lie under one suffix."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.4
        word = lambda k: "".join(rng.choices("aeioulnrst", k=k))
        if bad and rng.random() < 0.5:
            url = f"http://{word(3)}{rng.randint(10**6, 10**9)}.example.org/{rng.randint(1, 10**9)}?a={rng.randint(1, 10**6)}&b={word(2)}&c=1"
        elif bad:
            url = f"http://{word(6)}.deals.example.org/{word(5)}/{word(7)}"
        else:
            url = f"https://{word(6)}.press.example.org/{word(4)}/{word(8)}" + rng.choice(["", "?page=2"])
        out.append((url, bad))
    return out


def test_held_out_urls_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", 50)  # the split join, with a hot host
    known, asked = web(1500, 1), web(600, 2) + [("http://hot.press.example.org/a/b", False)] * 300
    labelled = spark.createDataFrame([(u, b) for u, b in known], "url string, blocked boolean")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(asked)], PAGES)
    got = judge(pages, labelled, train_rows=1000).collect()
    assert len(got) == len(asked)
    right = sum((r.verdict == "block") == asked[r.page_id][1] for r in got)
    assert right / len(asked) >= 0.97


def test_a_training_row_does_not_see_its_own_fold(spark):
    rows = [("a.example.org", 0, 1, 1, 1), ("a.example.org", 1, 1, 1, 0), ("b.example.org", 0, 1, 0, 0)]
    hosts = spark.createDataFrame(rows, "host string, fold int, n long, labelled long, blocked long")
    got = {(r.host, r.fold): r for r in url_filter.suffix_statistics(hosts).collect()}
    prior = url_filter.PRIOR
    assert len(got) == 2 * (url_filter.FOLDS + 1)
    assert got["a.example.org", -1].blocked_1 == pytest.approx((1 + prior * 0.5) / (2 + prior))
    assert got["a.example.org", 0].blocked_4 == pytest.approx((0 + prior * 0.5) / (1 + prior))
    assert got["b.example.org", 1].blocked_3 == pytest.approx(0.5) and got["b.example.org", 1].blocked_2 == pytest.approx((1 + prior * 0.5) / (1 + prior))
    assert got["b.example.org", -1].seen_4 == pytest.approx(np.log(2))
