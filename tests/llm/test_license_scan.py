import random
import re

from pyspark.sql import functions as F

from riskset.llm.licences import PHRASES, TEMPLATES
from riskset.llm.license_scan import MAX_GAP, MIN_RUN, Automaton, automaton, scan_licences, scan_text, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_places(text):
    words = plain_words(text)
    return sorted((i, label) for phrase, label in PHRASES for i in range(len(words))
                  if words[i:i + len(phrase.split())] == phrase.split())


def texts(seed=3, n=300):
    rng = random.Random(seed)
    vocab = "the of cc by general public license all rights reserved gnu mit under licensed to Ünï café 4 0 x9".split()
    return ["".join(w + rng.choice([" ", "-", ". ", "\n", "\x7f"]) for w in rng.choices(vocab, k=rng.randint(0, 120))) for _ in range(n)]


def test_words():
    for t in ["Ab-c1\x00d\x7fÉé’x", "", None, "a\xa0b", "🙂x y", "A_Z[z]{q}"]:
        assert [w.decode() for w in words_of(t)] == plain_words(t)


def brute_runs(words, templates):
    """(end, words, template, position after) of every run of MIN_RUN words that can't be extended, by trying all places."""
    out = []
    for t, held in enumerate(templates):
        for i in range(len(words)):
            for j in range(len(held)):
                if words[i] == held[j] and (i == 0 or j == 0 or words[i - 1] != held[j - 1]):
                    n = 1
                    while i + n < len(words) and j + n < len(held) and words[i + n] == held[j + n]:
                        n += 1
                    if n >= MIN_RUN:
                        out.append((i + n, n, t, j + n))
    return sorted(out)


def brute_shares(runs, templates):
    """By template the largest share that a chain of runs covers: every run may follow every run that ends before it does."""
    covered, best = {}, {}
    for end, n, t, to in runs:
        most = n
        for (e, m, u, at), c in covered.items():
            both = max(0, at - (to - n), e - (end - n))
            if u == t and e < end and at <= to and end - n - e <= MAX_GAP and to - n - at <= MAX_GAP and both < n:
                most = max(most, c + n - both)
        covered[end, n, t, to] = most
        best[t] = max(best.get(t, 0), most / len(templates[t]))
    return best


def test_runs_and_shares_against_brute_force():
    auto = automaton()
    templates = [words_of(t) for _, t in TEMPLATES]
    rng = random.Random(4)
    cut = []
    for _ in range(60):  # pieces of templates with words lost, put in and doubled
        words = []
        for t in rng.choices(templates, k=3):
            piece = t[rng.randrange(3):] if rng.random() < 0.7 else t[rng.randrange(len(t)):]
            words += [w for w in piece if rng.random() < 0.95] + [b"noise"] * rng.randrange(3)
        cut.append(words)
    for words in [words_of(t) for t in texts(n=40)] + cut:
        runs = auto.scan(words)[1]
        assert sorted((end, n, t, to) for end, _, over in runs for n, t, to in over) == brute_runs(words, templates)
        assert [r[0] for r in runs] == sorted({r[0] for r in runs})
        assert {t: s[0] for t, s in auto.spans(runs).items()} == brute_shares(brute_runs(words, templates), templates)


def test_a_template_inside_anothers_longer_run_is_found():
    """The second half of A stands where B holds it too, after a word of B."""
    first, second = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    templates = [("A", f"{first} x {second}"), ("B", f"y {second} " + " ".join(f"c{i}" for i in range(30)))]
    both, alone = Automaton(templates, []), Automaton(templates[:1], [])
    for text in (f"{first} y {second}", f"{first} y {second} c0 c1 c2"):
        assert scan_text(text, both)["labels"] == scan_text(text, alone)["labels"] == "A"


def test_places_against_brute_force(spark):
    rows = list(enumerate(texts() + [None, "", "--", "All Rights\nRESERVED", "cc by cc by", "word " * 200_000 + "CC-BY"]))
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("score", F.lit("s"))
    got = scan_licences(df).collect()
    assert len(got) == len(rows) + 2
    want = dict(rows)
    for r in got:
        places = brute_places(want[r.doc_id])
        assert (r.n_words, r.n_base) == (len(plain_words(want[r.doc_id])), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = sorted({label for _, label in places})
        assert r.base_labels == ",".join(base)
        assert set(base) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score >= 0.75) == bool(r.labels)


def test_templates_are_found_whole_changed_and_apart():
    for label, text in TEMPLATES:
        noise = "some other words here " * 5
        assert label in scan_text(noise + text.upper() + noise)["labels"].split(",")
    words = TEMPLATES[2][1].split()
    for k in range(9, len(words), 20):
        words[k] = "changed"
    found = scan_text("before " + " ".join(words) + " after")
    assert found["labels"] == "mit" and 0.75 <= found["score"] < 1
    assert found["spans"][0]["first"] == 1
    assert scan_text("licensed under the terms of the contract")["labels"] == ""
    apart = TEMPLATES[0][1].split()
    assert scan_text(" ".join(apart[:2]) + " filler" * 30 + " " + " ".join(apart[2:]))["labels"] == ""


def test_a_run_of_one_template_repeated():
    text = "Released under the MIT License. " * 2000
    assert scan_text(text)["labels"] == "mit" and scan_text(text)["score"] == 1.0


def test_empty_table_and_own_templates(spark):
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    auto = Automaton([("one", "a b c d e f"), ("two", "a b x y c d e f")], [("b c", "bc")])
    got = scan_text("a b x y c d e f", auto)
    assert got["labels"] == "two" and got["score"] == 1.0 and scan_text("q b c", auto)["base_labels"] == "bc"
