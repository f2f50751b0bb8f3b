import random
import time

import pytest

from riskset.llm import html_main
from riskset.llm.html_main import boxes, extract_main_text, host_of, main_text
from riskset.llm.html_tree import parse, subtree_hashes, walk


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain <b>text</b>", "plain text"),
    ("<p>one<p>two<br>half<ul><li>a<li>b</ul>tail", "one\ntwo half\na\nb\ntail"),
    ("a < b & c &lt;p&gt; &eacute; &#x41; &amp &unknown; &am", "a < b & c <p> é A & &unknown; &am"),
    ("<nav>menu</nav><header>top</header><article><h1> T\n x </h1><p>body</article><footer>end</footer>", "T x\nbody"),
    ("<article><p><b>x<br><p>y</p></article>", "x\ny"),
    ("<article>in<div class='ad box'>ad</div><section id=comments>c</section><form>f</form></article>out", "in"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>c</p> --><p>t", "t"),
    ("<div class='has-sidebar'><article class='post'><div class='entry-header'><h1>H</h1></div>x</article></div>", "H\nx"),
    ("<p>open <!-- never closed", "open"), ("<p>cut <a hre", "cut"), ("<div hidden>h</div><p aria-hidden=true>i</p>v", "v"),
    ("<b><p>x</b>y</p>z", "xy\nz"),
    ("<main><p>m</p></main><p>n</p>", "m"), ("<TITLE>t</TITLE><P>up", "up"),
    ("<main><p>The real text\u2026</p></main><article class='card'><p>teaser</p></article>", "The real text\u2026"),
    ("<div class='content has-sidebar'><p>long main text</p></div>", "long main text"),
    ("<article><p>t</p><section class='related work'><p>real</p></section><div id='share-index'>x</div></article>", "t\nreal\nx"),
    ("<article><p>text</p><div class=related><a>one</a> <a>two</a></div></article>", "text"),
    ("<p>a text of some length here</p><article class=post>so</article>", "a text of some length here\nso"),
    ("<div class='page-nav wrap'><p>most of the text is here</p></div><div class=menu>few</div>", "most of the text is here"),
    ("<div class=comments><p>readers write much more than that</p></div><p>body</p>", "body"),
    ("<article>text</article><div class=notice>a notice that is longer than the text itself</div>", "text"),
])
def test_main_text(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 50_000 + "x" + "</b>" * 1000) == "x"
    assert main_text("<p>word</p>" * 20_000).count("\n") == 19_999
    assert main_text("<a b='" * 2000) == ""
    start = time.perf_counter()
    assert main_text("<p><button>" + "<h1>" * 64_000 + "x") == ""
    assert main_text("<ul>" + "<li><div>" * 64_000 + "x") == "x"
    assert time.perf_counter() - start < 20  # quadratic work would take many minutes


def test_hashes_see_all_that_is_below():
    a, b, c = (parse(x) for x in ("<div><p>x</p></div>", "<div> <p> x </p></div>", "<div><p>y</p></div>"))
    top = [subtree_hashes(t)[id(next(n for n, _ in walk(t) if n.tag == "div"))][0] for t in (a, b, c)]
    assert top[0] == top[1] != top[2]
    assert len(boxes(parse("<div>a</div><div>a</div><section>b</section><div></div><article><p>c</article>"))) == 2


def test_hosts():
    urls = ["http://A.b:80/x", "x", "//c.d?e", None, "https://u:p@h.com/", ""]
    assert [host_of(u) for u in urls] == ["a.b", None, "c.d", None, "h.com", None]


def pages(n, extra="<div class=x1>Same on all pages</div>"):
    return [(i, f"http://one.com/{i}", f"<body>{extra}<div class=t><p>Text {i}</p><p>cookie sentence</p></div></body>") for i in range(n)]


@pytest.mark.parametrize("limit", [html_main.BROADCAST_BOXES, 0])
def test_recurring_boxes_go_by_host(spark, monkeypatch, limit):
    """Also where the templates are joined and not broadcast."""
    monkeypatch.setattr(html_main, "BROADCAST_BOXES", limit)
    rows = pages(20) + [(100, "http://two.com/", "<div class=x1>Same on all pages</div>own"), (101, None, "<p>n</p>"),
                        (102, "http://one.com/a", None), (103, "http://one.com/b", ""), (103, "http://one.com/b", "")]
    got = {(r.page_id, r.text, r.n_chars) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {(i, f"Text {i}") for i in range(20)} | {(100, "Same on all pages\nown"), (101, "n"), (102, ""), (103, "")}
    assert got == {(i, t, len(t)) for i, t in want}


def test_boxes_on_many_pages_go_whatever_the_hosts_size(spark):
    """Five of 300 pages have the menu of one section; a box on four pages stays."""
    section, few = "<div class=x1>Section list</div>", "<div class=x2>Seen four times</div>"
    rows = [(i, f"http://one.com/{i}", f"<body>{section * (i < 5)}{few * (i >= 296)}<p>Text {i}</p></body>") for i in range(300)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("Seen four times\n" if i >= 296 else "") + f"Text {i}" for i in range(300)}


@pytest.mark.parametrize("limit", [html_main.BROADCAST_BOXES, 0])
def test_against_plain_counts_over_hosts(spark, monkeypatch, limit):
    """Pages of random boxes and paragraphs: what is on five different pages of a host goes, there and nowhere else."""
    monkeypatch.setattr(html_main, "BROADCAST_BOXES", limit)
    rng = random.Random(3)
    stock = [(t, f"{t} text {i}") for i in range(40) for t in ("div", "p", "section", "h2")]
    pages, parts = [], {}
    for i in range(200):
        host = "hot.org" if i % 3 == 0 else f"h{rng.randrange(6)}.org"
        held = [("p", f"own {i if i % 10 else 0}")] + rng.sample(stock, rng.randrange(12))
        rng.shuffle(held)
        parts[i] = host, held
        pages.append((i, f"https://{host}/{i}", "".join(f"<{t}>{x}</{t}>" for t, x in held)))
    pages += [(1000 + i, "https://hot.org/copy", pages[0][2]) for i in range(30)]  # copies count once
    parts |= {1000 + i: ("hot.org", parts[0][1]) for i in range(30)}
    on: dict = {}
    for host, held in parts.values():
        for part in held:
            on.setdefault((host, part), set()).add(tuple(held))
    want = {i: "\n".join(x for t, x in held if t == "h2" or len(on[host, (t, x)]) < html_main.MIN_PAGES) for i, (host, held) in parts.items()}
    got = extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(pages)
    assert sum(w.count("\n") + 1 for w in want.values()) < sum(len(held) for _, held in parts.values())


def test_a_page_carries_only_its_own_templates(spark):
    rows = [("h", i, f"<div>menu {i % 20}</div><p>text {i}</p>") for i in range(200)]
    got = html_main.templates(spark.createDataFrame(rows, "host string, page long, html string")).collect()
    assert {r.page for r in got} == set(range(200)) and all(len(r.boxes) == 1 for r in got)


def test_articles_stay_though_they_recur(spark):
    rows = [(i, "http://a.b/", "<article><p>same</p></article>") for i in range(30)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 30 and {r.text for r in got} == {"same"}


def test_empty_and_clashing_columns(spark):
    schema = "page_id string, url string, html string, host int, boxes int, text int"
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []
    got = extract_main_text(spark.createDataFrame([("p", "http://a/", "<p>ü</p>", 1, 2, 3)], schema)).collect()
    assert [tuple(r) for r in got] == [("p", "http://a/", "ü", 1)]
