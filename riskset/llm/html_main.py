"""Main text of web pages, with the templates of their sites removed.

Every box of a page (an element that groups others: ``div``, ``section``, lists, tables ...) and every paragraph outside articles
is hashed with all that is below it. Spark counts on how many different pages of a host each hash occurs; those on ``MIN_PAGES`` or more
are the host's template and are deleted with all that is in them. Each page gets only the recurring hashes it holds itself.

What a page says about itself is used as well. Elements whose tag or role marks them as navigation, forms and the like go, and those
hidden. Class and id words weigh less: a word that also names content (``related``, ``share``) counts only where links make up
half of the text, and no word but those for reader comments removes a wrapper that holds most of a page's text, if there is no
``article`` or ``main`` beside it. ``main`` and ``article`` are hints too: a character there weighs ``HINT`` characters elsewhere, and the
text is taken from there alone if it outweighs the rest.

Defined results: a null or empty page, or one of which nothing is left, has the empty text. A page without a host in its
url keeps its boxes, since nothing says which site's they are. Repeated rows give a row each; exact copies of a page count
once. A box that holds most of an article's text stays though it recurs: the page is a copy. An empty table
gives no rows. A very long or deeply nested page is read whole, in time proportional to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import left_counted, stored, task_batch, text_slices
from riskset.llm.html_tree import BLOCK, Node, parse, squeeze, subtree_hashes, walk

MIN_PAGES = 5  #: different pages of a host from which on a box or paragraph is its template
HINT = 4
BROADCAST_BOXES = 500_000

BOXES = frozenset("div section aside nav header footer ul ol dl table form fieldset details dialog menu address center".split())
COUNTED = BOXES | {"p"}
DROPPED = frozenset("""head script style noscript template iframe object embed svg canvas math audio video map form button input
select textarea datalist nav footer aside menu dialog title search noembed noframes applet""".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_MARK = re.compile(r"""(?:^|[_-])(?:ads?|adverts?|advertisement|advertising|adsense|adbox|adslot|banner|sponsor(?:ed|s)?|promo(?:tion|s)?
|cookies?|consent|gdpr|notice|notices|notification|alert|popup|pop-up|modal|overlay|paywall|nav|navbar|navigation|menu|menus|breadcrumbs?
|topbar|masthead|site-?header|page-?header|site-?footer|page-?footer|footer|sidebar|side-?bar|aside|widgets?|teasers?
|share-?bar|newsletter|subscribe|subscription|signup|sign-?up|login|log-?in|pagination|pager|toolbar|skip-?link)(?=$|[_-])""", re.I | re.X)
_COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|comment-?list|respond|replies|reply|disqus)(?=$|[_-])", re.I)
#: words that name content as often as its surroundings
_WEAK = re.compile(r"(?:^|[_-])(?:related|recommend(?:ed|ations?)?|share|sharing|social|search|rail|copyright|disclaimer)(?=$|[_-])", re.I)
_HEADER = re.compile(r"(?:^|[_-])header(?=$|[_-])", re.I)
_STATES = ("has-", "has_", "no-", "no_", "with-", "with_", "without-", "without_")  #: what a wrapper holds, not what it is
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_COUNTED = pa.schema([("host", pa.string()), ("page", pa.int64()), ("box", pa.int64())])
_ANY = 0  #: stands for the page itself


def host_of(url: str | None) -> str | None:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else None


def _gone(node: Node, in_article: bool) -> bool:
    """Whether tag, role or style say that the element isn't main text, or its names that it holds comments."""
    if node.tag in DROPPED or node.tag == "header" and not in_article:
        return True
    attrs = node.attrs
    if not attrs:
        return False
    if attrs.get("role", "").strip().lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return bool(_HIDDEN.search(attrs.get("style", ""))) or any(_COMMENTS.search(x) for x in _names(node))


def _names(node: Node) -> list[str]:
    if not node.attrs:
        return []
    found = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split()
    return [x for x in found if not x.lower().startswith(_STATES)]


def _sizes(root: Node, gone: set[int]) -> dict[int, tuple[int, int]]:
    """By the element's ``id()``: characters of text, and those in links, that are below it and not in ``gone``."""
    out: dict[int, tuple[int, int]] = {}
    for node, leaving in walk(root):
        if leaving:
            chars = linked = 0
            for c in node.children if id(node) not in gone else ():
                a, b = out[id(c)] if isinstance(c, Node) else (len(squeeze(c)), 0)
                chars, linked = chars + a, linked + b
            out[id(node)] = chars, chars if node.tag == "a" else linked
    return out


def _deleted(root: Node, template: frozenset[int] | set[int]) -> set[int]:
    """``id()`` of the elements that go with all that is below them."""
    keep = _holds_article(root)
    hashes = subtree_hashes(root) if template else {}
    sure: set[int] = set()
    recurring: list[tuple[Node, Node | None]] = []
    articles: list[Node] = []
    for node, leaving in walk(root):
        if node.tag == "article":
            if leaving:
                articles.pop()
            else:
                articles.append(node)
        if leaving or id(node) in keep and node.tag != "article":
            continue
        if _gone(node, bool(articles)):
            sure.add(id(node))
        elif id(node) not in keep and node.tag in COUNTED and template and hashes[id(node)][0] in template:
            recurring.append((node, articles[-1] if articles else None))
    sizes = _sizes(root, sure) if recurring else {}
    sure.update(id(n) for n, article in recurring if article is None or 2 * sizes[id(n)][0] <= sizes[id(article)][0])
    sizes = _sizes(root, sure)
    total = sizes[id(root)][0]
    hinted = any(n.tag in ("article", "main") and sizes[id(n)][0] for n, leaving in walk(root) if leaving)
    inside = 0
    for node, leaving in walk(root):
        if node.tag == "article":
            inside += -1 if leaving else 1
        if leaving or id(node) in sure or id(node) in keep and node.tag != "article":
            continue
        names = _names(node)
        if not names:
            continue
        chars, linked = sizes[id(node)]
        if any(_MARK.search(x) for x in names) or not inside and any(_HEADER.search(x) for x in names):
            if hinted and node.tag != "article" or 2 * chars <= total:
                sure.add(id(node))
        elif 2 * linked >= chars and any(_WEAK.search(x) for x in names):
            sure.add(id(node))
    return sure


def _holds_article(root: Node) -> set[int]:
    """``id()`` of the elements that are or hold an article or the page's main part."""
    out, path = set(), []
    for node, leaving in walk(root):
        if leaving:
            path.pop()
            continue
        path.append(id(node))
        if node.tag in ("article", "main", "body"):
            out.update(path)
    return out


def boxes(root: Node) -> set[int]:
    """Hashes of the page's boxes with text, and of its paragraphs outside articles."""
    hashes, keep = subtree_hashes(root), _holds_article(root)
    out, inside = set(), 0
    for node, leaving in walk(root):
        if node.tag == "article":
            inside += -1 if leaving else 1
        if leaving and node.tag in COUNTED and id(node) not in keep and hashes[id(node)][1] and not (inside and node.tag == "p"):
            out.add(hashes[id(node)][0])
    return out - {_ANY}


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text, one line for each block; ``template`` holds the hashes of boxes to delete."""
    if not page:
        return ""
    root = parse(page)
    gone = _deleted(root, template)
    lines: list[tuple[str, bool, bool]] = []  # (text, in main, in an article)
    current: list[str] = []
    level = {"article": 0, "main": 0}

    def end() -> None:
        if line := squeeze("".join(current)):
            lines.append((line, level["main"] > 0, level["article"] > 0))
        current.clear()

    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            current.append(node)
            continue
        if leaving:
            end()
            if node.tag in level:
                level[node.tag] -= 1
            continue
        if node.tag == "br":
            current.append(" ")
            continue
        if id(node) in gone:
            if node.tag in BLOCK:
                end()
            continue
        if node.tag in BLOCK or node.tag == "#page":
            end()
            if node.tag in level:
                level[node.tag] += 1
            todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children))
    end()
    for hint in (1, 2):  # main, then the articles in what is left
        chosen = [x for x in lines if x[hint]]
        weight = sum(len(x[0]) for x in chosen)
        if chosen and HINT * weight >= sum(len(x[0]) for x in lines) - weight:
            lines = chosen
    return "\n".join(x[0] for x in lines)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "html"):
        out: dict[str, list] = {"host": [], "page": [], "box": []}
        for host, page, html in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), part.column("html")):
            found = {_ANY} | (boxes(parse(html.as_py())) if html.is_valid else set())
            out["host"] += [host] * len(found)
            out["page"] += [page] * len(found)
            out["box"] += found
        yield task_batch(out, _COUNTED)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, page, boxes, n): the recurring hashes that each different page holds itself, and the number of its copies.

    ``pages`` has (host, page, html), a row for each page; ``page`` is a hash of the html. Hosts are not null.
    """
    held = stored(pages.select("host", "page", "html").mapInArrow(_count, "host string, page long, box long")
                  .groupBy("host", "page", "box").agg(F.count("*").alias("copies")), "boxes")
    often = held.groupBy("host", "box").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    often = stored(often.withColumn("recurs", F.lit(True)), "recurring")
    box = F.when(F.col("recurs") & (F.col("box") != _ANY), F.col("box"))
    return (left_counted(held, often, ["host", "box"]).groupBy("host", "page")
            .agg(F.collect_set(box).alias("boxes"), F.max("copies").alias("n")))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    host = F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.when(host != "", host).alias("host"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumn("page", F.xxhash64("html"))
    known = rows.filter("host is not null")
    found = stored(templates(known, min_pages), "templates")
    some = found.filter(F.size("boxes") > 0)
    held = some.agg(F.sum(F.size("boxes") + 1)).first()[0] or 0
    if held <= BROADCAST_BOXES:
        joined = rows.join(F.broadcast(some), ["host", "page"], "left")
    else:  # a page may have many copies
        nowhere = rows.filter("host is null").withColumn("boxes", F.lit(None).cast("array<long>"))
        joined = left_counted(known, found, ["host", "page"]).unionByName(nowhere)
    schema = f"page_id {dict(pages.dtypes)[id_col]}, url string, text string"
    out = joined.select("page_id", "url", "html", "boxes").mapInArrow(_extract, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "html"):
        texts = []
        for html, gone in zip(part.column("html"), part.column("boxes")):
            texts.append(main_text(html.as_py(), frozenset(gone.as_py()) if gone.is_valid else frozenset()))
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])
