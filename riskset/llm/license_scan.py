"""Licence texts in documents, by matching statistics against a generalised suffix automaton.

The automaton accepts every run of words of all templates and phrases together. A document's words are streamed through
it once: at every word it knows the longest run ending there that some template holds. Phrases are found where their
state lies on the suffix links of the current one, and so do shorter runs of other templates. Runs of at least ``MIN_RUN`` words
that no neighbouring word extends in their template are chained, in the order of
both text and template, over gaps of at most ``MAX_GAP`` words on either side; a template of which a chain covers at
least ``COVER`` gives its label. The score is the largest share of a template that is covered (1 where a phrase stands).

Words are runs of ASCII letters (lower-cased), digits and all characters from U+0080 on.

Defined results: a null, empty or wordless text has no words, no places, empty labels and score 0. Rows repeated with one
id are scanned each. An empty table gives no rows. Nothing is shuffled, and a text is read once, in time in proportion to its
length: the chains that a run may continue end at most ``MAX_GAP`` words before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import text_slices
from riskset.llm.licences import PHRASES, TEMPLATES

MIN_RUN = 4
MAX_GAP = 8
COVER = 0.75

_KEEP = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Automaton:
    """A generalised suffix automaton of token sequences, with what it needs to name phrases and template spans."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], min_run: int = MIN_RUN):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.min_run = [-1], [0], min_run
        self._places: dict[int, list] = {}
        self.templates = [(label, words_of(text)) for label, text in templates]
        sequences = [words for _, words in self.templates] + [words_of(p) for p, _ in phrases]
        if any(not s for s in sequences):
            raise ValueError("a template has no words")
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        #: by state: (template, position after the run) of every place where the state's runs end
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for t, (_, words) in enumerate(self.templates):
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                v = state
                while v > 0 and self.length[v] >= min_run:
                    self.ends[v].append((t, i + 1))
                    v = self.link[v]
        at: dict[int, list[tuple[int, str]]] = {}
        for p, label in phrases:
            state = 0
            for w in words_of(p):
                state = self.next[state][w]
            at.setdefault(state, []).append((len(words_of(p)), label))
        #: by state: (words, label) of the phrases that may end there
        self.phrases: list[tuple[tuple[int, str], ...]] = []
        for v in range(n):
            out, u = [], v
            while u > 0:
                out += at.get(u, [])
                u = self.link[u]
            self.phrases.append(tuple(out))

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state of the runs of ``q`` no longer than ``p``'s with ``w``; ``q`` itself if that is all of them."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:  # another sequence holds the run
            return self._split(last, self.next[last][w], w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def places(self, state: int) -> list[tuple[int, int, int, bytes | None]]:
        """(words, template, position after the run, template's next word) of every place of the state's runs and their suffixes.

        Each place has its longest run; 0 words stand for the whole run that is held.
        """
        found = self._places.get(state)
        if found is None:
            found, seen, v = [], set(), state
            while v > 0 and self.length[v] >= self.min_run:
                for t, to in self.ends[v]:
                    if (t, to) not in seen:
                        seen.add((t, to))
                        words = self.templates[t][1]
                        found.append((0 if v == state else self.length[v], t, to, words[to] if to < len(words) else None))
                v = self.link[v]
            self._places[state] = found
        return found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, list[tuple[int, int, int]]]]]:
        """(start, label) of every phrase place; (end, words held, [(words, template, position after the run)]) by rising end.

        A run of at least ``min_run`` words is listed where no neighbouring word extends it in its template.
        """
        edges, link, length, named = self.next, self.link, self.length, self.phrases
        root, places, runs = edges[0], [], []
        state = held = 0

        def end(at: int, w: bytes | None) -> None:
            if over := [(n or held, t, to) for n, t, to, after in self.places(state) if w is None or after != w]:
                runs.append((at, held, over))

        for i, w in enumerate(words):
            if held >= self.min_run:
                end(i, w)
            if w in edges[state]:
                state = edges[state][w]
                held += 1
            elif not state and w not in root:
                continue
            else:
                while state and w not in edges[state]:
                    state = link[state]
                held = length[state] if state else 0
                if w in edges[state]:
                    state = edges[state][w]
                    held += 1
            if named[state]:
                places += [(i + 1 - n, label) for n, label in named[state] if n <= held]
        if held >= self.min_run:
            end(len(words), None)
        return places, runs

    def spans(self, runs: list[tuple[int, int, list[tuple[int, int, int]]]]) -> dict[int, tuple[float, int, int]]:
        """By template: (largest share covered by one chain, the chain's first word, the word after its last)."""
        open_chains: dict[int, list[tuple[int, int, int, int]]] = {}  # (text end, template end, covered, text start)
        best: dict[int, tuple[float, int, int]] = {}
        for end, held, over in runs:
            fresh: dict[int, list] = {}
            for n, t, to in over:
                start, begin = end - n, to - n
                if t not in fresh:  # no later run begins before the one held
                    open_chains[t] = [c for c in open_chains.get(t, ()) if end - held - c[0] <= MAX_GAP]
                covered, first = n, start
                for c_end, c_to, c_covered, c_first in open_chains[t]:
                    # a run may begin inside the last one; what both cover counts once
                    both = max(0, c_to - begin, c_end - start)
                    if (start - c_end <= MAX_GAP and c_to <= to and begin - c_to <= MAX_GAP and both < n
                            and c_covered + n - both > covered):
                        covered, first = c_covered + n - both, c_first
                fresh.setdefault(t, []).append((end, to, covered, first))
                share = covered / len(self.templates[t][1])
                if share > best.get(t, (0.0,))[0]:
                    best[t] = (share, first, end)
            for t, chains in fresh.items():
                open_chains[t] += chains
        return best


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(TEMPLATES, PHRASES)


def scan_text(text: str | None, auto: Automaton | None = None) -> dict:
    auto = auto or automaton()
    words = words_of(text)
    places, runs = auto.scan(words)
    starts = [s for s, _ in places]
    base = sorted({label for _, label in places})
    spans = auto.spans(runs) if runs else {}
    found = {auto.templates[t][0]: s for t, s in sorted(spans.items(), key=lambda x: x[1][0]) if s[0] >= COVER}
    shares = [s[0] for s in spans.values()] + [1.0] * bool(places)
    return {"n_words": len(words), "n_base": len(places), "first_word": min(starts) if starts else None,
            "last_word": max(starts) if starts else None, "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *found})), "score": min(1.0, max(shares)) if shares else 0.0,
            "spans": [{"label": k, "first": s[1], "until": s[2], "share": min(1.0, s[0])} for k, s in sorted(found.items())]}


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                  ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                  ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("until", pa.int64()), ("share", pa.float64())])))])
_DDL = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first:long,until:long,share:double>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = automaton()
    for part in text_slices(batches):
        rows = [scan_text(text.as_py(), auto) for text in part.column("text")]
        columns = [pa.array([r[f.name] for r in rows], f.type) for f in _OUT]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *_OUT.names])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {dict(docs.dtypes)[id_col]}, {_DDL}")
