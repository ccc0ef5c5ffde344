"""Held-out passages in a corpus: a generalised suffix automaton of the items' words, streamed over by every document.

The items are a small table: its words are bounded (MOST_WORDS) and checked before the automaton goes to the workers.
A document's spoken words are read once; the automaton gives, at each word, the longest run of words up to there that
occurs in any item. Runs of at least RUN words name the items they come from. For an item with enough of its words in
such runs within one stretch, an exact check follows: the longest chain of the item's words in their order, words
allowed a slight damage, over the cues around the runs. Cues with hardly any word of the chain are other cues and don't
count for the length of the stretch.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame

from kinlink.llm.speech import spoken_cues
from kinlink.llm.translit import ascii_lower
from kinlink.llm.variants import _osa

#: words of all items together; above, the table is no small held-out set and must be split by the caller
MOST_WORDS = 2_000_000
#: words of a run that names an item
RUN = 3
#: share of an item's words in runs that calls for the exact check
HINT = 0.2
#: share of an item's words, in order, that makes a leak
SHARE = 0.6
#: words of a stretch for each word of the part of the item that it covers
SLACK = 1.35
WORD = re.compile(r"[^\W_]+")
_ALIKE = str.maketrans({"l": "i", "1": "i", "|": "i", "0": "o", "’": "'"})


@lru_cache(maxsize=1 << 18)
def word_key(word: str) -> str:
    """A word without case and accents, letters and figures that are taken for each other as one."""
    return ascii_lower(word).translate(_ALIKE)


class SuffixAutomaton:
    """Of several sequences of words; a state is a set of runs of words that end at the same places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for item, seq in enumerate(sequences):
            last = 0
            for pos, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].append((item, pos))
        # a run ends where any longer one with the same end does: those below it in the tree of links
        self.below: list[list[int]] = [[] for _ in self.length]
        for s in range(1, len(self.length)):
            self.below[self.link[s]].append(s)

    def places(self, state: int) -> Iterator[tuple[int, int]]:
        """(sequence, last position) of every occurrence of the runs of a state."""
        todo = [state]
        while todo:
            s = todo.pop()
            yield from self.ends[s]
            todo += self.below[s]

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # met in an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def runs(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(last position, length, state) of the runs of at least ``least`` words that can't be longer; word -1 is in no
        sequence."""
        out: list[tuple[int, int, int]] = []
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        for i, c in enumerate(words):
            if c < 0:
                if n >= least:
                    out.append((i - 1, n, s))
                s = n = 0
                continue
            t = nxt[s].get(c)
            if t is None:
                if n >= least:
                    out.append((i - 1, n, s))
                while t is None and s:
                    s = link[s]
                    t = nxt[s].get(c)
                if t is None:
                    s = n = 0
                    continue
                n = length[s]
            s, n = t, n + 1
        if n >= least:
            out.append((len(words) - 1, n, s))
        return out


class Items:
    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [[word_key(w) for w in WORD.findall(t)] for _, t in items]
        self.vocabulary: dict[str, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for ws in self.words]
        self.automaton = SuffixAutomaton(coded)
        self.keys: dict[str, int] = {}
        self.close = lru_cache(maxsize=1 << 16)(self._close)

    def code(self, word: str) -> int:
        got = self.keys.get(word)
        if got is None:
            if len(self.keys) > 500_000:
                self.keys.clear()
            got = self.keys[word] = self.vocabulary.get(word_key(word), -1)
        return got

    def _close(self, item: int, word: str) -> tuple[tuple[int, ...], ...]:
        """Places in an item that a word of a document may stand for: the word itself, one slightly damaged, or several
        written as one."""
        words = self.words[item]
        same = tuple((i,) for i, w in enumerate(words) if w == word)
        if same or len(word) < 4:
            return same
        most = 1 if len(word) < 8 else 2
        near = tuple((i,) for i, w in enumerate(words) if len(w) > 3 and abs(len(w) - len(word)) <= most and _osa(w, word, most) <= most)
        if near:
            return near
        out = []
        for i in range(len(words) - 1):
            two = words[i] + words[i + 1]
            if abs(len(two) - len(word)) <= 1 and _osa(two, word, 1) <= 1:
                out.append((i, i + 1))
            elif i + 2 < len(words) and two + words[i + 2] == word:
                out.append((i, i + 1, i + 2))
        return tuple(out)

    def found(self, cues: list[str]) -> list[int]:
        """Ids of the items that the cues hold."""
        return list(dict.fromkeys(i for i, *_ in self.spans(cues)))

    def spans(self, cues: list[str]) -> list[tuple[int, int, int, int, float]]:
        """(id of an item, first word, last word, words of the item, their share) of each stretch of the cues that holds
        enough of an item; words are counted over all cues."""
        texts = [WORD.findall(c.lower()) for c in cues]
        code = self.keys.get
        words: list[int] = []
        for t in texts:
            for w in t:
                c = code(w)
                words.append(self.code(w) if c is None else c)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in self.automaton.runs(words, RUN):
            for item, pos in self.automaton.places(state):
                hits.setdefault(item, []).append((end - n + 1, end, pos))
        if not hits:
            return []
        owner = [k for k, t in enumerate(texts) for _ in t]
        flat: list[str] | None = None
        out = []
        for item, spans in hits.items():
            size = len(self.words[item])
            if sum(e - a + 1 for a, e, _ in spans) < HINT * size:
                continue
            flat = flat or [word_key(w) for t in texts for w in t]
            reach = 2 * size + 60
            spans.sort()
            groups: list[list[tuple[int, int, int]]] = []
            for s in spans:
                if groups and s[0] - groups[-1][-1][1] <= reach:
                    groups[-1].append(s)
                else:
                    groups.append([s])
            for g in groups:
                if sum(e - a + 1 for a, e, _ in g) >= HINT * size and (got := self._stretch(item, flat, owner, g[0][0], max(x[1] for x in g))):
                    out.append((self.ids[item], *got))
        return out

    def _stretch(self, item: int, flat: list[str], owner: list[int], first: int, last: int) -> tuple[int, int, int, float] | None:
        """The stretch around first to last that holds most of the item, if it holds enough."""
        size = len(self.words[item])
        lo, hi = max(0, first - size), min(len(flat), last + size + 1)
        while lo and owner[lo - 1] == owner[lo]:
            lo -= 1
        while hi < len(flat) and owner[hi] == owner[hi - 1]:
            hi += 1
        places = {i: p for i in range(lo, hi) if (p := self.close(item, flat[i]))}
        inside: dict[int, int] = {}
        for i in range(lo, hi):
            inside[owner[i]] = inside.get(owner[i], 0) + 1
        # cues that share next to nothing with the item are others, in between
        shared: dict[int, int] = {}
        for i in places:
            shared[owner[i]] = shared.get(owner[i], 0) + 1
        keep = {k for k, n in shared.items() if n >= 0.3 * inside[k]}
        for _ in range(2):
            chain = _chain({i: p for i, p in places.items() if owner[i] in keep})
            n: dict[int, int] = {}
            for i, _ in chain:
                n[owner[i]] = n.get(owner[i], 0) + 1
            less = {k for k in keep if n.get(k, 0) >= 0.25 * inside[k]}
            if less == keep:
                break
            keep = less
        chain = _chain({i: p for i, p in places.items() if owner[i] in keep})
        need = SHARE * size - 1e-9
        if len(chain) < need:
            return None
        # positions counted in kept cues only
        rank, at = {}, 0
        for i in range(lo, hi):
            if owner[i] in keep:
                rank[i] = at
                at += 1
        a, best = 0, None
        for z in range(len(chain)):
            while a < z and rank[chain[z][0]] - rank[chain[a][0]] + 1 > SLACK * (chain[z][1] - chain[a][1] + 1) + 3:
                a += 1
            if z - a + 1 >= max(need, best[2] + 1 if best else 0):
                best = (chain[a][0], chain[z][0], z - a + 1, (z - a + 1) / size)
        return best


def _chain(places: dict[int, tuple[tuple[int, ...], ...]]) -> list[tuple[int, int]]:
    """Longest sequence of (position in the document, place in the item), both growing; a word written for several counts
    for each of them."""
    tails: list[int] = []
    back: list[tuple[int, int, int]] = []  # place, position, entry before
    entry: list[int] = []
    for i in sorted(places):
        fresh = []
        for run in sorted(places[i], reverse=True):
            k = bisect_left(tails, run[0])
            fresh.append((k, run))
        for k, run in fresh:
            before = entry[k - 1] if k else -1
            for j, place in enumerate(run):
                back.append((place, i, before))
                before = len(back) - 1
                if k + j == len(tails):
                    tails.append(place)
                    entry.append(before)
                elif place < tails[k + j]:
                    tails[k + j] = place
                    entry[k + j] = before
    out = []
    at = entry[-1] if entry else -1
    while at >= 0:
        place, i, at = back[at]
        out.append((i, place))
    return out[::-1]


_BUILT: dict[str, Items] = {}


def _built(shared: Broadcast) -> Items:
    """The automaton, made once in each worker."""
    name, rows = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(rows)
    return _BUILT[name]


def _search(shared: Broadcast, whole: bool):
    columns = ["doc_id", "item_id", *(() if whole else ("first_word", "last_word", "words", "coverage"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = _built(shared)
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b["doc_id"], b["text"], strict=True):
                cues = spoken_cues(t)
                rows += [(k, i) for i in items.found(cues)] if whole else [(k, *x) for x in items.spans(cues)]
            yield pd.DataFrame(rows, columns=columns)

    return run


def _clean(shared: Broadcast, least_words: int, least_share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = _built(shared)
        for b in batches:
            rows = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                cues = spoken_cues(text)
                gone = {w for _, a, z, n, share in items.spans(cues) if n >= least_words and share >= least_share for w in range(a, z + 1)}
                rows.append((key, without(cues, gone) if gone else text, len(gone)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "removed"])

    return run


def without(cues: list[str], gone: set[int]) -> str:
    """Cues, one a line, without the words of these numbers; cues that lose all words go."""
    out, at = [], 0
    for cue in cues:
        kept, last = [], 0
        words = list(WORD.finditer(cue))
        for m in words:
            if at in gone:
                kept.append(cue[last : m.start()])
                last = m.end()
            at += 1
        line = " ".join("".join((*kept, cue[last:])).split())
        if WORD.search(line) or not words:
            out.append(line)
    return "\n".join(out)


def _shared(documents: DataFrame, items: DataFrame) -> Broadcast:
    size = items.selectExpr("coalesce(sum(length(text) - length(replace(text, ' ', '')) + 1), 0) as n").first().n
    if size > MOST_WORDS:
        raise ValueError(f"{size} words of items; at most {MOST_WORDS} fit an automaton")
    rows = [(r.item_id, r.text) for r in items.where("item_id is not null and trim(text) <> ''").select("item_id", "text").collect()]
    return documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


def leaked_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, words, coverage) for each stretch of the speech of documents(doc_id, text) that
    holds at least six tenths of the words of an item of items(item_id, text), in their order: numbers of its first and
    last word among the spoken ones, how many of the item's words it holds, and their share. Null and empty texts hold and
    are nothing; a document that occurs twice is reported twice. Documents are not shuffled."""
    kinds = "doc_id bigint, item_id bigint, first_word int, last_word int, words int, coverage double"
    return documents.select("doc_id", "text").mapInPandas(_search(_shared(documents, items), False), kinds)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of leaked_spans, each item of a document once."""
    return documents.select("doc_id", "text").mapInPandas(_search(_shared(documents, items), True), "doc_id bigint, item_id bigint")


def cleaned(documents: DataFrame, items: DataFrame, least_words: int = 8, least_share: float = SHARE) -> DataFrame:
    """(doc_id, text, removed) of all documents: the text as it is, or, where it holds stretches of items of at least so many
    words and such a share, its speech without them, a cue on each line; removed words are counted. Null stays null."""
    return documents.select("doc_id", "text").mapInPandas(_clean(_shared(documents, items), least_words, least_share), "doc_id bigint, text string, removed int")
