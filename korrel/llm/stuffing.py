"""Keyword-stuffed and link-list pages.

A page is a sequence of symbols: its words in small letters, marks and line breaks; all numbers are one symbol, and so
are all words of addresses in links, all hashtags and all words of list items (at most ``ITEM`` words, none of them a
function word, beside a separator). The page's suffix automaton over these symbols tells which
characters lie in repeated maximal substrings: for every prefix, the longest suffix that occurs at least ``REPEATS``
times. Units (lines and sentences) have clause structure if enough of their words are function words of the languages
of the corpus, links and tags aside; a unit mostly of links has none. A unit without clauses counts as stuffed if
repeats cover enough of it, or of all such units of the page; a page is found if more than half of its words are in
stuffed units. So nothing is found that repeats don't cover.

The automaton is built for every page. A substring that occurs often consists of pairs of neighbours that occur as
often, or is a single symbol, whose count tells enough; so the automaton reads the stretches of such pairs one after
the other, each from its root, which changes no result. Its states are flat arrays, with a dictionary only where they branch.

Defined cases: null, empty and blank texts are not found; repeated rows are judged each; texts of any length are judged
whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.hashing import codes_of, stretch_hashes

REPEATS, SHORTEST, COVERED, PAGE_COVERED, CLAUSE, ITEM = 3, 6, 0.35, 0.3, 0.16, 3
#: Characters that are judged together; a longer page is judged alone.
CHARS = 2_000_000
#: Function words of Dutch, English, German and French, fixed values in natural order.
FUNCTION_WORDS = frozenset(
    """
    de het een en of maar want dus dat die dit deze is was zijn waren wordt worden werd werden heeft hebben had hadden kan kunnen
    kon mag mogen moet moeten zal zullen zou ben bent ik je jij u hij zij ze wij we men mij mijn uw hun haar hem er niet geen wel
    ook nog al van in op aan bij met voor na naar om over onder uit tot te door tegen tussen sinds tijdens volgens als dan
    wanneer waarbij wie wat welke toen omdat doch hoe
    the a an and or but that this these those is was are were be been has have had can could may might must will would should i
    you he she it we they my your his her their its not of in on at by with for after to from about under out until through
    against between since during as than when which who what because how while if before did do does
    der die das ein eine einer eines einem einen und oder aber dass ist war sind waren wird werden wurde wurden hat haben hatte
    kann darf muss soll ich du er sie es wir ihr nicht kein keine auch noch von im in auf an bei mit zu zum zur nach aus bis durch
    gegen zwischen seit als wenn den dem des für über unter vor wie
    le la les un une des du et ou mais que qui ce cette ces est était sont ont été être avoir peut doit je tu il elle nous vous
    ils elles ne pas plus de d l à au aux en dans sur par avec pour après entre depuis comme se sa son ses leur
    """.split()
)
#: Addresses in links, and link elements with their anchor texts.
_LINK = re.compile(r"https?://\S+|www\.\S+|<a\s[^>]*>|\[[\w.-]+\.\w{2,}\]", re.I)
_ELEMENT = re.compile(r"<a\s[^>]*>(?:(?!</?a\b).)*</a\s*>|https?://\S+|www\.\S+", re.I | re.S)
_MARKUP = re.compile(r"</?[a-z]\w*(?:\s[^<>]*)?/?>", re.I)
_SEPARATORS = np.array([ord(c) for c in ";|,•·»›>→#"], np.uint32)
SPACE, LETTER, DIGIT, LINE, MARK = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and small letter of every code point below 0x3000; all above are letters of their own."""
    kind, small = np.full(0x3001, MARK, np.uint8), np.arange(0x3001, dtype=np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        kind[c] = LINE if ch in "\n\r" else SPACE if ch.isspace() or c == 0 else LETTER if ch.isalpha() or 0x300 <= c < 0x370 else DIGIT if ch.isdigit() else MARK
        if len(ch.lower()) == 1:
            small[c] = ord(ch.lower())
    kind[0x3000] = LETTER
    return kind, small


_KIND, _SMALL = _tables()


def _word_hash(words: list[str]) -> np.ndarray:
    size = np.array([len(w) for w in words], np.int64)
    return np.sort(stretch_hashes(codes_of("".join(words)), np.cumsum(size) - size, size))


_GRAMMAR = _word_hash(sorted(FUNCTION_WORDS))


class SuffixAutomaton:
    """Suffix automaton of sequences of symbols (numbers below 2^31), with the number of places of each state. A state's
    only move is packed into one number; states with more moves have a dictionary."""

    def __init__(self, runs: list[list[int]]) -> None:
        length, link, one, places = array("i", [0]), array("i", [-1]), array("q", [-1]), array("i", [0])
        more: dict[int, dict[int, int]] = {}
        self.prefix: list[int] = []

        def to(p: int, c: int) -> int:
            x = one[p]
            if x >= 0 and x >> 32 == c:
                return x & 0xFFFFFFFF
            return more[p].get(c, -1) if p in more else -1

        def put(p: int, c: int, q: int) -> None:
            x = one[p]
            if x < 0 or x >> 32 == c:
                one[p] = c << 32 | q
            else:
                more.setdefault(p, {})[c] = q

        def split(p: int, c: int, q: int) -> int:
            twin = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            one.append(one[q])
            places.append(0)
            if q in more:
                more[twin] = more[q].copy()
            link[q] = twin
            while p >= 0 and to(p, c) == q:
                put(p, c, twin)
                p = link[p]
            return twin

        for run in runs:
            last = 0
            for c in run:
                q = to(last, c)
                if q >= 0:  # a later run that begins like an earlier one
                    last = q if length[q] == length[last] + 1 else split(last, c, q)
                else:
                    now, p = len(length), last
                    length.append(length[last] + 1)
                    link.append(0)
                    one.append(-1)
                    places.append(0)
                    q = -1
                    while p >= 0:
                        q = to(p, c)
                        if q >= 0:
                            break
                        put(p, c, now)
                        p = link[p]
                    if p >= 0:
                        link[now] = q if length[q] == length[p] + 1 else split(p, c, q)
                    last = now
                places[last] += 1
                self.prefix.append(last)
        self.length, self.link, self.places = length, link, places
        self.order = np.argsort(np.array(length, np.int32), kind="stable")[1:].tolist()
        for state in reversed(self.order):
            if link[state] > 0:
                places[link[state]] += places[state]

    def repeated(self, times: int) -> list[int]:
        """For each prefix of each run, the length of its longest suffix that occurs at least ``times`` times."""
        best, length, link, places = array("i", [0]) * len(self.length), self.length, self.link, self.places
        for state in self.order:
            best[state] = length[state] if places[state] >= times else best[link[state]]
        return [best[s] for s in self.prefix]


def covered(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray, page: np.ndarray, times: int = REPEATS, shortest: int = SHORTEST) -> np.ndarray:
    """Whether each symbol (place start..stop in the text) lies in a substring of its page that occurs ``times`` times
    and is at least ``shortest`` characters long."""
    if not len(symbols):
        return np.zeros(0, bool)
    each = pd.factorize(page.astype(np.int64) << 32 | symbols)[0]
    alone = (np.bincount(each)[each] >= times) & (stop - start >= shortest)
    pair = symbols[:-1].astype(np.int64) << 32 | symbols[1:].astype(np.int64)
    same = page[1:] == page[:-1]
    order = np.lexsort((pair, page[:-1]))
    edge = np.r_[True, (pair[order][1:] != pair[order][:-1]) | (page[:-1][order][1:] != page[:-1][order][:-1])]
    group = np.cumsum(edge) - 1
    often = np.empty(len(pair), bool)
    often[order] = np.bincount(group)[group] >= times
    often &= same
    turn = np.diff(np.r_[0, often.view(np.int8), 0])
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + 1  # stretches of symbols [first, last)
    lists = symbols.tolist()
    owner = page[first]
    longest = np.zeros(len(symbols), np.int64)
    for at in np.split(np.arange(len(first)), np.flatnonzero(np.diff(owner)) + 1) if len(first) else []:
        runs = [lists[a:b] for a, b in zip(first[at].tolist(), last[at].tolist())]
        where = np.concatenate([np.arange(a, b) for a, b in zip(first[at], last[at])])
        longest[where] = SuffixAutomaton(runs).repeated(times)
    end = np.flatnonzero(longest >= 2)
    begin = end - longest[end] + 1
    long_ = stop[end] - start[begin] >= shortest
    step = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(step, begin[long_], 1)
    np.add.at(step, end[long_] + 1, -1)
    return alone | (np.cumsum(step[:-1]) > 0)


def _inside(pattern: re.Pattern, text: str) -> np.ndarray:
    out = np.zeros(len(text) + 1, np.int32)
    for m in pattern.finditer(text):
        out[m.start()] += 1
        out[m.end()] -= 1
    return np.cumsum(out[:-1]) > 0


def scores(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each page the share of its words in stuffed units and the share of its characters in units without clauses
    that repeats cover."""
    n = len(texts)
    text = "\0".join(texts)
    page_end = np.cumsum([len(t) + 1 for t in texts])
    codes = codes_of(text)
    kind = _KIND[np.minimum(codes, 0x3000)]
    codes = np.where(codes < 0x3000, _SMALL[np.minimum(codes, 0x3000)], codes)
    first = np.flatnonzero((kind != SPACE) & np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] >= LINE)])
    if not len(first):
        return np.zeros(n), np.zeros(n)
    edge = np.r_[np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(kind)]
    stop = np.where(kind[first] >= LINE, first + 1, edge[np.searchsorted(edge, first, "right")])
    sort, page = kind[first], np.searchsorted(page_end, first, "right")
    hashed = stretch_hashes(codes, first, stop - first)
    link, markup = _inside(_LINK, text)[first], _inside(_MARKUP, text)[first]
    linked = _inside(_ELEMENT, text)[first]
    tag = (sort == LETTER) & (codes[np.maximum(first - 1, 0)] == 35) & (first > 0)
    # Units end at line breaks and behind a stop mark before white space; and with their page.
    blank = np.r_[kind[1:] == SPACE, True] | np.r_[kind[1:] == LINE, True]
    ends = (sort == LINE) | np.isin(codes[first], (33, 46, 63, 0x2026)) & blank[first] & ~link
    unit = np.cumsum(np.r_[0, ends[:-1] | (page[1:] != page[:-1])])
    word = (sort == LETTER) | (sort == DIGIT)
    said = (sort == LETTER) & ~link & ~markup & ~tag
    function = said & np.isin(hashed, _GRAMMAR)
    # Items: what lies from one separator, or the begin of a unit, to the next.
    separator = np.isin(codes[first], _SEPARATORS) & ~link & ~markup
    change = np.r_[True, unit[1:] != unit[:-1]]
    item = np.cumsum(change | separator) - 1
    opens = np.flatnonzero(change | separator)
    beside = separator[opens] | np.r_[~change[opens[1:]], False]
    words = np.bincount(item, said)
    listed = (beside & (words > 0) & (words <= ITEM) & (np.bincount(item, function) == 0))[item] & said
    # Symbols: words by their hash; numbers, words of links, hashtags and words of items as one each.
    symbol = np.select([sort == DIGIT, word & link, tag, listed], [np.uint64(i) for i in range(1, 5)], hashed)
    symbol = pd.factorize(symbol)[0].astype(np.int64)
    mask = covered(symbol, first, stop, page)
    of = page[np.searchsorted(unit, np.arange(unit[-1] + 1))]
    count = lambda what: np.bincount(unit, what, minlength=len(of))
    begins = np.r_[True, (first[1:] > stop[:-1]) | (sort[:-1] == LINE)]  # runs of characters without white space
    grammar, plain = count(function), count(said | (sort == DIGIT) & ~link & ~markup)
    runs, in_links = count(begins & (sort != LINE)), count(begins & linked & (sort != LINE))
    clause = (grammar >= np.maximum(1, CLAUSE * plain)) & (2 * in_links <= runs)
    size, hit = count(stop - first), count((stop - first) * mask)
    of_page = lambda what: np.bincount(of, what, minlength=n)
    bare, bare_hit = of_page(size * ~clause), of_page(hit * ~clause)
    everywhere = (bare_hit >= PAGE_COVERED * bare)[of]
    stuffed = ~clause & (hit > 0) & (everywhere | (hit >= COVERED * size))
    total = np.maximum(of_page(runs), 1)
    return of_page(runs * stuffed) / total, bare_hit / np.maximum([len(t) for t in texts], 1)


def stuffed_share(text: str) -> tuple[float, float]:
    """scores() of one page."""
    a, b = scores([text])
    return float(a[0]), float(b[0])


def find_stuffed(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """key, stuffed (share of words) and repeated (share of characters) of the pages above the share: one narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b.iloc[:, 1].str.len().cumsum().to_numpy()
            for _, part in b.groupby(size // CHARS, sort=False):
                stuffed, repeated = scores(part.iloc[:, 1].tolist())
                out = pd.DataFrame({key: part.iloc[:, 0], "stuffed": stuffed, "repeated": repeated})
                yield out[out.stuffed > share]

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).filter(F.length(text) > 0).mapInPandas(run, f"{key} {kind}, stuffed double, repeated double")
