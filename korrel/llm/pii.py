"""Personal information in free text: typed placeholders.

A character-level BiLSTM-CRF (tagger.py) labels e-mail addresses, phone numbers, identity numbers, street addresses and
names. It reads the whole of every text, without a gate before it. A text is cut into units at empty lines and sentence ends;
a unit longer than ``WINDOW`` characters is read in windows that overlap by ``OVERLAP``. Each window is decoded with the
CRF, and the windows are reconciled over the whole text: a character takes its label from the window in which it is
most central, and spans that continue across a seam are joined. Units that are the same to the tagger (all digits are
one class of characters) are read once in a batch of rows, and what units have in common at their beginnings (read
forwards) or ends (read backwards) is read once too. Neither changes a result: each unit is read as if it were alone.

A last exact check drops spans that
lack what their kind must have (digits for numbers and addresses, an at sign for e-mail).

Defined cases: null and empty texts have no mentions; existing placeholders are left alone; repeated rows are tagged
each; texts of any length are read whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.tagger import FREE, KINDS, BiLstmCrf, encode

WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
WINDOW, OVERLAP, BATCH = 512, 48, 1024
#: Characters that are read together, and that are cut into units together.
CHARS, CUT = 14_000_000, 2_000_000
_DIGIT = re.compile(r"\d")
_AT = re.compile(r"@|[(\[{]\s*(?:at|apenstaartje|æ)\s*[)\]}]|\bat\b", re.I)
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_PLACEHOLDER = re.compile(r"\[[A-Z_]+\]|\|\|\|[A-Z_]+\|\|\|?|<[A-Z_]+>")


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Windows of the stretch [a, b), as few as possible and of equal lengths, with overlaps of OVERLAP or one more."""
    n = max(1, -(-(b - a - OVERLAP) // (WINDOW - OVERLAP)))
    size = -(-(b - a + (n - 1) * OVERLAP) // n)
    starts = [a + (b - a - size) * i // max(1, n - 1) for i in range(n)]
    return [(s, s + size) for s in starts]


#: Short words that end in a full stop within a sentence, fixed values.
ABBREVIATIONS = """adr art bijv blz burg ca dhr dr drs fa fr geb gem herr ing ir jr kl lic max mevr min mlle mme mr mrs ms mw no nr num
pat prof pt ref resp sr st str tel vgl vs""".split()
#: Ends of words that are abbreviated so, fixed values.
ENDINGS = "str pln".split()
_SHORT, _STREET = (np.array(sorted(sum(ord(c) << (7 * i) for i, c in enumerate(reversed(w))) for w in words)) for words in (ABBREVIATIONS, ENDINGS))


def unit_ends(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of units within texts by their character classes; texts begin at ``starts`` with one character between them.
    A unit ends behind the white space that follows a full stop, question or exclamation mark, or that holds an empty
    line. Within a line a full stop counts only behind a digit, a closing sign or a word in small letters that is no
    abbreviation; an empty line doesn't count behind a comma or colon."""
    n = len(codes)
    space = (codes == 32) | (codes == 10)
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, stop = turns[int(n > 0 and space[0]) :: 2], turns[int(n > 0 and space[0]) + 1 :: 2]  # runs of white space behind something
    stop = np.append(stop, n) if len(stop) < len(first) else stop
    new = np.zeros(n + 1, bool)
    new[starts] = True
    inside = ~new[first]
    first, stop = first[inside], stop[inside]
    if not len(first):
        return np.empty(0, np.int64)
    lines = np.zeros(n + 1, np.int32)
    np.cumsum(codes == 10, out=lines[1:])
    mark = codes[first - 1]
    broken = lines[stop] - lines[first]
    ends = (mark == 33) | (mark == 63) | (mark == 46) & (broken > 0) | (broken > 1) & (mark != 44) & (mark != 58)
    dots = np.flatnonzero(mark == 46)
    at = first[dots][:, None] - 2 - np.arange(6)[None, :]
    word = np.where(at >= 0, codes[np.maximum(at, 0)], 32).astype(np.int64)  # the six characters before the full stop
    low = (word >= 97) & (word <= 122)
    size = np.where(low.all(1), 6, low.argmin(1))
    ahead = word[np.arange(len(word)), np.minimum(size, 5)]
    letter = (ahead >= 65) & (ahead <= 90) | (ahead == 2)
    packed = ((word << (7 * np.arange(6))[None, :]) * (np.arange(6)[None, :] < size[:, None])).sum(1)
    street = (size >= 3) & np.isin((word[:, :3] << (7 * np.arange(3))[None, :]).sum(1), _STREET)
    ends[dots] |= ((size >= 5) | (size >= 2) & ~letter & ~np.isin(packed, _SHORT)) & ~street | np.isin(word[:, 0], _CLOSING)
    return stop[ends]


def units_of(texts: list[str]) -> tuple[list[bytes], list[list[int]]]:
    """The distinct units of texts, as character classes, and the units of each text by number."""
    seen: dict[bytes, int] = {}
    laid: list[list[int]] = [[] for _ in texts]
    ends = np.cumsum([len(t) for t in texts])
    cuts = np.searchsorted(ends, np.arange(CUT, ends[-1], CUT)).tolist() if len(texts) else []
    for low, high in zip([0, *cuts], [*cuts, len(texts)]):
        if low < high:
            _lay(texts[low:high], seen, laid[low:high])
    return list(seen), laid


def _lay(texts: list[str], seen: dict[bytes, int], laid: list[list[int]]) -> None:
    """Adds the units of texts to those seen and their numbers to the texts' lists."""
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(size + 1)[:-1]].astype(np.int64)
    codes = encode("\x7f".join(texts))
    whole = codes.tobytes()
    bounds = np.unique(np.concatenate([starts, starts + size, unit_ends(codes, starts)]))
    owner = np.searchsorted(starts, bounds, "right") - 1
    for a, b, i, last in zip(bounds.tolist(), bounds[1:].tolist(), owner.tolist(), (starts + size)[owner].tolist()):
        if a < last:
            laid[i].append(seen.setdefault(whole[a:b], len(seen)))


#: Classes behind which a full stop ends a unit: digits and closing signs.
_CLOSING = np.array([48, 41, 93, 37, 34, 39], np.int64)


def _sound(kind: str, part: str) -> bool:
    """The exact check of a span."""
    if _PLACEHOLDER.search(part):
        return False
    if kind == "email":
        return bool(_AT.search(part)) and len(part) > 5
    if kind == "phone":
        return len(_DIGIT.findall(part)) >= 7
    if kind == "idnum":
        return len(_DIGIT.findall(part)) >= 4 and len(part) >= 7
    if kind == "address":
        return bool(_DIGIT.search(part)) and bool(_LETTERS.search(part))
    return bool(_LETTERS.search(part)) and "@" not in part


def spans_of(labels: np.ndarray, text: str, offset: int) -> list[tuple[int, int, str]]:
    """Spans of the labels of a stretch that starts at offset: runs of one kind; a B- begins a new one."""
    if not labels.any():
        return []
    kind = np.where(labels, (labels - 1) % len(KINDS) + 1, 0)
    edges = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | ((labels[1:] < FREE) & (labels[1:] > 0))])
    out = []
    for i, s in enumerate(edges):
        if kind[s]:
            e = int(edges[i + 1]) if i + 1 < len(edges) else len(labels)
            name = KINDS[kind[s] - 1]
            if _sound(name, text[offset + s : offset + e]):
                out.append((offset + int(s), offset + e, name))
    return out


class Finder:
    """Mentions in batches of texts with one set of weights."""

    def __init__(self, path: str = WEIGHTS) -> None:
        self.model = BiLstmCrf.load(path)

    def label(self, encoded: list[np.ndarray]) -> list[np.ndarray]:
        """Labels of windows of any lengths up to WINDOW, each as if it were read alone."""
        return self.model.paths(encoded, BATCH)

    def unit_labels(self, units: list[bytes]) -> list[np.ndarray]:
        """Labels of whole units, their windows reconciled: the seam between two lies in the middle of their overlap."""
        places = [windows(0, len(u)) if len(u) > WINDOW else [(0, len(u))] for u in units]
        labels = self.label([np.frombuffer(u, np.uint8)[s:e] for u, w in zip(units, places) for s, e in w])
        out, i = [], 0
        for u, w in zip(units, places):
            if len(w) == 1:
                out.append(labels[i])
            else:
                seams = [0, *((b + s) // 2 for (_, b), (s, _) in zip(w, w[1:])), len(u)]
                out.append(np.concatenate([labels[i + q][seams[q] - s : seams[q + 1] - s] for q, (s, _) in enumerate(w)]))
            i += len(w)
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the mentions of each text."""
        units, laid = units_of([t or "" for t in texts])
        labels = self.unit_labels(units)
        some = [bool(y.any()) for y in labels]
        out: list[list[tuple[int, int, str]]] = []
        for t, ids in zip(texts, laid):
            spans: list[tuple[int, int, str]] = []
            if any(some[i] for i in ids):
                spans = spans_of(np.concatenate([labels[i] for i in ids]), t, 0)
            out.append(spans)
        return out


_FINDERS: dict[str, Finder] = {}


def finder(path: str = WEIGHTS) -> Finder:
    if path not in _FINDERS:
        _FINDERS[path] = Finder(path)
    return _FINDERS[path]


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for a, b, kind in sorted(spans):
        if a < last:
            continue
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*parts, text[last:]])


def pieces(rows: Iterable[tuple]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of rows in lists of CHARS characters, whatever the size of the batches they came in; a longer text is
    in a list of its own."""
    keys, bodies, held = [], [], 0
    for k, t in rows:
        if held and held + len(t) > CHARS:
            yield keys, bodies
            keys, bodies, held = [], [], 0
        keys.append(k)
        bodies.append(t)
        held += len(t)
    if keys:
        yield keys, bodies


def find_pii(texts: DataFrame, key: str, text: str, path: str = WEIGHTS) -> DataFrame:
    """key, kinds (distinct, sorted), n_mentions and the text with placeholders of every row that has a mention: one
    narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = finder(path)
        for keys, bodies in pieces((r for b in batches for r in zip(b.iloc[:, 0].tolist(), b.iloc[:, 1].tolist()))):
            rows = [(k, sorted({x[2] for x in f}), len(f), replace_spans(t, f)) for k, t, f in zip(keys, bodies, tag.find(bodies)) if f]
            yield pd.DataFrame(rows, columns=["rec_id", "kinds", "n_mentions", "clean"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).filter(F.length(text) > 0).mapInPandas(run, f"rec_id {kind}, kinds array<string>, n_mentions int, clean string")
