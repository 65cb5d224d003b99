"""Garbled text from wrong character decodings.

Runs of non-ASCII characters are mapped back to the bytes that a legacy character set would have shown so. An automaton
over the byte structure of UTF-8 finds the maximal well-formed multibyte spans in them, and only those spans are
decoded; this repeats while anything changes, which undoes double encodings. The character set of a run is the one whose
spans cover most of it. Spans are kept only where they make sense: their characters are of western text, and their
neighbours do not show that the run is proper foreign script or capitals; or at least LONG of them have one script.

Bytes of a single-byte set shown in another one have no multibyte structure. They are found by their place instead:
C1 controls, and signs, capitals or foreign letters inside Latin words that become small Latin letters when mapped back.
U+FFFD is found, but what it stood for is lost unless the set has only one byte that it cannot show.

Defined cases: null, empty and ASCII texts are not found; texts of any length are read whole; repeated rows are judged
each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Character sets that text is wrongly read in, fixed values; earlier ones win ties.
CHARSETS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866", "cp852", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "cp1253", "koi8-u")
#: Sets in which single bytes of cp1252 are wrongly shown.
SINGLE = ("cp850", "cp437", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250", "cp1253")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
#: Scripts that one language mixes, fixed values.
EAST_ASIAN = ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL")
#: Decoded characters of one script that make a foreign span.
LONG = 4
_CONTROL = re.compile(r"[\x80-\x9f]")
_ODD = re.compile(r"[\x80-\x9f�]")
_LOST_SPACE = re.compile(r"(?<![^\W\d_])Ã(?: (?= )|(?= \S))")
_QUOTES = "‐‑–—‘’‚“”„…´`¨ˆ˜•"
_UNITS = "µμ°ΩÅÂÃ"
_LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœšž"
_WESTERN = frozenset(chr(c) for c in range(0xA0, 0x100)) | frozenset("ŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™₂≤≥≠≈∞→←×Ωπ√∆‑​  ﻿�") | frozenset(chr(c) for c in range(0x391, 0x3CA))
_INSIDE = re.compile(r"(?<=[a-z])[^\x00-\x7f](?=[a-z\x80-￿])|(?<![^\W\d_])[^\x00-\x7f](?=[a-z]{3})|(?<=[a-z]{2})[^\x00-\x7f](?![^\W\d_])|[░-▓]|[─-▟](?=[a-zA-Z])|(?<![^\W_])[^\x00-\x7f](?= ?\d)|(?<=\d)[^\x00-\x7f](?=\d)|(?<=[\d ])[^\x00-\x7f](?=(?:g|m|l|mol|C)\b)")


def _table(charset: str) -> tuple[dict[str, int], int | None]:
    """Character -> byte of the upper half; the byte that U+FFFD must be, if just one has no character."""
    back, missing = {}, []
    for b in range(0x80, 0x100):
        try:
            back[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            missing.append(b)
            back.setdefault(chr(b), b)
    return back, missing[0] if len(missing) == 1 else None


TABLES = {c: _table(c) for c in CHARSETS}


def well_formed(data: list[int | None], at: int) -> int:
    """Length of the well-formed multibyte character that starts at a place, or 0: the byte structure of UTF-8, that is
    one lead byte that tells the number of following bytes and bounds the first of them."""
    lead = data[at]
    if lead is None or not 0xC2 <= lead <= 0xF4:
        return 0
    more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
    low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
    high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
    for b in data[at + 1 : at + 1 + more]:
        if b is None or not low <= b <= high:
            return 0
        low, high = 0x80, 0xBF
    return more + 1 if at + more < len(data) else 0


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def _one_script(text: str) -> str:
    """The script that all letters of a text have; empty if there are several, or none, or other than letters."""
    scripts = {_script(c) for c in text if not unicodedata.category(c).startswith("M")}
    scripts = {"CJK" if s in EAST_ASIAN else s for s in scripts}
    return scripts.pop() if len(scripts) == 1 else ""


def _sense(shown: str, decoded: str, before: str, after: str, seen: set[str]) -> bool:
    """Whether a maximal span may be decoded where it stands. Other than western characters make sense if at least LONG
    of them have one script, or if the text has such a span of that script already."""
    astral = all(ord(c) > 0xFFFF or c in "️‍" for c in decoded)
    if not astral and not all(c in _WESTERN or 0x80 <= ord(c) < 0xA0 for c in decoded):
        script = _one_script(decoded)
        if not script or len(decoded) < LONG and script not in seen:
            return False
        seen.add(script)
        return True
    script = _script(shown[0])
    if script and script != "LATIN" and script in (_script(before), _script(after)):
        return False
    # Capitals before a closing sign, as in «CAFÉ», look like lead and following byte.
    capitals = before.isupper() and shown[0].isupper() and len(decoded) == 1 and not after.islower()
    return not (capitals and (not decoded.isupper() if decoded.isalpha() else shown[1] in "»”’“…"))


def _twice(decoded: str) -> bool:
    """Whether decoded characters are themselves bytes of a whole multibyte text, as in double encodings."""
    return len(decoded) > 1 and _decode_run(decoded, 0, len(decoded))[1] == len(decoded)


def _decode_run(text: str, start: int, end: int, scripts: set[str] | None = None) -> tuple[str, int]:
    """The run with its spans decoded by the set that covers most of it, and the number of characters covered. Scripts of
    long foreign spans are added to ``scripts``."""
    run, best, most = text[start:end], "", 0
    known: set[str] = set() if scripts is None else scripts
    won = known
    for charset, (back, lost) in TABLES.items():
        data = [back.get(c, lost if c == "�" else None) for c in run]
        out, covered, i = [], 0, 0
        mine = set(known)
        while i < len(run):
            spans, j = [], i
            while j < len(run) and (n := well_formed(data, j)):
                spans.append(n)
                j += n
            if spans:
                decoded = bytes(data[i:j]).decode("utf-8")
                before, after = text[start + i - 1 : start + i], text[start + j : start + j + 1]
                if (_twice(decoded) or not _CONTROL.search(decoded)) and _sense(run[i:j], decoded, before, after, mine):
                    out.append(decoded)
                    covered += j - i
                else:
                    out.append(run[i:j])
                i = j
            else:
                out.append(run[i])
                i += 1
        if covered > most:
            best, most, won = "".join(out), covered, mine
    known |= won
    return (best, most) if most else (run, 0)


def _multibyte(text: str) -> tuple[str, int]:
    """All runs of a text, repeated while they change; the number of spans decoded. It ends, because every pass that
    decodes a span shortens the text."""
    total, scripts = 0, set()
    while True:
        parts, last, hits = [], 0, 0
        for m in _RUN.finditer(text):
            fixed, covered = _decode_run(text, m.start(), m.end(), scripts)
            if covered:
                parts += [text[last : m.start()], fixed]
                last = m.end()
                hits += 1
        if not hits:
            break
        text = "".join([*parts, text[last:]])
        total += hits
    if total:  # an à whose second byte, a no-break space, was made a plain space
        text = _LOST_SPACE.sub("à", text)
    return text, total


def _controls(text: str) -> tuple[str, int]:
    """C1 controls are bytes of cp1252 read as latin-1."""
    hits = 0

    def fix(m: re.Match) -> str:
        nonlocal hits
        hits += 1
        try:
            return bytes([ord(m.group())]).decode("cp1252") if m.group() != "�" else "�"
        except UnicodeDecodeError:
            return m.group()

    return _ODD.sub(fix, text), hits


def _evidence(text: str, m: re.Match, back: dict[str, int]) -> str | None:
    """What a character inside a word becomes if it is a byte of cp1252 shown in another set; None if it fits there."""
    c = m.group()
    b = back.get(c)
    if b is None:
        return None
    try:
        d = bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return None
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    if "░" <= c <= "▓":
        return d if d in "°±²" + _LETTERS else None
    if c in _UNITS:
        return None
    if after[:1] in "gmlC" and after and (before.isdigit() or before == " ") and d in "µ°" or c.isalpha() and d == "–" and before.isdigit() and after.isdigit():
        return d
    if c.isalpha() and d in "€£±" and not before.isalpha() and re.match(r" ?\d", text[m.end() : m.end() + 2]):
        return d
    if d not in _LETTERS and d not in _LETTERS.upper() or c in _QUOTES and not (c == "´" and d == "ï" and before in "aeo"):
        return None
    if c.isalpha() and _script(c) == "LATIN":  # a capital amid small letters
        return d if c.isupper() and d.islower() and before.islower() and (after.islower() or not after.isalpha()) else None
    if c.isalpha():  # a foreign letter in a word of small Latin ones
        return d if c not in "µμ" and before.isascii() and before.islower() and (after.isascii() and after.islower() or not after.isalpha()) else None
    if before.islower():
        return d if after.islower() or not after.isascii() else None
    return d if not before.isalpha() and ("─" <= c <= "▟" or c in "÷∩ⁿ⌠") and after.islower() else None


def _single(text: str) -> tuple[str, int]:
    """Single bytes of cp1252 shown in another set; the set with most evidence is taken."""
    marks = [m for m in _INSIDE.finditer(text)]
    if not marks:
        return text, 0
    best: tuple[int, str] = (0, "")
    for charset in SINGLE:
        back = TABLES[charset][0]
        found = sum(_evidence(text, m, back) is not None for m in marks)
        if found > best[0]:
            best = (found, charset)
    if not best[0]:
        return text, 0
    back = TABLES[best[1]][0]
    hits = [(m, d) for m in marks if (d := _evidence(text, m, back)) is not None]
    parts, last = [], 0
    for m, d in hits:
        parts += [text[last : m.start()], d]
        last = m.end()
    return "".join([*parts, text[last:]]), len(hits)


def repair(text: str) -> tuple[str, int, bool]:
    """The text with its garbled passages restored, the number of places found, and whether nothing stayed garbled."""
    fixed, spans = _multibyte(text)
    fixed, controls = _controls(fixed) if _ODD.search(fixed) else (fixed, 0)
    fixed, single = _single(fixed)
    return fixed, spans + controls + single, not _ODD.search(fixed)


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, places, whole (nothing stayed garbled) and the restored text of every garbled document: one narrow pass;
    ASCII texts are dismissed in the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, whole, fixed) for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]) for fixed, n, whole in [repair(t)] if n]
            yield pd.DataFrame(rows, columns=[key, "places", "whole", "restored"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).filter(F.length(text) < F.octet_length(text)).mapInPandas(run, f"{key} {kind}, places int, whole boolean, restored string")
