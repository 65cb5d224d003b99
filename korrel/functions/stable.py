"""Text steps that built-in expressions cannot state: replacements repeated to a fixpoint and repair of decodings.

They run as Arrow-batched functions. Null gives null; empty texts stay empty; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.functions import text as t

#: Patterns of the tokenizer's cleaning, fixed values. The repeated unit is bounded, because an unbounded one takes
#: time quadratic in the length of a run.
UNIT = 64
SPURIOUS_WORDS = re.compile(rf"(\b[\w\-\s;:,.]{{1,{UNIT}}}\b)\1{{4,}}")
SPURIOUS_CHARS = re.compile(r"([^\w])\1{3,}")
MULTISPACE = re.compile(r"\s{2,}")
ROUNDS = 20
_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def apply_until_stable(pattern: re.Pattern, replacement: str, text: str, most: int = ROUNDS) -> str:
    """Replacements until a round changes nothing, at most ``most`` rounds."""
    for _ in range(most):
        text, changed = pattern.subn(replacement, text)
        if not changed:
            break
    return text


def repair_text(text: str) -> str:
    """UTF-8 that was read as cp1252 or latin-1, decoded again until nothing changes: runs of non-ASCII characters that
    are whole multibyte text in one of the two sets. Every round shortens the text."""
    while True:
        fixed = _RUN.sub(_decoded, text)
        if fixed == text:
            return text
        text = fixed


def _decoded(run: re.Match) -> str:
    for charset in ("cp1252", "latin-1"):
        try:
            return run.group().encode(charset).decode("utf-8")
        except UnicodeError:
            continue
    return run.group()


def tokenizer_text(text: str, repair: Callable[[str], str] = repair_text, most: int = ROUNDS) -> str:
    """The tokenizer's cleaning: repeated words, repeated signs, repeated words again, white space, decoding."""
    text = apply_until_stable(SPURIOUS_WORDS, r"\1", text, most)
    text = SPURIOUS_CHARS.sub(r"\1", text)
    text = apply_until_stable(SPURIOUS_WORDS, r"\1", text, most)
    return repair(MULTISPACE.sub(" ", text))


def mapped(function: Callable[[str], str]) -> Callable[[Column | str], Column]:
    """A function of a text as one of columns."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def clean_for_tokenizer(c: Column | str, repair: Callable[[str], str] = repair_text) -> Column:
    return mapped(lambda x: tokenizer_text(x, repair))(t.col(c))


def repair_encoding(c: Column | str, repair: Callable[[str], str] = repair_text) -> Column:
    """Texts of ASCII characters stay in the JVM."""
    return F.when(F.length(t.col(c)) < F.octet_length(t.col(c)), mapped(repair)(t.col(c))).otherwise(t.col(c))
