"""Text expressions that stay in the JVM. Character classes are spelled out, because \\s and \\w differ between regex
engines: the same pattern text then means the same in Spark, DuckDB and Python.

Null texts give null unless a function says otherwise; empty texts are legal everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split() sees it; word characters; fixed values.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"
#: Control characters and quote characters that the sanitiser drops, fixed values.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SINGLE_QUOTES = r"[\x{27}\x{2018}\x{2019}\x{201a}\x{201b}\x{2032}]"
DOUBLE_QUOTES = r"[\x{22}\x{201c}\x{201d}\x{201e}\x{201f}\x{2033}]"
#: The report replacement chain, fixed values in their order.
REPORT_CHAIN = (
    (r"[\r\n]+", " "),
    (r"\.{2,}", " "),
    (r"\-{2,}", " "),
    (SPACE + WORD + SPACE, " "),
    (r"[\.\:\;]", " . "),
    (r"[\+\_\^\$\#\@\;\(\)\{\}\[\],]", " "),
    (r"\t+", " "),
    (OTHER + r"ong\.", ":"),
    (OTHER + r"syst\.", ""),
    (r"[23][dD]", ""),
    (r"\([45][Cc][Hh]\)", ""),
    (r"meer dan", ">"),
    (r"minder dan", "<"),
    (r"ongeveer", ":"),
    (r"minimaal", ">"),
    (r"maximaal", "<"),
    (r"minimaal", ">"),
    (r"maximaal", "<"),
    (r"ongeveer", ":"),
    (r"circa", ":"),
    (r"[\=]", ":"),
    (r"minimaal", ">"),
    (r"maximaal", "<"),
    (SPACE + r"{2,}", " "),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(col(c), SPACE + "{2,}", " ")


def words(c: Column | str) -> Column:
    """The words between white space, without empty ones."""
    return F.filter(F.split(col(c), SPACE + "+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.when(col(c).isNull(), F.lit(0)).otherwise(F.size(words(c)))


def collapse_repeated_signs(c: Column | str) -> Column:
    """Three or more repeats of up to eight non-word characters become one."""
    return F.regexp_replace(col(c), r"(?U)(\W{1,8})\1{2,}", "$1")


def collapse_repeated_words(c: Column | str) -> Column:
    """A word of two or more characters that repeats stays once. The loop is possessive: a backtracking one overflows
    the stack on thousands of repeats."""
    return F.regexp_replace(col(c), r"(?U)\b(\w{2,})(?:[\s,.]+\1\b)++", "$1")


def clean(c: Column | str, repair: Callable[[Column], Column] | None = None) -> Column:
    """Normaliser: repair of the decoding, if a function for it is given (stable.repair_encoding, or one of the caller's),
    strip, collapse repeated signs, repeated words and white space, in that order."""
    fixed = repair(col(c)) if repair else col(c)
    return collapse_spaces(collapse_repeated_words(collapse_repeated_signs(strip(fixed))))


def sanitize(c: Column | str) -> Column:
    """Null becomes empty; control characters (but tab and line ends) and all quote characters are dropped."""
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), (CONTROLS, SINGLE_QUOTES, DOUBLE_QUOTES), F.coalesce(col(c), F.lit("")))


def replace_chain(c: Column | str, chain: Sequence[tuple[str, str]] = REPORT_CHAIN) -> Column:
    return reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), chain, col(c))


def count_of(c: Column | str, char_class: str) -> Column:
    """Number of characters in a class."""
    return F.length(F.regexp_replace(col(c), f"[^{char_class}]", ""))


def sentences(c: Column | str) -> Column:
    """Sentences: cut behind . ! ? and white space. The pieces are trimmed; empty ones are dropped."""
    marked = F.regexp_replace(col(c), f"([.!?]){SPACE}+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda s: s != "")


def drop_stopwords(c: Column | str, stop: Sequence[str]) -> Column:
    """Case-sensitive, on single blanks, so runs of blanks survive."""
    return F.array_join(F.filter(F.split(col(c), " "), lambda w: ~w.isin(*stop)), " ")


def alternation(terms: Sequence[str], before: str = "", after: str = "") -> str:
    return "(?i)" + "|".join(f"({before}{t}{after})" for t in terms)


def drop_noise(c: Column | str, terms: Sequence[str]) -> Column:
    """Noise terms with one other character on each side go."""
    return collapse_spaces(F.regexp_replace(col(c), alternation(terms, OTHER, OTHER), ""))


def strip_tags(c: Column | str) -> Column:
    """HTML to text: scripts, styles, comments and tags go, the five basic entities are decoded."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")), bare)


def split_on(c: Column | str, removed: Sequence[str], separators: Sequence[str]) -> Column:
    """Drops some characters, then splits at any of the separators (literal texts) and trims."""
    kept = reduce(lambda t, r: F.replace(t, F.lit(r), F.lit("")), removed, col(c))
    one = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("\x01")), separators, kept)
    return F.transform(F.split(one, "\x01"), lambda s: F.trim(s))


def byte_size(c: Column | str) -> Column:
    """1536 -> 1.5 KB."""
    n = col(c).cast("double")
    out = F.lit(None).cast("string")
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n >= float(1024**power), F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out) if power == 4 else F.when((n >= float(1024**power)) & (n < float(1024 ** (power + 1))), F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return F.coalesce(out, F.format_string("%.1f B", n))
