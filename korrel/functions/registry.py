"""The text functions as SQL functions of a session: register(spark), then korrel_word_count(text) and the like in
spark.sql. Their bodies are SQL expressions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from korrel.functions import text as t


def _r(pattern: str) -> str:
    """A raw SQL string literal."""
    return "r\"" + pattern.replace('"', r"\x{22}") + '"'


_STRIP = f"regexp_replace(x, {_r(f'^{t.SPACE}+|{t.SPACE}+$')}, '')"
_SPACES = lambda c: f"regexp_replace({c}, {_r(t.SPACE + '{2,}')}, ' ')"
_SIGNS = f"regexp_replace({_STRIP}, {_r(r'(?U)(\W{1,8})\1{2,}')}, '$1')"
_REPEATS = f"regexp_replace({_SIGNS}, {_r(r'(?U)\b(\w{2,})(?:[\s,.]+\1\b)++')}, '$1')"
#: name -> (result type, body over x)
FUNCTIONS = {
    "korrel_strip": ("string", _STRIP),
    "korrel_collapse_spaces": ("string", _SPACES("x")),
    "korrel_clean": ("string", _SPACES(_REPEATS)),
    "korrel_word_count": ("int", f"if(x is null, 0, size(filter(split(x, {_r(t.SPACE + '+')}), w -> w <> '')))"),
    "korrel_sanitize": ("string", f"regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), {_r(t.CONTROLS)}, ''), {_r(t.SINGLE_QUOTES)}, ''), {_r(t.DOUBLE_QUOTES)}, '')"),
    "korrel_char_count": ("int", "length(x)"),
}


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of one text each; their names."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(x string) returns {kind} return {body}")
    return sorted(FUNCTIONS)
