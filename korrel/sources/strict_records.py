"""Rows that fail to parse: strict load plus anti-join.

1. keep each record's offset (file_name, line_no and the row's own key),
2. load only the rows that conform to their file's format into canonical records,
3. subtract the loaded offsets from the raw offsets (left anti join),
4. diagnose only the remainder.

Defined cases: null text and empty rows are rejects (``empty``); rows of files that the catalog does not list are
rejects (``unknown_file``); repeated rows are judged each on their own; trailing CR and LF are not part of a row; an
empty table gives empty frames. Extra columns of the raw table are dropped, so they cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.session import broadcast_if_small

COUNTS = ("approx_token_counts_original", "approx_token_counts_translated")
LOW, HIGH = -1, 2**63 - 1
CANONICAL = "id string, text string, source string, approx_token_counts_original bigint, approx_token_counts_translated bigint"
_FIELD = re.compile(r'(?:"([^"]*(?:""[^"]*)*)"|([^";\r\n]*))(;|\Z)')
_WHOLE = re.compile(r"-?[0-9]+\Z")
_JSON_SPACE = " \t\n\r"


class Reject(ValueError):
    """A record that does not conform; the message is the reason."""


def _no_constant(name: str) -> None:
    raise Reject("json_constant")



class _Long(str):
    pass


def _parse_json(text: str) -> object:
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=lambda s: int(s) if len(s) <= 30 else _Long(s), parse_float=lambda s: _Float(s))
    except Reject:
        raise
    except RecursionError:
        return _parse_deep(text)
    except ValueError as e:
        message = str(e)
        for part, reason in (("Extra data", "json_extra_data"), ("Unterminated string", "json_unterminated_string"), ("control character", "json_control_character"), ("escape", "json_escape"), ("property name", "json_property_name"), ("trailing comma", "json_trailing_comma"), ("':' delimiter", "json_colon"), ("',' delimiter", "json_comma"), ("BOM", "json_bom")):
            if part in message:
                raise Reject(reason) from None
        raise Reject("json_value") from None


class _Float(str):
    """A number with a fraction or an exponent."""


_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|([{}\[\],:]))')


def _parse_deep(text: str) -> object:
    """RFC 8259 without recursion, for nesting beyond the parser's depth; only the top object's plain values are kept."""
    pos, stack, state, top, key = 0, [], "value", {}, None
    end = len(text.rstrip(_JSON_SPACE))
    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m:
            raise Reject("json_value")
        pos = m.end()
        string, number, word, mark = m.groups()
        depth = len(stack)
        if state == "done":
            raise Reject("json_extra_data")
        if string is not None and state in ("key", "key_or_end"):
            key, state = json.loads(string) if depth == 1 else key, "colon"
        elif mark == ":" and state == "colon":
            state = "value"
        elif state in ("value", "value_or_end") and mark not in ("}", ",", ":", "]"):
            if mark in ("{", "["):
                if depth == 1 and stack[0] == "{":
                    top[key] = []
                stack.append(mark)
                state = "key_or_end" if mark == "{" else "value_or_end"
                continue
            if depth == 1:
                top[key] = _parse_json(m.group().strip(_JSON_SPACE))
            state = "after" if stack else "done"
        elif mark in ("}", "]") and stack and stack[-1] == {"}": "{", "]": "["}[mark] and state in ("after", "key_or_end" if mark == "}" else "value_or_end"):
            first = stack.pop()
            state = "after" if stack else "done"
            if not stack and first == "[":
                return []
        elif mark == "," and state == "after":
            state = "key" if stack[-1] == "{" else "value"
        else:
            raise Reject("json_value")
    if state != "done":
        raise Reject("json_value")
    return top


def _is_whole(value: object) -> bool:
    return type(value) is int


def load_jsonl(text: str, id_field: str | None, text_field: str) -> tuple:
    """The canonical record of one JSON line, or Reject."""
    data = _parse_json(text)
    if not isinstance(data, dict):
        raise Reject("json_not_object")
    body = data.get(text_field)
    if not isinstance(body, str) or isinstance(body, (_Long, _Float)):
        raise Reject("text_missing" if body is None else "text_type")
    if not body.strip():
        raise Reject("text_blank")
    rid = None
    if id_field is not None:
        rid = data.get(id_field)
        if isinstance(rid, _Float) or not (_is_whole(rid) or isinstance(rid, str)):
            raise Reject("id_missing" if rid is None else "id_type")
        rid = str(rid)
        if not rid.strip():
            raise Reject("id_blank")
    counts = []
    for name in COUNTS:
        value = data.get(name)
        if value is not None and not (_is_whole(value) and LOW <= value <= HIGH):
            raise Reject("count_range" if _is_whole(value) or isinstance(value, _Long) else "count_type")
        counts.append(value)
    source = data.get("source")
    return (_plain(rid), _plain(body), _plain(source) if isinstance(source, str) else None, *counts)


def _plain(text: str | None) -> str | None:
    """JSON may escape lone surrogates, which no UTF-8 column can hold: they become U+FFFD in the canonical record."""
    return None if text is None else str(text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def load_csv(text: str, id_field: str | None) -> tuple:
    """The canonical record of one csv row, or Reject."""
    fields, pos = [], 0
    while True:
        m = _FIELD.match(text, pos)
        if not m:
            raise Reject("csv_quoting")
        fields.append(m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2))
        pos = m.end()
        if m.group(3) == "":
            break
    if len(fields) != 5:
        raise Reject("csv_columns")
    rid, body, source, *numbers = fields
    if not body.strip():
        raise Reject("text_blank")
    if id_field is not None and not rid.strip():
        raise Reject("id_blank")
    counts = []
    for number in numbers:
        if number == "":
            counts.append(None)
            continue
        if not _WHOLE.match(number):
            raise Reject("count_type")
        if len(number.lstrip("-0")) > 19 or not LOW <= int(number) <= HIGH:
            raise Reject("count_range")
        counts.append(int(number))
    return (rid if rid.strip() else None, body, source if source != "" else None, *counts)


def load_record(text: str | None, row_format: str | None, id_field: str | None, text_field: str | None) -> tuple:
    """The canonical record of one row in its file's format, or Reject with the reason."""
    body = (text or "").rstrip("\r\n")
    if not body:
        raise Reject("empty")
    if row_format == "jsonl":
        return load_jsonl(body, id_field, text_field or "text")
    if row_format == "csv":
        return load_csv(body, id_field)
    raise Reject("unknown_file")


def _some(value: object) -> object:
    return None if value is None or (isinstance(value, float) and value != value) else value


def _strict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, name, line, text, kind, idf, tf in zip(b.raw_id, b.file_name, b.line_no, b.text, b.row_format, b.id_field, b.text_field):
            try:
                rows.append((key, name, line, *load_record(_some(text), _some(kind), _some(idf), _some(tf))))
            except Reject:
                pass
        names = ["raw_id", "file_name", "line_no", "id", "text", "source", *COUNTS]
        # Column by column, because a frame of mixed rows would turn counts with nulls into floats and lose digits.
        columns = zip(*rows) if rows else [()] * len(names)
        yield pd.DataFrame({n: pd.array(list(c), dtype="Int64" if n in ("raw_id", "line_no", *COUNTS) else object) for n, c in zip(names, columns)})


def _diagnose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        reasons = []
        for text, kind, idf, tf in zip(b.text, b.row_format, b.id_field, b.text_field):
            try:
                load_record(_some(text), _some(kind), _some(idf), _some(tf))
                reasons.append("not_loaded")
            except Reject as e:
                reasons.append(str(e))
        yield b[["raw_id", "file_name", "line_no", "text"]].assign(reason=reasons)


def with_format(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """Raw rows with their file's form. The catalog has a row per file; it is broadcast only if counted as small."""
    forms = catalog.select("file_name", "row_format", "id_field", "text_field").dropDuplicates(["file_name"])
    return raw.select("raw_id", "file_name", "line_no", "text").join(broadcast_if_small(forms), "file_name", "left").select("raw_id", "file_name", "line_no", "text", "row_format", "id_field", "text_field")


def strict_load(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """Canonical records of the conforming rows with their offsets. An absent id becomes <file>_<line>; an absent
    source 'not available'; absent counts -1."""
    schema = f"raw_id bigint, file_name string, line_no bigint, {CANONICAL}"
    loaded = with_format(raw, catalog).mapInPandas(_strict, schema)
    return loaded.withColumns({
        "id": F.coalesce("id", F.concat_ws("_", "file_name", F.col("line_no").cast("string"))),
        "source": F.coalesce("source", F.lit("not available")),
        **{c: F.coalesce(c, F.lit(-1).cast("bigint")) for c in COUNTS},
    })


def rejected(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows that the strict load does not return, each with its reason: raw offsets minus loaded offsets."""
    loaded = strict_load(raw, catalog).select("raw_id")
    rest = with_format(raw, catalog).join(loaded, "raw_id", "left_anti")
    return rest.mapInPandas(_diagnose, "raw_id bigint, file_name string, line_no bigint, text string, reason string")
