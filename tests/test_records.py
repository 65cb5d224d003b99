"""Strict loading: what RFC 8259 and the csv form allow, against literal rows."""

import json

import pytest

from korrel.sources.strict_records import Reject, _parse_deep, load_record, rejected, strict_load

CATALOG = [("a.jsonl", "jsonl", "id", "text"), ("n.jsonl", "jsonl", None, "body"), ("c.csv", "csv", "id", "text"), ("d.csv", "csv", None, "text")]
FORMS = {c[0]: c[1:] for c in CATALOG}
GOOD = [
    ("a.jsonl", '{"id": "x", "text": "hi"}'), ("a.jsonl", ' {"id": 7, "text": "hi", "more": {"a": [1.5e3, null, true]}}\r\n'), ("n.jsonl", '{"body": "b", "approx_token_counts_original": -1}'),
    ("a.jsonl", '{"id": "x", "text": "\\ud83d\\ude00", "approx_token_counts_translated": 9223372036854775807}'), ("a.jsonl", '{"id":"x","text":"t","big":' + "9" * 6000 + "}"),
    ("a.jsonl", '{"id":"x","text":"t","deep":' + "[" * 20000 + "]" * 20000 + "}"),
    ("c.csv", 'i;"a ""b"" c\nd";s;1;-1'), ("c.csv", "i;t;;;\n"), ("d.csv", ';t;"s";"12";0'), ("c.csv", 'i;"' + "x" * 100000 + '";;;'),
]
BAD = [
    ("a.jsonl", "", "empty"), ("a.jsonl", None, "empty"), ("a.jsonl", "\r\n", "empty"), ("a.jsonl", "null", "json_not_object"), ("a.jsonl", "[{}]", "json_not_object"),
    ("a.jsonl", '{"id": "x", "text": "hi"', "json_comma"), ("a.jsonl", "{'id': 'x'}", "json_property_name"), ("a.jsonl", '{"id": "x", "text": "a\tb"}', "json_control_character"),
    ("a.jsonl", '{"id": "x", "text": NaN}', "json_constant"), ("a.jsonl", '{"id": "x", "text": "a"} {}', "json_extra_data"), ("a.jsonl", '{"id": "x", "text": "  "}', "text_blank"),
    ("a.jsonl", '{"text": "t"}', "id_missing"), ("a.jsonl", '{"id": true, "text": "t"}', "id_type"), ("a.jsonl", '{"id": 1.5, "text": "t"}', "id_type"), ("a.jsonl", '{"id": "", "text": "t"}', "id_blank"),
    ("n.jsonl", '{"text": "t"}', "text_missing"), ("n.jsonl", '{"body": "t", "approx_token_counts_original": 1.0}', "count_type"), ("n.jsonl", '{"body": "t", "approx_token_counts_original": -2}', "count_range"),
    ("n.jsonl", '{"body": "t", "approx_token_counts_original": 9223372036854775808}', "count_range"), ("n.jsonl", '{"body": "t", "approx_token_counts_original": true}', "count_type"),
    ("a.jsonl", '﻿{"id": "x", "text": "t"}', "json_bom"), ("a.jsonl", '{"id": "x", "text": "t", "n": 012}', "json_comma"), ("a.jsonl", '{"id":"x","text":"t","deep":' + "[" * 20000 + "}", "json_value"),
    ("c.csv", "a;b;c;1", "csv_columns"), ("c.csv", "a;b;c;1;2;3", "csv_columns"), ("c.csv", 'a;"b;c;1;2', "csv_quoting"), ("c.csv", 'a;b"c;s;1;2', "csv_quoting"), ("c.csv", 'a;"b" x;s;1;2', "csv_quoting"),
    ("c.csv", "a;b\nc;s;1;2", "csv_quoting"), ("c.csv", ";b;s;1;2", "id_blank"), ("c.csv", "a; ;s;1;2", "text_blank"), ("c.csv", "a;b;s;x;2", "count_type"), ("c.csv", "a;b;s;+1;2", "count_type"), ("c.csv", "a;b;s;-2;2", "count_range"),
    ("c.csv", "a;b;s;1;9223372036854775808", "count_range"), ("c.csv", "a;b;s;1;١", "count_type"), ("z.txt", "x", "unknown_file"),
]


@pytest.mark.parametrize("name,row", GOOD)
def test_good(name, row):
    assert load_record(row, *FORMS[name])[1].strip()


@pytest.mark.parametrize("name,row,reason", BAD)
def test_bad(name, row, reason):
    with pytest.raises(Reject, match=f"^{reason}$"):
        load_record(row, *FORMS.get(name, (None, None, None)))


def test_deep_parser_agrees():
    for text in ('{"a": 1, "b": [1, {"c": "x"}], "d": null}', '{"a": "x\\n", "b": {}}', "{}"):
        want = json.loads(text)
        got = _parse_deep(text)
        assert {k: v for k, v in want.items() if not isinstance(v, (list, dict))} == {k: v for k, v in got.items() if not isinstance(v, list)}
    for text in ('{"a": 1,}', '{"a" 1}', "[1 2]", '{"a": 1}}', '{"a": tru}', "[", '{"a": [}'):
        with pytest.raises(Reject):
            _parse_deep(text)


def test_split_of_rows(spark):
    rows = [(i, n, i, r, "x") for i, (n, r) in enumerate([*GOOD, *[b[:2] for b in BAD]])]
    raw = spark.createDataFrame(rows, "raw_id bigint, file_name string, line_no bigint, text string, row_format string")
    catalog = spark.createDataFrame([*CATALOG, CATALOG[0]], "file_name string, row_format string, id_field string, text_field string")
    good = {r.raw_id for r in strict_load(raw, catalog).select("raw_id").collect()}
    bad = {r.raw_id: r.reason for r in rejected(raw, catalog).collect()}
    assert good == set(range(len(GOOD)))
    assert bad == {len(GOOD) + i: b[2] for i, b in enumerate(BAD)}
    assert rejected(raw.limit(0), catalog).count() == 0
