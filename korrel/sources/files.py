"""Reading raw files: JSON lines with repair, text files, listings, declared schemas, tables of any listed form.

Bad rows never stop a scan: they are counted or returned beside the good ones. Null and empty inputs give empty frames.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.json as arrow_json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.functions.text import strip
from korrel.ordering import md5_of, ordinal
from korrel.session import broadcast_if_small

CANONICAL = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("approx_token_counts_original", T.LongType()), T.StructField("approx_token_counts_translated", T.LongType()),
])
#: Line ends as splitlines() sees them, a fixed value.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def repair_line(line: str, strict: bool = False) -> tuple[dict | list | str | None, str]:
    """(value, status) of one JSON line: ok, repaired (a truncated string was closed), or bad. With ``strict`` the
    closing is tried behind the line end, where it helps only on an unterminated last line."""
    body = line if strict else line.rstrip("\r\n")
    for text, status in ((body, "ok"), (body + '"}', "repaired")):
        try:
            return json.loads(text), status
        except (ValueError, RecursionError):
            continue
    return None, "bad"


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], strict: bool = False) -> DataFrame:
    """file, line text, status and the repaired JSON of every line; filter on status for good and bad rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [repair_line(v, strict) for v in b.value]
            yield b.assign(status=[s for _, s in found], json=[json.dumps(x, ensure_ascii=False) if s != "bad" else None for x, s in found])

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").filter(strip("value") != "")
    return lines.mapInPandas(run, "file string, value string, status string, json string")


def read_txt(spark: SparkSession, paths: str | Sequence[str], separator: str | None = None, charset: str = "ISO-8859-1") -> DataFrame:
    """file, ix, text in one charset, split at a literal separator or at line ends. A file is one value here,
    because a reader of lines knows neither all line ends of splitlines nor the empty text behind a last separator: for
    many small files; read_lines takes large ones."""
    raw = spark.read.format("binaryFile").load(paths)
    body = F.decode("content", charset)
    if separator is None:
        parts = F.split(body, LINE_END)
        parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    else:
        parts = F.split(body, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    return raw.select(F.col("path").alias("file"), F.posexplode(parts).alias("ix", "text"))


def read_lines(spark: SparkSession, paths: str | Sequence[str], separator: str | None = None, charset: str = "ISO-8859-1") -> DataFrame:
    """file, ix, text of text files of any size, which are split among tasks: cut at a literal separator of one to a few
    bytes, or at line feeds and carriage returns. As a reader of lines it gives nothing behind a last separator."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), F.decode(F.col("value").cast("binary"), charset).alias("text"))
    placed = ordinal(rows, ["file", "__b", "__m"], "__p")
    first = placed.groupBy("file").agg(F.min("__p").alias("__first"))
    return placed.join(broadcast_if_small(first), "file").select("file", (F.col("__p") - F.col("__first")).alias("ix"), "text")


def listing(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """path, length of the files below a directory, sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    return files.select("path", "length").orderBy("path")


def read_declared(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = CANONICAL) -> DataFrame:
    """JSON lines with a declared schema; what does not fit is null, not an error."""
    return spark.read.schema(schema).json(paths)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """json, jsonl, csv, txt, parquet or orc by extension."""
    kind = path.rstrip("*").rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    return spark.read.format(kind).load(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).csv(path)


def texts(df: DataFrame, names: Sequence[str] = ("text", "tekst")) -> DataFrame:
    """The text column under the first name that is there, else the first string column; nulls are dropped."""
    found = next((n for n in names if n in df.columns), None) or next((f.name for f in df.schema if isinstance(f.dataType, T.StringType)), None)
    if found is None:
        raise ValueError("no text column")
    return df.select(F.col(found).alias("text")).filter("text is not null")


def read_splits(spark: SparkSession, inputs: dict[str, str]) -> DataFrame:
    """One input per split, tagged."""
    out = None
    for name, path in inputs.items():
        part = read_any(spark, path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_shuffled(spark: SparkSession, inputs: dict[str, str], key: str, text: str, seed: object = 42) -> tuple[DataFrame, list[str]]:
    """Texts of named tables in the order of a loader that shuffles its files and the rows of each: input, key, text,
    file_key, row_key in their order; blank texts are left out. Inputs without the text column are skipped and named."""
    parts, skipped = [], []
    for name, path in inputs.items():
        df = read_any(spark, path)
        if text in df.columns:
            parts.append(df.select(F.lit(name).alias("input"), F.col(key).alias("key"), F.col(text).alias("text")).filter(strip("text") != ""))
        else:
            skipped.append(name)
    if not parts:
        raise ValueError("no input has the text column")
    rows = reduce(lambda a, b: a.unionByName(b), parts).withColumns({"file_key": md5_of(seed, "input"), "row_key": md5_of(seed, "input", "key")})
    return rows.orderBy("file_key", "row_key", "key"), skipped


def header(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


#: Nesting beyond which a line is not given to the second parser, whose recursion has no guard of its own.
DEEPEST = 64


def _depth(value: object) -> int:
    level, depth = [value], 0
    while level:
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        depth += 1
    return depth


def _line_status(line: str) -> str:
    """blank, good, or the first parser that does not take the line: a strict one, then Arrow's."""
    if not line.strip():
        return "blank"
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return "bad"
    if not isinstance(value, dict) or line.count("[") + line.count("{") > DEEPEST and _depth(value) > DEEPEST:
        return "bad_arrow"
    try:
        arrow_json.read_json(io.BytesIO(line.encode("utf-8", "surrogatepass")), arrow_json.ReadOptions(use_threads=False, block_size=max(1 << 20, 8 * len(line))))
    except pa.ArrowException:
        return "bad_arrow"
    return "good"


def json_report(lines: DataFrame, first: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts of lines by status, and the first bad ones; blank lines are counted but not tested. lines has n, value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(status=[_line_status(v) for v in b.value])

    tested = lines.select("n", "value").filter("value is not null").mapInPandas(run, "n bigint, value string, status string")
    return tested.groupBy("status").agg(F.count(F.lit(1)).alias("n")), tested.filter("status like 'bad%'").orderBy("n").limit(first)


def read_jsonl_skipping(spark: SparkSession, directory: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Lines of all files below a directory that can be read (as read_jsonl), and a log: file, line text and problem of
    every bad line, and every file that gave no line at all because it is unreadable, with a null line."""
    spark_reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [repair_line(v) for v in b.value]
            yield b.assign(status=[s for _, s in found], json=[json.dumps(x, ensure_ascii=False) if s != "bad" else None for x, s in found])

    lines = spark_reader.text(directory).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = lines.filter(strip("value") != "").mapInPandas(run, "file string, value string, status string, json string")
    name = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    seen = lines.select(name("file").alias("file")).distinct()
    listed = listing(spark, directory, pattern).filter("length > 0").select(name("path").alias("file"))
    silent = listed.join(seen, "file", "left_anti").select("file", F.lit(None).cast("string").alias("line"), F.lit("unreadable file").alias("problem"))
    bad = rows.filter("status = 'bad'").select(name("file").alias("file"), F.col("value").alias("line"), F.lit("bad line").alias("problem"))
    return rows, bad.unionByName(silent)
