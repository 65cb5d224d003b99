"""Queries of sources and sinks: tables are written to a scratch folder in the shared checkpoint folder by a sink and
read back by a source, over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import registry
from korrel.functions import text as t
from korrel.operators.chunks import chunked
from korrel.plans.corpus import sql_chain, sql_words
from korrel.session import read, scratch
from korrel.sources import files, sinks

COUNTS = ("approx_token_counts_original", "approx_token_counts_translated")


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "id", "text", "source", "split", *COUNTS)


def sink_combined_parquet(spark: SparkSession, d: str) -> DataFrame:
    """One table per split, sanitised, counts cast; read back with the split of its folder (null for none)."""
    root = scratch(spark, "combined")
    sinks.combined(_canonical(spark, d), root)
    return spark.read.parquet(root).select("doc_id", "split", F.md5(F.col("text").cast("binary")).alias("text_md5"), *COUNTS)


def sink_combined_json(spark: SparkSession, d: str) -> DataFrame:
    """The same as JSON lines with the counts as text; what is no number becomes -1."""
    root = scratch(spark, "combined")
    texts = _canonical(spark, d).withColumns({c: F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("n/a")).otherwise(F.col(c).cast("string")) for c in COUNTS})
    sinks.combined(texts, root, fmt="json", clean=False)
    back = spark.read.schema(f"doc_id bigint, {COUNTS[0]} bigint, {COUNTS[1]} bigint, split string").json(root)
    return back.select("doc_id", "split", *COUNTS)


def sink_merge(spark: SparkSession, d: str) -> DataFrame:
    """Tables merged under the first one's schema: other types are cast, missing columns null, others dropped."""
    root = scratch(spark, "merge")
    read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("n"), "source").write.parquet(f"{root}/a")
    read(spark, d, "raw_records").select(F.col("raw_id").cast("string").alias("key"), F.length("text").alias("n"), "line_no").write.parquet(f"{root}/b")
    sinks.merge(spark, [f"{root}/a", f"{root}/b"], f"{root}/out")
    return spark.read.parquet(f"{root}/out")


def sink_jsonl_per_file(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines in one folder per input, <stem>_normalised."""
    root = scratch(spark, "jsonl")
    rows = read(spark, d, "raw_records").select("raw_id", F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit("_normalised")).alias("source_file"), F.length("text").alias("n"))
    sinks.jsonl_per_file(rows, root)
    back = spark.read.schema("raw_id bigint, n bigint, source_file string").json(root)
    return back.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))


def sink_fixed_rows(spark: SparkSession, d: str) -> DataFrame:
    """No file of more than 100 rows: how many rows there are in all, and whether a file has more."""
    root = scratch(spark, "fixed")
    sinks.fixed_rows(read(spark, d, "raw_records").select("raw_id"), root, 100)
    per = spark.read.parquet(root).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), (F.max("n") <= 100).alias("within"))


def sink_near_equal(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "equal")
    sinks.near_equal(read(spark, d, "raw_records").select("raw_id"), root, "raw_id", 7)
    return spark.read.parquet(root).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("raw_id").alias("first"), F.max("raw_id").alias("last"))


def sink_keep(spark: SparkSession, d: str) -> DataFrame:
    """A table that is there is kept, unless its writing is forced."""
    root, docs = scratch(spark, "keep"), read(spark, d, "documents").select("doc_id")
    sinks.keep_or_write(docs.withColumn("turn", F.lit(1)), f"{root}/kept")
    sinks.keep_or_write(docs.withColumn("turn", F.lit(2)), f"{root}/kept")
    sinks.keep_or_write(docs.withColumn("turn", F.lit(1)), f"{root}/forced")
    sinks.keep_or_write(docs.withColumn("turn", F.lit(3)), f"{root}/forced", force=True)
    return spark.read.parquet(f"{root}/kept").unionByName(spark.read.parquet(f"{root}/forced"))


def sink_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """Where each input would be copied, with its folder below the root."""
    listed = read(spark, d, "file_catalog").select(F.concat(F.lit("file:/data/raw/"), "row_format", F.lit("/"), "file_name").alias("path"), F.length("file_name").alias("length"))
    return sinks.dry_run(listed, "/data/raw", "bucket/corpus/").select("path", "target", "length")


def sink_result_csv(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "csv")
    sinks.result_csv(read(spark, d, "study_labels").select("studyid_0771", "target", "label"), root)
    return files.read_dictionary(spark, root).select("studyid_0771", "target", F.col("label").cast("int").alias("label"))


def sink_projected(spark: SparkSession, d: str) -> DataFrame:
    """Lazy scan, columns projected and given, written with a bounded row group."""
    root = scratch(spark, "projected")
    out = read(spark, d, "documents").select(F.col("id").cast("string").alias("id"), F.col("n_chars").alias("approx_tokens"), F.lit("web").alias("source"))
    out.write.option("parquet.block.size", 1 << 20).parquet(root)
    return spark.read.parquet(root)


def source_declared_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines under a declared schema: a field that isn't in it is left out, one that is missing is null."""
    root = scratch(spark, "declared")
    _canonical(spark, d).select("id", "text", F.col(COUNTS[0]), F.lit(1).alias("extra")).write.json(root)
    return files.read_declared(spark, root).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", *COUNTS)


def source_csv_dictionary(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "dictionary")
    sinks.result_csv(read(spark, d, "misspellings").select("seed", "word"), root)
    return files.read_dictionary(spark, root).groupBy("seed", "word").agg(F.count(F.lit(1)).alias("n"))


def source_splits(spark: SparkSession, d: str) -> DataFrame:
    """One input per split, of other formats and with other columns, as one tagged table."""
    root, docs = scratch(spark, "splits"), read(spark, d, "documents").select("doc_id", "lang", "split")
    docs.filter("split = 'train'").drop("split").write.parquet(f"{root}/train.parquet")
    docs.filter("split = 'validation'").select("doc_id").write.json(f"{root}/validation.json")
    return files.read_splits(spark, {"train": f"{root}/train.parquet", "validation": f"{root}/validation.json"}).select("doc_id", "lang", "split")


def source_pretokenized(spark: SparkSession, d: str) -> DataFrame:
    """Tokenized tables train_<length>.parquet, found by their name."""
    root = scratch(spark, "tokenized")
    read(spark, d, "tokenized_examples").select("item_id", "input_ids").write.parquet(f"{root}/train_512.parquet")
    return files.read_any(spark, f"{root}/train_512.parquet").select("item_id", F.coalesce(F.size("input_ids"), F.lit(0)).alias("n"))


def source_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts alone, from JSON lines, text lines and Parquet with another column name; null ones are left out."""
    root, docs = scratch(spark, "texts"), read(spark, d, "documents").select("text", "lang", "source")
    docs.select("text").write.json(f"{root}/a.jsonl")
    docs.select("lang").filter("lang is not null").write.text(f"{root}/b.txt")
    docs.select(F.col("source").alias("tekst")).write.parquet(f"{root}/c.parquet")
    parts = [files.texts(files.read_any(spark, f"{root}/{n}")) for n in ("a.jsonl", "b.txt", "c.parquet")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


def source_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of texts and one without, read in the order of shuffled files and rows."""
    root = scratch(spark, "shuffled")
    read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").write.parquet(f"{root}/a.parquet")
    read(spark, d, "radiology_reports").select(F.col("report_id").alias("key"), F.col("content_attachment1_plain_data").alias("text")).write.parquet(f"{root}/b.parquet")
    read(spark, d, "tokenized_examples").select(F.col("item_id").alias("key")).write.parquet(f"{root}/c.parquet")
    rows, skipped = files.read_shuffled(spark, {n: f"{root}/{n}.parquet" for n in "abc"}, "key", "text")
    return rows.select("input", "key", "file_key", "row_key", F.lit(",".join(skipped)).alias("skipped"))


def source_header(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, (n, _) in enumerate(files.header(read(spark, d, "documents")))], "place int, name string")


def source_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files below a folder by pattern: inputs per form."""
    root = scratch(spark, "listing")
    read(spark, d, "raw_records").select("file_name", "text").repartition("file_name").write.partitionBy("file_name").text(root)
    return files.listing(spark, root, "*.txt").select(F.regexp_extract("path", "file_name=[^/]*?([a-z]+)/[^/]*$", 1).alias("form"), F.regexp_extract("path", "(file_name=[^/]*)/", 1).alias("folder")).distinct().groupBy("form").agg(F.count(F.lit(1)).alias("inputs"))


def source_jsonl_repair(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines read with repair: rows by status."""
    root = scratch(spark, "repair")
    _lines(spark, d).write.text(f"{root}/lines")
    return files.read_jsonl(spark, f"{root}/lines").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def source_skipping(spark: SparkSession, d: str) -> DataFrame:
    """What a reader skips: bad lines, and a file that cannot be read (a broken archive), by problem."""
    root = scratch(spark, "skipping")
    _lines(spark, d).write.text(f"{root}/good")
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/broken/x.txt.gz")
    stream = broken.getFileSystem(spark._jsc.hadoopConfiguration()).create(broken)
    stream.writeBytes("this is no archive")
    stream.close()
    return files.read_jsonl_skipping(spark, root, "*.txt*")[1].groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def source_txt(spark: SparkSession, d: str) -> DataFrame:
    """Text files in latin-1, cut at a literal separator."""
    root = scratch(spark, "txt")
    read(spark, d, "file_catalog").agg(F.array_join(F.array_sort(F.collect_list("file_name")), "|*|").alias("v")).coalesce(1).write.option("lineSep", "|*|").text(root)
    parts = files.read_txt(spark, f"{root}/*.txt", separator="|*|").filter("text <> ''")
    return parts.select("ix", "text")


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text files in latin-1 that are split among tasks: how often each line occurs, and the sum of their places
    against what it must be."""
    root = scratch(spark, "lines")
    read(spark, d, "documents").select("source").filter("source is not null").repartition(3, "source").write.text(root)
    rows = files.read_lines(spark, root)
    wrong = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ix").alias("m"), F.max("ix").alias("x")).filter("n <> m or x <> n - 1")
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")).unionByName(wrong.select(F.lit("files numbered wrongly").alias("text"), "n"))


def sink_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and as Parquet with array columns, read back from both."""
    root = scratch(spark, "chunks")
    chunks = chunked(read(spark, d, "tokenized_examples"), "input_ids", 128, ["item_id"])
    chunks.write.json(f"{root}/json")
    chunks.write.parquet(f"{root}/parquet")
    a = spark.read.schema("item_id bigint, chunk_ix int, chunk array<int>").json(f"{root}/json")
    both = a.withColumn("form", F.lit("json")).unionByName(spark.read.parquet(f"{root}/parquet").withColumn("form", F.lit("parquet")))
    return both.select("form", "item_id", "chunk_ix", F.size("chunk").alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw records of JSON files that are one line each."""
    one = r"[\r\n]"
    return read(spark, d, "raw_records").filter("file_name like '%.jsonl'").select(F.regexp_replace("text", r"[\r\n]+$", "").alias("value")).filter(~F.col("value").rlike(one) & (t.strip("value") != ""))


def registered_functions(spark: SparkSession, d: str) -> DataFrame:
    """The text functions by name in SQL."""
    registry.register(spark)
    return spark.sql("select doc_id, korrel_word_count(text) as n_words, md5(korrel_sanitize(text)) as sane, md5(korrel_collapse_spaces(korrel_strip(text))) as stripped from {docs}", docs=read(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        sink_combined_parquet, sink_combined_json, sink_merge, sink_jsonl_per_file, sink_fixed_rows, sink_near_equal, sink_keep, sink_dry_run, sink_result_csv,
        sink_projected, source_declared_json, source_csv_dictionary, source_splits, source_pretokenized, source_texts, source_shuffled, source_header, source_listing,
        source_jsonl_repair, source_skipping, source_txt, source_lines, sink_chunks, registered_functions,
    )
}
_SANE = lambda c: sql_chain(f"coalesce({c}, '')", ((t.CONTROLS, ""), (t.SINGLE_QUOTES, ""), (t.DOUBLE_QUOTES, "")))
_STRIPPED = sql_chain(sql_chain("text", ((f"^{t.SPACE}+|{t.SPACE}+$", ""),)), ((t.SPACE + "{2,}", " "),))
SQL = {
    "sink_combined_parquet": f"select doc_id, split, md5({_SANE('text')}) as text_md5, {', '.join(f'coalesce({c}, -1) as {c}' for c in COUNTS)} from documents",
    "sink_combined_json": f"select doc_id, split, {', '.join(f'case when doc_id % 7 = 0 then -1 else coalesce({c}, -1) end as {c}' for c in COUNTS)} from documents",
    "sink_merge": "select doc_id as key, n_chars as n, source from documents union all select raw_id, length(text)::bigint, null from raw_records",
    "sink_jsonl_per_file": r"select regexp_replace(file_name, '\.[^.]*$', '') || '_normalised' as source_file, count(*) as rows, sum(length(text))::bigint as n from raw_records group by 1",
    "sink_fixed_rows": "select count(*) as rows, true as within from raw_records",
    "sink_near_equal": "with k as (select raw_id, (ntile(7) over (order by raw_id) - 1)::int as part from raw_records) select part, count(*) as rows, min(raw_id) as first, max(raw_id) as last from k group by 1",
    "sink_keep": "select doc_id, 1 as turn from documents union all select doc_id, 3 from documents",
    "sink_dry_run": "select 'file:/data/raw/' || row_format || '/' || file_name as path, 'bucket/corpus/' || row_format || '/' || file_name as target, length(file_name)::int as length from file_catalog",
    "sink_result_csv": "select studyid_0771, target, label from study_labels",
    "sink_projected": "select id, n_chars as approx_tokens, 'web' as source from documents",
    "source_declared_json": f"select id, md5(text) as text_md5, null::varchar as source, {COUNTS[0]}, null::bigint as {COUNTS[1]} from documents",
    "source_csv_dictionary": "select seed, word, count(*) as n from misspellings group by 1, 2",
    "source_splits": "select doc_id, case when split = 'train' then lang end as lang, split from documents where split in ('train', 'validation')",
    "source_pretokenized": "select item_id, coalesce(len(input_ids), 0)::int as n from tokenized_examples",
    "source_texts": "with x as (select text from documents union all select lang from documents union all select source from documents) select md5(text) as text_md5, count(*) as n from x where text is not null group by 1",
    "source_shuffled": f"""with x as (select 'a' as input, doc_id as key, text from documents union all select 'b', report_id, content_attachment1_plain_data from radiology_reports)
        select input, key, md5('42:' || input) as file_key, md5('42:' || input || ':' || key) as row_key, 'c' as skipped from x where {sql_chain("text", ((f"^{t.SPACE}+|{t.SPACE}+$", ""),))} <> ''""",
    "source_header": "select (row_number() over () - 1)::int as place, column_name as name from (describe documents)",
    "source_listing": "select regexp_extract(file_name, '([a-z]+)$', 1) as form, count(distinct file_name) as inputs from raw_records group by 1",
    "source_txt": "select (row_number() over (order by file_name) - 1)::int as ix, file_name as text from file_catalog",
    "source_lines": "select source as text, count(*) as n from documents where source is not null group by 1",
    "sink_chunks": """with c as (select item_id, input_ids as a, unnest(range(ceil(len(input_ids) / 128.0)::bigint)) as k from tokenized_examples)
        select form, item_id, k::int as chunk_ix, least(128, len(a) - k * 128)::int as n from c, (values ('json'), ('parquet')) f(form)""",
    "registered_functions": f"select doc_id, coalesce(len({sql_words('text')}), 0)::int as n_words, md5({_SANE('text')}) as sane, md5({_STRIPPED}) as stripped from documents",
}
