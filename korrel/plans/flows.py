"""Queries over streams and whole flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.plans.tokens import SQL as TOKEN_SQL
from korrel.session import read, scratch
from korrel.sources.files import json_report
from korrel.streaming import corpus as s


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windowed counts of the event table as a stream, run to its end; the file sink takes closed windows only, so the
    result is written batch by batch."""
    schema = read(spark, d, "events").schema
    root = scratch(spark, "stream")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, d, "events"))
    counts = s.windowed_counts(events)

    def one(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out")

    q = counts.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream, cleaned and filtered into a table."""
    schema = read(spark, d, "documents").schema
    root = scratch(spark, "stream")
    docs = s.normalise_stream(spark, _folder(spark, d, "documents"), schema)
    s.write_available(docs, f"{root}/out", f"{root}/log").awaitTermination()
    return spark.read.schema(docs.schema).parquet(f"{root}/out").select("doc_id", "n_words")


def _folder(spark: SparkSession, d: str, table: str) -> str:
    """A path that a file stream accepts: the table's folder, or a pattern that only its file matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{d}/{table}.parquet" if fs.getFileStatus(path).isDirectory() else f"{d}/{table}.parque[t]"


def json_line_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the JSON files that a strict parser takes, and those it does not."""
    lines = read(spark, d, "raw_records").filter("file_name like '%.jsonl'").select(F.col("raw_id").alias("n"), F.col("text").alias("value"))
    return json_report(lines)[0]


def json_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 lines that a strict parser or the second one does not take, with the parser and their beginning."""
    lines = read(spark, d, "raw_records").filter("file_name like '%.jsonl'").select(F.col("raw_id").alias("n"), F.col("text").alias("value"))
    return json_report(lines)[1].select("n", "status", F.substring("value", 1, 80).alias("head"))


def chunk_stream(spark: SparkSession, d: str) -> DataFrame:
    """Concatenate-and-cut over arriving items: the scope of a cut is its micro-batch; here all items arrive in one."""
    root = scratch(spark, "chunks")
    items = read(spark, d, "tokenized_examples").select("item_id", "input_ids")
    s.chunk_available(spark, _folder(spark, d, "tokenized_examples"), items.schema, f"{root}/out", f"{root}/log", batch=100).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("batch", "chunk_ix", F.md5(F.array_join(F.col("chunk").cast("array<string>"), ",").cast("binary")).alias("ids"))


QUERIES = {"stream_event_counts": stream_event_counts, "stream_normalise": stream_normalise, "json_line_report": json_line_report, "json_bad_lines": json_bad_lines, "chunk_stream": chunk_stream}
SQL = {
    "chunk_stream": TOKEN_SQL["concat_chunk"],
    "stream_event_counts": "select strftime(time_bucket(interval 5 minutes, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
