"""Incremental arrival with Structured Streaming. The file log of the checkpoint tells which inputs are done, so a
restart reads only new files; stateless steps are the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from korrel.functions.text import clean, word_count
from korrel.operators.chunks import concat_and_cut


def normalise_stream(spark: SparkSession, source: str, schema: str, min_words: int = 32) -> DataFrame:
    docs = spark.readStream.schema(schema).parquet(source)
    return docs.filter("text is not null").withColumn("text", clean("text")).withColumn("n_words", word_count("text")).filter(F.col("n_words") >= min_words)


def write_available(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """All files that are there, then stop; run again for new ones."""
    return df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, size: int = 128, batch: int = 1000) -> StreamingQuery:
    """Concatenate-and-cut per micro-batch: its scope is the batch anyway."""

    def one(df: DataFrame, number: int) -> None:
        concat_and_cut(df, "item_id", "input_ids", size, batch).withColumn("micro_batch", F.lit(number)).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; ts may be a timestamp without zone, which watermarks do not take."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
