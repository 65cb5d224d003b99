"""Word vocabularies by frequency, and encoding with them. No tokenizer is trained.

A vocabulary of up to LARGEST counted words is shipped to every task, and encoding is one narrow pass over Arrow
batches; a larger one is joined.
Null and empty texts give empty arrays; unknown words give UNK.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions.text import words

PAD, UNK, BOS, EOS, MASK = range(5)
#: Words of the largest vocabulary that is shipped.
LARGEST = 500_000
SPECIALS = ("<pad>", "<unk>", "<s>", "</s>", "<mask>")


def build(texts: DataFrame, text: str, size: int, min_frequency: int = 1) -> DataFrame:
    """token, count, id: the most frequent words, ties by the word itself; the first ids are the special tokens'."""
    counted = texts.filter(F.col(text).isNotNull()).select(F.explode(words(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_frequency)
    top = counted.orderBy(F.col("count").desc(), "token").limit(size)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.col("count").desc(), "token")) + len(SPECIALS) - 1).cast("int"))


def encode(df: DataFrame, keys: list[str], text: str, vocabulary: DataFrame, largest: int = LARGEST) -> DataFrame:
    """keys and input_ids; the keys tell rows apart."""
    rows = vocabulary.select("token", "id").limit(largest + 1).collect()
    split = F.coalesce(words(text), F.array().cast("array<string>"))
    if len(rows) > largest:
        return _encode_joined(df.select(*keys, split.alias("__words")), keys, vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(([r["token"] for r in rows], [r["id"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids = pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.int32())
        for b in batches:
            lists = b.column(len(keys))
            found = pc.fill_null(ids.take(pc.index_in(lists.flatten(), tokens)), UNK)
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.ListArray.from_arrays(offsets, found)], names=[*keys, "input_ids"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, split.alias("__words")).mapInArrow(run, f"{schema}, input_ids array<int>")


def _encode_joined(df: DataFrame, keys: list[str], vocabulary: DataFrame) -> DataFrame:
    """Words with their places joined to the vocabulary and put together again."""
    one = df.select(*keys, F.posexplode_outer("__words").alias("__at", "token")).join(vocabulary.select("token", "id"), "token", "left")
    listed = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("__at", F.coalesce("id", F.lit(UNK)).alias("id"))))).alias("l"))
    return listed.select(*keys, F.transform("l", lambda x: x["id"]).alias("input_ids"))


def special_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x < len(SPECIALS)).cast("int"))
