"""Queries of the problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.llm import bpe, mix, mojibake, overlap, pack, pii, split, stuffing
from korrel.session import read


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(read(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("doc_id")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = pii.find_pii(read(spark, d, "documents"), "doc_id", "text").withColumn("origin", F.lit("documents"))
    reports = pii.find_pii(read(spark, d, "radiology_reports"), "report_id", "content_attachment1_plain_data")
    return docs.unionByName(reports.withColumn("origin", F.lit("radiology_reports")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_clean(spark, d).select("origin", "rec_id", F.explode("kinds").alias("kind"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    texts = split.split_texts(read(spark, d, "documents")).withColumn("origin", F.lit("documents"))
    items = split.split_ids(read(spark, d, "tokenized_examples")).withColumn("origin", F.lit("tokenized_examples"))
    return texts.unionByName(items, allowMissingColumns=True).select("origin", "rec_id", "piece_ix", "n_pieces", "start", "end", "text", "input_ids")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).filter("piece_ix = 0 and n_pieces > 1").select("origin", "rec_id")


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(read(spark, d, "tokenized_examples"))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    return pack.fill_report(read(spark, d, "tokenized_examples"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.classes(read(spark, d, "documents"))[1]


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.classes(read(spark, d, "documents"))[0]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(read(spark, d, "documents")).select(F.least("eval_id", "train_id").alias("doc_id_a"), F.greatest("eval_id", "train_id").alias("doc_id_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(read(spark, d, "documents"))


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    return overlap.exact_counts(read(spark, d, "documents"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(read(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.find_stuffed(read(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_containers": p5_containers,
    "p5_fill": p5_fill,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p6_members": p6_members,
    "p6_report": p6_report,
    "p6_exact": p6_exact,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
}
SQL = {
    "p4_found": """
        select 'documents' as origin, doc_id as rec_id from documents where length(text) > 3000
        union all
        select 'tokenized_examples', item_id from tokenized_examples
        where len(list_filter(input_ids, lambda x, i: coalesce(attention_mask[i] = 1, x <> 2))) > 512""",
}
