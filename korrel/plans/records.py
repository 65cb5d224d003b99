"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.session import read
from korrel.sources.strict_records import rejected, strict_load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(read(spark, d, "raw_records"), read(spark, d, "file_catalog")).select("raw_id")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rejected(read(spark, d, "raw_records"), read(spark, d, "file_catalog"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return strict_load(read(spark, d, "raw_records"), read(spark, d, "file_catalog"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return p1_rejects(spark, d).groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_rejects": p1_rejects, "p1_records": p1_records, "p1_reasons": p1_reasons}
SQL: dict[str, str] = {}
