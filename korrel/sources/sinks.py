"""Writing results: JSON lines per input, combined tables per split, merged, fixed-size and near-equal files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions.text import sanitize
from korrel.operators.sequence import tiles


def jsonl_per_file(df: DataFrame, path: str, file: str = "source_file") -> None:
    df.write.mode("overwrite").partitionBy(file).json(path)


def combined(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet", clean: bool = True) -> None:
    """One directory per split; text, id and source sanitised; counts cast, failing casts become -1."""
    counts = [c for c in ("approx_token_counts_original", "approx_token_counts_translated") if c in df.columns]
    out = df.withColumns({c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(-1).cast("bigint")) for c in counts})
    if clean:
        out = out.withColumns({c: sanitize(c) for c in ("text", "id", "source") if c in df.columns})
    out.write.mode("overwrite").option("compression", "snappy" if fmt == "parquet" else "none").partitionBy(split).format(fmt).save(path)


def merge(spark: SparkSession, paths: Sequence[str], path: str, files: int | None = None) -> None:
    """Tables cast to the first one's schema and written as one; exactly once, the last partial batch too. files asks
    for a number of output files, by default Spark's own."""
    first = spark.read.parquet(paths[0])
    out = first
    for p in paths[1:]:
        other = spark.read.parquet(p)
        out = out.unionByName(other.select([F.col(f.name).cast(f.dataType).alias(f.name) if f.name in other.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema]))
    (out if files is None else out.coalesce(files)).write.mode("overwrite").parquet(path)


def fixed_rows(df: DataFrame, path: str, rows: int) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def near_equal(df: DataFrame, path: str, key: str, parts: int) -> None:
    tiles(df, key, parts).drop("pos").repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(path)


def keep_or_write(df: DataFrame, path: str, force: bool = False) -> None:
    """Written only if nothing is there, unless forced."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def dry_run(files: DataFrame, root: str, target: str) -> DataFrame:
    """Where each listed file would go, with the structure below root kept; nothing is copied."""
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + root.rstrip("/") + "\\E/", "")
    return files.select("path", F.concat(F.lit(target.rstrip("/") + "/"), relative).alias("target"), "length")


def result_csv(df: DataFrame, path: str) -> None:
    """Separated by semicolons; white space at the ends of values is kept."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(sep=";", header=True, **kept).csv(path)
