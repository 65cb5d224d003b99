"""Queries of shuffling, sharding, batching, splitting and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.operators import sequence as s
from korrel.ordering import md5_of, ordinal, uniform
from korrel.session import read

WINDOW, BUFFER, BATCH, SHARDS = 500, 100, 32, 7
WEIGHTS = {"abstract_en": 0.2, "bijsluiter_eu": 0.3, "richtlijn_mt": 0.5}


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "source", "split")


def full_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Train only; the other splits keep their order."""
    docs = _keys(spark, d)
    train = s.shuffled(docs.filter("split = 'train'"), "doc_id").select("doc_id", "split", "pos")
    rest = ordinal(docs.filter("split is null or split <> 'train'"), ["doc_id"]).select("doc_id", "split", "pos")
    return train.unionByName(rest)


def shuffle_all_splits(spark: SparkSession, d: str) -> DataFrame:
    return s.shuffled(_keys(spark, d).filter("split is not null"), "doc_id", groups=["split"]).select("doc_id", "split", "pos")


def windowed_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return s.windowed_shuffle(_keys(spark, d).select("doc_id"), "doc_id", WINDOW)


def windowed_shuffle_twice(spark: SparkSession, d: str) -> DataFrame:
    return s.windowed_shuffle(_keys(spark, d).select("doc_id"), "doc_id", WINDOW, iterations=2)


def merge_and_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Two inputs cast to the first one's schema, merged, then shuffled."""
    first = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").cast("bigint").alias("n"))
    second = read(spark, d, "raw_records").select(F.concat(F.lit("r"), F.col("raw_id").cast("string")).alias("key"), F.length("text").alias("n"))
    merged = first.unionByName(second.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in first.schema]))
    return s.shuffled(merged, "key")


def block_buffer_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return s.block_shuffle(_keys(spark, d).select("doc_id"), "doc_id", BUFFER, 4, 1, 200)


def reservoir_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return s.reservoir_shuffle(_keys(spark, d).select("doc_id"), "doc_id", None, BUFFER)


def file_order(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "raw_records").select("file_name").distinct()
    return s.shuffled(files, "file_name", "42:0")


def two_level_stream(spark: SparkSession, d: str) -> DataFrame:
    """Files in hash order, rows in hash order within a file, blank texts dropped."""
    rows = read(spark, d, "raw_records").filter(F.trim("text") != "").select("file_name", "raw_id")
    return rows.select("file_name", "raw_id", md5_of("f", "file_name").alias("file_key"), md5_of("r", "raw_id").alias("row_key"))


def shard_strided(spark: SparkSession, d: str) -> DataFrame:
    return s.strided_shard(_keys(spark, d).select("doc_id"), "doc_id", SHARDS).select("doc_id", "shard")


def shard_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return s.tiles(_keys(spark, d).select("doc_id"), "doc_id", SHARDS, "shard").select("doc_id", "shard")


def file_ntile_split(spark: SparkSession, d: str) -> DataFrame:
    return s.tiles(read(spark, d, "raw_records").select("raw_id"), "raw_id", 9).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("raw_id").alias("first"), F.max("raw_id").alias("last"))


def fixed_partitions(spark: SparkSession, d: str) -> DataFrame:
    return s.batches(read(spark, d, "raw_records").select("raw_id"), "raw_id", 100).groupBy(F.format_string("partition_%06d.parquet", "batch").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("raw_id").alias("keys"))


def distributed_sampler(spark: SparkSession, d: str) -> DataFrame:
    return s.distributed_sample(_keys(spark, d).select("doc_id"), "doc_id", 16, epoch=3).select("doc_id", "rank", "step")


def distributed_sampler_drop_last(spark: SparkSession, d: str) -> DataFrame:
    return s.distributed_sample(_keys(spark, d).select("doc_id"), "doc_id", 16, epoch=3, drop_last=True).select("doc_id", "rank", "step")


def batch_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return s.batches(_keys(spark, d).select("doc_id"), "doc_id", BATCH).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def batch_drop_last(spark: SparkSession, d: str) -> DataFrame:
    return s.batches(_keys(spark, d).select("doc_id"), "doc_id", BATCH, True).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def sample_hundred(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 100 reports: the sampling operator."""
    return read(spark, d, "radiology_reports").select("report_id", md5_of("s", "report_id").alias("h")).orderBy("h", "report_id").limit(100)


def head_rows(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).orderBy("doc_id").limit(3)


def lockstep_steps(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are used when all shards stop with the shortest one."""
    sharded = _keys(spark, d).select("doc_id", F.pmod("doc_id", F.lit(SHARDS)).cast("int").alias("shard"))
    counts = {r["shard"]: r["count"] for r in sharded.groupBy("shard").count().collect()}
    limit = s.lockstep_limit(counts, 8)
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", "n", F.lit(limit).cast("bigint").alias("steps"), (F.lit(limit) * 8).cast("bigint").alias("used"))


def lockstep_accumulated(spark: SparkSession, d: str) -> DataFrame:
    """The same where shards look at each other only every fourth step."""
    sharded = _keys(spark, d).select("doc_id", F.pmod("doc_id", F.lit(SHARDS)).cast("int").alias("shard"))
    counts = {r["shard"]: r["count"] for r in sharded.groupBy("shard").count().collect()}
    limit = s.lockstep_limit(counts, 8, 4)
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", "n", F.lit(limit).cast("bigint").alias("steps"))


def train_val_percent(spark: SparkSession, d: str) -> DataFrame:
    """Where there is no validation split: the first 5 per cent of the rows, rounded."""
    docs = _keys(spark, d).select("doc_id")
    cut = round(docs.count() * 0.05)
    return ordinal(docs, ["doc_id"]).select("doc_id", F.when(F.col("pos") < cut, F.lit("validation")).otherwise(F.lit("train")).alias("split"))


def split_load(spark: SparkSession, d: str) -> DataFrame:
    """One input per split, tagged with its name."""
    docs = read(spark, d, "documents")
    parts = [docs.filter(F.col("split") == name).drop("split").withColumn("split", F.lit(name)) for name in ("train", "validation")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def interleave_equal(spark: SparkSession, d: str) -> DataFrame:
    return s.interleave(_keys(spark, d).select("doc_id", "source"), "doc_id", "source").select("doc_id", "source", "pos")


def interleave_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 slots of three sources, as its SQL has it; interleave_weighted_whole has no limit."""
    docs = _keys(spark, d).filter(F.col("source").isin(*WEIGHTS)).select("doc_id", "source")
    return s.weighted_interleave(docs, "doc_id", "source", WEIGHTS, 60).select("slot", "source", "doc_id")


def interleave_weighted_whole(spark: SparkSession, d: str) -> DataFrame:
    """All sources, weighted by their documents, until the first one is used up."""
    docs = _keys(spark, d).filter("source is not null").select("doc_id", "source")
    weights = {r["source"]: float(r["count"]) for r in docs.groupBy("source").count().collect()}
    if not weights:
        return docs.select(F.lit(0).cast("bigint").alias("slot"), "source", "doc_id")
    return s.weighted_interleave(docs, "doc_id", "source", weights).select("slot", "source", "doc_id")


def global_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal in an order of several keys, nulls first."""
    return ordinal(_keys(spark, d).select("source", "split", "doc_id"), ["source", "split", "doc_id"])


def steps_per_epoch(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", "n", F.ceil(F.col("n") / BATCH).cast("bigint").alias("batches"), F.floor(F.floor(F.col("n") / BATCH) / 4).cast("bigint").alias("steps"))


def uniform_draws(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("doc_id", F.round(uniform("u", "doc_id"), 9).alias("u"))


_MD5 = lambda seed, key: f"md5('{seed}:' || {key})"


def _windowed(source: str, it: int) -> str:
    return f"""select doc_id, row_number() over (order by {_MD5(f"42:{it}:w", f"(pos // {WINDOW})")}, {_MD5(f"42:{it}:r", "doc_id")}, doc_id) - 1 as pos from {source}"""


_SAMPLER = f"""o as (select doc_id, row_number() over (order by {_MD5(3, 'doc_id')}, doc_id) - 1 as pos from documents), n as (select count(*) as n from documents)"""
_PICK = "case " + " ".join(f"when u >= {e} then '{n}'" for e, n in ((0.5, "richtlijn_mt"), (0.2, "bijsluiter_eu"), (0.0, "abstract_en"))) + " end"

QUERIES = {f.__name__: f for f in (full_shuffle, shuffle_all_splits, windowed_shuffle, windowed_shuffle_twice, merge_and_shuffle, block_buffer_shuffle, reservoir_shuffle, file_order, two_level_stream, shard_strided, shard_contiguous, file_ntile_split, fixed_partitions, distributed_sampler, distributed_sampler_drop_last, batch_keep_last, batch_drop_last, sample_hundred, head_rows, lockstep_steps, lockstep_accumulated, train_val_percent, split_load, interleave_equal, interleave_weighted, interleave_weighted_whole, global_ordinal, steps_per_epoch, uniform_draws)}
SQL = {
    "full_shuffle": f"""select doc_id, split, row_number() over (order by {_MD5(42, 'doc_id')}, doc_id) - 1 as pos from documents where split = 'train'
        union all select doc_id, split, row_number() over (order by doc_id) - 1 from documents where split is null or split <> 'train'""",
    "shuffle_all_splits": f"select doc_id, split, row_number() over (partition by split order by {_MD5(42, 'doc_id')}, doc_id) - 1 as pos from documents where split is not null",
    "windowed_shuffle": f"with o as (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) {_windowed('o', 0)}",
    "windowed_shuffle_twice": f"with o as (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents), a as ({_windowed('o', 0)}) {_windowed('a', 1)}",
    "merge_and_shuffle": f"""with m as (select 'd' || doc_id as key, n_chars as n from documents union all select 'r' || raw_id, length(text)::bigint from raw_records)
        select key, n, row_number() over (order by {_MD5(42, 'key')}, key) - 1 as pos from m""",
    "block_buffer_shuffle": f"""with o as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents), m as (select doc_id, (i // 4) // {BUFFER} as k from o where i % 4 = 1),
        p as (select doc_id, row_number() over (order by k, {_MD5(42, 'doc_id')}, doc_id) - 1 as pos from m) select doc_id, pos from p where pos < 200""",
    "file_order": f"select file_name, row_number() over (order by {_MD5('42:0', 'file_name')}, file_name) - 1 as pos from (select distinct file_name from raw_records)",
    "two_level_stream": f"select file_name, raw_id, {_MD5('f', 'file_name')} as file_key, {_MD5('r', 'raw_id')} as row_key from raw_records where trim(text) <> ''",
    "shard_strided": f"select doc_id, ((row_number() over (order by doc_id) - 1) % {SHARDS})::int as shard from documents",
    "shard_contiguous": f"select doc_id, (ntile({SHARDS}) over (order by doc_id) - 1)::int as shard from documents",
    "file_ntile_split": "with t as (select raw_id, (ntile(9) over (order by raw_id) - 1)::int as part from raw_records) select part, count(*) as n, min(raw_id) as first, max(raw_id) as last from t group by 1",
    "fixed_partitions": "with t as (select raw_id, (row_number() over (order by raw_id) - 1) // 100 as b from raw_records) select printf('partition_%06d.parquet', b) as file, count(*) as n, sum(raw_id)::bigint as keys from t group by 1",
    "distributed_sampler": f"""with {_SAMPLER}, e as (select doc_id, pos from o union all select doc_id, pos + n from o, n where pos < (ceil(n / 16.0) * 16)::bigint - n)
        select doc_id, (pos % 16)::int as rank, (pos // 16)::bigint as step from e""",
    "distributed_sampler_drop_last": f"with {_SAMPLER} select doc_id, (pos % 16)::int as rank, (pos // 16)::bigint as step from o, n where pos < n // 16 * 16",
    "batch_keep_last": f"with t as (select doc_id, ((row_number() over (order by doc_id) - 1) // {BATCH})::bigint as batch from documents) select batch, count(*) as n, min(doc_id) as first from t group by 1",
    "batch_drop_last": f"with t as (select doc_id, ((row_number() over (order by doc_id) - 1) // {BATCH})::bigint as batch from documents) select batch, count(*) as n, min(doc_id) as first from t group by 1 having count(*) = {BATCH}",
    "sample_hundred": f"select report_id, {_MD5('s', 'report_id')} as h from radiology_reports order by h, report_id limit 100",
    "head_rows": "select doc_id, source, split from documents order by doc_id limit 3",
    "lockstep_steps": f"""with t as (select (doc_id % {SHARDS})::int as shard, count(*) as n from documents group by 1), l as (select min(n // 8) as steps from t)
        select shard, n, steps::bigint as steps, (steps * 8)::bigint as used from t, l""",
    "lockstep_accumulated": f"""with t as (select (doc_id % {SHARDS})::int as shard, count(*) as n from documents group by 1), l as (select min(n // 8) // 4 * 4 as steps from t)
        select shard, n, steps::bigint as steps from t, l""",
    "train_val_percent": "with t as (select doc_id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents) select doc_id, case when pos < round_even(n * 0.05, 0) then 'validation' else 'train' end as split from t",
    "split_load": "select split, count(*) as n, sum(n_chars)::bigint as chars from documents where split in ('train', 'validation') group by 1",
    "interleave_equal": f"""with k as (select doc_id, source, row_number() over (partition by source order by {_MD5('interleave', 'doc_id')}, doc_id) - 1 as k from documents where source is not null),
        m as (select min(n) as least, count(*) as sources from (select source, count(*) as n from documents where source is not null group by 1)),
        r as (select source, row_number() over (order by source) - 1 as rank from (select distinct source from documents where source is not null))
        select doc_id, k.source, k * sources + rank as pos from k join r on k.source = r.source, m where k < least""",
    "interleave_weighted": f"""with u as (select i as slot, ('0x' || substr(md5('42:' || i), 1, 8))::bigint / 4294967296.0::double as u from range(60) t(i)), p as (select slot, {_PICK} as source from u),
        n as (select slot, source, row_number() over (partition by source order by slot) - 1 as k from p), h as (select source, count(*) as have from documents group by 1),
        q as (select coalesce(min(slot), 1000) as stop from n left join h using (source) where k >= coalesce(have, 0)),
        d as (select doc_id, source, row_number() over (partition by source order by {_MD5('interleave', 'doc_id')}, doc_id) - 1 as k from documents)
        select slot, n.source, doc_id from n join d on n.source = d.source and n.k = d.k, q where slot < stop""",
    "global_ordinal": "select source, split, doc_id, row_number() over (order by source nulls first, split nulls first, doc_id) - 1 as pos from documents",
    "steps_per_epoch": f"select split, count(*) as n, ceil(count(*) / {BATCH}.0)::bigint as batches, ((count(*) // {BATCH}) // 4)::bigint as steps from documents group by 1",
    "uniform_draws": "select doc_id, round(('0x' || substr(md5('u:' || doc_id), 1, 8))::bigint / 4294967296.0::double, 9) as u from documents",
}
