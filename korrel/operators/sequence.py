"""Shuffles, shards, batches, buffers and interleaving: orders that depend on keys and seeds, never on partitions.

All of them take rows with a unique key. Positions come from ordering.ordinal or hash_ordinal, which number rows in
many tasks; a window without PARTITION BY is used nowhere. Empty frames give empty frames.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.ordering import hash_ordinal, md5_of, ordinal, uniform
from korrel.session import broadcast_if_small, cut

#: Rows of one worker of reservoir_shuffle, where the number of workers is not given.
WORKER_ROWS = 1_000_000


def shuffled(df: DataFrame, key: str, seed: object = 42, groups: Sequence[str] = ()) -> DataFrame:
    """Full seeded shuffle: pos is the 0-based place of each row."""
    return hash_ordinal(df, seed, [key], "pos", groups)


def windowed_shuffle(df: DataFrame, key: str, window: int, iterations: int = 1, seed: object = 42) -> DataFrame:
    """Rows are shuffled inside windows of the current order, the windows among themselves; repeated. Each order is cut off
    from what made it; pass keys alone, the other columns can be joined to the result."""
    rows = df.count()
    out = ordinal(df, [key], "pos", rows=rows)
    for i in range(iterations):
        out = cut(out)
        w = F.floor(F.col("pos") / window)
        keyed = out.withColumn("__w", md5_of(f"{seed}:{i}:w", w)).withColumn("__r", md5_of(f"{seed}:{i}:r", key)).drop("pos")
        out = ordinal(keyed, ["__w", "__r", key], "pos", rows=rows).drop("__w", "__r")
    return out


def block_shuffle(df: DataFrame, key: str, buffer: int, shards: int = 1, shard: int = 0, max_items: int | None = None, seed: object = 42) -> DataFrame:
    """Takes every shards-th row, fills a buffer, shuffles and drains it; stops after max_items."""
    mine = cut(ordinal(df, [key], "__i")).filter(F.pmod("__i", F.lit(shards)) == shard).withColumn("__k", F.floor(F.floor(F.col("__i") / shards) / buffer)).drop("__i")
    out = ordinal(mine.withColumn("__r", md5_of(seed, key)), ["__k", "__r", key], "pos").drop("__k", "__r")
    return out if max_items is None else out.filter(F.col("pos") < max_items)


def reservoir_order(keys: Sequence, buffer: int, seed: int, shuffle: bool = True) -> list:
    """A buffer of fixed size: fill it, then emit a random slot and put the next row in; shuffle what is left."""
    if not shuffle or buffer <= 0:
        return list(keys)
    rng, held, out = random.Random(seed), [], []
    for k in keys:
        if len(held) < buffer:
            held.append(k)
        else:
            i = rng.randrange(buffer)
            out.append(held[i])
            held[i] = k
    rng.shuffle(held)
    return out + held


def reservoir_shuffle(df: DataFrame, key: str, workers: int | None, buffer: int, seed: int = 42) -> DataFrame:
    """Each worker (rows dealt by key hash) runs its own buffer over its rows in key order; pos counts per worker. Only
    keys enter Python. Without a number of workers there is one per WORKER_ROWS counted rows, and 8 at least."""
    workers = workers or max(8, -(-df.count() // WORKER_ROWS))
    keys = df.select(key, F.pmod(F.xxhash64(key), F.lit(workers)).cast("int").alias("worker"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = reservoir_order(sorted(pdf[key].tolist()), buffer, seed + int(pdf.worker.iloc[0]))
        return pd.DataFrame({key: order, "worker": pdf.worker.iloc[0], "pos": range(len(order))})

    kind = df.schema[key].dataType.simpleString()
    return df.join(keys.groupBy("worker").applyInPandas(run, f"{key} {kind}, worker int, pos bigint"), key)


def strided_shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    return ordinal(df, [key], "pos").withColumn("shard", F.pmod("pos", F.lit(shards)).cast("int"))


def tiles(df: DataFrame, key: str, parts: int, name: str = "part") -> DataFrame:
    """Contiguous near-equal parts, the remainder to the first ones: ntile without one big task."""
    total = df.count()
    small, more = divmod(total, parts)
    edge = more * (small + 1)
    pos = F.col("pos")
    tile = F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(more + F.floor((pos - edge) / max(small, 1)))
    return ordinal(df, [key], "pos", rows=total).withColumn(name, tile.cast("int"))


def batches(df: DataFrame, key: str, size: int, drop_last: bool = False) -> DataFrame:
    """batch number of each row in key order; the last partial batch can be dropped."""
    out = ordinal(df, [key], "pos").withColumn("batch", F.floor(F.col("pos") / size).cast("bigint"))
    if drop_last:
        out = out.filter(F.col("batch") < df.count() // size)
    return out


def distributed_sample(df: DataFrame, key: str, replicas: int, epoch: int = 0, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """rank and step of each row of an epoch: shuffled by seed + epoch, dealt round robin; the tail is dropped, or
    filled by repeating the first rows, so that all ranks have as many."""
    total = df.count()
    placed = hash_ordinal(df, seed + epoch, [key], "pos", rows=total)
    if drop_last:
        placed = placed.filter(F.col("pos") < total // replicas * replicas)
    elif total and total % replicas:
        more = -(-total // replicas) * replicas - total
        copies = F.explode(F.sequence(F.lit(0), F.when(F.col("pos") < more % total, F.lit(more // total + 1)).otherwise(F.lit(more // total))))
        placed = placed.select("*", copies.alias("__c")).withColumn("pos", F.col("pos") + F.col("__c") * total).drop("__c")
    return placed.select("*", F.pmod("pos", F.lit(replicas)).cast("int").alias("rank"), F.floor(F.col("pos") / replicas).cast("bigint").alias("step"))


def interleave(df: DataFrame, key: str, source: str) -> DataFrame:
    """Round robin over sources until the first one is used up: pos is the place of each row that is taken. Sources are
    numbered in the order of their names by ``ordinal``, whatever their number; rows without a source take no part."""
    placed = hash_numbered(df, key, source)
    counts = df.filter(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    least, names = counts.agg(F.coalesce(F.min("__n"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    rank = broadcast_if_small(ordinal(counts.select(source), [source], "__rank"))
    return placed.filter(F.col("k") < least).join(rank, source).withColumn("pos", F.col("k") * names + F.col("__rank")).drop("k", "__rank")


def hash_numbered(df: DataFrame, key: str, source: str) -> DataFrame:
    """0-based number k of each row within its source, in hash order."""
    return hash_ordinal(df.filter(F.col(source).isNotNull()), "interleave", [key], "k", groups=[source])


def weighted_interleave(df: DataFrame, key: str, source: str, weights: dict[str, float], slots: int | None = None, seed: object = 42) -> DataFrame:
    """Slot i draws a source by its weight from a hash of i; the draw stops before the first slot whose source is used
    up. Without a number of slots it goes on until that happens. Weights are normalised; a sum of 0 or less, and sources without
    a weight, are errors of the caller."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    spark = df.sparkSession
    have = df.filter(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("__have"))
    if slots is None:
        held = {r[source]: r["__have"] for r in have.filter(F.col(source).isin(*weights)).collect()}
        tried = int(min(held.get(name, 0) * total / w for name, w in weights.items() if w > 0)) + 1024
        while True:  # the expected end of the first source; more slots where the draw has not used one up by then
            taken, ended = _drawn(spark, have, source, weights, tried, seed)
            if ended:
                break
            tried *= 2
    else:
        taken, _ = _drawn(spark, have, source, weights, slots, seed)
    return taken.join(hash_numbered(df, key, source), [source, "k"])


def _drawn(spark, have: DataFrame, source: str, weights: dict[str, float], slots: int, seed: object) -> tuple[DataFrame, bool]:
    """slot, source and number within the source of the slots before the first whose source is used up, and whether
    there is such a slot."""
    total = sum(weights.values())
    draws = spark.range(slots).withColumn("u", uniform(seed, F.col("id")))
    pick, edge = F.lit(None).cast("string"), 1.0
    for name, w in reversed(sorted(weights.items())):
        pick = F.when(F.col("u") < edge, F.lit(name)).otherwise(pick)
        edge -= w / total
    drawn = ordinal(draws.select(F.col("id").alias("slot"), pick.alias(source)), ["slot"], "__p")
    by = hash_free_number(drawn, "slot", source)
    short = by.join(have, source, "left").filter(F.col("k") >= F.coalesce("__have", F.lit(0))).agg(F.min("slot").alias("s")).collect()[0]["s"]
    taken = by if short is None else by.filter(F.col("slot") < short)
    return taken.select("slot", source, "k"), short is not None


def hash_free_number(df: DataFrame, order: str, source: str) -> DataFrame:
    """Number of each row within its source in slot order: per range of slots, plus the counts of earlier ranges."""
    from pyspark.sql import Window

    ranged = df.withColumn("__b", F.floor(F.col("__p") / 4096)).drop("__p")
    counts = ranged.groupBy(source, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(source).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = ranged.withColumn("__k", F.row_number().over(Window.partitionBy(source, "__b").orderBy(order)) - 1)
    return local.join(before, [source, "__b"]).withColumn("k", F.col("__k") + F.col("__before")).drop("__k", "__before", "__b")


def lockstep_limit(counts: dict[int, int], batch: int, accumulate: int = 1) -> int:
    """Steps until any shard is used up, which is looked at only at accumulation boundaries."""
    least = min((n // batch for n in counts.values()), default=0)
    return least if accumulate == 1 else -(-(least + 1) // accumulate) * accumulate - accumulate


def python_batches(rows: Iterator, size: int) -> Iterator[list]:
    """Batches of an iterator, the last one partial."""
    out = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
