"""Deterministic ordering without rand(): md5 draws, hash orders and global ordinals in parallel.

A global row_number() over an unpartitioned window sends every row to one task. ``ordinal`` instead cuts the key
space into buckets, numbers rows inside each bucket and adds the bucket's offset, which comes from one small
aggregate (one row per bucket). The number of buckets grows with the counted rows, so that no task sorts many more than
``BUCKET_ROWS`` of them at any size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket is to hold at most, on average; and buckets at least, for work on all cores.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 64
#: Keys drawn per bucket to find its bounds.
DRAWN = 16


def md5_of(seed: object, *parts: Column | str) -> Column:
    """md5('<seed>:<p1>:<p2>…') as 32 hex digits; null parts count as empty strings."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols).cast("binary"))


def uniform(seed: object, *parts: Column | str) -> Column:
    """A draw in [0, 1) that depends only on the seed and the parts: the first 8 hex digits over 2^32."""
    return F.conv(F.substring(md5_of(seed, *parts), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def _offsets(numbered: DataFrame, bucket: str, groups: Sequence[str]) -> DataFrame:
    """Rows before each bucket, per group: an aggregate of at most buckets × groups rows."""
    counts = numbered.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")


def _number(df: DataFrame, bucket: str, order: Sequence[Column], name: str, groups: Sequence[str]) -> DataFrame:
    before = _offsets(df, bucket, groups)
    w = Window.partitionBy(*groups, bucket).orderBy(*order)
    keys = [*groups, bucket]
    right = before.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before")
    on = [df[k].eqNullSafe(right[f"__k{i}"]) for i, k in enumerate(keys)]
    out = df.withColumn("__rn", F.row_number().over(w)).join(right, on, "left")
    return out.withColumn(name, F.col("__rn") + F.col("__before") - 1).drop("__rn", "__before", bucket, *[f"__k{i}" for i in range(len(keys))])


def _rows(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()


def hash_ordinal(df: DataFrame, seed: object, keys: Sequence[str], name: str = "pos", groups: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS, rows: int | None = None) -> DataFrame:
    """0-based position of each row in the order md5(seed, keys), keys: a full seeded shuffle, per group if groups
    are given. The leading hex digits split the order into equal ranges, 256 or as many as the counted rows need, so no
    sampling is needed and a hot group is numbered by all of them. Keys must be unique per row for a defined result; ties
    are broken by the keys. The number of rows can be given where it is known."""
    order = [F.col("__h"), *[F.col(k) for k in keys]]
    rows, digits = _rows(df) if rows is None else rows, 2
    while rows > bucket_rows * 16**digits:
        digits += 1
    hashed = df.withColumn("__h", md5_of(seed, *keys)).withColumn("__bucket", F.substring("__h", 1, digits))
    return _number(hashed, "__bucket", order, name, groups).drop("__h")


def ordinal(df: DataFrame, keys: Sequence[str], name: str = "pos", bucket_rows: int = BUCKET_ROWS, rows: int | None = None) -> DataFrame:
    """0-based position of each row in the order of keys (which must be unique per row; nulls first).

    The bounds of the buckets come from the rows whose key hash is small, ``DRAWN`` per bucket: a seedless sample that
    every run takes alike. Up to 64 bounds are tested one by one; each of these ranges has its own list of finer bounds,
    joined by range. Empty input gives an empty frame with the new column."""
    rows = _rows(df) if rows is None else rows
    buckets = max(LEAST_BUCKETS, -(-rows // bucket_rows))
    share = min(1.0, 1.5 * DRAWN * buckets / max(rows, 1))
    sample = df.select(*keys).filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    rank = lambda row: tuple((v is not None, v if v is not None else 0) for v in row)
    sample = sorted(sample, key=rank)
    bounds = sample[:: max(1, len(sample) // buckets)][1:]
    coarse = bounds[:: -(-len(bounds) // LEAST_BUCKETS)] if bounds else []
    kinds = {f.name: f.dataType for f in df.select(*keys).schema}
    bucket = F.lit(0)
    if coarse:
        tests = [_at_least([(k, F.lit(v).cast(kinds[k]) if v is not None else F.lit(None).cast(kinds[k]), v is None) for k, v in zip(keys, s)]) for s in coarse]
        bucket = F.aggregate(F.array(*[t.cast("int") for t in tests]), F.lit(0), lambda a, x: a + x)
    placed = df.withColumn("__bucket", bucket)
    if len(bounds) > len(coarse):
        firsts = [rank(s) for s in coarse]
        numbered = [(bisect_right(firsts, rank(s)), s) for s in bounds]
        lists = [(r, [tuple(s) for _, s in g]) for r, g in groupby(numbered, key=lambda x: x[0])]
        item = ", ".join(f"k{i}: {kinds[k].simpleString()}" for i, k in enumerate(keys))
        finer = F.broadcast(df.sparkSession.createDataFrame(lists, f"__range int, __bounds array<struct<{item}>>"))
        mine = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        inner = F.coalesce(F.size(F.filter("__bounds", lambda b: b <= F.col("__mine"))), F.lit(0))
        placed = placed.withColumn("__mine", mine).join(finer, F.col("__bucket") == F.col("__range"), "left").withColumn("__bucket", F.col("__bucket").cast("bigint") * (1 << 32) + inner).drop("__mine", "__range", "__bounds")
    return _number(placed, "__bucket", [F.col(k).asc_nulls_first() for k in keys], name, ())


def _at_least(parts: list[tuple[str, Column, bool]]) -> Column:
    """keys >= split in lexicographic order with nulls first."""
    name, value, is_null = parts[0]
    col = F.col(name)
    more = col.isNotNull() if is_null else (col.isNotNull() & (col > value))
    same = col.eqNullSafe(value)
    if len(parts) == 1:
        return F.coalesce(more | same, F.lit(False))
    return F.coalesce(more | (same & _at_least(parts[1:])), F.lit(False))
