"""Running and tumbling metrics, schedules and masking draws as column expressions.

Running numbers are prefix sums in two levels: per bucket of the order, plus the totals of earlier buckets, so that one
group's rows are spread over its buckets instead of one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.ordering import uniform


def running(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """The frame with n and total up to and including each row, within its groups. bucket must rise with the order."""
    totals = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__t"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__bn"), F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__bt"))
    here = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__hn", F.count(F.lit(1)).over(here)).withColumn("__ht", F.sum(value).over(here)).join(totals, [*groups, bucket])
    return out.withColumn("n", F.col("__hn") + F.col("__bn")).withColumn("total", F.col("__ht") + F.col("__bt")).drop("__hn", "__ht", "__bn", "__bt")


def clean_loss(c: Column) -> Column:
    """NaN and infinite values become 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def perplexity(c: Column, clamp: float | None = 10.0) -> Column:
    return F.exp(c if clamp is None else F.least(c, F.lit(clamp)))


def linear_rate(step: Column, peak: float, warm: int, total: int) -> Column:
    return F.when(step < warm, step / warm * peak).otherwise(F.greatest(F.lit(0.0), (F.lit(float(total)) - step) / max(1, total - warm)) * peak)


def cosine_rate(step: Column, peak: float, warm: int, total: int, cycles: float = 0.5) -> Column:
    part = (step - warm) / max(1, total - warm)
    return F.when(step < warm, step / warm * peak).otherwise(F.greatest(F.lit(0.0), F.lit(0.5) * (1 + F.cos(F.lit(math.pi * cycles * 2) * part))) * peak)


def aligned(step: Column, accumulate: int) -> Column:
    """Rounded up to an accumulation boundary, at least one."""
    return F.greatest(F.ceil(step / accumulate) * accumulate, F.lit(accumulate))


def mlm(df: DataFrame, ids: str, key: str, specials: tuple[int, ...], mask_id: int, vocabulary: int, rate: float = 0.15, mask_all: bool = False, seed: object = "mlm") -> DataFrame:
    """df with masked (masked ids) and labels: a draw per place selects it; of the selected, 8 in 10 become mask_id, 1 in
    10 a drawn id and 1 in 10 stay (all become mask_id if mask_all). Labels are -100 elsewhere; specials are never
    selected. Each place is drawn once, into an array that ids and labels share."""
    draw = lambda s, i: uniform(f"{seed}{s}", F.col(key), i)
    how = (lambda i: F.lit(0.0)) if mask_all else (lambda i: draw("h", i))
    drawn = df.withColumn("__how", F.transform(ids, lambda x, i: F.when(~x.isin(*specials) & (draw("s", i) < rate), how(i))))

    def masked(x: Column, i: Column) -> Column:
        h = F.get(F.col("__how"), i)
        return F.when(h.isNull(), x).when(h < 0.8, F.lit(mask_id)).when(h < 0.9, F.floor(draw("r", i) * vocabulary).cast("int")).otherwise(x)

    labels = F.transform(ids, lambda x, i: F.when(F.get(F.col("__how"), i).isNull(), F.lit(-100)).otherwise(x))
    return drawn.withColumns({"masked": F.transform(ids, masked), "labels": labels}).drop("__how")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays of one size; 0 where a norm is 0, null where the sizes differ."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(F.size(x) == F.size(y), F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0)))


def contrastive(df: DataFrame, group: str, place: str, first: str, second: str, temperature: float = 0.1) -> DataFrame:
    """group, n and loss of in-batch contrast: each of the two views of a row must find the other one among all views of
    its batch but itself. Rows of a batch go to one task, so a batch is to be of bounded size; norms of 0 stay 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(place)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        x, y = (unit(np.array(pdf[c].tolist(), float)) for c in (first, second))
        n, queue = len(x), np.concatenate([x, y])
        total = 0.0
        for own, offset in ((x, 0), (y, n)):
            logits = own @ queue.T / temperature
            logits[np.arange(n), offset + np.arange(n)] = -1e3
            top = logits.max(1, keepdims=True)
            total += float((np.log(np.exp(logits - top).sum(1)) + top[:, 0] - logits[np.arange(n), n - offset + np.arange(n)]).mean()) / 2
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [n], "loss": [total]})

    return df.select(group, place, first, second).groupBy(group).applyInPandas(run, f"{group} {df.schema[group].dataType.simpleString()}, n bigint, loss double")


def covariance_sums(df: DataFrame, vector: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of all dimensions: size² numbers per task, summed in Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            x = np.array(b.iloc[:, 0].tolist(), float).reshape(-1, size)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        values = np.r_[n, s, p.ravel()]
        yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

    sums = df.select(vector).filter(F.size(vector) == size).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas().v.to_numpy()
    if not len(sums):
        return 0, np.zeros(size), np.zeros((size, size))
    return int(sums[0]), sums[1 : size + 1], sums[size + 1 :].reshape(size, size)


def vicreg(df: DataFrame, vector: str, size: int) -> tuple[float, float]:
    """Variance and covariance regularisers of a set of vectors."""
    n, s, p = covariance_sums(df, vector, size)
    if n < 2:
        return 0.0, 0.0
    c = (p - np.outer(s, s) / n) / (n - 1)
    variance = float(np.maximum(0, 1 - np.sqrt(np.diag(c) + 1e-4)).mean())
    return variance, float(((c**2).sum() - (np.diag(c) ** 2).sum()) / size)
