"""Chunking, grouping and padding of token arrays. Arrays are cut per row and never exploded to single tokens, except
where rows are joined end to end.

Null arrays count as empty; an empty array has no chunk. Ties and repeated rows need no rule: every row is cut alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.functions.text import words
from korrel.ordering import ordinal


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ids_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.array().cast("array<int>"))


def pad(c: Column | str, size: int, value: int) -> Column:
    """Padded on the right up to size; longer arrays stay."""
    return F.concat(col(c), F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(col(c)), F.lit(0))))


def pad_to_multiple(c: Column | str, width: int, value: int) -> Column:
    return F.concat(col(c), F.array_repeat(F.lit(value), F.pmod(F.lit(width) - F.pmod(F.size(col(c)), F.lit(width)), F.lit(width))))


def pieces(c: Column | str, size: int) -> Column:
    """Consecutive slices of at most size elements."""
    a = col(c)
    n = F.ceil(F.size(a) / size).cast("int")
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(a, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))


def chunked(df: DataFrame, ids: str, size: int, keys: list[str]) -> DataFrame:
    """One row per chunk: keys, chunk_ix, chunk (not padded)."""
    return df.select(*keys, F.posexplode(pieces(ids_or_empty(ids), size)).alias("chunk_ix", "chunk"))


def with_eos(c: Column | str, eos: int) -> Column:
    """EOS at the end unless it is there."""
    a = col(c)
    return F.when(F.try_element_at(a, F.lit(-1)).eqNullSafe(F.lit(eos)), a).otherwise(F.concat(a, F.array(F.lit(eos))))


def truncated_eos(c: Column | str, size: int, eos: int) -> Column:
    """At most size elements; where something is cut off, the last one is EOS."""
    a = with_eos(c, eos)
    return F.when(F.size(a) > size, F.concat(F.slice(a, 1, size - 1), F.array(F.lit(eos)))).otherwise(a)


def mask_of(c: Column | str, real: Column | int, size: int) -> Column:
    """1 for the real elements, 0 for padding."""
    n = F.lit(real) if isinstance(real, int) else real
    return F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(size))), F.array_repeat(F.lit(0), F.greatest(F.lit(size) - n, F.lit(0))))


def concat_and_cut(df: DataFrame, key: str, ids: str, size: int, batch: int) -> DataFrame:
    """Rows in key order are joined end to end in batches of ``batch`` rows and cut every ``size`` tokens; a batch's
    remainder is dropped. Offsets come from the rows' lengths; a row is cut at the chunk borders it crosses, so tokens
    are moved in slices, not one by one."""
    placed = ordinal(df.select(key, ids_or_empty(ids).alias("__ids")), [key], "__pos").withColumn("batch", F.floor(F.col("__pos") / batch).cast("bigint"))
    from pyspark.sql import Window

    w = Window.partitionBy("batch").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("__ids")
    sized = placed.filter(n > 0).withColumn("__from", F.coalesce(F.sum(n).over(w), F.lit(0)))
    first, last = F.floor(F.col("__from") / size), F.floor((F.col("__from") + n - 1) / size)
    cut = sized.select("batch", "__from", "__ids", F.explode(F.sequence(first, last)).alias("chunk_ix"))
    low = F.greatest(F.col("chunk_ix") * size - F.col("__from"), F.lit(0))
    high = F.least((F.col("chunk_ix") + 1) * size - F.col("__from"), F.size("__ids").cast("bigint"))
    part = cut.select("batch", "chunk_ix", F.struct("__from", F.slice("__ids", (low + 1).cast("int"), (high - low).cast("int")).alias("ids")).alias("p"))
    out = part.groupBy("batch", "chunk_ix").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("chunk"))
    return out.filter(F.size("chunk") == size)


def position_ids(c: Column | str, width: int, pad_id: int) -> Column:
    return F.transform(col(c), lambda x, i: F.when(x == pad_id, F.lit(0)).otherwise(F.lit(pad_id + 1) + F.pmod(i, F.lit(width))))


def first_of_each(c: Column | str, width: int) -> Column:
    return F.filter(col(c), lambda x, i: F.pmod(i, F.lit(width)) == 0)


def uniform_chunks(c: Column | str, size: int, special: int, pad_id: int, longest: int) -> Column:
    """Slices of size - 1 of at most ``longest`` tokens, padded, each with a special id in front, or the pad id where a
    slice holds nothing but padding."""
    return F.transform(pieces(F.slice(col(c), 1, longest), size - 1), lambda p: F.concat(F.array(F.when(F.exists(p, lambda x: x != 0), F.lit(special)).otherwise(F.lit(pad_id))), pad(p, size - 1, pad_id)))


def overlay_pair(first: Column | str, second: Column | str, width: int, pad_id: int) -> Column:
    """The second text goes into the sentence slots behind those that the first one uses."""
    a, b = col(first), col(second)
    used = F.size(F.filter(first_of_each(a, width), lambda x: x != pad_id))
    room = F.size(a) - used * width
    return F.concat(F.slice(a, 1, used * width), F.slice(pad(b, 1, pad_id), F.lit(1), F.least(F.size(b), room)), F.array_repeat(F.lit(pad_id), F.greatest(room - F.size(b), F.lit(0))))


def pack_sentences(lengths: list[int], limit: int, split: bool = False) -> list[list[int]]:
    """Greedy packing of sentence numbers: a sentence that is too long alone is dropped, or put alone if split."""
    out, now, used = [], [], 0
    for i, n in enumerate(lengths):
        if n > limit:
            if now:
                out.append(now)
                now, used = [], 0
            if split:
                out.append([i])
            continue
        if used + n > limit:
            out.append(now)
            now, used = [], 0
        now.append(i)
        used += n
    return [*out, now] if now else out


def group_sentences(sentences: list[list[int]], size: int, special: int, pad_id: int, most: int) -> list[int]:
    """Hierarchical grouping: sentences are packed to size - 1 tokens, each group gets a special id in front and is
    padded. An over-long sentence that meets an empty group leaves its first size - 1 tokens and carries what follows
    position size; one that meets a filled group becomes the next group and is cut to size - 1 later."""
    groups: list[list[int]] = []
    buffer: list[int] = []
    for s in sentences:
        rest = list(s)
        if len(buffer) + len(rest) <= size - 1:
            buffer += rest
            continue
        if buffer:
            groups.append(buffer)
            buffer = rest
        else:
            while len(rest) > size - 1:
                groups.append(rest[: size - 1])
                rest = rest[size:]
            buffer = rest
    if buffer:
        groups.append(buffer)
    out: list[int] = []
    for g in groups[:most]:
        out += [special, *g[: size - 1], *[pad_id] * (size - 1 - len(g[: size - 1]))]
    return out


def sentence_packs(df: DataFrame, key: str, sentences: str, limit: int) -> DataFrame:
    """key, pack_ix, text of greedy packs by words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, s, n in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2]):
                rows += [(k, i, " ".join(s[j] for j in p), int(sum(n[j] for j in p))) for i, p in enumerate(pack_sentences(list(n), limit))]
            yield pd.DataFrame(rows, columns=[key, "pack_ix", "text", "n_words"])

    kind = df.schema[key].dataType.simpleString()
    sized = df.select(key, sentences, F.transform(sentences, lambda s: F.size(words(s))).alias("__n"))
    return sized.mapInPandas(run, f"{key} {kind}, pack_ix int, text string, n_words int")


def hierarchical(df: DataFrame, key: str, ids: str, ends: list[int], size: int, special: int, pad_id: int, most: int) -> DataFrame:
    """key and grouped ids; sentences end behind the given ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop = set(ends)
        for b in batches:
            rows = []
            for k, v in zip(b.iloc[:, 0], b.iloc[:, 1]):
                sents, now = [], []
                for x in v.tolist():
                    now.append(x)
                    if x in stop:
                        sents.append(now)
                        now = []
                rows.append((k, group_sentences([*sents, now] if now else sents, size, special, pad_id, most)))
            yield pd.DataFrame(rows, columns=[key, "grouped"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids_or_empty(ids)).mapInPandas(run, f"{key} {kind}, grouped array<int>")
