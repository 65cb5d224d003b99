"""Filling fixed-capacity containers: harmonic packing, with the room that classes leave filled from smaller ones.

Harmonic packing puts a length L into class k = capacity // L and fills each bin of the class with exactly k items.
Alone it leaves class 1 (more than half the capacity) a quarter empty. The plan here opens bins in the same way, class
by class from the longest length, but first offers items to the best-fitting room of bins that are already open. It
works on the histogram of lengths only (at most ``capacity`` numbers); a plan is a table of slots: "of length L, items
number first.. go t per bin into the bins from base on".

Workers pack independently: items are dealt by a hash of their key into groups of about ``GROUP_ITEMS``, and each group
is planned and filled alone. Ids are shuffled once. What this costs is the partly filled bins at the end of each group,
a few in thousands; ``fill_report`` counts them. A group's size doesn't depend on how lengths or sources are spread.

Defined cases: items without real positions are in no container; items longer than the capacity are cut into full
containers' worth and a rest; repeated rows are packed each (the key must be unique); an empty table gives none.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.items import real_ids

CAPACITY = 512
#: Items that are packed together; a group's ids are held in one task's memory.
GROUP_ITEMS = 16_384
Slots = list[tuple[int, int, int, int, int, int]]


def harmonic_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Slots, int]:
    """Pure harmonic packing: bins of class k take k items of the class, whatever their lengths."""
    classes: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, count in sorted(histogram.items(), reverse=True):
        classes[capacity // n].append((n, count))
    slots, base = [], 0
    for k, members in sorted(classes.items()):
        shift = 0
        for n, count in members:
            slots.append((n, 0, count, shift, k, base))
            shift += count
        base += -(-shift // k)
    return slots, base


def refined_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Slots, int]:
    """Harmonic opening plus best fit into the room of open bins, over groups of equal bins."""
    slots: Slots = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first bin, bins)
    bins = 0
    for n, count in sorted(histogram.items(), reverse=True):
        first = 0
        fitting = [r for r in rooms if r >= n]
        heap: list[int] = []
        for r in fitting:
            heappush(heap, r)
        while first < count and heap:
            room = heappop(heap)
            fit = room // n
            for start, size in rooms.pop(room, []):
                left = count - first
                if left == 0:
                    rooms[room].append((start, size))
                    continue
                full = min(size, left // fit)
                if full:
                    slots.append((n, first, first + full * fit, 0, fit, start))
                    if room - fit * n:
                        rooms[room - fit * n].append((start, full))
                    first += full * fit
                left = count - first
                if full < size and left:  # fewer than fit are left: one bin takes them
                    slots.append((n, first, count, 0, left, start + full))
                    if room - left * n:
                        rooms[room - left * n].append((start + full, 1))
                    first = count
                    full += 1
                if full < size:
                    rooms[room].append((start + full, size - full))
        if first < count:
            k = capacity // n
            full, rest = divmod(count - first, k)
            if full:
                slots.append((n, first, first + full * k, 0, k, bins))
                if capacity - k * n:
                    rooms[capacity - k * n].append((bins, full))
                first += full * k
                bins += full
            if rest:
                slots.append((n, first, count, 0, rest, bins))
                rooms[capacity - rest * n].append((bins, 1))
                bins += 1
    return slots, bins


def fragments(items: DataFrame, key: str = "item_id", capacity: int = CAPACITY) -> DataFrame:
    """key, frag_ix, ids, n: whole items, and the parts of those longer than the capacity."""
    whole = items.select(key, real_ids().alias("__real"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("__real") / capacity).cast("int") - 1), lambda i: F.slice("__real", i * capacity + 1, F.lit(capacity)))
    out = whole.filter(F.size("__real") > 0).select(key, F.posexplode(parts).alias("frag_ix", "ids"))
    return out.withColumn("n", F.size("ids"))


def _group(key: str, groups: int, seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(groups)).cast("int")


def _groups(items: DataFrame) -> int:
    return max(1, -(-items.select(F.lit(1)).count() // GROUP_ITEMS))


def bins_of(sizes: np.ndarray, capacity: int, refine: bool) -> np.ndarray:
    """The bin of each item of a group, from the plan for its sizes; items of one size are numbered as they come."""
    values, counts = np.unique(sizes, return_counts=True)
    slots, _ = (refined_slots if refine else harmonic_slots)(dict(zip(values.tolist(), counts.tolist())), capacity)
    order = np.argsort(sizes, kind="stable")
    begin = dict(zip(values.tolist(), (np.cumsum(counts) - counts).tolist()))
    out = np.empty(len(sizes), np.int64)
    for n, first, last, shift, per_bin, base in slots:
        out[order[begin[n] + first : begin[n] + last]] = base + (np.arange(last - first) + shift) // per_bin
    return out


def pack(items: DataFrame, key: str = "item_id", capacity: int = CAPACITY, refine: bool = True, seed: int = 42) -> DataFrame:
    """container_id, n_items, used, members (key, frag_ix, n in order) and input_ids of every container."""
    groups = _groups(items)
    parts = fragments(items, key, capacity).select(_group(key, groups, seed).alias("__g"), key, "frag_ix", "n", "ids")
    kind = items.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group, keys = table.column(0)[0].as_py(), table.column(1)
        table = table.take(pa.array(np.lexsort((table.column(2).to_numpy(), pd.Series(keys.to_pandas()).rank(method="dense").to_numpy()))))
        frag, n = (table.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        bins = bins_of(n, capacity, refine)
        order = np.lexsort((np.arange(len(n)), -n, bins))
        table, bins, n = table.take(pa.array(order)), bins[order], n[order]
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        members = pa.StructArray.from_arrays([table.column(1).combine_chunks(), pa.array(frag[order].astype(np.int32)), pa.array(n.astype(np.int32))], names=[key, "frag_ix", "n"])
        rows, ids = np.r_[first, len(bins)].astype(np.int32), np.r_[0, np.cumsum(n)]
        return pa.table(
            {
                "container_id": pa.array((np.int64(group) << 32) + bins[first]),
                "n_items": pa.array(np.diff(rows).astype(np.int32)),
                "used": pa.array(np.diff(ids[rows]).astype(np.int32)),
                "members": pa.ListArray.from_arrays(pa.array(rows), members),
                "input_ids": pa.ListArray.from_arrays(pa.array(ids[rows].astype(np.int32)), pa.concat_arrays([c.flatten() for c in table.column(4).chunks])),
            }
        )

    schema = f"container_id bigint, n_items int, used int, members array<struct<{key}: {kind}, frag_ix: int, n: int>>, input_ids array<int>"
    return parts.groupBy("__g").applyInArrow(run, schema)


def fill_report(items: DataFrame, key: str = "item_id", capacity: int = CAPACITY, seed: int = 42) -> DataFrame:
    """Containers, positions and fill of pure and refined harmonic packing, beside the least number possible by size."""
    groups = _groups(items)
    sizes = fragments(items, key, capacity).groupBy(_group(key, groups, seed).alias("g"), "n").count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        histogram = dict(zip(pdf["n"].tolist(), pdf["count"].tolist()))
        plans = (("harmonic", harmonic_slots), ("harmonic_refined", refined_slots))
        total = sum(n * c for n, c in histogram.items())
        return pd.DataFrame([(name, plan(histogram, capacity)[1], total) for name, plan in plans], columns=["method", "containers", "positions"])

    bins = sizes.groupBy("g").applyInPandas(run, "method string, containers bigint, positions bigint").groupBy("method").agg(F.sum("containers").alias("containers"), F.sum("positions").alias("positions"))
    fill = F.col("positions") / (F.col("containers") * capacity)
    return bins.select("method", "containers", "positions", fill.alias("fill"), F.ceil(F.col("positions") / capacity).alias("least_possible"))
