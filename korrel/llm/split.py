"""Splitting oversized items at natural boundaries.

Every position has a boundary strength. A sparse table answers "strongest boundary in this window, the rightmost of
equals" in O(1): level j holds the winner of each window of length 2^j, and any window is covered by two of them. A
piece that starts at s ends in [s + limit/2, s + limit], or, where there is no boundary, at the strongest one in
(s + overlap, s + limit/2), and is cut hard at the limit only if there is none either; the next one starts exactly
``overlap`` before that end.

Defined cases: items within the limit, null and empty ones give no piece; a text without any boundary is cut at the
limit; repeated rows are split each on their own; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.items import END, LINE_BREAK, SENTENCE_END, real_ids

TEXT_LIMIT, TEXT_OVERLAP = 3000, 200
ID_LIMIT, ID_OVERLAP = 512, 64
_SPACES = np.array([9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)
_ENDS = np.array([ord(c) for c in ".!?…。！？।"], np.uint32)


class StrongestCut:
    """Sparse table for range-maximum queries over boundary strengths, ties to the right."""

    def __init__(self, strength: np.ndarray, longest: int) -> None:
        self.strength = strength
        self.levels = [np.arange(len(strength))]
        step = 1
        while 2 * step <= min(longest, len(strength)):
            low = self.levels[-1]
            a, b = low[: len(low) - step], low[step:]
            self.levels.append(np.where(strength[b] >= strength[a], b, a))
            step *= 2

    def query(self, first: int, last: int) -> int:
        """Position of the strongest cut in [first, last]."""
        j = (last - first + 1).bit_length() - 1
        level = self.levels[j]
        a, b = level[first], level[last - (1 << j) + 1]
        return int(b if self.strength[b] >= self.strength[a] else a)


def text_strength(text: str) -> np.ndarray:
    """Strength of ending a piece before position i (0..n): 4 after an empty line, 3 after a line break, 2 after the
    space behind a sentence end, 1 after any space, 0 elsewhere."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    out = np.zeros(n + 1, np.int8)
    space = np.isin(code, _SPACES)
    out[1:][space] = 1
    closing = np.isin(code, _ENDS)
    out[2:][space[1:] & closing[:-1]] = 2
    line = code == 10
    out[1:][line | ((code == 13) & ~np.r_[line[1:], False])] = 3
    breaks = np.flatnonzero(out[1:] == 3)
    if len(breaks) > 1:  # two line breaks with nothing but spaces between them
        solid = np.r_[0, np.cumsum(~space)]
        twin = solid[breaks[1:] + 1] == solid[breaks[:-1]]
        out[breaks[1:][twin] + 1] = 4
    return out


def id_strength(ids: np.ndarray) -> np.ndarray:
    """Strength of ending a piece before position i: 3 after END, 2 after a line break, 1 after a sentence end."""
    out = np.zeros(len(ids) + 1, np.int8)
    out[1:][ids == SENTENCE_END] = 1
    out[1:][ids == LINE_BREAK] = 2
    out[1:][ids == END] = 3
    return out


def cut_points(strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item of len(strength) - 1 positions."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    n = len(strength) - 1
    least = min(limit, max(overlap + 1, limit // 2))
    table = StrongestCut(strength, max(limit - least + 1, least - overlap)) if n > limit else None
    start, out = 0, []
    while n - start > limit:
        end = table.query(start + least, start + limit)
        if not strength[end] and least > overlap + 1:
            early = table.query(start + overlap + 1, start + least - 1)
            end = early if strength[early] else end
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)] if n else out


def split_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> DataFrame:
    """rec_id, piece_ix, n_pieces, start, end, text of every text longer than limit; shorter ones stay in the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                cuts = cut_points(text_strength(t), limit, overlap)
                rows += [(k, i, len(cuts), s, e, t[s:e]) for i, (s, e) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=["rec_id", "piece_ix", "n_pieces", "start", "end", "text"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"rec_id {kind}, piece_ix int, n_pieces int, start int, end int, text string"
    return docs.select(key, text).filter(F.length(text) > limit).mapInPandas(run, schema)


def split_ids(items: DataFrame, key: str = "item_id", limit: int = ID_LIMIT, overlap: int = ID_OVERLAP) -> DataFrame:
    """The same over the real positions of tokenized items, with input_ids in place of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, ids in zip(b.iloc[:, 0], b.iloc[:, 1]):
                cuts = cut_points(id_strength(ids), limit, overlap)
                rows += [(k, i, len(cuts), s, e, ids[s:e]) for i, (s, e) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=["rec_id", "piece_ix", "n_pieces", "start", "end", "input_ids"])

    kind = items.schema[key].dataType.simpleString()
    schema = f"rec_id {kind}, piece_ix int, n_pieces int, start int, end int, input_ids array<int>"
    long_ = items.filter(F.size("input_ids") > limit).select(key, real_ids().alias("__real")).filter(F.size("__real") > limit)
    return long_.mapInPandas(run, schema)
