"""Tokenized items: their real positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of the unnamed vocabulary of tokenized_examples, fixed values.
BEGIN, END, PAD, SENTENCE_END, LINE_BREAK = 0, 1, 2, 13, 198


def real_ids(ids: str = "input_ids", mask: str = "attention_mask") -> Column:
    """The ids whose mask is 1, or where the mask (or its element) is null those that are not PAD. Null ids: empty."""
    kept = F.filter(ids, lambda x, i: F.coalesce(F.get(F.col(mask), i) == 1, x != PAD))
    return F.coalesce(kept, F.array().cast("array<int>"))
