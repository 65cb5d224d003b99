"""Encoding with a public byte-level BPE vocabulary by batched numpy merge rounds.

The distinct words of a batch are laid out as one flat array of symbols. In every round the rank of each adjacent pair
is found by binary search over the sorted pair keys, each word picks its lowest rank, all non-overlapping occurrences
of that pair merge at once, and words without a mergeable pair leave the array. A new symbol's own merges always rank
after the merge that made it, so merging all occurrences in one round equals merging them one by one.

Defined cases: null and empty texts have no ids; special-token strings in a text are ordinary text; text of any
length is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The word pattern of the byte-level BPE vocabularies, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.path.join(os.environ.get("KORREL_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Characters handled at once, and distinct words remembered between batches: they bound a worker's memory only.
CHARS_AT_ONCE = 1_500_000
WORDS_KEPT = 150_000
_NONE = np.iinfo(np.int32).max


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable latin-1 bytes stand for themselves, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BatchBPE:
    """Encoder of one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.zeros(256, np.int64)
        for symbol, byte in _byte_symbols().items():
            self.of_byte[byte] = vocab[symbol]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _rank(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each symbol; _NONE where there is none or the word ends."""
        rank = np.full(len(symbols), _NONE, np.int32)
        key = symbols[:-1] * self.size + symbols[1:]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (word[:-1] == word[1:])
        rank[:-1][hit] = self.ranks[at[hit]]
        return rank

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the offsets of the words in it."""
        raw = [w.encode("utf-8", "replace") for w in words]
        n = np.fromiter((len(b) for b in raw), np.int64, len(raw))
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), n)
        done_symbols, done_word = [], []
        while len(symbols):
            rank = self._rank(symbols, word)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(word)])
            mine = np.repeat(least, length)
            open_ = mine != _NONE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_word.append(word[~open_])
                symbols, word, rank, mine = symbols[open_], word[open_], rank[open_], mine[open_]
                if not len(symbols):
                    break
            hit = rank == mine
            run = hit[1:] & hit[:-1] & (word[1:] == word[:-1])
            if run.any():  # the pair overlaps itself, as in aaa: keep every other start of a run, from the left
                where = np.flatnonzero(hit)
                fresh = np.r_[True, ~((np.diff(where) == 1) & (word[where[1:]] == word[where[:-1]]))]
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                hit[where[(np.arange(len(where)) - begin) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.made[mine[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_word:
            return np.empty(0, np.int32), np.zeros(len(raw) + 1, np.int64)
        all_word = np.concatenate(done_word)
        order = np.argsort(all_word, kind="stable")
        counts = np.bincount(all_word, minlength=len(raw))
        return np.concatenate(done_symbols)[order].astype(np.int32), np.r_[0, np.cumsum(counts)]

    def _lookup(self, words: list[str]) -> np.ndarray:
        """Positions of words among the kept ones, after encoding those that are new."""
        kept = self.kept
        if len(kept) > WORDS_KEPT:
            kept.clear()
            self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)
        new = list(dict.fromkeys(w for w in words if w not in kept)) if kept else list(dict.fromkeys(words))
        if new:
            ids, start = self.encode_words(new)
            base = len(kept)
            kept.update(zip(new, range(base, base + len(new))))
            self.start = np.r_[self.start, start[1:] + len(self.flat)]
            self.flat = np.r_[self.flat, ids]
        return np.fromiter(map(kept.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the number of ids of each text."""
        words: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = self.split(t)
                per_text[i] = len(found)
                words += found
        if not words:
            return np.empty(0, np.int32), per_text
        at = self._lookup(words)
        n = self.start[at + 1] - self.start[at]
        total = np.r_[0, np.cumsum(n)]
        ids = self.flat[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])]
        bounds = np.r_[0, np.cumsum(per_text)]
        return ids, total[bounds[1:]] - total[bounds[:-1]]

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """encode() over blocks of texts of bounded size."""
        begin, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= CHARS_AT_ONCE:
                yield self.encode(texts[begin : i + 1])
                begin, size = i + 1, 0
        if begin < len(texts) or not texts:
            yield self.encode(texts[begin:])


_ENCODERS: dict[str, BatchBPE] = {}


def encoder(path: str = VOCABULARY) -> BatchBPE:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchBPE(path)
    return _ENCODERS[path]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key and ids (array<int>) of every row: one narrow pass, no shuffle. Rows are never filtered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            begin = 0
            for ids, n in bpe.blocks(b.column(1).to_pylist()):
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(n)), lists], names=[key, "ids"])
                begin += len(n)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """keys and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            n = np.concatenate([n for _, n in bpe.blocks(b.column(len(keys)).to_pylist())])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{schema}, n_tokens bigint")
