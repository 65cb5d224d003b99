"""64-bit hashes of stretches of characters, in numpy, and the words of texts by their hashes."""

from __future__ import annotations

import unicodedata

import numpy as np

_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def stretch_hashes(codes: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Hash of each stretch of codes (start, size), sizes above 0; a block of stretches at a time."""
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(0, len(start), block):
            n = size[b : b + block]
            ends = np.cumsum(n)
            inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
            x = codes[np.repeat(start[b : b + block], n) + inner] * _ODD + inner.astype(np.uint64) * _STEP
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[b : b + block] = np.add.reduceat(x ^ (x >> np.uint64(32)), ends - n)
    return out


#: Whether each code point of the first plane is a letter or digit.
_ALNUM = np.array([chr(c).isalnum() for c in range(0x10000)])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and the number of each text's: words are the maximal runs of letters
    and digits in NFKC and lower case. Null and empty texts have none."""
    plain = [(t if t.isascii() else unicodedata.normalize("NFKC", t)).lower() if t else "" for t in texts]
    codes = codes_of("\n".join(plain))
    if not len(codes):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    word = _ALNUM[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        kinds, at = np.unique(codes[high], return_inverse=True)
        word[high] = np.array([chr(c).isalnum() for c in kinds])[at]
    turn = np.diff(np.r_[0, word.view(np.int8), 0])
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    ends = np.cumsum([len(t) + 1 for t in plain])
    counts = np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts))
    return stretch_hashes(codes, start, stop - start), counts
