"""Distinct word-shingle sets of texts as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
WORDS = 5
#: Words whose shingles are hashed at once.
CHUNK_WORDS = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _POWERS, _INVERSES = made
    return _POWERS[:n], _INVERSES[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(words: list[bytes], size: int) -> np.ndarray:
    """A hash of each run of `size` words: the polynomial of its bytes, moved to the front of the text."""
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(data)]])
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers[:-1], out=sums[1:])
    first, last = starts[: len(starts) - size + 1], ends[size - 1 :]
    return mix((sums[last] - sums[first]) * inverses[first])


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at space and U+0009 to U+000D: what bytes.lower and bytes.split do."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; with fewer words one for the whole sequence; empty without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= WORDS:
        return _hashed(words, len(words))
    step = CHUNK_WORDS - WORDS + 1
    parts = [_hashed(words[at : at + CHUNK_WORDS], WORDS) for at in range(0, len(words) - WORDS + 1, step)]
    return np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of the set; with the set's size it tells different sets apart."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(text)
