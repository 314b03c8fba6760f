"""Word splitting and 64-bit hashing of whole texts with numpy.

Words are maximal runs of bytes other than ``0x20`` and ``0x09``-``0x0D``.  A
word's hash is a polynomial over random byte values modulo 2**64, read off
prefix sums, so a buffer costs a few array passes and no Python loop per word.
Buffers are worked through in slices that end at white space, which bounds
memory for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n + 1, SLICE + 4096)
        both = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def _hash_slice(raw: np.ndarray, values: np.ndarray) -> np.ndarray:
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[0::2], edges[1::2]
    if not len(begins):
        return np.empty(0, dtype=np.uint64)
    up, down = _power_table(len(raw))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[begins]) * down[begins]
    return mix(h + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """Hashes of the words of ``text`` in order; ``lower`` folds A-Z."""
    values = _BYTE[_LOWER] if lower else _BYTE
    raw = np.frombuffer(text, dtype=np.uint8)
    if len(raw) <= SLICE:
        return _hash_slice(raw, values)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            more = np.flatnonzero(_SPACE[raw[end : end + SLICE]])
            end += int(more[0]) if len(more) else min(SLICE, len(raw) - end)
        parts.append(_hash_slice(raw[at:end], values))
        at = end
    return np.concatenate(parts)


def batched_hashes(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first text, word hashes, offsets)`` for runs of texts of about ``SLICE`` bytes.

    ``offsets`` has one entry more than the run has texts; text ``i`` of the run
    owns ``hashes[offsets[i]:offsets[i + 1]]``.
    """
    values = _BYTE[_LOWER] if lower else _BYTE
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) < SLICE):
            total += len(texts[end]) + 1
            end += 1
        if end == at + 1 and total > SLICE:
            h = word_hashes(texts[at], lower)
            yield at, h, np.array([0, len(h)])
        else:
            raw = np.frombuffer(b" ".join(texts[at:end]) + b" ", dtype=np.uint8)
            h = _hash_slice(raw, values)
            spaced = np.concatenate(([True], _SPACE[raw]))
            begins = np.flatnonzero(spaced[:-1] & ~spaced[1:])
            stops = np.cumsum([len(x) + 1 for x in texts[at:end]])
            yield at, h, np.concatenate(([0], np.searchsorted(begins, stops)))
        at = end


def runs(h: np.ndarray, k: int, multiplier: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes, ``len(h) - k + 1`` of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= np.uint64(multiplier)
        out += h[i : i + n]
    return mix(out)
