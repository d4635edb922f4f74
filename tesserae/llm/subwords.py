"""Hashed character windows of whole texts, for the language and toxicity classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import FOLD, buffer_of

#: Letters keep their lower-case byte (bytes above 127 as they are); everything else is a space.
LETTERS = np.where((FOLD >= 97) & (FOLD <= 122) | (FOLD >= 128), FOLD, 32).astype(np.uint8)


def letter_buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, begins = buffer_of([b"", *texts])  # so that a space stands before the first text too
    return LETTERS[buf], begins[1:]


def windows(buf: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the positions and buckets of all windows of that many bytes that don't reach across a space (one may stand at either end)."""
    letter = buf != 32
    wide = buf.astype(np.uint64)
    for n in sizes:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        ok = letter[:m] | letter[n - 1 :] if n == 2 else letter[1 : m + 1].copy()
        for k in range(2, n - 1):
            ok &= letter[k : m + k]
        at = np.flatnonzero(ok)
        key = wide[at].copy()
        for k in range(1, n):
            key |= wide[at + k] << np.uint64(8 * k)
        with np.errstate(over="ignore"):
            key = (key ^ key >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        yield at, (key >> np.uint64(64 - bits)).astype(np.int64)
