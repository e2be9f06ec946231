"""Word and shingle hashes of whole batches of texts with numpy; nothing is done letter by letter in Python."""

from __future__ import annotations

import numpy as np

_SEED = np.random.default_rng(20240501)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) and the number of words of each text."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] if texts else np.zeros(0, np.uint8)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power = np.empty(len(data), np.uint64)
    if len(data):
        power[0] = 1
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power, dtype=np.uint64)))
    # Dividing by the power of the start makes the hash of a word the same at any place.
    back = np.empty(len(data), np.uint64)
    if len(data):
        back[0] = 1
        back[1:] = _INVERSE
        np.multiply.accumulate(back, out=back)
    hashes = mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    borders = np.concatenate(([0], np.cumsum(sizes)))
    return hashes, np.diff(np.searchsorted(starts, borders))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a text of fewer words has its whole sequence as one, or none without words."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    windows = hashes.copy()
    for k in range(1, size):
        windows[: len(hashes) - k] = windows[: len(hashes) - k] * _STEP + hashes[k:]
    windows = mixed(windows)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= size:
            sets.append(np.unique(windows[end - n:end - size + 1]))
        elif n:
            whole = n
            for h in hashes[end - n:end].tolist():
                whole = (whole * int(_STEP) + h) % 2**64
            sets.append(mixed(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
