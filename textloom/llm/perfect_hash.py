"""A minimal perfect hash over 64-bit keys, as plain arrays.

Level by level each key falls on a bit; keys alone on theirs are settled there, the
rest go on to a smaller level.  A key's slot is the number of settled bits before
its own, so n keys fill slots 0..n-1.
"""

from __future__ import annotations

import numpy as np

LEVELS = 40


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_spread(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray, room: float = 1.5) -> dict[str, np.ndarray]:
    """Arrays of a perfect hash over distinct keys (about 3 bits a key, and the counts)."""
    left = np.unique(np.asarray(keys, np.uint64))
    sizes, bits = [], []
    while len(left) and len(sizes) < LEVELS:
        size = max(64, int(len(left) * room) + 63 & ~63)
        at = _spread(left, len(sizes)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at.astype(np.int64)]]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    per_word = flat.reshape(-1, 64).sum(1)
    return {"sizes": np.array(sizes, np.int64), "bits": np.packbits(flat, bitorder="little"), "before": np.concatenate([[0], np.cumsum(per_word)]).astype(np.int64), "rest": left}


def slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; for keys that the hash wasn't built on any slot, or -1."""
    keys = np.asarray(keys, np.uint64)
    out = np.full(len(keys), -1, np.int64)
    words = index["bits"].view("<u8")
    todo, start = np.arange(len(keys)), 0
    for level, size in enumerate(index["sizes"]):
        at = start + (_spread(keys[todo], level) % np.uint64(size)).astype(np.int64)
        word, shift = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> shift & np.uint64(1)).astype(bool)
        below = word & ((np.uint64(1) << shift) - np.uint64(1))
        out[todo[hit]] = index["before"][at[hit] >> 6] + np.bitwise_count(below[hit])
        todo, start = todo[~hit], start + int(size)
    if len(todo) and len(index["rest"]):
        k = np.minimum(np.searchsorted(index["rest"], keys[todo]), len(index["rest"]) - 1)
        found = index["rest"][k] == keys[todo]
        out[todo[found]] = index["before"][-1] + k[found]
    return out
