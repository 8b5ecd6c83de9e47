"""A cuckoo filter over 64-bit key hashes, in whole-array steps of numpy.

A bucket has four 16-bit fingerprints. A key may stand in the bucket that its low bits name or in the one that its fingerprint
points to from there, so any entry can move without its key. Whatever was inserted is always found; other keys are found in about
one of 8,000 cases. Entries can be removed again (only keys that were inserted, once each).
"""

from __future__ import annotations

import numpy as np

from thermoflux.llm.common import U64, mix

SLOTS = 4
#: Share of the slots that are filled at most, and rounds of moves after which an insert is given up.
LOAD, ROUNDS = 0.84, 400


class Cuckoo:
    def __init__(self, capacity: int = 0, table: bytes | None = None):
        if table is None:
            self.table = np.zeros((1 << max(2, int(np.ceil(capacity / (SLOTS * LOAD))) - 1).bit_length(), SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        self.mask = U64(len(self.table) - 1)

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    def room(self) -> int:
        """Keys that may be added still."""
        return max(0, int(self.table.size * LOAD) - int(np.count_nonzero(self.table)))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = np.maximum((keys >> U64(48)).astype(np.uint16), 1)
        first = (keys & self.mask).astype(np.int64)
        return prints, first, self._other(prints, first)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(U64)) & self.mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def _place(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put entries into free slots of their buckets; True where there was none."""
        if not len(prints):
            return np.zeros(0, bool)
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        rank = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)]))
        free = self.table[b] == 0
        hit = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
        ok = hit.any(axis=1)
        self.table[b[ok], hit[ok].argmax(axis=1)] = prints[order[ok]]
        left = np.zeros(len(b), bool)
        left[order[~ok]] = True
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """Add distinct keys; False (and nothing added) where they do not fit."""
        before = self.table.copy()
        prints, a, b = self._places(keys)
        left = self._place(prints, a)
        prints, b = prints[left], b[left]
        left = self._place(prints, b)
        prints, at = prints[left], b[left]
        rng = np.random.default_rng(len(keys))
        for _ in range(ROUNDS):
            if not len(prints):
                return True
            # one entry a bucket takes the slot of another, which moves to its own other bucket
            _, one = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            out = self.table[at[one], slot]
            self.table[at[one], slot] = prints[one]
            prints[one], at[one] = out, self._other(out, at[one])
            left = (prints > 0) & self._place(prints, at)
            prints, at = prints[left], at[left]
        self.table = before
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that are in the filter."""
        prints, a, b = self._places(keys)
        for k in range(4 * SLOTS):
            if not len(prints):
                return
            bucket = b if k % 2 else a
            # keys with one fingerprint in one bucket take slots of their own, one a round
            _, one = np.unique(bucket * (1 << 16) + prints, return_index=True)
            hit = self.table[bucket[one]] == prints[one, None]
            ok = hit.any(axis=1)
            self.table[bucket[one][ok], hit[ok].argmax(axis=1)] = 0
            left = np.ones(len(prints), bool)
            left[one[ok]] = False
            prints, a, b = prints[left], a[left], b[left]


def built(keys: np.ndarray) -> Cuckoo:
    """A filter of distinct keys, as large as they need."""
    size = max(1, len(keys))
    while not (out := Cuckoo(size)).insert(keys):
        size *= 2
    return out
