"""Cuckoo filter over 64-bit hashes: membership with insertion and deletion.

Buckets of four 16-bit fingerprints; a fingerprint's other bucket follows from the
one it is in, so it can be moved without its key.  No false negatives; a false
positive rate of about 8 / 65,536.  Only keys that are in may be deleted.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 500


class CuckooFilter:
    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        assert buckets & (buckets - 1) == 0, "a power of two"
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def for_keys(cls, n: int) -> "CuckooFilter":
        """Room for ``n`` keys at a load of at most 0.8."""
        return cls(1 << max(0, int(np.ceil(np.log2(max(1, n) / (0.8 * SLOTS))))))

    @classmethod
    def holding(cls, keys: np.ndarray) -> "CuckooFilter":
        """A filter with all ``keys``, enlarged until they fit."""
        out = cls.for_keys(len(keys))
        while not all(map(out.insert, keys.tolist())):
            out = cls(out.buckets * 2)
        return out

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        cells = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(cells), cells)

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    def _print(self, key: int) -> int:
        return ((key >> 48) & 0xFFFF) or 1

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ ((print_ * 0x5BD1E995) & (self.buckets - 1))

    def insert(self, key: int) -> bool:
        """False when no room was found; the filter then lost a key and must be rebuilt."""
        print_, bucket = self._print(key), key & (self.buckets - 1)
        for b in (bucket, self._other(bucket, print_)):
            for slot in range(SLOTS):
                if self.cells[b, slot] == 0:
                    self.cells[b, slot] = print_
                    return True
        for kick in range(MAX_KICKS):
            slot = (print_ + kick) % SLOTS
            print_, self.cells[bucket, slot] = int(self.cells[bucket, slot]), print_
            bucket = self._other(bucket, print_)
            for slot in range(SLOTS):
                if self.cells[bucket, slot] == 0:
                    self.cells[bucket, slot] = print_
                    return True
        return False

    def delete(self, key: int) -> bool:
        print_, bucket = self._print(key), key & (self.buckets - 1)
        for b in (bucket, self._other(bucket, print_)):
            for slot in range(SLOTS):
                if self.cells[b, slot] == print_:
                    self.cells[b, slot] = 0
                    return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Which of the hashes (uint64) may be in."""
        prints = (keys >> np.uint64(48)).astype(np.int64)
        prints[prints == 0] = 1
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        second = first ^ ((prints * 0x5BD1E995) & (self.buckets - 1))
        wanted = prints.astype(np.uint16)[:, None]
        return (self.cells[first] == wanted).any(1) | (self.cells[second] == wanted).any(1)
