"""A cuckoo filter on numpy arrays: 16-bit marks in buckets of four, whole arrays of keys at a time.

A key is 16 bytes of a good hash. Its mark and first bucket come from different halves; the second bucket is the first one turned by a hash of the mark, so a
mark can move, and be taken out, without its key. A key that was added is always found; another one is by chance, some 8 in 65,536. A key may only be removed if
it was added.
"""

from __future__ import annotations

import numpy as np

SLOTS, ROUNDS = 4, 400
_TURN = np.uint64(0x9E3779B97F4A7C15)


def halves(keys: list[bytes] | np.ndarray) -> np.ndarray:
    """16-byte keys as rows of two unsigned longs."""
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


class Cuckoo:
    def __init__(self, table: np.ndarray):
        self.table = table
        self._mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        """Empty, for n keys at a load of at most 0.8."""
        buckets = 1
        while buckets * SLOTS * 0.8 < n:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loads(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _home(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = (keys[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        return (keys[:, 1] & self._mask).astype(np.int64), np.where(marks == 0, np.uint16(1), marks)

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        turn = (marks.astype(np.uint64) * _TURN) >> np.uint64(24)
        return ((bucket.astype(np.uint64) ^ turn) & self._mask).astype(np.int64)

    def __contains__(self, key: bytes) -> bool:
        return bool(self.contains(halves([key]))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        bucket, marks = self._home(keys)
        found = (self.table[bucket] == marks[:, None]).any(axis=1)
        return found | (self.table[self._other(bucket, marks)] == marks[:, None]).any(axis=1)

    def _place(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Put marks in their buckets' free slots, which follow the taken ones; returns the places of those that found none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        slot = (self.table[b] != 0).sum(axis=1) + rank
        fits = slot < SLOTS
        self.table[b[fits], slot[fits]] = marks[order[fits]]
        return order[~fits]

    def add(self, keys: np.ndarray) -> bool:
        """Whether all found a slot. If not, the filter is of no more use and has to be built anew, larger."""
        bucket, marks = self._home(keys)
        left = self._place(bucket, marks)
        bucket, marks, draw = bucket[left], marks[left], np.random.default_rng(len(keys))
        for _ in range(ROUNDS):
            bucket = self._other(bucket, marks)
            left = self._place(bucket, marks)
            if not len(left):
                return True
            bucket, marks = bucket[left], marks[left].copy()
            _, one = np.unique(bucket, return_index=True)  # one of each full bucket takes another's slot
            slot = draw.integers(0, SLOTS, len(one))
            out = self.table[bucket[one], slot].copy()
            self.table[bucket[one], slot] = marks[one]
            marks[one] = out
        return False

    def remove(self, keys: np.ndarray) -> None:
        bucket, marks = self._home(keys)
        for turned in (False, True):
            missing = []
            while len(bucket):
                _, one = np.unique(bucket, return_index=True)
                rest = np.delete(np.arange(len(bucket)), one)
                b, m = bucket[one], marks[one]
                hit = self.table[b] == m[:, None]
                found = hit.any(axis=1)
                missing.append(np.stack([b[~found], m[~found]]))
                b, slot = b[found], hit[found].argmax(axis=1)
                last = (self.table[b] != 0).sum(axis=1) - 1
                self.table[b, slot] = self.table[b, last]
                self.table[b, last] = 0
                bucket, marks = bucket[rest], marks[rest]
            left = np.concatenate(missing, axis=1) if missing else np.zeros((2, 0), np.int64)
            if not left.shape[1]:
                return
            if turned:
                raise KeyError("a key was removed that had not been added")
            bucket, marks = left[0].astype(np.int64), left[1].astype(np.uint16)
            bucket = self._other(bucket, marks)
