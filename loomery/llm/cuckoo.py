"""Cuckoo filters over 64-bit key hashes in numpy: insert, delete and probe whole arrays."""

from __future__ import annotations

import numpy as np

from loomery.llm.arrays import mix

SLOTS = 4
_MAX_ROUNDS = 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; zero is an empty slot.

    A key's two buckets differ by a hash of its fingerprint, so either is found from the
    other and a stored fingerprint can move or be deleted without the key. The same key may
    be inserted once only (callers insert keys of a table that holds each once); a key that
    was never inserted must not be deleted.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def for_size(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(n, 1) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        n = len(keys)
        while True:
            made = cls.for_size(n)
            if made.insert(keys):
                return made
            n = max(2 * n, 64)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = h & self.mask
        return mark, first, self._other(mark, first)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._place(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts as many as fit into free slots; True where it did."""
        order = np.argsort(bucket, kind="stable")
        of = bucket[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        free = np.argsort(self.table[of] != 0, axis=1, kind="stable")  # empty slots first
        room = (self.table[of] == 0).sum(1)
        fits = rank < room
        self.table[of[fits], free[fits, rank[fits]]] = mark[order][fits]
        done = np.zeros(len(mark), dtype=bool)
        done[order[fits]] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; its content is then undefined."""
        if len(keys) == 0:
            return True
        if np.count_nonzero(self.table) + len(keys) > 0.95 * self.table.size:
            return False
        mark, a, b = self._place(keys)
        left = ~self._settle(mark, a)
        mark, bucket = mark[left], b[left]
        for turn in range(_MAX_ROUNDS):
            done = self._settle(mark, bucket)
            mark, bucket = mark[~done], bucket[~done]
            if len(mark) == 0:
                return True
            # one waiting fingerprint per bucket evicts a stored one, which then waits for its other bucket
            _, one = np.unique(bucket, return_index=True)
            slot = (turn + mark[one]) % SLOTS
            evicted = self.table[bucket[one], slot].copy()
            self.table[bucket[one], slot] = mark[one]
            mark[one] = evicted
            bucket[one] = self._other(evicted, bucket[one])
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Removes one stored fingerprint for every key: in its first bucket, or else in its second."""
        mark, bucket, other = self._place(keys)
        for _ in range(2):
            # keys of one bucket and fingerprint take its copies in turn
            order = np.lexsort((mark, bucket))
            of, marks = bucket[order], mark[order]
            head = np.append(True, (of[1:] != of[:-1]) | (marks[1:] != marks[:-1])) if len(of) else np.zeros(0, dtype=bool)
            turn = np.arange(len(of)) - np.maximum.accumulate(np.where(head, np.arange(len(of)), 0))
            there = self.table[of] == marks[:, None]
            spot = np.argsort(~there, axis=1, kind="stable")  # the slots that hold it first
            found = turn < there.sum(1)
            self.table[of[found], spot[found, turn[found]]] = 0
            left = np.sort(order[~found])
            mark, bucket = mark[left], other[left]
            other = bucket
