"""A cuckoo filter over arrays: sets of 64-bit hashes with whole-array insert, delete and lookup.

Buckets hold four 16-bit fingerprints. The second bucket of a fingerprint is the first XOR a hash
of the fingerprint, so that a fingerprint can be moved, and deleted, without its key. Insertion
works in rounds on all waiting fingerprints at once.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.75
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    return (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)


def buckets_for(n: int) -> int:
    """Buckets, a power of two, for n keys at most."""
    return 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * LOAD)))))


class Full(Exception):
    """No place was found; the filter must be rebuilt larger."""


class Cuckoo:
    def __init__(self, buckets: int = 4, data: bytes | None = None):
        buckets = buckets if data is None else len(data) // (2 * SLOTS)
        self.mask = U(buckets - 1)
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if data is None else np.frombuffer(data, np.uint16).reshape(buckets, SLOTS).copy()

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = _mix(keys.view(np.uint64))
        fp = (m >> U(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (m & self.mask).astype(np.int64)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (_mix(fp.astype(np.uint64)) & self.mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, i = self._places(keys)
        j = self._other(fp, i)
        return (self.cells[i] == fp[:, None]).any(1) | (self.cells[j] == fp[:, None]).any(1)

    def _settle(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put what fits into free slots of ``at``; True for what was put."""
        order = np.argsort(at, kind="stable")
        b = at[order]
        first = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        free = self.cells[b] == 0
        slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
        fits = free.sum(1) > rank
        self.cells[b[fits], slot[fits]] = fp[order][fits]
        put = np.zeros(len(fp), bool)
        put[order] = fits
        return put

    def insert(self, keys: np.ndarray, rounds: int = 500) -> None:
        """Add distinct keys. A key that is in the filter already must not be added again."""
        fp, at = self._places(keys)
        put = self._settle(fp, at)
        fp, at = fp[~put], self._other(fp[~put], at[~put])
        for k in range(rounds):
            put = self._settle(fp, at)
            fp, at = fp[~put], at[~put]
            if not len(fp):
                return
            # one waiting fingerprint of each bucket takes the place of another, which moves on
            _, one = np.unique(at, return_index=True)
            slot = (_mix((at[one].astype(np.uint64) << U(10)) + U(k)) & U(SLOTS - 1)).astype(np.int64)
            out = self.cells[at[one], slot].copy()
            self.cells[at[one], slot] = fp[one]
            rest = np.ones(len(fp), bool)
            rest[one] = False
            fp, at = np.concatenate([fp[rest], out]), np.concatenate([self._other(fp[rest], at[rest]), self._other(out, at[one])])
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were added; one fingerprint goes for each."""
        fp, i = self._places(keys)
        for other in (False, True):
            at = self._other(fp, i) if other else i
            left = np.arange(len(fp))
            while len(left):
                cell = self.cells[at[left]] == fp[left][:, None]
                left, cell = left[cell.any(1)], cell[cell.any(1)]
                if not len(left):
                    break
                slot = cell.argmax(1)
                _, one = np.unique(at[left] * SLOTS + slot, return_index=True)
                self.cells[at[left[one]], slot[one]] = 0
                gone = np.zeros(len(fp), bool)
                gone[left[one]] = True
                left = left[~gone[left]]
                keep = ~gone
                if gone.any():
                    remap = np.cumsum(keep) - 1
                    left = remap[left]
                    fp, i, at = fp[keep], i[keep], at[keep]
            if not len(fp):
                return
