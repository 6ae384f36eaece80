"""Minimal perfect hashing of 64-bit keys, built bucket by bucket.

In a bucket, keys fall on the bits of a first level; a bit on which exactly one
key falls is set and belongs to that key, and the others go on to the next
level. The levels of all buckets laid end to end are one string of bits, and
the number of set bits before a key's own is its place: a number from 0 to the
number of keys, without gaps. The keys stand in that order beside the bits, so
an unknown key is told from a known one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS_PER_KEY = 2
BUCKET_KEYS = 1 << 14


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A different hash of 64-bit keys for every seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(keys, 0) % np.uint64(n_buckets)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """Sizes of the levels in bits, their bits, and the keys in order, of one bucket of distinct keys."""
    sizes, words, ordered, rest = [], [], [], keys
    while len(rest):
        size = 64 * -(-BITS_PER_KEY * len(rest) // 64)
        place = (mix(rest, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        found = alone[place]
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").tobytes())
        ordered.append(rest[found][np.argsort(place[found])])
        rest = rest[~found]
    return sizes, b"".join(words), np.concatenate([*ordered, np.empty(0, keys.dtype)]).astype("<i8").tobytes()


@dataclass
class PerfectHash:
    """Some consecutive buckets, from ``first`` on, of ``n_buckets``."""

    n_buckets: int
    first: int
    size: np.ndarray  # bits by level and bucket
    base: np.ndarray  # where these begin
    words: np.ndarray
    before: np.ndarray  # set bits before every word
    keys: np.ndarray

    @classmethod
    def of(cls, n_buckets: int, first: int, built: dict[int, tuple[list[int], bytes, bytes]], buckets: int) -> PerfectHash:
        """``built`` has what :func:`build` made of each bucket that has keys."""
        depth = max([len(sizes) for sizes, _, _ in built.values()], default=0)
        size = np.zeros((depth, buckets), np.int64)
        for bucket, (sizes, _, _) in built.items():
            size[: len(sizes), bucket - first] = sizes
        in_order = [built[b] for b in sorted(built)]
        words = np.frombuffer(b"".join([w for _, w, _ in in_order]), "<u8")
        own = size.T.ravel()  # bucket by bucket, level by level
        base = (np.cumsum(own) - own).reshape(buckets, depth).T
        before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
        return cls(n_buckets, first, size, base, words, before, np.frombuffer(b"".join([k for _, _, k in in_order]), "<i8"))

    def __len__(self) -> int:
        return len(self.keys)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, -1 for keys of other buckets. A missing key of its own buckets is an error."""
        bucket = bucket_of(keys, self.n_buckets) - self.first
        out = np.full(len(keys), -1, np.int64)
        inside = (bucket >= 0) & (bucket < self.size.shape[1])
        left = np.flatnonzero(inside)
        for level in range(len(self.size)):
            size = self.size[level][bucket[left]]
            left, size = left[size > 0], size[size > 0]
            bit = self.base[level][bucket[left]] + (mix(keys[left], level + 1) % size.astype(np.uint64)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            found = (word >> shift & np.uint64(1)).astype(bool)
            lower = word & ((np.uint64(1) << shift) - np.uint64(1))
            place = self.before[bit >> 6] + np.bitwise_count(lower)
            out[left[found]] = place[found]
            left = left[~found]
        if (out[inside] < 0).any() or not np.array_equal(self.keys[out[inside]], keys[inside]):
            raise KeyError("a key that the hash was not built from")
        return out
