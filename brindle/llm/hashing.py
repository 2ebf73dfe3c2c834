"""Vectorised words and 64-bit hashes over the UTF-8 buffers of Arrow text columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .common import text_buffers

U64 = np.uint64
#: Words are runs of bytes outside this set: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEEDED = np.random.Generator(np.random.PCG64(20240229))
_COEFFICIENTS = _SEEDED.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_SEEDS = _SEEDED.integers(1, 2**63, 2, dtype=U64)
#: The first 0 to 8 of a word's bytes, as a little-endian number.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... so many as sizes[0], then from first[1]."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: 8 bytes after another are mixed in.

    Spans of one length up to 8 bytes never share a hash; longer ones do as chance has it, for no step is linear in the bytes.
    """
    size = end - start
    h = mix(size.astype(U64) + _SEEDS[lane])
    eight = np.lib.stride_tricks.as_strided(np.concatenate((data, np.zeros(8, np.uint8))).view(np.uint8), (len(data) + 1, 8), (1, 1))
    at = np.arange(len(start))
    done = 0
    while len(at):
        part = np.ascontiguousarray(eight[start[at] + done]).view("<u8").reshape(-1)
        h[at] = mix(h[at] ^ (part & _KEEP[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    return h


class Words:
    """Words of a column of texts: byte spans, the row of each word and the first word of each row."""

    def __init__(self, text: pa.Array, lower: bool = False):
        self.offsets, self.data = text_buffers(text)
        if lower:
            self.data = LOWER[self.data]
        rows, data, offsets = len(self.offsets) - 1, self.data, self.offsets
        word = ~SEPARATOR[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        edge = np.empty(len(data) + 1, bool)  # a word can't run across this byte's left side
        edge[0] = edge[-1] = True
        edge[1:-1] = ~word[:-1] | first[1:-1]
        self.start = np.flatnonzero(word & edge[:-1])
        edge[:-1] |= ~word
        edge[:-1] |= first[:-1]
        self.end = np.flatnonzero(word & edge[1:]) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1))

    def hashes(self, keyed: bool = False) -> np.ndarray:
        """A 64-bit hash of each word. With ``keyed``, words of over 8 bytes, which could be made to meet, get a cryptographic one."""
        if not len(self.start):
            return np.zeros(0, U64)
        h = span_hashes(self.data, self.start, self.end)
        if keyed and len(long := np.flatnonzero(self.end - self.start > 8)):
            words = self.as_arrow(long).dictionary_encode()
            made = [hashlib.blake2b(w, digest_size=8, key=b"word").digest() for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
            h[long] = np.frombuffer(b"".join(made), "<u8")[words.indices.to_numpy()]
        return h

    def as_arrow(self, which: np.ndarray) -> pa.Array:
        """The bytes of some words."""
        start, size = self.start[which], self.end[which] - self.start[which]
        data = self.data[byte_runs(start, size)]
        return pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(data)])

    def ranks(self) -> np.ndarray:
        """A number for each word that only equal words share."""
        return self.as_arrow(np.arange(len(self.start))).dictionary_encode().indices.to_numpy().astype(np.int64)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each starts and ends there."""
        size = self.end - self.start
        start = np.cumsum(size + 1) - (size + 1)
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        out[byte_runs(start, size)] = self.data[byte_runs(self.start, size)]
        return out, start, start + size

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; as many as words, less n - 1. Rows are the caller's business."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(m, U64)
    for j in range(n):
        total += words[j : j + m] * _COEFFICIENTS[j]
    return mix(total + U64(n))


def run_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n words, given by ranks, that only equal runs share: by doubling, without a hash."""
    now, have = words, 1
    while have < n:
        step = min(have, n - have)
        now = np.unique(now[:-step] * (int(now.max(initial=0)) + 1) + now[step:], return_inverse=True)[1] if len(now) > step else np.zeros(0, np.int64)
        have += step
    return now


def long(x: np.ndarray) -> np.ndarray:
    """The same bits as signed numbers, for Spark."""
    return np.ascontiguousarray(x, U64).view(np.int64)
