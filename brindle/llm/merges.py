"""Byte-pair merges of many short pieces at once, in numpy."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
#: Symbols of a piece up to which all pieces are merged together, a merge of each a round; longer ones go one by one.
SHORT = 40


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranks of pairs of token ids, and the ids that they make, in a table of open addresses."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str = ""):
        alphabet = byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = np.array([(vocabulary[a], vocabulary[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        self.made = np.array([vocabulary[a + b] for a, b in pairs] or [0], np.int32)
        self.ranks = {(int(a), int(b)): r for r, (a, b) in enumerate(ids)}
        #: Ids of single bytes inside a piece and at its end.
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.inner[b], self.last[b] = vocabulary.get(c, 0), vocabulary.get(c + end, 0)
        bits = max(4, (4 * len(ids)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = ids[:, 0] << 32 | ids[:, 1]
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):  # of those that want one free place, the first gets it
            free = self.keys[at[todo]] < 0
            place, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[place], self.rank[place] = keys[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is no merge."""
        keys = a.astype(np.int64) << 32 | b
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.rank[at], NONE)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def merge(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has. ``ends``: where each, of one byte at least, ends in ``data``."""
        sizes = np.diff(ends, prepend=0)
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        if (sizes <= SHORT).all():
            return self._short(ids, sizes)
        long = np.flatnonzero(sizes > SHORT)
        n = sizes.copy()
        parts, at = [], 0
        for i in long.tolist():
            some, k = self._short(ids[ends[at - 1] if at else 0 : ends[i] - sizes[i]], sizes[at:i])
            one = self._long(ids[ends[i] - sizes[i] : ends[i]].tolist())
            n[at:i], n[i] = k, len(one)
            parts += [some, np.array(one, np.int32)]
            at = i + 1
        some, k = self._short(ids[ends[at - 1] if at else 0 :], sizes[at:])
        n[at:] = k
        return np.concatenate([*parts, some]), n

    def _short(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges the best pair of every piece that has one, the leftmost among equals."""
        count = len(sizes)
        if not count:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(count, dtype=np.int32), sizes)
        ranks = np.full(len(ids), NONE, np.int32)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self.look(ids[inside], ids[inside + 1])
        place = np.arange(len(ids), dtype=np.int32)  # in the result, of which merged symbols are left out
        result, stays = ids.copy(), np.ones(len(ids), bool)
        while True:
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(ranks, starts)
            length = np.diff(starts, append=len(owner))
            hit = np.flatnonzero((ranks == np.repeat(best, length)) & (ranks != NONE))
            if len(hit):
                hit = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]
            if (best == NONE).any():  # these pieces are done
                live = np.repeat(best != NONE, length)
                done = ~live
                result[place[done]] = ids[done]
                shift = np.cumsum(live) - 1
                hit = shift[hit]
                ids, owner, ranks, place = ids[live], owner[live], ranks[live], place[live]
            if not len(hit):
                break
            ids[hit] = self.made[ranks[hit]]
            stays[place[hit + 1]] = False
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            hit -= np.arange(len(hit))
            ids, owner, ranks, place = ids[keep], owner[keep], ranks[keep], place[keep]
            ranks[hit] = NONE
            right = hit[hit + 1 < len(ids)]
            right = right[owner[right] == owner[right + 1]]
            ranks[right] = self.look(ids[right], ids[right + 1])
            left = hit[hit > 0]
            left = left[owner[left] == owner[left - 1]] - 1
            ranks[left] = self.look(ids[left], ids[left + 1])
        by = np.repeat(np.arange(count, dtype=np.int32), sizes)
        return result[stays], np.bincount(by[stays], minlength=count)

    def _long(self, ids: list[int]) -> list[int]:
        """The same for one piece in n log n steps, by a heap over a linked list."""
        import heapq

        n, ranks, made = len(ids), self.ranks, self.made
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = right[i]
            if not live[i] or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], live[j], right[i] = int(made[rank]), False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [x for x, y in zip(ids, live, strict=True) if y]
