"""Best-two-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, shuffle_partitions, whole_documents
from .tokens import TEXT_BYTES, encoder


class _Available:
    """Lengths with unpacked pieces; the largest at most x by path compression."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.below = [0] * len(counts)
        for x in range(1, len(counts)):
            self.below[x] = x if counts[x] else self.below[x - 1]

    def at_most(self, x: int) -> int:
        path = []
        while x > 0 and not self.counts[x]:
            path.append(x)
            x = self.below[x] if self.below[x] < x else self.below[x - 1]
        for p in path:
            self.below[p] = x
        return max(x, 0)


def _best_two(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum of at most ``room``."""
    have = np.flatnonzero(left[: room + 1])
    have = have[have > 0]
    if not len(have):
        return None
    mate = np.searchsorted(have, room - have, side="right") - 1
    ok = mate >= 0
    b = have[np.maximum(mate, 0)]
    alone = (b == have) & (left[have] < 2)  # the only piece of its length can't be used twice
    b = np.where(alone, np.where(mate > 0, have[np.maximum(mate - 1, 0)], 0), b)
    total = np.where(ok & (b > 0), have + b, 0)
    i = int(total.argmax())
    return (int(have[i]), int(b[i])) if total[i] else None


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, pieces)]) that pack so many pieces of each length into few sequences.

    A sequence is filled greedily, the largest fitting length first; then its smallest piece is replaced by the two
    unpacked pieces that fit the expanded gap most tightly, if they fill more of it. The same choice is made again as
    long as its lengths last, so a pattern is repeated at once: work follows the number of lengths, not of documents.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    free = _Available(left)
    out = []
    while (largest := free.at_most(size)) > 0:
        used: dict[int, int] = {}
        gap, x = size, largest
        while x > 0:
            n = int(min(left[x] - used.get(x, 0), gap // x))
            if n > 0:
                used[x] = used.get(x, 0) + n
                gap -= n * x
            x = free.at_most(min(gap, x - 1))
        if gap and len(used):
            small = min(used)
            rest = left.copy() if len(used) > 64 else left
            for k, n in used.items():
                rest[k] -= n
            pair = _best_two(rest, gap + small)
            if rest is left:
                for k, n in used.items():
                    rest[k] += n
            if pair and sum(pair) > small:
                used[small] -= 1
                if not used[small]:
                    del used[small]
                for p in pair:
                    used[p] = used.get(p, 0) + 1
        times = int(min(left[k] // n for k, n in used.items()))
        for k, n in used.items():
            left[k] -= times * n
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def _pieces(tokenizer: str, size: int, end_id: int):
    def make(batch: pa.RecordBatch) -> dict:
        ids, counts = encoder(tokenizer).encode(batch.column("text"))
        ends = np.cumsum(counts)
        data = np.insert(ids, ends, end_id).astype("<u4", copy=False)  # after each document
        counts = counts + 1
        first = np.cumsum(counts) - counts
        many = -(-counts // size)
        row = np.repeat(np.arange(len(counts)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * size
        length = np.minimum(size, counts[row] - start)
        raw, at = memoryview(data.tobytes()), 4 * (first[row] + start)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
        return {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length.astype(np.int32), "ids_crc32": crc}

    return make


def pack(docs: DataFrame, size: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text).

    A document is its ids and ``end_id``; only one longer than ``size`` is cut, into pieces of ``size`` and a rest.
    Null texts count as empty (one id). Every row is a document of its own, also with a null or repeated doc_id.

    The driver sees how many pieces have each length, at most ``size`` numbers, and plans patterns of lengths. Pieces
    are numbered within their length, in salted groups so that a common length is spread over many tasks, and find
    their sequence and offset by that number.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(map_arrow(whole_documents(docs), "doc_id long, piece int, start long, length int, ids_crc32 long", _pieces(tokenizer, size, end_id), limit=TEXT_BYTES), "pieces")
    salts = 4 * shuffle_partitions(spark)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = scratch.save(pieces.groupBy("salt", "length").agg(F.count("*").alias("n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # By length: first number, pieces of it in a sequence, first sequence, first offset of each use.
    uses: dict[int, list[tuple[int, int, int, int]]] = {}
    done: dict[int, int] = {}
    sequence = 0
    for times, used in plan(counts, size):
        offset = 0
        for length, n in used:
            uses.setdefault(length, []).append((done.get(length, 0), n, sequence, offset))
            done[length] = done.get(length, 0) + times * n
            offset += n * length
        sequence += times
    tables = {k: np.array(v, np.int64) for k, v in uses.items()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("salt", "length", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("salt", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = pieces.withColumn("own", own).join(bases, ["salt", "length"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("base")).alias("number"))

    def place(batch: pa.RecordBatch) -> dict:
        length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
        sequences, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length).tolist():
            rows = np.flatnonzero(length == x)
            t = tables[x][np.searchsorted(tables[x][:, 0], number[rows], side="right") - 1]
            turn, slot = np.divmod(number[rows] - t[:, 0], t[:, 1])
            sequences[rows], offsets[rows] = t[:, 2] + turn, t[:, 3] + slot * x
        return {x: batch.column(x) for x in ("doc_id", "piece", "start", "ids_crc32")} | {"length": length.astype(np.int64), "sequence_id": sequences, "offset": offsets}

    return map_arrow(numbered, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", place, None)
