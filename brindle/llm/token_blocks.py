"""Token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import Scratch, map_arrow, shuffle_partitions, slices, whole_documents
from .tokens import TEXT_BYTES

#: Ids of a block, ids from which a segment is closed, and the share of a block that must fit its packed width.
BLOCK, SEGMENT, PERCENTILE = 256, 1 << 18, 0.9
MAGIC = b"PFB1"
SEGMENTS = "part int, seq int, before long, n_ids long, payload binary"


def _widths(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 0, np.frexp(x.astype(np.float64))[1]).astype(np.int64)


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of BLOCK values in w bits each, highest bit first, as rows of bytes."""
    out = np.zeros((len(values), BLOCK * w // 64 + 1), np.uint64)
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    for j in range(BLOCK):
        k, spare = j * w // 64, 64 - j * w % 64 - w
        if spare >= 0:
            out[:, k] |= columns[j] << np.uint64(spare)
        else:
            out[:, k] |= columns[j] >> np.uint64(-spare)
            out[:, k + 1] |= columns[j] << np.uint64(64 + spare)
    return np.ascontiguousarray(out[:, :-1]).astype(">u8").view(np.uint8).reshape(len(values), -1)


def _unpack(rows: np.ndarray, w: int) -> np.ndarray:
    """The values of _pack()."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64).T
    out, mask = np.empty((BLOCK, rows.shape[0]), np.uint32), np.uint64((1 << w) - 1)
    for j in range(BLOCK):
        k, spare = j * w // 64, 64 - j * w % 64 - w
        x = words[k] >> np.uint64(spare) if spare >= 0 else (words[k] << np.uint64(-spare)) | (words[k + 1] >> np.uint64(64 + spare))
        out[j] = x & mask
    return out.T


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... so many as sizes[0], then from first[1]."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def encode_blocks(ids: np.ndarray) -> bytes:
    """Block starts (u32 each, from the first block), then the blocks.

    A block: minimum u32, width u8, exceptions u16; BLOCK values less the minimum in ``width`` bits each, highest bit
    first; positions of exceptions u8 each; their values less the minimum u32 each. The width holds PERCENTILE of the
    block's values. The last block is padded with its minimum.
    """
    ids = np.asarray(ids, np.uint32)
    if not len(ids):
        return b""
    blocks = -(-len(ids) // BLOCK)
    grid = np.empty((blocks, BLOCK), np.uint32)
    grid.reshape(-1)[: len(ids)] = ids
    grid.reshape(-1)[len(ids) :] = ids[(blocks - 1) * BLOCK :].min()
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    width = _widths(np.partition(rest, at, axis=1)[:, at])
    odd = rest.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    many = odd.sum(axis=1)
    packed = BLOCK * width // 8
    size = 7 + packed + 5 * many
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    head = np.empty((blocks, 7), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4] = width
    head[:, 5:] = many.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[start[:, None] + np.arange(7)] = head
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            out[(start[rows] + 7)[:, None] + np.arange(BLOCK * w // 8)] = _pack(np.where(odd[rows], 0, rest[rows]), w)
    tail = start + 7 + packed
    out[_runs(tail, many)] = np.nonzero(odd)[1]
    out[_runs(tail + many, 4 * many)] = rest[odd].astype("<u4").view(np.uint8)
    return start.astype("<u4").tobytes() + out.tobytes()


def decode_blocks(data: bytes, n: int) -> np.ndarray:
    """The first n ids."""
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint32)
    start = np.frombuffer(data, "<u4", blocks).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, -1, 4 * blocks)
    head = raw[start[:, None] + np.arange(7)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").reshape(-1)
    width, many = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:]).view("<u2").reshape(-1).astype(np.int64)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            grid[rows] = _unpack(raw[(start[rows] + 7)[:, None] + np.arange(BLOCK * w // 8)], w)
    tail = start + 7 + BLOCK * width // 8
    place = raw[_runs(tail, many)]
    grid[np.repeat(np.arange(blocks), many), place] = raw[_runs(tail + many, 4 * many)].view("<u4")
    return (grid + low[:, None]).reshape(-1)[:n]


def segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file segment: magic, documents u32, ids u64; doc_id i64 (with a byte for null) and ids u32 of each document; blocks."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + len(doc_ids).to_bytes(4, "little") + len(ids).to_bytes(8, "little")
    return head + null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(counts, "<u4").tobytes() + encode_blocks(ids)


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, n = int.from_bytes(data[4:8], "little"), int.from_bytes(data[8:16], "little")
    null = np.frombuffer(data, np.uint8, docs, 16)
    at = 16 + docs
    doc_ids = [None if x else d for d, x in zip(np.frombuffer(data, "<i8", docs, at).tolist(), null, strict=True)]
    counts = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    return doc_ids, counts, decode_blocks(data[at + 12 * docs :], n)


def _write(tokenizer: str, end_id: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SEGMENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            row = (part, seq, before, size, segment(docs, np.concatenate(counts), np.concatenate(parts)))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches, limit=TEXT_BYTES):
            ids, n = load(tokenizer).encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(n), end_id)  # after each document
            n = n + 1
            ends, names, at = np.cumsum(n), batch.column("doc_id").to_pylist(), 0
            while at < len(n):
                done = int(ends[at - 1]) if at else 0
                # The document that fills the segment closes it.
                stop = min(len(n), int(np.searchsorted(ends, done + SEGMENT - size)) + 1)
                docs += names[at:stop]
                counts.append(n[at:stop])
                parts.append(ids[done : int(ends[stop - 1])])
                size += int(ends[stop - 1]) - done
                at = stop
                if size >= SEGMENT:
                    yield close()
                    before, seq, size = before + size, seq + 1, 0
                    docs, counts, parts = [], [], []
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text) below ``path``, in ascending doc_id order.

    Each text's ids end with ``end_id``; null texts count as empty. Null doc_ids come first; rows repeating a doc_id
    are in order of a hash of their texts. The files hold rows (part, seq, before, n_ids, payload): parts ascend in doc_id,
    ``seq`` counts a part's segments, ``before`` the ids of earlier segments of the part, and the payload is a
    segment(): whole documents, closed from SEGMENT ids on, so one task holds one segment. Spark's commit protocol
    makes them appear whole or not at all, also when tasks are run again.
    """
    rows = whole_documents(docs)
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_write(tokenizer, end_id), SEGMENTS).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in files of write_tokens(), decoded from their blocks.

    ``start`` counts the ids of all documents before it. Of each part the driver sees one number.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    total, bases = 0, {}
    for part, n in sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids")).collect()):
        bases[part] = total
        total += n

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x: [] for x in ("doc_id", "start", "n_tokens", "ids_crc32")}
        for part, before, payload in zip(*(batch.column(x).to_pylist() for x in ("part", "before", "payload")), strict=True):
            doc_ids, counts, ids = read_segment(payload)
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(counts.astype(np.int64))
            starts = ends - counts
            out["doc_id"] += doc_ids
            out["start"] += (starts + bases[part] + before).tolist()
            out["n_tokens"] += counts.tolist()
            out["ids_crc32"] += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    return map_arrow(files, "doc_id long, start long, n_tokens long, ids_crc32 long", make, None)


def token_files(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """write_tokens() into the shared checkpoint folder, then read_tokens() from there."""
    path = Scratch(docs.sparkSession, "tokens").root
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
