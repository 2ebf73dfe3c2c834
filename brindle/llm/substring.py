"""Exact substring de-duplication over windows of words, by super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, map_arrow, shuffle_partitions, slices, whole_documents
from .hashing import U64, Words, byte_runs, grams, long, run_ranks

#: Words of a minimiser.
MINIMISER = 8
#: Windows of a bucket, or of a share of dealt windows, that a task sorts together; more are dealt by their own digests.
TOGETHER = 1 << 17

def super_kmers(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows that share a minimiser: its hash, first word, windows, and whether it occurs twice in it.

    Runs stay within a row.
    """
    m = min(MINIMISER, k)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    every = least = grams(h, m)
    have, want = 1, k - m + 1
    while have < want:  # minimum over ``want`` neighbours by doubling
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = least[:n]
    inside = row[:n] == row[k - 1 : k - 1 + n]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | (row[1:n] != row[: n - 1])
    change &= inside
    first = np.flatnonzero(change)
    # A run ends before the next one, or before the first window that isn't inside its row.
    stop = np.append(first[1:], n)
    valid = np.concatenate(([0], np.cumsum(inside)))
    size = valid[stop] - valid[first]
    if not len(first):
        return least[first], first, size, np.zeros(0, bool)
    span = size + k - m
    starts = np.concatenate(([0], np.cumsum(span)[:-1]))
    place = np.arange(span.sum()) + np.repeat(first - starts, span)
    hits = np.add.reduceat((every[place] == np.repeat(least[first], span)).astype(np.int32), starts)
    return least[first], first, size, hits > 1


def _minimisers(k: int):
    def make(batch: pa.RecordBatch) -> dict:
        words = Words(batch.column("text"))
        mh, first, n, twice = super_kmers(words.hashes(), words.row, k)
        row = words.row[first] if len(first) else np.zeros(0, np.int64)
        doc, version = (batch.column(x).to_numpy()[row] for x in ("doc_id", "version"))
        return {"mh": long(mh), "doc_id": doc, "version": version, "start": (first - words.first[row]).astype(np.int32), "n": n.astype(np.int32), "twice": twice}

    return make


def _pack(k: int):
    """The words of each chosen super-k-mer as one string, with its digest."""

    def make(batch: pa.RecordBatch) -> dict:
        words, spans = Words(batch.column("text")), batch.column("spans")
        row = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)))
        mh, start, n = (spans.flatten().field(x).to_numpy() for x in ("mh", "start", "n"))
        data, first, last = words.joined()
        a = words.first[row] + start
        raw = memoryview(data.tobytes())
        strings = [bytes(raw[x:y]) for x, y in zip(first[a].tolist(), last[a + n + k - 2].tolist(), strict=True)] if len(a) else []
        doc, version = (batch.column(x).to_numpy()[row] for x in ("doc_id", "version"))
        return {"mh": mh, "doc_id": doc, "version": version, "start": start, "n": n, "digest": [hashlib.blake2b(x, digest_size=16).digest() for x in strings], "words": pa.array(strings, pa.binary()).cast(pa.string())}

    return make


def _digests(column: pa.Array) -> np.ndarray:
    """16-byte digests as two numbers each."""
    return np.frombuffer(b"".join(column.to_numpy(zero_copy_only=False).tolist()), "<u8").reshape(-1, 2)


STRINGS = "state byte, edge boolean, mh long, digest binary, doc_id long, version long, start int, n int, words string"
COPY, FIRST, LAST = 0, 1, 2


def _equal_strings():
    """Over rows sorted by digest and place: which strings start later than an equal one here (COPY), and which don't (FIRST).

    A digest's rows may begin in the partition before: FIRST rows of a partition's first digest have ``edge`` set, and a
    LAST row tells the place that its last digest starts at.
    """
    schema = arrow_schema(STRINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, lead, here, edge = None, (0, 0), (0, 0, 0), True
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            digest = _digests(batch.column("digest"))
            doc, version, start = (batch.column(x).to_numpy() for x in ("doc_id", "version", "start"))
            new = np.ones(n, bool)
            new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
            new[0] = before is None or tuple(digest[0].tolist()) != before
            run = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            lead_doc, lead_start = np.where(run >= 0, doc[run], lead[0]), np.where(run >= 0, start[run], lead[1])
            copy = (doc != lead_doc) | (start != lead_start)
            same = np.zeros(n, bool)  # the same row again
            same[1:] = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (version[1:] == version[:-1])
            same[0] = here == (int(doc[0]), int(start[0]), int(version[0]))
            same &= ~new
            runs = np.cumsum(new) - (1 if before is None else 0)
            first_run = (runs == 0) & edge
            keep = np.flatnonzero(copy | ~same)
            words = batch.column("words").take(pa.array(keep, pa.int64(), mask=copy[keep]))
            columns = [np.where(copy[keep], COPY, FIRST).astype(np.int8), first_run[keep], *(batch.column(x).take(pa.array(keep)) for x in ("mh", "digest", "doc_id", "version", "start", "n")), words]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
            before, lead, here = tuple(digest[-1].tolist()), (int(lead_doc[-1]), int(lead_start[-1])), (int(doc[-1]), int(start[-1]), int(version[-1]))
            edge &= runs[-1] == 0
            last = batch.column("digest")[-1].as_py()
        if last is not None:
            row = (LAST, True, None, last, lead[0], None, lead[1], None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _reduced(strings: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(first occurrences, copies) of equal strings. Sorted ranges, which also cut through the rows of a hot string."""
    place = ["digest", "doc_id", "start", "version"]
    ordered = strings.repartitionByRange(shuffle_partitions(strings.sparkSession), *place).sortWithinPartitions(*place)
    judged = scratch.save(ordered.mapInArrow(_equal_strings(), STRINGS), "equal")
    scratch.drop(strings)
    at = F.struct("doc_id", "start")
    leads = judged.filter(F.col("edge")).groupBy("digest").agg(F.min(at).alias("lead"))
    edges = judged.filter((F.col("state") == FIRST) & F.col("edge")).join(leads, "digest").withColumn("later", at != F.col("lead"))
    columns = ["mh", "digest", "doc_id", "version", "start", "n", "words"]
    firsts = judged.filter((F.col("state") == FIRST) & ~F.col("edge")).select(columns).unionByName(edges.filter("not later").select(columns))
    copies = judged.filter(F.col("state") == COPY).select(SPAN).unionByName(edges.filter("later").select(SPAN))
    return firsts, copies


def _windows(rows: list[pa.RecordBatch], k: int) -> tuple[Words, np.ndarray, tuple[np.ndarray, ...]]:
    """The words of packed strings, the first word of every window, and its document, version and position."""
    batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    words = Words(batch.column("words"))
    n = max(0, len(words.start) - k + 1)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :]) if n else np.zeros(0, np.int64)
    row = words.row[at]
    doc, version, start = (batch.column(x).to_numpy()[row] for x in ("doc_id", "version", "start"))
    return words, at, (doc, version, start + at - words.first[row])


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with equal keys: those that start later than the first, and one of each version that starts there."""
    by = np.lexsort((version, start, doc, *keys))
    doc, version, start = doc[by], version[by], start[by]
    new = np.ones(len(by), bool)
    new[1:] = False
    for x in keys:
        new[1:] |= x[by][1:] != x[by][:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[lead]) | (start != start[lead])
    again = np.zeros(len(by), bool)
    again[1:] = ~new[1:] & (version[1:] == version[:-1]) & (start[1:] == start[:-1]) & (doc[1:] == doc[:-1])
    return by[later], by[~later & ~again]


SPAN = ["doc_id", "version", "start", "n"]
FOUND = "share int, doc_id long, version long, start int, n int, packed binary"
_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("version", "<i8"), ("start", "<i4")])


def _found(schema: pa.Schema, doc: np.ndarray, version: np.ndarray, start: np.ndarray, entries: np.ndarray | None = None, shares: int = 1) -> pa.RecordBatch:
    """Windows that start earlier too, as runs; and entries of windows still to be compared, packed by their share."""
    by = np.lexsort((start, version, doc))
    doc, version, start = doc[by], version[by], start[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    share, packed = np.zeros(0, np.int32), []
    if entries is not None and len(entries):
        of = (entries["h1"] % U64(shares)).astype(np.int32)
        by = np.argsort(of, kind="stable")
        share, at = np.unique(of[by], return_index=True)
        packed = [x.tobytes() for x in np.split(entries[by], at[1:])]
    spans, more = len(first), len(share)
    columns = [
        pa.concat_arrays([pa.nulls(spans, pa.int32()), pa.array(share, pa.int32())]),
        *(pa.concat_arrays([pa.array(x, t), pa.nulls(more, t)]) for x, t in ((doc[first], pa.int64()), (version[first], pa.int64()), (start[first], pa.int32()), (start[last] - start[first] + 1, pa.int32()))),
        pa.concat_arrays([pa.nulls(spans, pa.binary()), pa.array(packed, pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _count_buckets(k: int, shares: int, together: int):
    """Over strings sorted by minimiser: windows that also start earlier in their bucket.

    Whole buckets are sorted together, by numbers that only equal runs of words share. The first and the last bucket
    of a partition may go on in the next one, and one of over ``together`` windows is too large: their windows are reduced
    as far as they are held, and packed by digest for a second comparison.
    """
    schema = arrow_schema(FOUND)

    def judged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        words, at, place = _windows(rows, k)
        later, _ = _later((run_ranks(words.ranks(), k)[at],), *place) if len(at) else (at, at)
        return _found(schema, *(x[later] for x in place))

    def dealt(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        words, at, place = _windows(rows, k)
        data, first, last = words.joined()
        raw = memoryview(data.tobytes())
        made = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first[at].tolist(), last[at + k - 1].tolist(), strict=True)] if len(at) else []
        h = np.frombuffer(b"".join(made), "<u8").reshape(-1, 2)
        later, stay = _later((h[:, 0], h[:, 1]), *place)
        entries = np.empty(len(stay), _ENTRY)
        for name, x in zip(_ENTRY.names, (h[:, 0], h[:, 1], *place), strict=True):
            entries[name] = x[stay]
        return _found(schema, *(x[later] for x in place), entries, shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, size = [], 0  # whole buckets, and their windows
        bucket, windows, split, before = [], 0, True, None  # the one that rows are added to
        for rows in slices(batches, "words"):
            mh, n = rows.column("mh").to_numpy(), np.concatenate(([0], np.cumsum(rows.column("n").to_numpy(), dtype=np.int64)))
            starts = (np.flatnonzero(mh[1:] != mh[:-1]) + 1).tolist()
            if before is not None and mh[0] != before:
                starts = [0, *starts]
            before = mh[-1]
            more = starts[0] if starts else len(mh)
            if more:
                bucket.append(rows.slice(0, more))
                windows += int(n[more])
            if windows > together:
                yield dealt(bucket)
                bucket, windows, split = [], 0, True
            if starts:
                if bucket and split:
                    yield dealt(bucket)
                else:
                    whole += bucket
                    size += windows
                a, b = starts[0], starts[-1]
                if a < b:
                    whole.append(rows.slice(a, b - a))
                    size += int(n[b] - n[a])
                if whole and size >= together >> 2:
                    yield judged(whole)
                    whole, size = [], 0
                bucket, windows, split = [rows.slice(b)], int(n[-1] - n[b]), False
        if whole:
            yield judged(whole)
        if bucket:
            yield dealt(bucket)

    return run


def _count_windows(together: int):
    """Over packed entries sorted by share: windows that also start earlier. What is held is reduced as it grows."""
    schema = arrow_schema(FOUND)

    def reduced(held: list[np.ndarray]) -> tuple[np.ndarray, pa.RecordBatch]:
        x = np.concatenate(held)
        later, stay = _later((x["h1"], x["h2"]), x["doc"], x["version"], x["start"])
        return x[stay], _found(schema, *(x[name][later] for name in ("doc", "version", "start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held, size, most = None, [], 0, together
        for batch in batches:
            for own, packed in zip(batch.column("share").to_pylist(), batch.column("packed"), strict=True):
                if own != share and held:
                    yield reduced(held)[1]
                    held, size, most = [], 0, together
                share = own
                held.append(np.frombuffer(packed.as_buffer(), _ENTRY))
                size += len(held[-1])
                if size > most:
                    rest, found = reduced(held)
                    yield found
                    held, size = [rest], len(rest)
                    most = max(together, 2 * size)
        if held:
            yield reduced(held)[1]

    return run


def repeated_spans(docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(doc_id, version, start, n): runs of windows of k words, in documents of ``docs``, that also start earlier elsewhere.

    1. Every document's super-k-mers as (minimiser, place, windows), without text.
    2. A window can only repeat if its minimiser occurs in two super-k-mers, or in one that repeats within itself;
       those super-k-mers go on as packed strings.
    3. Equal strings, by a cryptographic digest, are reduced to their first occurrence in sorted ranges, which also cut
       through the rows of a hot string; the windows of others start earlier.
    4. Strings of a minimiser meet in its bucket, where sorting finds every window that starts earlier, by its words.
       Buckets lie in sorted ranges too. One that a range cuts, or of over TOGETHER windows, is reduced in parts; what
       is left of these is packed by the windows' digests, and compared once more.
    """
    marks = scratch.save(map_arrow(docs, "mh long, doc_id long, version long, start int, n int, twice boolean", _minimisers(k)), "minimisers")
    often = marks.groupBy("mh").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).filter("c > 1 or twice").select("mh")
    spans = marks.join(often, "mh").groupBy("doc_id", "version").agg(F.collect_set(F.struct("mh", "start", "n")).alias("spans"))
    strings = scratch.save(map_arrow(docs.join(spans, ["doc_id", "version"]), "mh long, doc_id long, version long, start int, n int, digest binary, words string", _pack(k)), "strings")
    scratch.drop(marks)
    firsts, copies = _reduced(strings, scratch)
    parts = shuffle_partitions(docs.sparkSession)
    shares = 4 * parts
    buckets = firsts.repartitionByRange(parts, "mh", "digest").sortWithinPartitions("mh").mapInArrow(_count_buckets(k, shares, TOGETHER), FOUND)
    buckets = scratch.save(buckets, "buckets")
    windows = buckets.filter("share is not null").repartition(parts, "share").sortWithinPartitions("share").mapInArrow(_count_windows(TOGETHER), FOUND)
    found = scratch.save(copies.unionByName(buckets.filter("share is null").select(SPAN)).unionByName(windows.select(SPAN)), "spans")
    return found


def _cut_words(batch: pa.RecordBatch, text: pa.Array, k: int) -> tuple[Words, np.ndarray]:
    """The words of the texts, and which of them are covered by a span of the column ``spans``."""
    words, spans = Words(text), batch.column("spans")
    row = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)))
    gone = np.zeros(len(words.start) + 1, np.int64)
    if len(row):
        start, n = (spans.flatten().field(x).to_numpy().astype(np.int64) for x in ("start", "n"))
        first = words.first[row] + start
        gone = np.bincount(first, minlength=len(gone)) - np.bincount(first + n + k - 1, minlength=len(gone))
    return words, np.cumsum(gone[:-1]) > 0


def _cut(k: int):
    def make(batch: pa.RecordBatch) -> dict:
        words, gone = _cut_words(batch, batch.column("text"), k)
        lost = np.bincount(words.row[gone], minlength=batch.num_rows)
        data, first, last = words.joined()
        raw, digests = memoryview(data.tobytes()), []
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if not lost[i]:
                digests.append(hashlib.sha256(raw[first[a] : last[b - 1]] if b > a else b"").hexdigest())
                continue
            stays = ~gone[a:b]
            # Runs of kept words.
            edge = np.flatnonzero(np.diff(np.concatenate(([False], stays, [False])).astype(np.int8)))
            digests.append(hashlib.sha256(b" ".join(raw[first[a + x] : last[a + y - 1]] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_words": words.counts().astype(np.int64), "n_removed": lost.astype(np.int64), "kept_sha256": digests}

    return make


def remove_repeats(docs: DataFrame, k: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text).

    A word goes if it is covered by a window of k words that also starts earlier: in a document of smaller doc_id, or
    earlier in the same one. Windows are judged on the input. kept_sha256 is of the kept words joined by one space. A
    null text has no words. Rows with a null doc_id are left as they are and make no other word go. Rows repeating a
    doc_id are versions of one document: each loses its own windows that start earlier, in any version too.
    """
    docs = whole_documents(docs)
    return map_arrow(_with_spans(docs, k), "doc_id long, n_words long, n_removed long, kept_sha256 string", _cut(k))


def _with_spans(docs: DataFrame, k: int) -> DataFrame:
    """``docs``, whatever columns they have, with a column ``spans`` of (start, n); null where nothing goes."""
    scratch = Scratch(docs.sparkSession, "substring")
    version = F.xxhash64(F.col("text").cast("string"))
    known = whole_documents(docs).filter("doc_id is not null and text is not null").withColumn("version", version)
    found = repeated_spans(known, k, scratch)
    spans = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("span_doc_id"), F.col("version").alias("span_version"), "spans")
    own = (docs["doc_id"].cast("long") == F.col("span_doc_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("span_version"))
    return docs.join(spans, own, "left").select(*(docs[c] for c in docs.columns), "spans")


def cut_repeats(docs: DataFrame, k: int = 20) -> DataFrame:
    """``docs`` with the words that remove_repeats() removes cut out of text; n_chars, if there is one, follows.

    White space before each removed word goes with it. Each row is cut from its own text; null texts stay null.
    """
    names = docs.columns
    renamed = docs.toDF(*(c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(names)))
    chars = next((i for i, c in enumerate(names) if c == "n_chars"), None)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("text")
        words, gone = _cut_words(batch, text, k)
        batch = batch.drop_columns(["spans"])
        rows = np.unique(words.row[gone])
        if not len(rows):
            return batch
        at = np.flatnonzero(gone)
        before = np.where(at > words.first[words.row[at]], words.end[at - 1], words.offsets[words.row[at]])
        keep = np.ones(len(words.data), bool)
        keep[byte_runs(before, words.end[at] - before)] = False
        ends = np.concatenate(([0], np.cumsum(keep)))[words.offsets]
        cut = pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(ends), pa.py_buffer(words.data[keep])])
        mask = np.zeros(len(text), bool)
        mask[rows] = True
        changed = [("text", cut.cast(text.type))] + ([(f"column_{chars}", pc.utf8_length(cut))] if chars is not None else [])
        for name, new in changed:
            i = batch.schema.get_field_index(name)
            batch = batch.set_column(i, batch.schema.field(i), pc.if_else(pa.array(mask), new.cast(batch.schema.field(i).type), batch.column(i)))
        return batch

    return map_arrow(_with_spans(renamed, k), renamed.schema, make).toDF(*names)
