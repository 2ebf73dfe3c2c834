"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, light, map_arrow, shuffle_partitions, whole_documents
from .components import connected_components
from .hashing import U64, Words, byte_runs, grams, long, mix

#: Bands at least, bins of a band, and probability at most that a pair at the threshold shares no band.
BANDS, ROWS, MISS = 25, 5, 1e-5
#: A pair is confirmed on full sets unless its sketches, of an entry a bin, agree in less than the threshold minus this:
#: over six standard deviations, so that none is lost.
SLACK = 0.22
#: Centres of a bucket's stars.
CENTRES = 2
#: Bands of the first pass, of one centre a bucket: it joins most of a large group, so that the second, of all bands,
#: finds its buckets closed.
FEW = 3
#: Shingles of either side of a tile, on average: what a task compares at once.
TILE = 1 << 17


def bands_for(threshold: float) -> int:
    """Bands after which a pair at the threshold shares none with probability at most MISS."""
    return max(BANDS, math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS)))


class Layout:
    """Bins and bands of a signature."""

    def __init__(self, bands: int):
        random, bins = np.random.Generator(np.random.PCG64(7)), bands * ROWS
        #: For an empty bin, the order in which it tries the others.
        self.probes = np.stack([random.permutation(bins) for _ in range(bins)])
        self.band = random.integers(1, 2**63, (bands, ROWS), dtype=U64) * U64(2) + U64(1)
        self.salt = mix(np.arange(1, bands + 1, dtype=U64) * U64(0x632BE59BD9B4E019))
        self.edges = ((np.arange(bins, dtype=object) * (1 << 64) + bins - 1) // bins).astype(U64)


@functools.cache
def layout(bands: int) -> Layout:
    return Layout(bands)


def shingle_sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased; with fewer words the whole sequence is one."""
    words = Words(text, lower=True)
    h, first = words.hashes(keyed=True), words.first
    runs = grams(h, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(runs[a : b - size + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            sets.append(grams(h[a:b], b - a))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def signature(s: np.ndarray, of: Layout) -> np.ndarray:
    """The smallest hash of each bin; an empty bin copies the first full one of its own probing order."""
    at = np.searchsorted(s, of.edges)
    full = at < np.concatenate((at[1:], [len(s)]))
    values = s[np.minimum(at, len(s) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        order = of.probes[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return values


def _key(s: np.ndarray) -> bytes | None:
    """The class of documents of equal sets; none for an empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signatures(size: int, bands_of: int):
    def make(batch: pa.RecordBatch) -> dict:
        of = layout(bands_of)
        sets = shingle_sets(batch.column("text"), size)
        keys, bands, sketches = [], [], []
        for s in sets:
            if not len(s):
                keys.append(None)
                bands.append(None)
                sketches.append(None)
                continue
            v = signature(s, of)
            keys.append(_key(s))
            bands.append(long(mix((v.reshape(-1, ROWS) * of.band).sum(axis=1, dtype=U64) ^ of.salt)))
            sketches.append(mix(v).astype(np.uint16).tobytes())
        return {"doc_id": batch.column("doc_id"), "n": np.array([len(s) for s in sets], np.int64), "key": keys, "bands": bands, "sketch": sketches}

    return make


def _agreeing(threshold: float, ratio: tuple[int, int]):
    def make(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        if not n:
            return {x: [] for x in ("u", "v", "ku", "kv")}
        a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(n, -1) for x in ("su", "sv"))
        nu, nv = (batch.column(x).to_numpy() for x in ("nu", "nv"))
        keep = ((a == b).mean(axis=1) >= threshold) & (ratio[1] * np.minimum(nu, nv) >= ratio[0] * np.maximum(nu, nv))
        return {x: batch.column(x).filter(pa.array(keep)) for x in ("u", "v", "ku", "kv")}

    return make


def _sets(size: int):
    def make(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column("text"), size)
        return {"doc_id": batch.column("doc_id"), "key": [_key(s) for s in sets], "hashes": [s.tobytes() for s in sets]}

    return make


def _confirmed(ratio: tuple[int, int]):
    def make(batch: pa.RecordBatch) -> dict:
        keep = []
        for a, b in zip(batch.column("hu"), batch.column("hv"), strict=True):
            a, b = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
            keep.append(ratio[1] * both >= ratio[0] * (len(a) + len(b) - both))
        keep = np.array(keep, bool)
        return {x: batch.column(x).to_numpy()[keep] for x in ("u", "v")}

    return make


def _hashes(size: int):
    def make(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column("text"), size)
        row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        return {"doc_id": batch.column("doc_id").take(row), "key": pa.array([_key(s) for s in sets], pa.binary()).take(row), "h": long(np.concatenate(sets)) if sets else []}

    return make


def _hopeful(docs: DataFrame, members: DataFrame, sketches: DataFrame, size: int, ratio: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Members of open buckets without those that can't be linked with any other there.

    Shingles that no other document of open buckets has are in no intersection: a document of n shingles with r others
    has at most r in common with one of m shingles, so at most r / (n + m - r). With the smallest m of its bucket that
    rules out noisy copies of a passage without comparing them with each other, and nothing else.
    """
    ids = scratch.save(members.select("doc_id").distinct(), "ids")
    text = F.struct("doc_id", "key")
    shared = map_arrow(docs.join(light(ids), "doc_id", "left_semi"), "doc_id long, key binary, h long", _hashes(size)).filter("key is not null")
    alone = shared.groupBy("h").agg(F.min(text).alias("first"), F.max(text).alias("last")).filter("first = last").groupBy("first.doc_id", "first.key").agg(F.count("*").alias("alone"))
    sizes = sketches.join(light(ids), "doc_id", "left_semi").select("doc_id", "key", "n").join(alone, ["doc_id", "key"], "left")
    sizes = scratch.save(sizes.select("doc_id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("r")), "sizes")
    sized = members.join(light(sizes), "doc_id")
    least = sized.groupBy("bucket").agg(F.min("n").alias("m"))
    kept = sized.join(least, "bucket").filter(ratio[1] * F.col("r") >= ratio[0] * (F.col("n") + F.greatest("m", "r") - F.col("r")))
    return _open(kept.groupBy("bucket", "doc_id", "c").agg(F.max("n").alias("n")))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets of several components."""
    several = members.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("bucket")
    return members.join(several, "bucket").select(members.columns)


def _first_common(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether ``bucket`` is the first band that two signatures share, or they share none, for all pairs of rows."""
    equal = a[:, None, :] == b[None, :, :]
    place = equal.argmax(axis=2)
    return ~equal.any(axis=2) | (a[np.arange(len(a))[:, None], place] == bucket)


def tile_links(bucket: int, ids: np.ndarray, c: np.ndarray, head: np.ndarray, bands: np.ndarray, hashes: list[np.ndarray], ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): links of the heads with documents of other components, one for each head and component that it has a link with."""
    n = np.array([len(h) for h in hashes])
    heads, rest = np.flatnonzero(head), np.flatnonzero(~head)
    if not len(heads) or not len(rest):
        return ids[:0], ids[:0]
    where = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    ends = np.cumsum(n)
    mark = np.zeros(int(where.max(initial=0)) + 1, bool)
    us, vs = [], []
    for a in range(0, len(heads), 64):
        some = heads[a : a + 64]
        ask = (c[some][:, None] != c[rest][None, :]) & _first_common(bands[some], bands[rest], bucket)
        ask &= ratio[1] * np.minimum(n[some][:, None], n[rest][None, :]) >= ratio[0] * np.maximum(n[some][:, None], n[rest][None, :])
        for k, i in enumerate(some.tolist()):
            j = rest[ask[k]]
            if not len(j):
                continue
            own = where[ends[i] - n[i] : ends[i]]
            mark[own] = True
            hit = mark[where[byte_runs(ends[j] - n[j], n[j])]]
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[j]) - n[j])
            mark[own] = False
            j = j[ratio[1] * both >= ratio[0] * (n[i] + n[j] - both)]
            j = j[np.unique(c[j], return_index=True)[1]]
            us.append(np.full(len(j), ids[i]))
            vs.append(ids[j])
    return (np.concatenate(us), np.concatenate(vs)) if us else (ids[:0], ids[:0])


def _tiles(ratio: tuple[int, int]):
    """Over rows sorted by tile: the links of each."""
    schema = arrow_schema("u long, v long")

    def linked(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        bands = np.stack(t.column("bands").combine_chunks().to_numpy(zero_copy_only=False))
        hashes = [np.frombuffer(h, U64) for h in t.column("hashes").to_pylist()]
        ids, c, head = (t.column(x).to_numpy() for x in ("doc_id", "c", "head"))
        made = tile_links(t.column("bucket")[0].as_py(), ids, c, head.astype(bool), bands, hashes, ratio)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = [], None
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("bucket", "mp", "hp")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = tuple(keys[a].tolist())
                if held and own != before:
                    yield linked(held)
                    held = []
                held.append(batch.slice(a, b - a))
                before = own
        if held:
            yield linked(held)

    return run


def _completed(docs: DataFrame, members: DataFrame, own: DataFrame, size: int, ratio: tuple[int, int], scratch: Scratch) -> DataFrame:
    """(u, v): links in open buckets between documents outside the bucket's largest component and all of other components.

    Both sides are cut into parts, and each two of these meet in one task with their full sets. A pair is compared in
    the first band that it shares. What comes out is linear in rows: a link for each document and component.
    """
    ids = scratch.save(members.select("doc_id").distinct(), "ids")
    sets = map_arrow(docs.join(light(ids), "doc_id", "left_semi"), "doc_id long, key binary, hashes binary", _sets(size)).filter("key is not null").dropDuplicates(["doc_id", "key"])
    sets = scratch.save(sets.join(own.select("doc_id", "key", "bands"), ["doc_id", "key"]), "sets")
    sizes = members.groupBy("bucket", "c").agg(F.sum("n").alias("n"), F.count("*").alias("size"))
    facts = sizes.groupBy("bucket").agg(F.max_by(F.struct("c", "n"), F.struct("size", "c")).alias("most"), F.sum("n").alias("all"))
    parts = lambda n: F.ceil(n / TILE).cast("int")
    facts = facts.select("bucket", F.col("most.c").alias("most"), parts(F.col("all")).alias("mps"), parts(F.col("all") - F.col("most.n")).alias("hps"))
    rows = members.join(facts, "bucket")
    part = lambda of: F.pmod(F.xxhash64("doc_id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    named = ("bucket", "doc_id", "c")
    sides = rows.select(*named, part("mps").alias("mp"), every("hps").alias("hp"), F.lit(False).alias("head"))
    sides = sides.unionByName(rows.filter("c <> most").select(*named, every("mps").alias("mp"), part("hps").alias("hp"), F.lit(True).alias("head")))
    tile = ("bucket", "mp", "hp")
    dealt = sides.join(light(sets), "doc_id").select(*named, "mp", "hp", "head", "bands", "hashes")
    return dealt.repartition(shuffle_partitions(docs.sparkSession), *tile).sortWithinPartitions(*tile).mapInArrow(_tiles(ratio), "u long, v long")


def _linked(docs: DataFrame, own: DataFrame, stars: DataFrame, bands: int | None, size: int, ratio: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, component) after comparing the stars of buckets of the first ``bands`` bands, or of all; and (bucket, doc_id, c) of what may be linked yet.

    Buckets of several components compare all members with their centres: at first the smallest ids, then the smallest
    outside the largest component, for pairs inside that need no look.
    """
    nodes = own.select("doc_id", F.slice("bands", 1, bands).alias("bands") if bands else "bands")
    nodes = nodes.join(light(stars, F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    rows = nodes.select("doc_id", F.coalesce("component", "doc_id").alias("c"), F.explode("bands").alias("bucket"))
    several = scratch.save(rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("bucket"), "several")
    members = scratch.save(rows.join(light(several), "bucket").select("bucket", "doc_id", "c").distinct(), "members")
    if members.isEmpty():
        return stars, members
    ids = scratch.save(members.select("doc_id").distinct(), "ids")
    sketches = scratch.save(own.select("doc_id", "key", "n", "sketch").join(light(ids), "doc_id", "left_semi"), "sketches")
    able, centres = members, 1
    if bands is None:
        sizes = members.groupBy("bucket", "c").agg(F.count("*").alias("size"))
        able, centres = members.join(sizes.groupBy("bucket").agg(F.max_by("c", F.struct("size", "c")).alias("most")), "bucket").filter("c <> most"), CENTRES
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id"))
    heads = able.withColumn("place", place).filter(F.col("place") <= centres).select("bucket", F.col("doc_id").alias("u"), F.col("c").alias("cu"))
    heads = scratch.save(heads, "centres")
    pairs = members.join(light(heads), "bucket").filter("c <> cu")
    pairs = pairs.select(F.least("u", "doc_id").alias("u"), F.greatest("u", "doc_id").alias("v")).distinct()
    side = light(sketches)
    left = side.select(F.col("doc_id").alias("u"), F.col("key").alias("ku"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    right = side.select(F.col("doc_id").alias("v"), F.col("key").alias("kv"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    near = scratch.save(map_arrow(pairs.join(left, "u").join(right, "v"), "u long, v long, ku binary, kv binary", _agreeing(ratio[0] / ratio[1] - SLACK, ratio), None), "near")
    ends = scratch.save(near.select(F.col("u").alias("doc_id"), F.col("ku").alias("key")).unionByName(near.select(F.col("v").alias("doc_id"), F.col("kv").alias("key"))).distinct(), "ends")
    sets = map_arrow(docs.join(light(ends, "doc_id"), "doc_id", "left_semi"), "doc_id long, key binary, hashes binary", _sets(size))
    sets = scratch.save(sets.filter("key is not null").dropDuplicates(["doc_id", "key"]), "sets")
    hu = sets.select(F.col("doc_id").alias("u"), F.col("key").alias("ku"), F.col("hashes").alias("hu"))
    hv = sets.select(F.col("doc_id").alias("v"), F.col("key").alias("kv"), F.col("hashes").alias("hv"))
    found = map_arrow(near.join(hu, ["u", "ku"]).join(hv, ["v", "kv"]), "u long, v long", _confirmed(ratio), None)
    found = found.unionByName(stars.select(F.col("id").alias("u"), F.col("component").alias("v")))
    stars = scratch.save(connected_components(found, scratch), "stars")
    if bands is None:
        # Centres have met all of their bucket; the others go on where these are of several components.
        rest = members.select("bucket", "doc_id").join(light(heads, "bucket", F.col("u").alias("doc_id")), ["bucket", "doc_id"], "left_anti")
        rest = rest.join(light(stars, F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("c"))
        rest = scratch.save(_open(rest), "members")
        members = rest if rest.isEmpty() else scratch.save(_hopeful(docs, rest, sketches, size, ratio, scratch), "members")
    scratch.drop(near, sets, heads)
    return stars, members


def near_duplicates(docs: DataFrame, size: int = 5, ratio: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Documents are linked when intersection / union of their sets of ``size``-word shingles is at least ratio[0] /
    ratio[1], confirmed on full sets. Documents of equal sets are one class, compared once through its smallest id.
    Class representatives meet in buckets of equal bands, first of FEW bands, then of all: every bucket compares its
    members with its smallest ids, so stars keep pairs in proportion to rows. What is in buckets of several components
    then, but for documents that can't be linked with any there, is compared whole in tiles of bounded size, those
    outside the largest component with all others: no link between different texts that share a bucket is lost, and
    pairs already in one component aren't compared. A pair at the threshold shares no band with probability below
    1e-5 (at 0.8, by 29 bands) or 1e-6 (at 0.85, by 25).

    Null and empty texts, and texts of separators only, have 0 shingles and link with nothing. Rows with a null doc_id
    link with nothing and have a null component. Rows repeating a doc_id count as one document with the links of all their texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = whole_documents(docs)
    threshold = ratio[0] / ratio[1]
    marks = scratch.save(map_arrow(docs, "doc_id long, n long, key binary, bands array<long>, sketch binary", _signatures(size, bands_for(threshold))), "signatures")
    full = marks.filter("key is not null and doc_id is not null")
    classes = scratch.save(full.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    # A class is compared through its smallest id. An id of several texts is one document: it joins their classes.
    own = scratch.save(full.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["doc_id", "key"]), "representatives")
    repeated = scratch.save(full.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("doc_id"), "repeated")
    several = full.select("doc_id", "key").join(light(repeated), "doc_id").join(classes, "key")
    versions = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").select(F.col("rep").alias("u"), "v")
    stars = scratch.save(connected_components(versions, scratch), "stars")
    for bands in (FEW, None):
        stars, left = _linked(docs, own, stars, bands, size, ratio, scratch)
    if not left.isEmpty():
        links = _completed(docs, left, own, size, ratio, scratch).unionByName(stars.select(F.col("id").alias("u"), F.col("component").alias("v")))
        stars = scratch.save(connected_components(links, scratch), "stars")
    base = marks.select("doc_id", "n", "key").join(classes, "key", "left")
    base = base.join(light(stars, F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = base.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, ratio: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` without the rows that near_duplicates() doesn't keep: the smallest doc_id of each group stays."""
    gone = near_duplicates(docs, size, ratio).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
