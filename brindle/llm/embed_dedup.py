"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, light, map_arrow, shuffle_partitions
from .components import connected_components
from .vectors import packed, plain, stacked

#: Neighbours in a pass's order that a block holds, and that each of its vectors is compared with at least, on either side.
WINDOW = 1024
#: Hash bits that order a pass.
BITS = 40
#: Probability of missing a pair at the threshold, over all passes.
MISS = 1e-5
#: Rows compared with a block at once.
TILE = 256


def bits_for(count: int) -> int:
    """Leading bits that WINDOW of ``count`` vectors share if hashes split evenly: those of a run."""
    return min(BITS, max(0, math.ceil(math.log2(max(count, 1) / WINDOW))))


def passes_for(count: int, threshold: float) -> int:
    """Passes after which a pair at the threshold has been in one run with probability 1 - MISS.

    Two vectors at angle a agree in a random hash bit with probability 1 - a / pi, whatever the other vectors are. Runs
    are compared whole, so that a pair meets once it agrees in all leading bits of one pass.
    """
    met = (1 - math.acos(threshold) / math.pi) ** bits_for(count)
    return 1 if met == 1 else math.ceil(math.log(MISS) / math.log(1 - met))


def _codes(passes: int):
    """A row for each vector and pass: BITS random hashes, sides of random planes, one after another. Planes depend on length and pass only."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x: [] for x in ("dim", "pass", "code", "rep")}
        dims, reps, vectors = batch.column("dim").to_numpy(), batch.column("rep").to_numpy(), batch.column("vector").to_pylist()
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            x = stacked([vectors[i] for i in rows], int(d))
            planes = np.random.Generator(np.random.PCG64([20240301, int(d)])).standard_normal((passes * BITS, x.shape[1]))
            some = max(1, (1 << 21) // len(planes))
            for a in range(0, len(x), some):
                sides = (x[a : a + some] @ planes.T >= 0).reshape(-1, passes, BITS)
                out["code"].append((sides @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))).reshape(-1))
            out["pass"].append(np.tile(np.arange(passes), len(rows)))
            out["dim"].append(np.full(len(rows) * passes, d))
            out["rep"].append(np.repeat(reps[rows], passes))
        return {k: np.concatenate(x) if x else [] for k, x in out.items()}

    return make


PLACES = "dim int, pass int, rep long, run long, part int, place long"


def _places(bits: int):
    """Over rows in order: each one's run, and its place among the rows of its pass in this partition."""
    schema = arrow_schema(PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, own = batch.column("dim").to_numpy(), batch.column("pass").to_numpy()
            new = np.ones(len(dim), bool)
            new[1:] = (dim[1:] != dim[:-1]) | (own[1:] != own[:-1])
            new[0] = before != (dim[0], own[0])
            at = np.arange(len(dim))
            first = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(first >= 0, at - first, at + done)
            before, done = (dim[-1], own[-1]), int(place[-1]) + 1
            columns = (dim, own, batch.column("rep"), batch.column("code").to_numpy() >> (BITS - bits), np.full(len(dim), part), place)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _blocks(before: dict[tuple[int, int, int], int], window: int):
    """The block of each row, from the rows of its pass in the partitions before."""

    def make(batch: pa.RecordBatch) -> dict:
        keys = zip(*(batch.column(x).to_pylist() for x in ("dim", "pass", "part")), strict=True)
        block = (np.fromiter((before[k] for k in keys), np.int64, batch.num_rows) + batch.column("place").to_numpy()) // window
        return {x: batch.column(x) for x in ("dim", "pass", "rep", "run")} | {"block": block}

    return make


def _compared(threshold: float):
    """Links in a block and between it and another: (id, null, linked vectors) of each class, and (id, other, null) to join what is linked.

    A pair that met in an earlier pass is left to it, so that each is counted once. What is returned is linear in rows:
    edges are a spanning forest of the links.
    """
    schema = arrow_schema("id long, other long, n long")

    def run(rows: pa.Table) -> pa.Table:
        size = rows.num_rows
        own, a, b, dim = (rows.column(x)[0].as_py() for x in ("pass", "a", "b", "dim"))
        block, ids, copies = (rows.column(x).to_numpy() for x in ("block", "rep", "copies"))
        x = stacked(rows.column("vector").to_pylist(), dim)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        runs, blocks = (np.stack(rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("runs", "blocks"))
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        linked, label = np.zeros(size, np.int64), np.arange(size)
        for at in range(0, len(left), TILE):
            r = left[at : at + TILE]
            s = np.concatenate((left[at:], right)) if b == a + 1 else right
            cosine = unit[r] @ unit[s].T
            near = cosine >= threshold - 1e-9
            if b == a + 1:
                near[:, : len(left) - at] &= s[None, : len(left) - at] > r[:, None]
            else:
                near &= runs[r, own][:, None] == runs[s, own][None, :]
            i, j = np.nonzero(near)
            for p in range(own):
                if not len(i):
                    break
                u, v = r[i], s[j]
                keep = (runs[u, p] != runs[v, p]) & (np.abs(blocks[u, p] - blocks[v, p]) > 1)
                i, j = i[keep], j[keep]
            keep = ids[r[i]] != ids[s[j]]
            i, j = i[keep], j[keep]
            edge = np.abs(cosine[i, j] - threshold) <= 1e-9
            if edge.any():
                p, q = x[r[i]], x[s[j]]
                exact = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
                keep = ~edge | (exact >= threshold)
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            u, v = r[i], s[j]
            linked += np.bincount(u, copies[v], size).astype(np.int64) + np.bincount(v, copies[u], size).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            for first, last in zip(starts, [*starts[1:], len(u)], strict=True):
                joined = np.append(label[v[first:last]], label[u[first]])
                if (joined != joined[0]).any():
                    to = np.arange(size)
                    to[joined] = joined.min()
                    label = to[label]
        some, moved = np.flatnonzero(linked), np.flatnonzero(label != np.arange(size))
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate((ids[some], ids[moved]))),
                pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[label[moved]])]),
                pa.concat_arrays([pa.array(linked[some]), pa.nulls(len(moved), pa.int64())]),
            ],
            schema=schema,
        )

    return run


def near_vectors(table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``table`` (vec_id, embedding).

    Two vectors are linked when a pass finds them and their cosine in double precision is at least ``threshold``. Each
    pass orders all vectors lexicographically by BITS concatenated random hashes, ties by a hash of their own, and compares
    windows of neighbours: blocks of WINDOW with themselves and with the next one. Where more vectors share their leading
    bits than a window holds, such a run is compared whole, block by block: so no pair's chance depends on what else
    lies near it. The number of passes grows with rows; a pair at the threshold is missed by all with probability below
    1e-5. Verified pairs of all passes are united. Only keys are sorted; a vector travels to two blocks a pass. Tasks
    compare two blocks at most and return counts and a spanning forest, not pairs. Equal vectors are one class, compared
    once and counted as often as they occur. A group of near but unequal vectors costs time with the square of its size,
    as its links do.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links and their own
    component. Vectors of different lengths aren't compared. Rows with a null vec_id link with nothing and have a null
    component. Rows repeating a vec_id with another vector keep the links of both.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = plain(table)
    vectors = scratch.save(packed(table, lambda x: x if np.any(x != 0) and np.isfinite(np.dot(x, x)) and np.dot(x, x) > 0 else None, kind), "vectors")
    classes = scratch.save(vectors.groupBy("dim", "vector").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")).withColumn("tie", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    passes, bits = passes_for(count, threshold), bits_for(count)
    # An id that repeats with other vectors may be the smallest of several classes: these are told apart by their tie.
    codes = map_arrow(classes.select("dim", F.col("tie").alias("rep"), "vector"), "dim int, pass int, code long, rep long", _codes(passes), None)
    keys = ("dim", "pass", "code", F.xxhash64("rep", "pass"))
    order = codes.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    order = scratch.save(order.mapInArrow(_places(bits), PLACES), "order")
    before, done = {}, {}
    for d, p, part, n in sorted(tuple(r) for r in order.groupBy("dim", "pass", "part").agg(F.count("*")).collect()):
        before[d, p, part] = done.get((d, p), 0)
        done[d, p] = before[d, p, part] + n
    placed = scratch.save(map_arrow(order, "dim int, pass int, rep long, run long, block long", _blocks(before, WINDOW), None), "blocks")
    long = placed.groupBy("dim", "pass", "run").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("high > low + 1")
    long = scratch.save(long, "long")
    of = placed.groupBy(F.col("rep").alias("tie")).agg(F.sort_array(F.collect_list(F.struct("pass", "run", "block"))).alias("at"))
    rows = classes.join(of, "tie").select("dim", "rep", "copies", "vector", F.col("at.run").alias("runs"), F.col("at.block").alias("blocks"), F.explode("at").alias("own"))
    rows = rows.select("*", "own.pass", "own.run", "own.block").drop("own").join(light(long), ["dim", "pass", "run"], "left")
    far = F.expr("transform(filter(sequence(low, high), x -> abs(x - block) > 1), x -> named_struct('a', least(x, block), 'b', greatest(x, block)))")
    near = F.expr("array(named_struct('a', block, 'b', block + 1), named_struct('a', block - 1, 'b', block))")
    rows = rows.withColumn("pair", F.explode(F.when(F.col("low").isNull(), near).otherwise(F.concat(near, far)))).filter("pair.a >= 0")
    rows = rows.select("dim", "pass", "pair.a", "pair.b", "block", "rep", "copies", "runs", "blocks", "vector")
    found = scratch.save(rows.groupBy("dim", "pass", "a", "b").applyInArrow(_compared(threshold), "id long, other long, n long"), "links")
    links = found.filter("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v"))
    stars = scratch.save(connected_components(links, scratch), "stars")
    counts = found.filter("other IS NULL").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("others"))
    by_class = classes.join(counts, "rep", "left").join(light(stars, F.col("id").alias("rep"), "component"), "rep", "left")
    by_class = by_class.select("vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    by_id = vectors.join(by_class, "vector").groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = table.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_id, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
