"""Connected components by alternating large and small stars, in Spark from end to end."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Up to so many edges (16 bytes each, counted first) one task unites them; more take the distributed steps.
ONE_TASK = 500_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v); component is the smallest id reachable.

    Up to ONE_TASK edges are united by one task. Beyond that each step points vertices at the smallest neighbour; a few steps reach stars even on long paths. Edges stay
    distributed; the driver sees one count and checksum a step. A vertex with very many edges is reduced by partial
    aggregation and joined by a join that adaptive execution can split.
    """
    pair = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = scratch.save(pair, "edges")
    mark = _mark(now)
    if mark[0] <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_united, "id long, component long")
    while mark[0]:
        large = _large_star(now)
        after = scratch.save(_small_star(large), "edges")
        seen = _mark(after)
        scratch.drop(now)
        now = after
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _united(batches):
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "component"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u joins the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, joins the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
