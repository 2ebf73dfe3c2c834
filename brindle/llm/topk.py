"""Exact top-k inner-product search pruned by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow
from .vectors import packed, stacked

#: Shares of a vector's entries that are segments of their own at each level, coarse to fine, and segments of the rest.
LEVELS, REST = (1 / 8, 1 / 2, 3 / 4), 4
#: Numbers of a block of rows, and of queries. Memory of a task is bounded by these.
ROW_BLOCK, QUERY_BLOCK = 1 << 19, 1 << 18
#: Numbers of the sample of rows (8 MB) that the rotation is fitted on and that gives queries their first floor; its rows at most.
SEED, SEED_ROWS = 1 << 20, 8192
#: Rows that are compared with a block of queries at once, and the share of survivors from which a product of matrices is cheaper.
CHUNK, DENSE = 512, 1 / 16


def segments(d: int, share: float) -> list[slice]:
    """Segments of ``d`` entries at a level."""
    own = min(d, int(d * share))
    cuts = np.unique(np.linspace(own, d, min(REST, d - own) + 1).astype(int))
    return [slice(i, i + 1) for i in range(own)] + [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def segment_statistics(x: np.ndarray, share: float) -> np.ndarray:
    """Means and deviations of each row's segments, scaled so that dot products of two rows bound their own.

    Over a segment of m entries, a.b = m mean(a) mean(b) + (a - mean(a)).(b - mean(b)), and the second term is at most
    m dev(a) dev(b). With |a|^2 and |b|^2 this is the lower bound on |a - b|^2 = |a|^2 + |b|^2 - 2 a.b. A segment of
    one entry has no deviation.
    """
    own = sum(1 for s in segments(x.shape[1], share) if s.stop - s.start == 1)
    parts = [x[:, s] for s in segments(x.shape[1], share) if s.stop - s.start > 1]
    singles = [x[:, s] for s in segments(x.shape[1], share) if s.stop - s.start == 1]
    scaled = [f(p) * np.sqrt(p.shape[1]) for f in (lambda p: p.mean(axis=1, keepdims=True), lambda p: p.std(axis=1, keepdims=True)) for p in parts]
    return np.concatenate([*singles, *scaled], axis=1) if own or parts else np.zeros((len(x), 0))


def rotation(x: np.ndarray) -> np.ndarray:
    """An orthogonal basis, which changes no inner product, in which the rows' energy is in the first entries."""
    return np.linalg.eigh(x.T @ x / max(1, len(x)))[1][:, ::-1]


def _sums_fit(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether doubles hold the inner products exactly."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53


def _exact(q: np.ndarray, x: np.ndarray, fit: bool) -> np.ndarray:
    """Integer inner products of paired rows."""
    if fit:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    made = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q.tolist(), x.tolist(), strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in made], np.int64)


def block_top(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, basis: np.ndarray | None = None, least: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows of a block, ties to smaller ids; a row isn't its own partner.

    Rows come in chunks: the bounds of each level leave out rows that can't reach a query's k-th best score so far, or
    ``least``, a score that k rows elsewhere reach; rows below that aren't returned. ``seen`` gets the pairs that every
    level leaves.
    """
    best_score = np.full((len(q), 0), 0, np.int64)
    best_id = np.full((len(q), 0), 0, np.int64)
    turned = (q, x) if basis is None else (q @ basis, x @ basis)
    levels = [tuple(segment_statistics(y, s) for y in turned) for s in LEVELS if int(s * x.shape[1])]
    # Rounding of the bounds is far below this part of the norms' product.
    slack = 1e-9 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1e-9
    least = np.full(len(q), -np.inf) if least is None else least
    fit = _sums_fit(q, x)
    for a in range(0, len(x), CHUNK):
        rows = slice(a, min(a + CHUNK, len(x)))
        alive = ids[rows][None, :] != query_ids[:, None]
        left = [int(alive.sum())]
        floor = (np.maximum(least, best_score[:, k - 1]) if best_score.shape[1] >= k else least)[:, None] - slack[:, rows]
        for sq, sx in levels:
            if not left[-1] or not np.isfinite(floor).any():
                break
            alive &= sq @ sx[rows].T >= floor
            left.append(int(alive.sum()))
        if seen is not None:
            seen.append(left)
        i, j = np.nonzero(alive)
        if not len(i):
            continue
        if fit and len(i) >= DENSE * alive.size:
            found = (q @ x[rows].T)[i, j].astype(np.int64)
        else:
            found = np.concatenate([_exact(q[i[b : b + (1 << 16)]], x[rows][j[b : b + (1 << 16)]], fit) for b in range(0, len(i), 1 << 16)])
        keep = found >= least[i]
        i, j, found = i[keep], j[keep], found[keep]
        if not len(i):
            continue
        width = np.bincount(i, minlength=len(q)).max()
        score = np.full((len(q), width), np.iinfo(np.int64).min, np.int64)
        other = np.full((len(q), width), np.iinfo(np.int64).max, np.int64)
        place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i]
        score[i, place], other[i, place] = found, ids[rows][j]
        score, other = np.concatenate((best_score, score), axis=1), np.concatenate((best_id, other), axis=1)
        by = _by_score(score, other)[:, :k]
        best_score, best_id = np.take_along_axis(score, by, 1), np.take_along_axis(other, by, 1)
    i, j = np.nonzero(best_id != np.iinfo(np.int64).max)
    return query_ids[i], best_id[i, j], best_score[i, j]


def _by_score(score: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Order of each row's columns: score descending, then id ascending, absent ones last."""
    first = np.argsort(other, axis=1, kind="stable")
    falling = ~np.take_along_axis(score, first, 1)  # ~x = -x - 1 never overflows
    return np.take_along_axis(first, np.argsort(falling, axis=1, kind="stable"), 1)


def _floors(seeds, k: int):
    """Each query with its k-th best score among the sample; -infinity where there are fewer."""

    def make(batch: pa.RecordBatch) -> dict:
        dims, ids, vectors = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("vector").to_pylist()
        floor = np.full(len(ids), -np.inf)
        for d in np.unique(dims).tolist():
            if d in seeds.value:
                rows = np.flatnonzero(dims == d)
                basis, own, x = seeds.value[d]
                q = stacked([vectors[i] for i in rows], d)
                if _sums_fit(q, x) and len(own) > k:
                    for a in range(0, len(rows), CHUNK):
                        some = rows[a : a + CHUNK]
                        score = np.where(own[None, :] == ids[some][:, None], -np.inf, q[a : a + CHUNK] @ x.T)
                        floor[some] = np.partition(score, -k, axis=1)[:, -k]
        return {x: batch.column(x) for x in ("vec_id", "dim", "vector")} | {"floor": floor}

    return make


def _pair_tasks(seeds, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        d = rows.column("dim")[0].as_py()
        x, q = (stacked(t.column("vector").to_pylist(), d) for t in (rows, queries))
        ids, of = (t.column("vec_id").to_numpy() for t in (rows, queries))
        made = block_top(of, q, ids, x, k, seeds.value[d][0] if d in seeds.value else None, queries.column("floor").to_numpy())
        return pa.Table.from_arrays([pa.array(m, pa.int64()) for m in made], schema=schema)

    return run


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` its k best other rows.

    Vectors become floor(scale * x); the score is their integer inner product, ties go to the smaller vec_id, and a
    query with fewer candidates gets all. Vectors that are null, empty or hold null or non-finite components, and rows
    with a null vec_id, take no part. Vectors of different lengths aren't compared. Rows repeating a vec_id are
    candidates once each and a query once, by the smallest vector. Scores beyond 64 bits saturate.

    A sample of at most SEED_ROWS rows (SEED numbers) gives a rotation that moves energy to the first entries, and each
    query a floor: the k-th best score in the sample. Neither changes a result. Row blocks of bounded size then meet
    query blocks of bounded size in one task each; a query's best of each block are ranked once more. Only the sample is
    broadcast.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.save(packed(table, lambda x: np.floor(scale * x)), "vectors")
    widest = rows.agg(F.coalesce(F.max("dim"), F.lit(1))).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(max(1, min(SEED_ROWS, SEED // widest))).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r)
    made = {d: (stacked([r["vector"] for r in some], d), np.array([r["vec_id"] for r in some], np.int64)) for d, some in by_dim.items()}
    seeds = spark.sparkContext.broadcast({d: (rotation(x), ids, x) for d, (x, ids) in made.items()})
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("x")).select("vec_id", "x.dim", "x.vector")
    queries = scratch.save(map_arrow(queries, "vec_id long, dim int, vector binary, floor double", _floors(seeds, k), None), "queries")
    row_blocks, query_blocks = (max(1, -(-t.count() * widest // size)) for t, size in ((rows, ROW_BLOCK), (queries, QUERY_BLOCK)))
    rows = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(row_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    keys = ("dim", "rb", "qb")
    near = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_pair_tasks(seeds, k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
