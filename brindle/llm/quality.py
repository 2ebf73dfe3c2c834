"""Document quality: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, whole_documents
from .hashing import U64, Words, grams, mix, span_hashes

#: Labelled rows the model is fitted on at most, chosen by a hash of doc_id; hashed dimensions; passes over the rows.
SAMPLE, DIMENSIONS, EPOCHS = 6000, 1 << 18, 4
#: Rates and penalties of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Kinds of bytes in a word's shape: capitals, other letters (and bytes from 128 on), digits, others as they are.
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 65, 97, 97, 48


_KIND_SALT = mix(np.arange(1, 8, dtype=U64))


def shapes(words: Words) -> np.ndarray:
    """Hash of each word's shape: runs of one kind of byte count once."""
    kind = KIND[words.data]
    if not len(words.start):
        return np.zeros(0, U64)
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.start] = True
    place = np.cumsum(keep) - 1
    return span_hashes(kind[keep], place[words.start], place[words.end - 1] + 1)


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, value) of hashed n-grams: words and word pairs, shapes, their pairs and triples, repetitions.

    A row's values are the square roots of shares, so a row has about unit length whatever the text's length.
    """
    w = Words(text, lower=True)
    h, s, rows = w.hashes(), shapes(Words(text)), len(w.first) - 1
    parts, where = [], []
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    for k, (x, n) in enumerate(((h, 1), (h, 2), (s, 1), (s, 2), (s, 3), (mix(again.astype(U64)), 1), (mix(again.astype(U64)), 3))):
        g = grams(x, n)
        inside = w.row[: len(g)] == w.row[n - 1 :] if len(g) else np.zeros(0, bool)
        parts.append((mix(g + _KIND_SALT[k]) % U64(DIMENSIONS)).astype(np.int64)[inside])
        where.append(w.row[: len(g)][inside])
    key = np.sort(np.concatenate(where) * DIMENSIONS + np.concatenate(parts))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    row, dim = np.divmod(key[first], DIMENSIONS)
    total = np.bincount(row, weights=count, minlength=rows)
    return row, dim, np.sqrt(count / total[row])


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, dims: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(dims)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        sigma = (np.sqrt(self.n[dims] + g * g) - np.sqrt(self.n[dims])) / ALPHA
        self.z[dims] += g - sigma * w
        self.n[dims] += g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for batch in slices(batches):
        row, dim, value = features(batch.column("text"))
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for i, (key, label) in enumerate(zip(batch.column("place").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            at = slice(ends[i], ends[i + 1])
            # The last dimension is the intercept.
            rows.append((key, np.append(dim[at], DIMENSIONS).astype(np.int32), np.append(value[at], 1.0).astype(np.float32), label))
    rows.sort(key=lambda r: r[0])
    model = Ftrl()
    for epoch in range(EPOCHS):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)).tolist():
            _, dim, value, label = rows[i]
            model.learn(dim, value.astype(np.float64), label)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def training_fold(doc_id) -> object:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 3, isn't 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights (the last is the intercept) learnt from at most SAMPLE labelled rows of the training fold.

    Labels other than 0 and 1 are left out; of several labels of one id the smallest counts. The sample is chosen by
    a hash of doc_id and read by one task; all weights are 0 without labelled rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & training_fold(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy("place", "doc_id").limit(SAMPLE)
    rows = docs.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).select("place", "label", "text")
    found = rows.coalesce(1).mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros(DIMENSIONS + 1, np.float32)


def scores(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text."""
    row, dim, value = features(text)
    margin = np.bincount(row, weights=weights[dim] * value, minlength=len(text)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    ``score`` is the probability of label 1 from the text alone; null and empty texts have the intercept's.
    ``held_out`` rows (and those with a null doc_id, which have no label) are never learnt from. Repeated rows are
    scored alike.
    """
    docs = whole_documents(docs)
    weights = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, labels)))

    def make(batch: pa.RecordBatch) -> dict:
        score = scores(batch.column("text"), pickle.loads(weights.value))
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    scored = map_arrow(docs, "doc_id long, score double, predicted int", make)
    held = F.coalesce(~training_fold(F.col("doc_id")), F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted 0, each judged by its own text, also where doc_ids are null or repeated."""
    fitted = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(whole_documents(docs), labels)))
    names = docs.columns
    renamed = docs.toDF(*(c if c == "text" else f"column_{i}" for i, c in enumerate(names)))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scores(batch.column("text"), pickle.loads(fitted.value)) >= 0.5))

    return map_arrow(renamed, renamed.schema, make).toDF(*names)
