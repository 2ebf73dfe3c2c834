"""Tables, scratch storage and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of text that a vectorised step holds at once (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch while a table is saved: rows hold whole documents.
ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Saved tables of at most so many bytes are broadcast; larger ones are shuffled.
LIGHT_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written below the cluster's shared checkpoint folder.

    Writing a table cuts lineage, survives lost executors and gives the next plan exact sizes.
    """

    def __init__(self, spark: SparkSession, what: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or LOCAL_CHECKPOINTS
        self.spark, self.root, self.count = spark, f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        conf = self.spark.conf
        before = conf.get(ARROW)
        conf.set(ARROW, min(ARROW_ROWS, int(before) if int(before) > 0 else ARROW_ROWS))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(ARROW, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out.light = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength() <= LIGHT_BYTES
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                if self.root.split(":")[-1].lstrip("/") in folder:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(conf).delete(path, True)


def light(table: DataFrame, *columns: str) -> DataFrame:
    """A saved table, or columns of it, as the side of a join: broadcast if its size, measured when saved, allows it."""
    out = table.select(*columns) if columns else table
    return F.broadcast(out) if getattr(table, "light", False) else out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_sizes(text: pa.Array) -> np.ndarray:
    """Bytes of each text (or binary value); 0 for null."""
    return pc.binary_length(text).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def text_buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 (one more than rows) and the UTF-8 bytes; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that memory doesn't follow Arrow's row count."""
    for batch in batches:
        ends = np.cumsum(text_sizes(batch.column(batch.schema.get_field_index(column))) + 64)
        a = 0
        while a < batch.num_rows:
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(a, b - a)
            a = b


def arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def map_arrow(df: DataFrame, schema: str | StructType, make: Callable[[pa.RecordBatch], dict | pa.RecordBatch], column: str | None = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of ``limit`` bytes of text; ``make`` returns the output's columns, or a whole batch."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit) if column else batches:
            made = make(part)
            yield made if isinstance(made, pa.RecordBatch) else pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, made[f.name]) for f in out)], schema=out)

    return df.mapInArrow(run, schema)


def whole_documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, don't travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
