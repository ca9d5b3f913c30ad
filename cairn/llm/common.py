"""Shared plumbing of the training-data operators: inputs, durable intermediates, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is one step of its own.
STEP_BYTES = 1 << 20
STEP_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local master may go without; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are, below the shared folder."""
    return f"{shared_dir(spark)}/cairn/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, no lineage, survives lost executors.

    The table stays until drop() or clean(), as results may still be computed from it.
    """
    path = fresh_path(df.sparkSession, name)
    # written once and read by name: a marker file would only cost time
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table of materialize() that nothing is computed from any more."""
    folder = scratch_dir(table.sparkSession)
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/cairn/" in path and path.rsplit("/", 1)[0].endswith(folder.rsplit("/", 1)[1]):
            delete_path(table.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that weren't written are lost with them."""
    delete_path(spark, scratch_dir(spark))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def broadcast_if_few(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most most rows, which are counted first; else df, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder below the shared one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def open_store(uri: str):
    """(file system, path) for Python tasks that write or read ranges in the shared folder, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about step bytes of a string column, and rows rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + step, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def _lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
