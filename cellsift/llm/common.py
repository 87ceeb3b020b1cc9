"""What the operators share: scratch tables in the shared folder, text buffers, 64-bit mixing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cellsift

ROOT = Path(cellsift.__file__).resolve().parents[1]
# Python workers that run on this machine find the package where the driver found it; a cluster gets it with the job.
os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([*filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)), str(ROOT)]))
if SparkContext._active_spark_context is not None:
    SparkContext._active_spark_context.environment.setdefault("PYTHONPATH", str(ROOT))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where all runs on one machine and neither the session nor its configuration has one, a local folder is set."""
    sc = spark.sparkContext
    if (there := sc._jsc.sc().getCheckpointDir()).isDefined():
        return there.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="cellsift-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, outlives executors, is read by column. Removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that `written` gave, once nothing reads it any more. Other tables stay."""
    if path := getattr(df, "scratch", None):
        _remove(df.sparkSession, path)


def lean(run):
    """run, a function for mapInArrow, that gives what its batches took back to the machine when a task ends: workers live on, one beside the other."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def partitions(spark: SparkSession, *dfs: DataFrame) -> int:
    """Partitions for an exchange of whole texts' features: as many as the session shuffles to, or as the inputs have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), *(df.rdd.getNumPartitions() for df in dfs), 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, one after the other, and where each begins and ends. Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def spans(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes together; a longer text makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Rows whose features a worker holds at once: an executor has a few hundred MB for all its workers.
ROWS = 256


def filtered(df: DataFrame, columns: dict[str, str], decide) -> DataFrame:
    """The rows of df for which decide, given batches of some columns (cast to the named types), says so. One pass, no join."""
    n = len(df.columns)
    schema = df.schema
    asked = [F.col(f"`{c}`").cast(t).alias(f"__asked{k}") if c in df.columns else F.lit(None).cast(t).alias(f"__asked{k}") for k, (c, t) in enumerate(columns.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                part = whole.slice(k, ROWS)
                kept = pa.array(np.asarray(decide(*part.columns[n:]), bool))
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in part.columns[:n]], names=schema.names)

    return df.select("*", *asked).mapInArrow(lean(run), schema)
