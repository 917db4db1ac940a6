"""Helpers shared by the operators of this subpackage: tables, scratch space, Arrow slicing."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on this machine alone (tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints/millrace"
#: Rows of one Arrow batch of texts.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN = f"run-{uuid.uuid4().hex}"
_MADE: set[str] = set()
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a
    folder of its own and a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (shared or LOCAL_SCRATCH).rstrip("/") + f"/{_OWN}"


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    except Exception:  # the session may be gone; the folder is then left to the cluster's own cleaning
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut, lost executors cost nothing.

    Its schema is passed to the reader, so an empty result stays readable. The folder goes when Python ends.
    """
    spark = df.sparkSession
    root = scratch_root(spark)
    if root not in _MADE:
        _MADE.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def discard(*frames: DataFrame) -> None:
    """Takes away tables that `stored` wrote, after their last reader: anything that still reads them fails."""
    for frame in frames:
        _, path = _PATHS.pop(id(frame))
        _remove(frame.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, where the session has Spark's default: long texts by the ten thousand take
    hundreds of megabytes outside the heap."""
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4) == 2


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, index: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most max_bytes of the named (or numbered) text column each, one row at least.

    Python objects of one part are alive at a time, so long texts don't add up in a worker.
    """
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column) if index is None else index)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)), dtype=np.int64)
        start, before = 0, 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            before, start = int(ends[stop - 1]), stop
