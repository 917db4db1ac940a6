"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()
_OWN = f"operators-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    except Exception:  # the session may be gone by then
        pass


def scratch(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which goes when Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = (shared or "file:///tmp/checkpoints/millrace").rstrip("/") + f"/{_OWN}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table that is written once and read again: lineage is cut and lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
