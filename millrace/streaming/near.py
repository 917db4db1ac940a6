"""Near-duplicate removal of a stream: signatures of the last kept rows as state, in a table that survives restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.operators.pack import ordered_positions
from millrace.operators.storage import written
from millrace.streaming.tokens import there


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/cursor") if there(spark, f"{path}/cursor") else None


def kept(spark: SparkSession, path: str) -> DataFrame:
    """batch, key, at, rank of the kept rows of all committed batches: their places in the stream and among the kept."""
    done = _committed(spark, path)
    if done is None:
        raise FileNotFoundError(f"no committed batch in {path}")
    return spark.read.parquet(f"{path}/ring").join(F.broadcast(done.select("batch")), "batch", "left_semi").drop("signature")  # one row a batch


def add_batch(rows: DataFrame, number: int, path: str, size: int = 500_000, threshold: float = 0.8, key: str = "doc_id", text: str = "text", num_perm: int = 128, bands: int = 16) -> None:
    """Takes a batch in order of key: a row stays if it is like none of the last `size` kept rows before it.

    What stays is written with its signature, then the batch's totals as one file; a batch counts with its totals only,
    so one that is handed over again, or whose writer died, changes nothing. Of the state, the batches that the ring
    still reaches into are read; older ones are pruned by their number.
    """
    spark = rows.sparkSession
    done = _committed(spark, path)
    if done is not None and done.where(F.col("batch") == number).limit(1).count():
        return
    last = done.where(F.col("batch") < number).orderBy(F.desc("batch")).first() if done is not None else None
    seen, ranks = (last.seen, last.kept) if last else (0, 0)
    numbered = rows.withColumn("__tie", F.xxhash64(*rows.columns)).withColumn("__one", F.lit(1))
    placed = written(ordered_positions(numbered, [key, "__tie"], "__one").select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col("start") + seen).alias("at")))
    fresh = written(dedup.signed_texts(placed, "text", "at", num_perm))
    ring = fresh.limit(0)
    if last and ranks:
        reached = done.where((F.col("batch") < number) & (F.col("kept") > ranks - size)).agg(F.min("batch")).first()[0]
        ring = spark.read.parquet(f"{path}/ring").where(F.col("batch").between(reached, number - 1) & (F.col("rank") >= ranks - size)).select("at", "signature")
    both = written(ring.unionByName(fresh))
    edges = dedup.similar_pairs(both, threshold, "at", bands, since=seen).select("a", "b")
    stays = dedup.ring_kept(both.select("at"), edges, size, "at").where("kept").select("at").where(F.col("at") >= seen).withColumn("__one", F.lit(1))
    ranked = ordered_positions(stays, "at", "__one").select("at", (F.col("start") + ranks).alias("rank"))
    out = ranked.join(placed.select("key", "at"), "at").join(fresh, "at")
    out.write.mode("overwrite").parquet(f"{path}/ring/batch={number}")
    totals = spark.createDataFrame([(seen + placed.count(), ranks + ranked.count())], "seen long, kept long")
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/cursor/batch={number}")


def stream(samples: DataFrame, path: str, checkpoint: str, **how):
    """A streaming query that keeps what is unlike the last kept rows, and stops with what there is; it goes on from its
    checkpoint. Null and empty texts are alike, as all texts without words are."""
    write = lambda batch, number: add_batch(batch, number, path, **how)
    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
