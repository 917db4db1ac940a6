"""Sharding by rendezvous (highest random weight) hashing of stable record keys. Native expressions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: Rows of one slot-numbering task; its count of buckets follows from the table's row count.
ROWS_PER_BUCKET = 200_000
_UNIT = float(1 << 52)


def _scores(key: Column, weights: Sequence[float]) -> Column:
    """For each shard weight / -ln(u), where u in (0, 1) comes from 52 bits of md5(key:shard)."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    shards = F.array(*[F.struct(F.lit(str(i)).alias("name"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def score(shard: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), shard["name"]).cast("binary")), 1, 13), 16, 10).cast("double")
        return shard["weight"] / -F.log((bits + 0.5) / F.lit(_UNIT))

    return F.transform(shards, score)


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard", grown: tuple[str, float] | None = None) -> DataFrame:
    """df with the shard 0..len(weights)-1 of each row, whose score for the key is highest; the lowest of equal ones.

    Each shard's score depends on the key and that shard alone. So another shard at the end takes only the rows
    where it scores highest, and no row moves between the old ones. A null key acts as the text `null`.
    grown: a column for the shard if there were one more, and that one's weight. A projection without any shuffle.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and one at least")
    n, scores = len(weights), F.col("__scores")
    df = df.withColumn("__scores", _scores(F.col(key), [*weights, *([grown[1]] if grown else [])]))
    old = F.slice(scores, 1, n) if grown else scores
    df = df.withColumn(out, (F.array_position(old, F.array_max(old)) - 1).cast("int"))
    if grown:
        df = df.withColumn(grown[0], F.when(scores[n] > F.array_max(old), F.lit(n)).otherwise(F.col(out)).cast("int"))
    return df.drop("__scores")


def slots(df: DataFrame, shard: str, order: Sequence[str], rows: int, shards: int, out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard.

    Rows of a shard are dealt by a hash of `order` to buckets; a bucket is numbered in one task and begins where
    the buckets before it end. Only the counts, shards x buckets rows, meet in one place. rows: how many rows df
    has about, which sets the number of buckets. Rows that are equal in `order` are numbered in either way.
    """
    buckets = max(4, math.ceil(rows / max(1, shards) / ROWS_PER_BUCKET))
    dealt = df.withColumn("__bucket", F.pmod(F.crc32(F.coalesce(F.col(order[0]).cast("string"), F.lit("")).cast("binary")), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .select(F.col(shard).alias("__shard"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before.partitionBy(shard).orderBy("__bucket")), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy(shard, "__bucket").orderBy(*order)
    numbered = dealt.withColumn("__row", F.row_number().over(within) - 1)
    joined = numbered.join(starts, (F.col(shard) == F.col("__shard")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(out, F.col("__start") + F.col("__row")).drop("__bucket", "__row", "__shard", "__b", "__start")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: its shard under the `key` law, its slot there, and its shard if there were one more.

    size: UTF-8 bytes of the text and 16 (null: 16). text_crc32: of the text's bytes (null: 0). Repeated rows get
    a slot each. Null ids share one shard. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = stored(assign(out, "doc_id", [1.0] * shards, grown=("grown_shard", 1.0)), "shards")  # narrow, and used twice
    out = slots(out, "shard", ["doc_id", "text_crc32", "size"], out.count(), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
