"""Token tables that are written batch by batch, survive a killed writer and are taken up where they ended.

A run is a folder: `tokens/batch=N` (ids with their offsets), `kept/batch=N` (signatures of kept samples, with near-
duplicate removal) and `cursor/batch=N` (how far each language is, and the totals). The cursor is written last, as one
file: a batch counts only with its cursor, and one without is written anew, over what a killed writer left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import u01
from millrace.operators import dedup, mix
from millrace.operators.pack import ordered_positions
from millrace.operators.storage import written

Encode = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class State:
    """The last committed batch: its number (-1 before the first), totals, and whether there is nothing left to do."""

    batch: int = -1
    raw: int = 0
    samples: int = 0
    tokens: int = 0
    complete: bool = False


def there(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def cursor(spark: SparkSession, path: str) -> DataFrame | None:
    """One row for each committed batch and language: batch, lang, rows and last_key and clock (of all batches so far),
    raw, samples, tokens, complete; None before the first batch."""
    return spark.read.parquet(f"{path}/cursor") if there(spark, f"{path}/cursor") else None


def state(spark: SparkSession, path: str) -> State:
    table = cursor(spark, path)
    last = table.orderBy(F.desc("batch")).select("batch", "raw", "samples", "tokens", "complete").first() if table is not None else None
    return State(*last) if last else State()


def read(spark: SparkSession, path: str) -> DataFrame:
    """batch, key, position, offset, length, ids of all committed batches."""
    done = cursor(spark, path)
    if done is None:
        raise FileNotFoundError(f"no committed batch in {path}")
    return spark.read.parquet(f"{path}/tokens").join(F.broadcast(done.select("batch").distinct()), "batch", "left_semi")  # one row a batch


def _commit(rows: DataFrame, path: str, before: State, batch: int, raw: int, max_tokens: int | None, languages: DataFrame, ended: bool) -> State:
    """Writes rows (key, position, ids) as a batch behind `before`: samples without tokens go, the one that crosses the
    budget is the last. `languages` has lang, rows, last_key, clock.

    Rows are written before anything is asked of their ids: a filter on these would go below the join with the batch's
    samples and encode every text there is. Behind the budget's last position no ids are joined."""
    spark = rows.sparkSession
    sized = written(rows).withColumn("length", F.size("ids").cast("long")).where(F.col("length") > 0)
    placed = ordered_positions(sized.select("position", "length"), "position", "length").withColumn("offset", F.col("start") + before.tokens).drop("start")
    if max_tokens is not None:
        placed = written(placed.where(F.col("offset") < max_tokens))
        last = placed.agg(F.coalesce(F.max("position"), F.lit(-1))).first()[0]
        sized = sized.where(F.col("position") <= last)
    out = sized.drop("length").join(placed, "position")
    out.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").parquet(f"{path}/tokens/batch={batch}")
    made = spark.read.schema(out.schema).parquet(f"{path}/tokens/batch={batch}").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    after = State(batch, before.raw + raw, before.samples + made[0], before.tokens + made[1], ended or (max_tokens is not None and before.tokens + made[1] >= max_tokens))
    totals = {"raw": after.raw, "samples": after.samples, "tokens": after.tokens}
    marked = languages.withColumns({k: F.lit(v).cast("long") for k, v in totals.items()}).withColumn("complete", F.lit(after.complete))
    marked.coalesce(1).write.mode("overwrite").parquet(f"{path}/cursor/batch={batch}")  # a row a language; one file, so all or nothing
    return after


def _named(lang: str) -> Column:
    return F.when(F.col(lang).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(lang).cast("string")))


def _next(docs: DataFrame, past: DataFrame | None, take: int, weights: dict[str, float], seed: int, key: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """The next `take` samples of the weighted mix behind what languages have used up (key, __of, position), and how far
    each language is then. A language's samples are a run of its keys, so what is used up is pruned by key."""
    rest = docs.where(F.col(key).isNotNull()).select(key, F.col(lang).alias("__lang"), _named(lang).alias("__of"))
    if past is not None:
        used = F.broadcast(past.select(F.col("lang").alias("__of"), "last_key", "clock", "rows"))  # a row a language
        rest = rest.join(used, "__of", "left").where(F.col("last_key").isNull() | (F.col(key) > F.col("last_key")))
        rest = rest.withColumns({"clock": F.coalesce("clock", F.lit(0.0)), "rows": F.coalesce("rows", F.lit(0)).cast("long")})
    else:
        rest = rest.withColumns({"clock": F.lit(0.0), "rows": F.lit(0).cast("long")})
    gap = -F.log1p(-u01(seed, "mix", F.col(key))) / mix.weight_of(F.col("__lang"), weights)
    timed = mix.clocks(rest.withColumn("gap", gap), "__of", key, "gap").withColumn("time", F.col("clock") + F.col("time")).withColumn("one", F.lit(1))
    chosen = written(ordered_positions(timed, ["time", key], "one").where(F.col("start") < take).select(key, "__of", "time", "rows", F.col("start").alias("position")))
    now = chosen.groupBy(F.col("__of").alias("lang")).agg((F.max("rows") + F.count(F.lit(1))).alias("rows"), F.max(key).alias("last_key"), F.max("time").alias("clock"))
    if past is not None:
        now = now.unionByName(past.select("lang", "rows", "last_key", "clock").join(now, "lang", "left_anti"))
    return chosen, now


def _unlike(samples: DataFrame, path: str, batch: int, base: int, threshold: float, text: str) -> DataFrame:
    """The samples that are like no kept one before them, in this batch or in one before; their signatures are written."""
    spark = samples.sparkSession
    hashed = samples.select(F.col("position").alias("at"), dedup.shingle_hashes(F.col(text)).alias("h"))
    fresh = written(dedup.signed(hashed, "h", "at"))
    old = spark.read.parquet(f"{path}/kept").where(F.col("batch") < batch).drop("batch") if there(spark, f"{path}/kept") else fresh.limit(0)
    edges = written(dedup.similar_pairs(old.unionByName(fresh), threshold, "at").where(F.col("b") >= base))
    gone = edges.where(F.col("a") < base).select(F.col("b").alias("at")).distinct()
    inner = edges.where(F.col("a") >= base)
    for side in ("a", "b"):
        inner = inner.join(gone.withColumnRenamed("at", side), side, "left_anti")
    kept = written(dedup.greedy_kept(fresh.join(gone, "at", "left_anti"), inner, "at").where("kept").select("at"))
    fresh.join(kept, "at", "left_semi").write.mode("overwrite").parquet(f"{path}/kept/batch={batch}")
    return samples.join(kept.withColumnRenamed("at", "position"), "position", "left_semi")


def run(docs: DataFrame, path: str, encode: Encode, weights: dict[str, float], take: int = 1_000_000, max_tokens: int | None = None, batches: int | None = None, seed: int = 42, key: str = "doc_id", lang: str = "lang", text: str = "text", similar: float | None = None) -> State:
    """Writes the samples of a weighted mix as tokens, `take` raw samples a batch, from where the last run ended.

    encode takes the batch's rows (all columns of docs, and position) and returns them with `ids`, without those that it
    filters. With `similar`, samples like a kept one before them go, across batches too. It ends with the budget, with
    the samples, or after so many batches; a run that is complete does nothing. However a run is cut into calls, the
    rows and offsets are those of one call. Keys are unique within a language; rows without a key are not taken, a null
    language is one of its own, samples without tokens have no row, an empty table makes a complete run of no rows.
    """
    spark, made = docs.sparkSession, 0
    at = state(spark, path)
    while not at.complete and (batches is None or made < batches):
        table = cursor(spark, path)
        past = written(table.where(F.col("batch") == at.batch).drop("batch")) if table is not None else None
        chosen, languages = _next(docs, past, take, weights, seed, key, lang)
        raw = chosen.count()
        samples = docs.withColumn("__of", _named(lang)).join(chosen.select(key, "__of", (F.col("position") + at.raw).alias("position")), [key, "__of"]).drop("__of")
        batch = at.batch + 1
        if similar is not None:
            samples = _unlike(written(samples), path, batch, at.raw, similar, text)
        rows = encode(samples).select(F.col(key).alias("key"), "position", "ids")
        at = _commit(rows, path, at, batch, raw, max_tokens, languages, raw < take)
        made += 1
    return at


def stream(samples: DataFrame, path: str, checkpoint: str, encode: Encode, max_tokens: int | None = None, key: str = "doc_id"):
    """A streaming query that writes its batches as tokens in order of key, exactly once, and stops with what there is.

    A batch that is handed over again, after its commit or a death before it, changes nothing: its number names its
    folders, and its offsets follow from the batches before it. After the budget, batches are empty.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = cursor(spark, path)
        if done is not None and done.where(F.col("batch") == number).limit(1).count():
            return
        before = state(spark, path)
        numbered = batch.where(F.col(key).isNotNull()).withColumn("__tie", F.xxhash64(*batch.columns)).withColumn("__one", F.lit(1))
        rows = ordered_positions(numbered, [key, "__tie"], "__one").withColumn("position", F.col("start") + before.raw).drop("start", "__tie", "__one")
        raw = rows.count()
        where = spark.createDataFrame([("", before.raw + raw, None, None)], "lang string, rows long, last_key string, clock double")
        _commit(encode(rows).select(F.col(key).alias("key"), "position", "ids"), path, before, number, raw, max_tokens, where, False)

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
