"""Aggregations over evaluation results, weights and configurations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vector import snr_db


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product of k shares; 1 if fewer than k failed."""
    shares = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (n - c - i).cast("double") / (n - i))
    return F.when(n - c < k, 1.0).otherwise(1.0 - F.aggregate(shares, F.lit(1.0), lambda a, x: a * x))


def per_problem(outcomes: DataFrame, task: str = "task_id", passed: str = "passed") -> DataFrame:
    return outcomes.groupBy(task).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(passed).cast("int")).alias("passed"))


def pass_at_k_table(outcomes: DataFrame, ks: tuple[int, ...] = (1, 10, 100), task: str = "task_id", passed: str = "passed") -> DataFrame:
    """k, problems, pass_at_k: means over problems of k samples at least; a k without any has no row."""
    tallies = per_problem(outcomes, task, passed)
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("total") >= k, pass_at_k(F.col("total"), F.col("passed"), k)).alias("p")) for k in ks]))
    return tallies.select(cases.alias("x")).where("x.p is not null").groupBy(F.col("x.k").alias("k")).agg(F.count(F.lit(1)).alias("problems"), F.avg("x.p").alias("pass_at_k"))


def excess_kurtosis(values: DataFrame, key: str, value: str) -> DataFrame:
    """mean((x-m)^4) / var^2 - 3 with the sample variance; null where it is under 1e-12."""
    moments = values.groupBy(key).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    return values.join(moments, key).groupBy(key).agg(F.when(F.first("v") >= 1e-12, F.avg(F.pow(F.col(value) - F.col("m"), F.lit(4.0))) / F.pow(F.first("v"), F.lit(2.0)) - 3).alias("kurtosis"))


def global_norm(norms: DataFrame, value: str) -> DataFrame:
    """Norm of the finite norms."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return norms.where(finite).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"), F.count(F.lit(1)).alias("parameters"))


def layer_magnitudes(values: DataFrame, layer: str, value: str) -> DataFrame:
    """Greatest and mean of the layers' mean |x|."""
    return values.groupBy(layer).agg(F.avg(F.abs(value)).alias("m")).agg(F.max("m").alias("max_mean_abs"), F.avg("m").alias("avg_mean_abs"))


def eval_loss(losses: DataFrame, order: str, value: str, batches: int = 50) -> DataFrame:
    """Mean of the first batches; infinity without any."""
    first = losses.orderBy(order).limit(batches)
    return first.agg(F.coalesce(F.avg(value), F.lit(float("inf"))).alias("eval_loss"))


def index_percentile(values: DataFrame, value: str, p: float) -> DataFrame:
    """The value at place min(int(p * n), n - 1) of the sorted ones: no interpolation."""
    from millrace.operators.pack import ordered_positions

    placed = ordered_positions(values.select(value).where(F.col(value).isNotNull()).withColumn("one", F.lit(1)), value, "one")
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    return placed.join(F.broadcast(n), F.col("start") == F.least(F.floor(F.col("n") * p), F.col("n") - 1)).select(F.lit(p).alias("p"), F.col(value).alias("cut"))  # n is one row


def throughput(log: DataFrame, series: str, order: str, clock: str, tokens: str, per_second: int = 1) -> DataFrame:
    """step_ms and tokens_per_sec between log lines of a series; the clock has `per_second` ticks a second.

    A clock of whole ticks is exact; seconds since 1970 as a double are good for a quarter of a microsecond only.
    """
    w = Window.partitionBy(series).orderBy(order)
    step = (F.col(clock) - F.lag(clock).over(w)) * 1000 / per_second
    return log.withColumns({"step_ms": step, "tokens_per_sec": F.when(step > 0, F.col(tokens) / (step / 1000))})


def newest(df: DataFrame, keep: int, step: str = "step", group: str | None = None) -> DataFrame:
    """The newest rows by step."""
    w = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    return df.withColumn("__r", F.row_number().over(w.orderBy(F.desc(step)))).where(F.col("__r") <= keep).drop("__r")


def latest_with(df: DataFrame, artifact: str, step: str = "step") -> DataFrame:
    """The latest step that has the artifact."""
    return df.where(F.col(artifact)).agg(F.max(step).alias("step"))


# Dim, layers, heads, key-value heads, width of the feed-forward part.
PRESETS = {"150m": (768, 12, 12, 4, 2.667), "350m": (1024, 24, 16, 4, 2.667), "1b": (2048, 24, 16, 8, 2.667), "3b": (3072, 26, 24, 8, 2.667)}


def parameter_count(dim: Column, layers: Column, heads: Column, kv_heads: Column, width: Column, vocab: int = 49_152) -> Column:
    """Embedding (tied with the output), grouped-query attention, gated feed-forward of a multiple of 64, norms."""
    head = F.floor(dim / heads)
    inner = F.floor((F.floor(dim * width) + 63) / 64) * 64
    return (vocab * dim + layers * (2 * dim * dim + 2 * dim * head * kv_heads + 3 * dim * inner + 2 * dim) + dim).cast("bigint")


def diagnose(layers: DataFrame, block: int = 32) -> DataFrame:
    """One row from (layer, weight, restored): eligible layers, bytes, savings, least and mean finite SNR, layers under 30 dB."""
    n = F.size("weight")
    eligible = (n % block == 0) & (n % 16 == 0)
    snr = F.when(eligible, snr_db(F.col("weight"), F.col("restored")))
    rows = layers.select(eligible.alias("ok"), n.alias("n"), snr.alias("snr"))
    finite = F.when(F.col("snr").isNotNull() & (F.col("snr") != float("inf")), F.col("snr"))
    before, after = F.sum(F.col("n") * 2), F.sum(F.when(F.col("ok"), F.col("n") * (12 + 16 / block) / 8).otherwise(F.col("n") * 2))
    return rows.agg(
        F.count(F.lit(1)).alias("layers"), F.sum(F.col("ok").cast("int")).alias("eligible"), before.alias("bytes_before"), after.alias("bytes_after"),
        (100.0 * (before - after) / before).alias("savings_percent"), F.min(finite).alias("min_snr"), F.avg(finite).alias("mean_snr"), F.sum(F.when(finite < 30, 1).otherwise(0)).alias("under_30_db"),
    )


def low_rank(buffers: DataFrame, key: str, values: str, columns: int, share: float = 0.1) -> DataFrame:
    """key, rank, u, s, vt: the leading singular triplets of each row's matrix (row by row in one array).

    The rank is `share` of the lesser side, 1 at least. An array that isn't whole rows of `columns` stays out, with rank
    0 and its values as `s`: a vector has no factors.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x in frame[values]:
                x = np.asarray(x, dtype=float)
                if len(x) % columns or len(x) < 2 * columns or columns < 2:
                    out.append((0, np.zeros(0), x, np.zeros(0)))
                    continue
                u, s, vt = np.linalg.svd(x.reshape(-1, columns), full_matrices=False)
                rank = max(1, int(min(len(x) // columns, columns) * share))
                out.append((rank, u[:, :rank].ravel(), s[:rank], vt[:rank].ravel()))
            yield pd.DataFrame({key: frame[key], **dict(zip(("rank", "u", "s", "vt"), map(list, zip(*out, strict=True)), strict=True))}) if out else pd.DataFrame(columns=[key, "rank", "u", "s", "vt"])

    return buffers.select(key, values).mapInPandas(run, f"`{key}` {dict(buffers.dtypes)[key]}, rank int, u array<double>, s array<double>, vt array<double>")


def restored(factors: DataFrame, columns: int) -> DataFrame:
    """factors with `x`: u * s * vt, row by row in one array; the values themselves at rank 0."""

    def cell(i: Column) -> Column:
        r, c = F.floor(i / columns).cast("int"), (i % columns).cast("int")
        terms = F.transform(F.sequence(F.lit(0), F.col("rank") - 1), lambda k: F.get("u", r * F.col("rank") + k) * F.get("s", k) * F.get("vt", k * columns + c))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    cells = F.transform(F.sequence(F.lit(0), (F.size("u") / F.col("rank") * columns).cast("int") - 1), cell)
    return factors.withColumn("x", F.when(F.col("rank") == 0, F.col("s")).otherwise(cells))
