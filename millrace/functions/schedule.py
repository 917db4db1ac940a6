"""Closed forms over steps and sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Vocabulary geometry.
VOCAB_SIZE, BPE_SIZE, SPECIALS = 49_152, 49_088, 64
ALIGNMENT_FACTORS = (16, 32, 64, 128, 256, 512, 1024)
SPECIAL_TOKENS = {
    "<|pad|>": 49_088, "<|bos|>": 49_089, "<|eos|>": 49_090, "<|unk|>": 49_091,
    "<|fim_prefix|>": 49_100, "<|fim_middle|>": 49_101, "<|fim_suffix|>": 49_102, "<|fim_pad|>": 49_103,
    "<|repo_name|>": 49_110, "<|file_sep|>": 49_111, "<|im_start|>": 49_120, "<|im_end|>": 49_121,
    "<|code_start|>": 49_130, "<|code_end|>": 49_131,
}


def cosine_lr(step: Column, warmup: int, total: int, least: float = 0.1) -> Column:
    """Share of the peak rate: linear warm-up, then a cosine whose progress is not clamped."""
    progress = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, step / max(1, warmup)).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(progress * math.pi)))


def wsd_lr(step: Column, warmup: int, stable: int, decay: int, least: float = 0.1, linear: bool = False) -> Column:
    """Warm-up, stable, decay; progress is clamped at 1."""
    flat = (step < warmup + stable) | F.lit(decay <= 0)
    progress = F.least((step - warmup - stable) / max(1, decay), F.lit(1.0))
    shape = 1 - progress if linear else 0.5 * (1 + F.cos(progress * math.pi))
    return F.when(step < warmup, step / max(1, warmup)).when(flat, 1.0).otherwise(least + (1 - least) * shape)


def wave(step: Column, wave_steps: int = 500, recovery: int = 100, waves: int = 5) -> dict[str, Column]:
    """aggression, abd, srr of the wave and recovery curriculum."""
    place = step % (wave_steps + recovery)
    over = F.floor(step / (wave_steps + recovery)) >= waves
    a = F.when(over, 1.0).when(place >= wave_steps, 0.0).otherwise(place / max(wave_steps - 1, 1))
    return {"aggression": a, "abd": over | (a >= 0.5), "srr": over | (a >= 0.8)}


def alignment(size: Column) -> dict[str, Column]:
    """Divisibility of a vocabulary size and the waste of its last tile."""
    left = size % 128
    out = {f"by_{f}": size % f == 0 for f in ALIGNMENT_FACTORS}
    return out | {"waste_128": (128 - left) % 128, "tiles_128": F.floor(size / 128), "peak": (size % 16 == 0) & (size % 32 == 0) & (left == 0)}


def suggested_size(merges: Column, specials: int = SPECIALS) -> Column:
    """The next multiple of 256."""
    return F.floor((merges + specials + 255) / 256) * 256


def special_table(spark: SparkSession, learned: int = BPE_SIZE) -> DataFrame:
    """token_id, token for all ids from `learned` on: names where there are, else reserved ones."""
    names = F.create_map(*[F.lit(x) for t, i in SPECIAL_TOKENS.items() for x in (i, t)])
    ids = spark.range(learned, VOCAB_SIZE).select(F.col("id").cast("int").alias("token_id"))
    return ids.select("token_id", F.coalesce(names[F.col("token_id")], F.concat(F.lit("<|reserved_"), F.col("token_id").cast("string"), F.lit("|>"))).alias("token"))


def checked_geometry(vocab: int = VOCAB_SIZE, learned: int = BPE_SIZE, specials: int = SPECIALS, code_share: float = 0.7, tile: int = 128) -> None:
    """An error unless the sizes add up, fill whole tiles, and the share of code is one."""
    if vocab != learned + specials:
        raise ValueError(f"{vocab} tokens are not {learned} learned and {specials} special ones")
    if vocab % tile:
        raise ValueError(f"{vocab} tokens do not fill tiles of {tile}")
    if not 0.0 <= code_share <= 1.0:
        raise ValueError(f"the share of code must lie in [0, 1], not {code_share}")


def vocabulary_report(vocab: DataFrame, tile: int = 128) -> DataFrame:
    """size, aligned, misplaced, missing of a table (token, token_id): special tokens that are elsewhere, or nowhere."""
    spark = vocab.sparkSession
    wanted = spark.createDataFrame(list(SPECIAL_TOKENS.items()), "token string, __at int")
    found = wanted.join(vocab, "token", "left")
    placed = found.agg(F.count(F.when(F.col("token_id") != F.col("__at"), 1)).alias("misplaced"), F.count(F.when(F.col("token_id").isNull(), 1)).alias("missing"))
    sizes = vocab.agg(F.count(F.lit(1)).alias("size")).withColumn("aligned", F.col("size") % tile == 0)
    return sizes.crossJoin(placed)  # one row each


def checked_vocabulary(vocab: DataFrame, tile: int = 128) -> DataFrame:
    """vocab, or an error if its size isn't aligned or a special token has another id. A missing one is no error."""
    report = vocabulary_report(vocab, tile).first()
    if not report.aligned:
        raise ValueError(f"{report['size']} tokens do not fill tiles of {tile}")
    if report.misplaced:
        raise ValueError(f"{report.misplaced} special tokens have other ids")
    return vocab


# Weights of a preset's flags.
DIFFICULTY = {
    "disable_error_feedback": 0.40, "force_global_scale": 0.20, "promote_sensitivity_tier": 0.20,
    "halve_abd_hysteresis": 0.10, "verbose_gemm": 0.05, "disable_monitoring": 0.05,
}


def difficulty(flags: dict[str, Column]) -> Column:
    """Sum of the weights of the flags that are set."""
    total = F.lit(0.0)
    for name, weight in DIFFICULTY.items():
        total = total + F.when(flags[name], weight).otherwise(0.0)
    return total


def tier_for_step(step: Column, full_every: int, ef_every: int) -> Column:
    return F.when(step % full_every == 0, 2).when(step % ef_every == 0, 1).otherwise(0)


def highway(index: Column, every: int = 4) -> Column:
    return index % every == 0
