"""Composed datasets: samples through their operators to packed sequences."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import preprocessed
from millrace.operators import mix, pack

#: A table (key, order..., text) becomes one with `ids`, other columns kept.
Encode = Callable[[DataFrame], DataFrame]


def code_sequences(files: DataFrame, encode: Encode, length: int = 2048, eos: int = 49_090, fim_rate: float = 0.5, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """chunk, input_ids, targets of files in order of key: preprocessing, fill-in-the-middle, tokens, packing.

    No quality, duplicate or contamination filter; see mixed_sequences for those.
    """
    code = files.select(key, preprocessed(F.col(text)).alias("text")).where(F.col("text").isNotNull())
    made = code.select(key, mix.fim_sample(F.col("text"), fim_rate, seed, F.col(key)).alias("text"))
    return pack.packed(encode(made), length, key, eos=eos)


def mixed_sequences(docs: DataFrame, benchmark: DataFrame, weights: dict[str, float], encode: Encode, length: int = 2048, eos: int = 49_090, seed: int = 42, key: str = "doc_id", lang: str = "lang", **funnel) -> DataFrame:
    """chunk, input_ids, targets of documents that pass the funnel, in the weighted order of their languages."""
    passed = mix.funnel(docs, benchmark, seed=seed, key=key, lang=lang, **funnel).where(F.col("stage") == mix.STAGES[-1])
    passed = mix.written(passed.select(key, lang, F.col("code").alias("text"), F.monotonically_increasing_id().alias("__row")))
    order = mix.mix_order(passed, weights, seed, key, lang, keep=("__row",)).select("__row", "position")  # rows of one key are several
    return pack.packed(encode(passed.join(order, "__row").drop("__row")), length, "position", eos=eos)


@dataclass(frozen=True)
class Settings:
    """What a corpus run is set up with, checked as it is made; it drives the funnel and the packed sequences.

    Weights name languages and need not sum to one; thresholds and rates are shares from 0 to 1.
    """

    language_weights: dict[str, float] = field(default_factory=lambda: dict(mix.LANGUAGE_WEIGHTS))
    quality_threshold: float = 0.3
    dedup_threshold: float = 0.8
    fim_rate: float = 0.5
    seed: int = 42
    max_seq_len: int = 2048
    eos_id: int = 49_090

    def __post_init__(self):
        if not self.language_weights or any(not isinstance(w, int | float) or isinstance(w, bool) or w <= 0 for w in self.language_weights.values()):
            raise ValueError("language_weights: every weight is a number above 0, and there is one at least")
        for name in ("quality_threshold", "dedup_threshold", "fim_rate"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is a share from 0 to 1")
        if self.max_seq_len < 1:
            raise ValueError("max_seq_len is 1 at least")

    @classmethod
    def of(cls, data: dict) -> Settings:
        """Settings of a mapping; what it doesn't name has its default, what nobody knows is an error."""
        if unknown := sorted(set(data) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**data)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        """Settings of a JSON file's `data` (of the whole file if it has none), on any file system that Spark reads."""
        data = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls.of(data.get("data", data))

    def funnel(self, docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
        return mix.funnel(docs, benchmark, self.quality_threshold, self.dedup_threshold, seed=self.seed, fim_rate=self.fim_rate, **names)

    def sequences(self, docs: DataFrame, benchmark: DataFrame, encode: Encode, **names) -> DataFrame:
        how = {"threshold": self.quality_threshold, "similar": self.dedup_threshold, "fim_rate": self.fim_rate}
        return mixed_sequences(docs, benchmark, self.language_weights, encode, self.max_seq_len, self.eos_id, self.seed, **how, **names)
