"""What shows on larger tables only, on small ones that have the same trait."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from millrace.operators import decontam, dedup, pack, tokenizer
from millrace.plans import training
from millrace.streaming import tokens


def test_throughput_of_lines_a_microsecond_apart(spark, tmp_path):
    at = datetime(2024, 5, 1, tzinfo=UTC)
    rows = [(7, 1, at, 3.0), (7, 2, at + timedelta(microseconds=1), 2.0), (7, 3, at + timedelta(microseconds=4), 6.0), (7, 4, at, 1.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.step_ms, r.tokens_per_sec) for r in training.QUERIES["throughput"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, None), 2: (0.001, 2_000_000.0), 3: (0.003, 2_000_000.0), 4: (-0.004, None)}


def test_spread_merges_hold_few_pieces_on_the_driver(spark, monkeypatch):
    counts = tokenizer.written(tokenizer.pretoken_counts(spark.read.parquet(f"{SMALL}/documents.parquet")).where(F.col("n") > 1))
    want = tokenizer.learn_merges(counts, 1_500)
    runs, run = [], tokenizer.PieceRound.run
    monkeypatch.setattr(tokenizer.PieceRound, "run", lambda work, *a: runs.append((len(work.pieces), run(work, *a))) or runs[-1][1])
    for name, value in {"PRETOKENS_ON_DRIVER": 800, "PAIRS_ON_DRIVER": 1_200, "LEAST_HERE": 10}.items():
        monkeypatch.setattr(tokenizer, name, value)
    assert tokenizer.learn_merges(counts, 1_500) == want and len(want) == 1_500
    assert max(held for held, _ in runs) <= 2_400 < counts.count() and len(runs) < 40


def test_signatures_in_one_map_are_those_of_the_shingles(spark):
    texts = ["", " \n", None, "one", "a b c d", "a b c d e", "a  b\tc d e f", "été \U0001f600 x y z w " * 3, " ".join(f"w{i % 1700}" for i in range(5_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.signature for r in dedup.signed_texts(rows).collect()}
    hashes = rows.select("doc_id", dedup.shingle_hashes(F.col("text")).alias("h"))
    assert got == {r.doc_id: r.signature for r in dedup.signed(hashes).collect()}
    a, b = dedup.family()
    plain = lambda hs: [min(((x * h + y) % dedup.PRIME) & dedup.MAX_HASH for h in hs) if hs else dedup.MAX_HASH for x, y in zip(a, b, strict=True)]
    assert got == {r.doc_id: plain(r.h) for r in hashes.collect()}


def test_minima_at_the_ends_of_the_range():
    p = dedup.PRIME
    a, b = np.array([1, p - 1, p - 1, 2**32, p - 2**32], dtype=np.uint64), np.array([p - 1, p - 1, 0, p - 1, 1], dtype=np.uint64)
    for h in (0, 1, 2, 2**31, 2**32 - 1):
        want = [((int(x) * h + int(y)) % p) & dedup.MAX_HASH for x, y in zip(a, b, strict=True)]
        assert dedup._minima(np.array([h], dtype=np.uint64), a, b).tolist() == want


def test_packing_makes_each_row_once(spark):
    made = spark.sparkContext.accumulator(0)

    def encode(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, [i] * (i % 7)) for i in range(500)], "doc_id long, ids array<int>")
    assert pack.packed(rows.mapInArrow(encode, rows.schema), 4).count() == sum(i % 7 + 1 for i in range(500) if i % 7) // 5
    assert made.value == 500


@pytest.mark.parametrize("length", [1, 6, 30])
def test_packing_over_blocks_and_ranges(spark, monkeypatch, length):
    monkeypatch.setattr(pack, "LEAST_BLOCK", 1)
    rows = [(i, None if i % 11 == 5 else [i * 1_000 + j for j in range((i * 37) % 23 + 700 * (i % 13 == 4))]) for i in range(60)]
    flat = [x for _, ids in rows if ids for x in [*ids, 7]]
    want = [flat[i : i + length + 1] for i in range(0, len(flat) - length, length + 1)]
    frame = spark.createDataFrame(rows, "doc_id int, ids array<bigint>").repartition(5)
    got = pack.packed(frame, length, eos=7).orderBy("chunk").collect()
    assert [(r.chunk, r.input_ids, r.targets) for r in got] == [(i, w[:-1], w[1:]) for i, w in enumerate(want)]


def test_a_batch_encodes_its_own_samples_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def ids(text):
        made.add(1)
        return [len(w) for w in text.split()]

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text").where("text is not null")
    tokens.run(docs, str(tmp_path / "run"), lambda rows: rows.withColumn("ids", ids("text")), {"en": 1.0}, take=5, batches=1, max_tokens=100_000)
    assert made.value == 5 < docs.count()


def test_ngram_sets_in_one_map_are_those_of_the_expression(spark, monkeypatch):
    monkeypatch.setattr(decontam, "GRAMS_AT_ONCE", 7)
    texts = ["", " \n", None, "One", "a b c", "A  b\tc d", "a b a b a b a b", " été \U0001f600 x y z ", "w " * 40, " ".join(f"w{i % 17}" for i in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for n in (1, 3, 10):
        want = {r.doc_id: sorted(r.gs) for r in rows.select("doc_id", decontam.ngram_set(F.col("text"), n).alias("gs")).collect()}
        assert {r.doc_id: sorted(r.gs) for r in decontam.with_ngram_sets(rows, ["doc_id"], F.col("text"), n).collect()} == want
