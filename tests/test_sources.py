"""Token files, walks of files, tables by language, quotas with languages that are given up, and the Bloom filter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from millrace.operators import decontam, mix
from millrace.sources import files, token_files


def put(folder, samples, dtype=np.int64):
    lengths = np.array([len(s) for s in samples], dtype=dtype)
    np.array([t for s in samples for t in s], dtype="<u2").tofile(folder / "tokens.bin")
    np.save(folder / "index.npy", np.stack([np.cumsum(lengths) - lengths, lengths], axis=1).astype(dtype))


def test_token_files_by_partitions(spark, tmp_path):
    draw = random.Random(3)
    samples = [[draw.randint(0, 65_535) for _ in range(draw.randint(0, 40))] for _ in range(3000)]
    put(tmp_path, samples)
    total = sum(map(len, samples))
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        got = token_files.read(spark, folder, size=10_000)
        assert got.rdd.getNumPartitions() == -(-(3000 * 16 + total * 2) // 10_000)
        assert [r.ids for r in got.orderBy("row").collect()] == samples
    assert dict(got.dtypes) == {"row": "bigint", "offset": "bigint", "length": "bigint", "ids": "array<int>"}
    assert token_files.read(spark, str(tmp_path)).rdd.getNumPartitions() == 1


def test_columns_that_are_not_asked_for_are_not_read(spark, tmp_path):
    put(tmp_path, [[1, 2], [3]], np.int32)
    (tmp_path / "tokens.bin").write_bytes(b"")  # its tokens can't be read any more
    got = token_files.read(spark, str(tmp_path), ("length", "row"))
    assert [tuple(r) for r in got.orderBy("row").collect()] == [(2, 0), (1, 1)]
    assert [r.ids for r in token_files.read(spark, str(tmp_path)).orderBy("row").collect()] == [[], []]  # as slices beyond the end


def test_token_files_out_of_order(spark, tmp_path):
    np.arange(10, dtype="<u2").tofile(tmp_path / "tokens.bin")
    np.save(tmp_path / "index.npy", np.array([[6, 3], [0, 2], [2, 4], [8, 9], [3, 0]], dtype=np.int64))
    assert [r.ids for r in token_files.read(spark, str(tmp_path)).orderBy("row").collect()] == [[6, 7, 8], [0, 1], [2, 3, 4, 5], [8, 9], []]


def test_errors_of_token_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        token_files.read(spark, str(tmp_path))
    put(tmp_path, [[1]])
    np.save(tmp_path / "index.npy", np.zeros((2, 3), dtype=np.int64))
    with pytest.raises(ValueError, match="shape"):
        token_files.read(spark, str(tmp_path))
    np.save(tmp_path / "index.npy", np.zeros(0, dtype=np.int64))
    assert token_files.read(spark, str(tmp_path)).count() == 0


def test_named_files_have_any_suffix_and_walks_are_sorted(spark, tmp_path):
    for name in ("b/z.py", "b/a.py", "b/c/d.go", "b/no.bin", "named.xyz"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.local_files(spark, f"{tmp_path}/named.xyz", f"{tmp_path}/b").orderBy("position").collect()
    assert [r.content for r in got] == ["named.xyz", "b/a.py", "b/c/d.go", "b/z.py"] and [r.position for r in got] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        files.local_files(spark, f"{tmp_path}/none")


def test_languages_by_partition_and_by_fallback(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = f"{tmp_path}/by"
    files.write_by_language(docs, path)
    want = docs.where("lower(lang) IN ('fr', 'de') AND length(regexp_replace(text, '\\\\A\\\\s+|\\\\s+\\\\z', '')) > 50").groupBy("lang").count().collect()
    got = files.language_samples(spark, path, docs.limit(0), ["FR", "de", "none"])  # the fallback would give nothing
    assert sorted(got.groupBy("lang").count().collect()) == sorted(want) and len(want) == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__language" in plan.replace("__language#", "__language#") or "PartitionFilters: [__language" in plan
    other = files.language_samples(spark, f"{tmp_path}/none", docs, ["FR", "de", "none"])
    assert sorted(other.groupBy("lang").count().collect()) == sorted(want)
    empty = files.language_samples(spark, path, docs.withColumn("lang", F.lit("tlh")), ["tlh"])  # no such partition
    assert empty.count() == docs.where("length(regexp_replace(text, '\\\\A\\\\s+|\\\\s+\\\\z', '')) > 50").count()


def test_weights_prune_partitions_as_they_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    files.write_by_language(docs, f"{tmp_path}/by")
    weights = spark.createDataFrame([("fr", 0.5), ("en", 0.0)], "__language string, weight double").where("weight > 0")
    joined = spark.read.parquet(f"{tmp_path}/by").join(F.broadcast(weights), "__language")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString().lower()
    assert joined.count() == docs.where("lang = 'fr'").count()


def plain_quota(rows, weights, total, least, most_skips):
    out, by = [], {}
    for key, lang, text in sorted(rows, key=lambda r: r[0]):
        by.setdefault(lang, []).append((key, text))
    for lang, quota in mix.quotas(weights, total).items():
        turn = skips = 0
        for key, text in by.get(lang, []):
            if turn == quota:
                break
            if text is None or len(text.strip(" \n\t")) < least:
                skips += 1
                if skips >= most_skips:
                    break
                continue
            skips, turn = 0, turn + 1
            out.append((key, lang, turn))
    return sorted(out)


@pytest.mark.parametrize("most", [2, 3, 5])
def test_quota_by_a_plain_loop(spark, most):
    draw = random.Random(most)
    rows = [(i, draw.choice(["en", "fr", "de", None, "xx"]), draw.choice(["long enough text", "long enough text", "  short \n", None, ""])) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    weights = {"en": 0.5, "fr": 0.3, "de": 0.2}
    got = mix.quota_sample(frame, weights, 90, least=10, most_skips=most)
    assert sorted(map(tuple, got.collect())) == plain_quota(rows, weights, 90, 10, most)


def test_a_language_is_given_up_across_partitions(spark):
    """Ten thousand short rows in a row, which several ranges hold; one less isn't enough."""
    for run, want in ((10_000, 5), (9_999, 10)):
        text = F.when((F.col("id") < 5) | (F.col("id") >= 5 + run), F.lit("a text of more than fifty characters, so that it isn't skipped")).otherwise("short")
        rows = spark.range(5 + run + 5).repartition(8).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), text.alias("text"))
        got = mix.quota_sample(rows, {"en": 1.0}, 100)
        assert got.count() == want and got.agg(F.max("turn")).first()[0] == want


def test_contamination_beyond_the_broadcast(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "two words"), (0, "of a repeated id")], "doc_id long, text string"))
    want = sorted(map(tuple, decontam.flags(rows, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_NGRAMS", 1)
    assert sorted(map(tuple, decontam.flags(rows, bench).collect())) == want and any(r[3] for r in want)
    wanted = decontam.benchmark_ngrams(bench)
    own = docs.select("doc_id", decontam.ngram_set(F.col("text")).alias("gs"))
    passed = decontam.possible(own, wanted, ["doc_id"]).select(F.explode("gs").alias("g"))
    hits = own.select(F.explode("gs").alias("g")).join(wanted, "g", "left_semi").count()
    every = own.select(F.size("gs").alias("n")).agg(F.sum("n")).first()[0]
    assert hits <= passed.count() <= hits + every // 50  # what is joined is near the hits, not near the corpus


def test_a_full_bloom_filter_loses_nothing(spark, monkeypatch):
    wanted = spark.range(500).select(F.concat(F.lit("g"), F.col("id")).alias("g"))
    monkeypatch.setattr(decontam, "MOST_BITS", 64)
    rows = spark.createDataFrame([(1, ["g1", "x", "g499"]), (2, []), (3, None)], "doc_id long, gs array<string>")
    got = {r.doc_id: r.gs for r in decontam.possible(rows, wanted, ["doc_id"]).collect()}
    assert {"g1", "g499"} <= set(got[1]) and got[2] == [] and not got[3]
