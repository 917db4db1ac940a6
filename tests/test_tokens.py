"""Token runs that are cut, killed, replayed and streamed against one run, and against plain loops."""

import math
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from millrace.functions.hashing import u01
from millrace.functions.text import words
from millrace.operators import mix
from millrace.streaming import tokens

WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


def lengths(rows):
    """Word lengths as ids: a sample without words has none."""
    return rows.withColumn("ids", F.transform(words(F.col("text")), F.length))


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame([(1000, None, "en"), (1001, "", "en"), (1002, "words of no language at all", None), (None, "no id", "en")], "doc_id long, text string, lang string")
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").unionByName(extra)


def index(spark, path):
    return sorted((r.position, r.key, r.offset, r.length, tuple(r.ids)) for r in tokens.read(spark, path).collect())


def plain(spark, docs, budget=None):
    """The mix by a loop over the clocks' times, then running offsets."""
    rows = docs.where("doc_id is not null").select("doc_id", "lang", F.transform(words(F.col("text")), F.length).alias("ids"), u01(42, "mix", F.col("doc_id")).alias("u")).collect()
    clock, timed = {}, []
    for r in sorted(rows, key=lambda r: (str(r.lang), r.doc_id)):
        clock[r.lang] = clock.get(r.lang, 0.0) - math.log1p(-r.u) / WEIGHTS.get(r.lang, mix.OTHER_WEIGHT)
        timed.append((clock[r.lang], r.doc_id, tuple(r.ids or ())))
    out, offset = [], 0
    for position, (_, key, ids) in enumerate(sorted(timed)):
        if ids and (budget is None or offset < budget):
            out.append((position, key, offset, len(ids), ids))
            offset += len(ids)
    return out


def test_one_run_is_the_plain_mix(spark, docs, tmp_path):
    done = tokens.run(docs, f"{tmp_path}/a", lengths, WEIGHTS, take=1000)
    want = plain(spark, docs)
    assert index(spark, f"{tmp_path}/a") == want
    assert done == tokens.State(0, docs.count() - 1, len(want), want[-1][2] + want[-1][3], True)


def test_cut_runs_equal_one_run(spark, docs, tmp_path):
    path = f"{tmp_path}/b"
    first = tokens.run(docs, path, lengths, WEIGHTS, take=70, batches=1)
    assert (first.batch, first.raw, first.complete) == (0, 70, False)
    again = tokens.run(docs, path, lengths, WEIGHTS, take=50, batches=2)  # another size of batch
    assert (again.batch, again.raw) == (2, 170)
    done = tokens.run(docs, path, lengths, WEIGHTS, take=1000)
    assert done.complete and index(spark, path) == plain(spark, docs)
    assert tokens.run(docs, path, lengths, WEIGHTS) == done  # nothing is left
    used = {r.lang: r.rows for r in tokens.cursor(spark, path).where("batch = 3").collect()}
    assert used == {("-" if r.lang is None else f"+{r.lang}"): r["count"] for r in docs.where("doc_id is not null").groupBy("lang").count().collect()}


def test_budget_ends_with_the_sample_that_crosses_it(spark, docs, tmp_path):
    for take, path in ((1000, f"{tmp_path}/c"), (40, f"{tmp_path}/d")):
        done = tokens.run(docs, path, lengths, WEIGHTS, take=take, max_tokens=9000)
        assert index(spark, path) == plain(spark, docs, 9000) and done.complete and done.tokens >= 9000


def test_a_killed_batch_is_written_anew(spark, docs, tmp_path, monkeypatch):
    path = f"{tmp_path}/e"
    tokens.run(docs, path, lengths, WEIGHTS, take=60, batches=1)

    def dying(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        tokens.run(docs, path, dying, WEIGHTS, take=60)
    tokens.run(docs, path, lengths, WEIGHTS, take=60, batches=1)
    before = index(spark, path)
    shutil.rmtree(f"{path}/cursor/batch=1")  # died after the tokens, before the cursor
    assert len(index(spark, path)) < len(before)  # such a batch doesn't count
    tokens.run(docs, path, lengths, WEIGHTS, take=60, batches=1)
    assert index(spark, path) == before
    tokens.run(docs, path, lengths, WEIGHTS, take=1000)
    assert index(spark, path) == plain(spark, docs)


def test_near_duplicates_across_batches(spark, tmp_path):
    body = [f"sample {k} speaks of matter {k * 7} and of {k * 11} more and then of still other {k * 13} things" for k in range(8)]
    rows = [(i, (body[i % 8] + " with a long enough end that all of them share word for word " * 3) if i % 8 < 6 else " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tokens.run(docs, f"{tmp_path}/f", lengths, {"en": 1.0}, take=1000, similar=0.8)
    for take in (25,):
        tokens.run(docs, f"{tmp_path}/g{take}", lengths, {"en": 1.0}, take=take, similar=0.8)
        assert index(spark, f"{tmp_path}/g{take}") == index(spark, f"{tmp_path}/f")
    kept = index(spark, f"{tmp_path}/f")
    assert 17 <= len(kept) < 30 and [k for _, k, *_ in kept if k % 8 >= 6] == [i for i in range(64) if i % 8 >= 6]


def test_empty_table(spark, docs, tmp_path):
    done = tokens.run(docs.limit(0), f"{tmp_path}/h", lengths, WEIGHTS)
    assert done == tokens.State(0, 0, 0, 0, True) and index(spark, f"{tmp_path}/h") == []


def test_stream_is_written_once(spark, docs, tmp_path, monkeypatch):
    source, path, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    parts = docs.where("doc_id is not null").withColumn("part", F.floor(F.col("doc_id") / 101).cast("int"))
    for part in (0, 1):
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)

    def start():
        made = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        tokens.stream(made, path, checkpoint, lengths, max_tokens=60_000).awaitTermination()

    commit, calls = tokens._commit, []

    def dying(*args):
        calls.append(args[3])
        after = commit(*args)
        if calls == [0]:
            raise RuntimeError("lost after the cursor, before the query knew")
        return after

    monkeypatch.setattr(tokens, "_commit", dying)
    with pytest.raises(Exception, match="lost"):
        start()
    start()  # the first batch is handed over again
    assert calls == [0, 1]
    parts.where("part > 1").drop("part").coalesce(1).write.mode("append").parquet(source)
    start()
    got = index(spark, path)
    offset, want = 0, []
    for position, r in enumerate(lengths(docs.where("doc_id is not null")).orderBy("doc_id").collect()):
        if r.ids and offset < 60_000:
            want.append((position, r.doc_id, offset, len(r.ids), tuple(r.ids)))
            offset += len(r.ids)
    assert got == want and tokens.state(spark, path).batch == 2


def test_positions_of_the_streamed_query_are_those_of_its_sql_with_texts_without_words(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["one two", "", "three", None, " \t\n", "four five six", "　", "seven"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["streamed_tokens"](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(f"SELECT doc_id, position, \"offset\", length FROM ({entry.oracle_sql()['streamed_tokens']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and [w[1] for w in sorted(want)] == [0, 1, 2, 3]
