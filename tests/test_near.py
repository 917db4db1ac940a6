"""Greedy choice, stars and the stream of near-duplicates against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.streaming import near


def plain_greedy(nodes, edges, size=None):
    before, kept = {}, []
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    for n in sorted(nodes):
        if not before.get(n, set()) & set(kept if size is None else kept[-size:]):
            kept.append(n)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_by_a_plain_loop(spark, seed):
    draw = random.Random(seed)
    edges = {tuple(sorted(draw.sample(range(-50, 200), 2))) for _ in range((60, 300, 900)[seed])}
    edges |= {(i, i + 1) for i in range(100, 160)}
    nodes = spark.createDataFrame([(i,) for i in range(-50, 200)], "doc_id long")
    frame = spark.createDataFrame(sorted(edges), "a long, b long")
    for block in (dedup.BLOCK_EDGES, 40):
        got = sorted(r.doc_id for r in dedup.greedy_kept(nodes, frame, block=block).where("kept").collect())
        assert got == plain_greedy(range(-50, 200), edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    calls, plain = [], dedup._settled
    monkeypatch.setattr(dedup, "scratch", lambda s, f=dedup.scratch: calls.append(f(s)) or calls[-1])
    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    kept = dedup.greedy_kept(spark.range(100_001).withColumnRenamed("id", "doc_id"), chain, block=20_000)
    assert kept.where("kept").agg(F.count(F.lit(1)), F.sum("doc_id")).first() == (50_001, 2 * sum(range(50_001)))
    rounds = spark.read.parquet(calls[0]).agg(F.max("round")).first()[0] + 1
    assert rounds <= 12 and plain is dedup._settled


def test_greedy_of_text_keys(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert sorted(r.k for r in dedup.greedy_kept(nodes, edges, "k").where("kept").collect()) == ["a", "c"]


def signatures(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, signature array<bigint>")


def test_memberships_are_linear_and_hold_every_pair(spark):
    draw = random.Random(4)
    base = [[draw.randint(0, 3) for _ in range(32)] for _ in range(5)]
    rows = [(i, [v if draw.random() < 0.9 else draw.randint(0, 3) for v in base[i % 5]]) for i in range(60)]
    rows += [(100 + i, base[0]) for i in range(40)]
    marks = signatures(spark, rows)
    members = dedup.memberships(marks, bands=16)
    assert members.count() == 16 * len(rows)
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and any(x[k : k + 2] == y[k : k + 2] for k in range(0, 32, 2)))
    assert sorted(map(tuple, dedup.pairs_within(members).collect())) == want == sorted(map(tuple, dedup.candidate_pairs(marks).collect()))
    late = [p for p in want if p[1] >= 100]
    assert sorted(map(tuple, dedup.pairs_within(members, since=100).collect())) == late == sorted(map(tuple, dedup.candidate_pairs(marks, since=100).collect()))


def test_stars_settle_near_copies_without_their_pairs(spark):
    """Twenty thousand near-equal and as many equal rows: 4 * 10**8 candidate pairs, none of which is made."""
    n = 20_000
    odd = F.when(F.sequence(F.lit(0), F.lit(127))[0] == 0, F.col("id"))  # one of 128 places differs
    base = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.when(i == F.col("id") % 128, odd + 1000).otherwise(i.cast("long")))
    other = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (i + 7).cast("long"))
    marks = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, base).otherwise(other).alias("signature"))
    kept, left = dedup.settled_by_stars(marks)
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [0, n] and left.count() == 0


def test_stars_and_pairs_agree(spark):
    draw = random.Random(9)
    base = [[draw.randint(0, 1000) for _ in range(32)] for _ in range(6)]
    rows = [(i, [v if draw.random() < 0.93 else draw.randint(0, 1000) for v in base[draw.randint(0, 5)]]) for i in range(150)]
    alike = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / 32 >= 0.8
    share = lambda x, y: any(x[k : k + 2] == y[k : k + 2] for k in range(0, 32, 2))
    want = plain_greedy(range(150), [(a, b) for a, x in rows for b, y in rows if a < b and share(x, y) and alike(x, y)])
    marks = signatures(spark, rows)
    for pairs in (0, 500, 10**9):
        sure, left = dedup.settled_by_stars(marks, 0.8, pairs=pairs)
        rest = dedup.greedy_kept(left, dedup.similar_pairs(left, 0.8)).where("kept").select("doc_id")
        assert sorted(r.doc_id for r in sure.unionByName(rest).collect()) == want


def alike_texts(n):
    """Groups that near copies come from; with copies of them among texts of their own."""
    draw = random.Random(2)
    body = [[f"w{g}x{k}" for k in range(60)] for g in range(7)]
    out = []
    for i in range(n):
        words = list(body[draw.randint(0, 6)]) if i % 3 else [f"own{i}y{k}" for k in range(40)]
        if draw.random() < 0.5:
            words[-1] = f"end{i}"
        out.append((i, " ".join(words)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "two words")]


@pytest.mark.parametrize("size", [4, 1000])
def test_stream_equals_the_ring_also_after_a_restart(spark, tmp_path, size, monkeypatch):
    rows = alike_texts(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = dedup.signed(docs.select("doc_id", dedup.shingle_hashes(F.col("text")).alias("h")))
    want = sorted(r.doc_id for r in dedup.ring_kept(docs, dedup.similar_pairs(marks), size).where("kept").collect())
    edges = [tuple(r) for r in dedup.similar_pairs(marks).select("a", "b").collect()]
    assert want == plain_greedy([i for i, _ in rows], edges, size)
    source, path, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"

    def put(low, high):
        docs.where(F.col("doc_id").between(low, high)).coalesce(1).write.mode("append").parquet(source)

    def start():
        made = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        near.stream(made, path, checkpoint, size=size).awaitTermination()

    put(0, 24)
    start()
    put(25, 44)
    real = dedup.ring_kept
    monkeypatch.setattr(dedup, "ring_kept", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        start()
    monkeypatch.setattr(dedup, "ring_kept", real)
    start()
    put(45, 62)
    start()
    got = near.kept(spark, path).orderBy("rank").collect()
    assert [r.key for r in got] == want and [r["rank"] for r in got] == list(range(len(want)))
    near.add_batch(docs, 1, path, size=size)  # handed over again
    assert near.kept(spark, path).count() == len(want)
