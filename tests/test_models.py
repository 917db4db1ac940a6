"""Logits, number formats, tokenizer files and checks, rings, composed datasets: small cases by plain code."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import schedule, vector
from millrace.operators import dedup, evaluate, metrics, mix, tokenizer
from millrace.sources import files
from millrace.streaming import monitor


def merges_by_hand(counts, merges):
    parts = {p: [bytes([b]) for b in p.encode()] for p in counts}
    made = []
    while len(made) < merges:
        totals = {}
        for p, n in counts.items():
            for pair in zip(parts[p], parts[p][1:], strict=False):
                totals[pair] = totals.get(pair, 0) + n
        best = min(totals, key=lambda x: (-totals[x], x), default=None)
        if best is None or totals[best] < 2:
            break
        made.append(best)
        for p in parts:
            out, i = [], 0
            while i < len(parts[p]):
                step = 2 if tuple(parts[p][i : i + 2]) == best else 1
                out.append(b"".join(parts[p][i : i + step]))
                i += step
            parts[p] = out
    return made


def test_merges_equal_a_plain_loop_to_the_end(spark):
    draw = random.Random(3)
    counts = {"".join(draw.choice("abcé ") for _ in range(draw.randint(1, 9))): draw.randint(1, 6) for _ in range(60)}
    counts["aaaaaaa"] = 5
    rows = spark.createDataFrame(list(counts.items()), "piece string, n long")
    assert tokenizer.learn_merges(rows, 10_000) == merges_by_hand(counts, 10_000)


def test_tokenizer_file_and_single_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(" return", 9), ("return", 8), ("->", 4), ("    ", 3)], "piece string, n long")
    merges = tokenizer.learn_merges(rows, 100)
    tokenizer.save(merges, str(tmp_path / "t.json"))
    assert tokenizer.load(str(tmp_path / "t.json")) == merges and len(list(tmp_path.iterdir())) == 1
    seen = {(r.kind, r.probe): (r.single, r.space_prefixed) for r in tokenizer.single_token_checks(spark, merges).collect()}
    assert seen["python", "return"] == (True, True) and seen["operator", "->"] == (True, False) and seen["go", "chan"] == (False, False)
    assert len(seen) == 3 + 9 + sum(map(len, tokenizer.KEYWORDS.values()))


def test_report_counts_texts_that_do_not_come_back(spark):
    docs = spark.createDataFrame([(1, "en", "one two"), (2, "en", None), (3, None, "")], "doc_id long, lang string, text string")
    out = tokenizer.report(spark, docs, []).first()
    assert (out.learned, out.bytes_per_token, out.roundtrip_failures) == (256, 1.0, 0)


def test_geometry_and_special_tokens(spark):
    schedule.checked_geometry()
    for wrong in ({"vocab": 49_153}, {"vocab": 49_089, "learned": 49_025}, {"code_share": 1.5}):
        with pytest.raises(ValueError):
            schedule.checked_geometry(**wrong)
    rows = [(f"t{i}", i) for i in range(127)]
    assert schedule.checked_vocabulary(spark.createDataFrame([*rows, ("<|eos|>", 49_090)], "token string, token_id int")).count() == 128
    with pytest.raises(ValueError):
        schedule.checked_vocabulary(spark.createDataFrame([*rows, ("<|eos|>", 5)], "token string, token_id int"))
    with pytest.raises(ValueError):
        schedule.checked_vocabulary(spark.createDataFrame(rows, "token string, token_id int"))


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_ring_equals_a_plain_loop(spark, size):
    draw = random.Random(size)
    edges = {(a, b) for a in range(40) for b in range(a + 1, 40) if draw.random() < 0.12}
    ring, want = [], {}
    for n in range(40):
        want[n] = not any((m, n) in edges for m in ring)
        if want[n]:
            ring = [*ring, n][-size:]
    nodes = spark.range(40).select(F.col("id").alias("doc_id"))
    got = dedup.ring_kept(nodes, spark.createDataFrame(sorted(edges), "a long, b long"), size)
    assert {r.doc_id: r.kept for r in got.collect()} == want


def test_stochastic_rounding_is_unbiased_and_keeps_grid_values(spark):
    made = spark.range(4000).select(vector.stochastic_e4m3(F.lit(1.03), vector.u01(1, "t", F.col("id"))).alias("y"), vector.stochastic_e4m3(F.lit(-1.125), F.lit(0.0)).alias("g"))
    ys = [r.y for r in made.collect()]
    assert set(ys) == {1.0, 1.125} and abs(np.mean(ys) - 1.03) < 0.005
    assert made.first().g == -1.125


def test_sampling(spark):
    rows = spark.createDataFrame([([0.0, 5.0, 1.0], u) for u in (0.0, 0.5, 0.999999)], "x array<double>, u double")
    pick = lambda **how: [r[0] for r in rows.select(vector.sampled_token(F.col("x"), F.col("u"), **how)).collect()]
    assert pick(temperature=0.0) == [1, 1, 1] and pick(k=1) == [1, 1, 1]
    assert pick(temperature=50.0, p=1.0) == [0, 1, 2]
    assert pick(temperature=50.0, k=2, p=1.0) == [1, 1, 2]


def test_losses_without_targets(spark):
    rows = spark.createDataFrame([([0.0, 0.0],)], "x array<double>")
    out = rows.agg(vector.masked_loss(vector.softmax_loss(F.col("x"), F.lit(-1))).alias("l"), vector.z_loss(F.col("x"), 1.0).alias("z")).first()
    assert out.l == 0.0 and abs(out.z - math.log(2) ** 2) < 1e-12


def test_low_rank(spark):
    x = np.random.default_rng(0).normal(size=(6, 4))
    rows = spark.createDataFrame([(1, x.ravel().tolist()), (2, [1.0, 2.0, 3.0])], "id long, x array<double>")
    got = {r.id: r for r in metrics.restored(metrics.low_rank(rows, "id", "x", 4, 0.5), 4).collect()}
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert got[1]["rank"] == 2 and np.allclose(np.array(got[1].x).reshape(6, 4), (u[:, :2] * s[:2]) @ vt[:2])
    assert got[2]["rank"] == 0 and got[2].x == [1.0, 2.0, 3.0]


def test_flat_tokens(spark, tmp_path):
    np.array([5, 6, 60_000, 7], dtype="<u2").tofile(tmp_path / "tokens.bin")
    np.save(tmp_path / "index.npy", np.array([[0, 3], [3, 1]], dtype=np.int64))
    assert [(r.row, r.offset, r.ids) for r in files.flat_tokens(spark, str(tmp_path)).orderBy("row").collect()] == [(0, 0, [5, 6, 60_000]), (1, 3, [7])]
    np.save(tmp_path / "index.npy", np.zeros((2, 3), dtype=np.int64))
    with pytest.raises(ValueError):
        files.flat_tokens(spark, str(tmp_path))
    np.save(tmp_path / "index.npy", np.zeros(0, dtype=np.int64))
    assert files.flat_tokens(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        files.flat_tokens(spark, str(tmp_path / "none"))


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0.5)], "k int, problems long, pass_at_k double")
    out = evaluate.harness({"code": lambda: rows}, ["code", "unknown"], str(tmp_path / "eval"))
    assert list(out["benchmarks"]) == ["code"] and out["benchmarks"]["code"]["metrics"] == {"pass@1": 0.5}
    assert json.loads(next((tmp_path / "eval").iterdir()).read_text())["benchmarks"] == out["benchmarks"]
    for _ in range(2):
        files.append_metrics(rows, str(tmp_path / "m"))
        files.write_results(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2 and spark.read.json(str(tmp_path / "r")).count() == 1


def test_metric_lines(spark, tmp_path):
    rows = "event_id long, value double"
    spark.createDataFrame([(1, 0.5), (2, 1.5)], rows).write.parquet(str(tmp_path / "in"))
    stream = monitor.events(spark, str(tmp_path / "in"), rows)
    for _ in range(2):
        monitor.metric_lines(stream, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.schema(rows).json(str(tmp_path / "out")).count() == 2


def test_python_rows_are_judged_by_their_syntax_as_well(spark):
    good = "# adds\ndef add(first, second):\n    total = first + second  # both\n    return total\n"
    rows = [(1, "python", good), (2, "python", good.replace("):", ")")), (3, "go", good.replace("):", ")")), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    stages = lambda t: {r.doc_id: r.stage for r in mix.funnel(docs, bench, threshold=t, similar=1.1, fim_rate=0.0).collect()}
    from millrace.functions.quality import quality_score
    from millrace.functions.syntax import syntax_of
    from millrace.functions.text import preprocessed

    code = docs.select("doc_id", "lang", preprocessed(F.col("text")).alias("c")).withColumn("s", syntax_of(F.col("c"), F.col("lang")))
    score = {r.doc_id: r.q for r in code.withColumn("q", quality_score(F.col("c"), F.col("lang"), F.col("s"))).collect()}
    assert score[1] > score[2] and score[3] > score[2] and score[4] == 0.0
    assert stages((score[2] + score[3]) / 2) == {1: "passed", 2: "quality_filtered", 3: "passed", 4: "quality_filtered"}
