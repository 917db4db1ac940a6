"""Small cases of operators whose rules the tables don't tell apart."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import vector
from millrace.operators import chat, dedup, evaluate, pack, recurrence, tokenizer
from millrace.sources import files


def test_greedy_keeps_what_a_dropped_row_would_drop(spark):
    nodes = spark.range(1, 5).withColumnRenamed("id", "doc_id")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert dict(dedup.greedy_kept(nodes, edges).collect()) == {1: True, 2: False, 3: True, 4: True}


def test_greedy_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    kept = []
    for i in range(60):
        if not any((j, i) in set(pairs) for j in kept):
            kept.append(i)
    nodes = spark.range(60).withColumnRenamed("id", "doc_id")
    got = dedup.greedy_kept(nodes, spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r.doc_id for r in got.collect() if r.kept) == kept


def test_minima_are_exact():
    import numpy as np

    a, b = dedup.family(16)
    hashes = [random.Random(1).getrandbits(32) for _ in range(300)]
    want = [min(((x * h + y) % dedup.PRIME) & dedup.MAX_HASH for h in hashes) for x, y in zip(a, b, strict=True)]
    assert dedup._minima(np.array(hashes, dtype=np.uint64), np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)).tolist() == want
    assert dedup._minima(np.array([], dtype=np.uint64), np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)).tolist() == [dedup.MAX_HASH] * 16


def test_registered_near_duplicates(spark, tmp_path):
    from millrace.plans import corpus

    rng, rows, copies = random.Random(5), [], set()
    for i in range(60):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
        near = [*words[:100], "changed", *words[101:]]  # Jaccard 0.95
        far = [*words[:152], *[f"v{rng.randint(0, 10**9)}" for _ in range(48)]]  # Jaccard 0.61
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
        copies.add(3 * i + 1)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus.QUERIES["near_dups_greedy"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if not r.kept} == copies


def test_funnel_drops_near_duplicates_by_default(spark):
    from millrace.operators import mix

    rng, rows = random.Random(7), []
    for i in range(40):
        words = [f"word{rng.randint(0, 10**9)}" for _ in range(200)]
        near = [*words[:183], *[f"other{rng.randint(0, 10**9)}" for _ in range(17)]]  # Jaccard 0.84
        rows += [(2 * i + j, "def f():\n" + "\n".join(" ".join(w[k : k + 5]) for k in range(0, 200, 5)), "en") for j, w in enumerate((words, near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, "nothing of these")], "item_id long, text string")
    defaults = {(r.doc_id, r.stage) for r in mix.funnel(docs, bench).collect()}
    assert defaults == {(r.doc_id, r.stage) for r in mix.funnel(docs, bench, num_perm=128, bands=16).collect()}
    assert sum(s == "dedup_filtered" for _, s in defaults) >= 30


@pytest.mark.parametrize("sizes", [[3, 3], [4], [9, 0, 2], [1] * 20])
def test_packing_equals_the_sequential_rule(spark, sizes):
    rows = [(i, [i * 100 + j for j in range(n)]) for i, n in enumerate(sizes)]
    flat = [x for _, ids in rows if ids for x in [*ids, 0]]
    want = [flat[i : i + 5] for i in range(0, len(flat) - 4, 5)]
    got = pack.packed(spark.createDataFrame(rows, "doc_id int, ids array<int>"), 4).orderBy("chunk").collect()
    assert [r.input_ids for r in got] == [w[:-1] for w in want] and [r.targets for r in got] == [w[1:] for w in want]


def test_repository_packs_flush_before_a_large_file(spark):
    rows = [("r", "a", "x" * 10), ("r", "b", "y" * 500), ("r", "c", "z" * 10), ("r", "d", "w" * 10)]
    made = pack.repository_packs(spark.createDataFrame(rows, "repo string, path string, content string"), "repo", "path", "content", 100, 3.0)
    got = [(r.n_files, r.text) for r in made.orderBy("pack").collect()]
    assert [n for n, _ in got] == [1, 1, 2]
    assert got[1][1].count("y") == 300 - 100 - len("<|file_sep|>b\n")
    assert got[2][1].startswith("<|repo_name|>r\n<|file_sep|>c\n")


def test_four_shapes_of_conversations(spark, tmp_path):
    lines = [
        '{"messages": [{"role": "user", "content": "q"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}], "system": "s"}',
        '{"instruction": "q", "response": "a"}',
        '{"problem": "q", "solution": "a"}',
        '{"other": 1}',
        "not json",
    ]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines))
    got = chat.parsed(files.sft_records(spark, str(path))).select("system", F.size("chat_messages").alias("n")).collect()
    assert sorted((r.n, r.system == "s") for r in got) == [(1, False), (2, False), (2, False), (2, True)]


def test_targets_and_dpo_labels(spark):
    row = spark.createDataFrame([([5, 6, 7, 8], [False, True, False, True], "ab", "cd")], "ids array<int>, m array<boolean>, p string, r string")
    got = row.select(chat.targets(F.col("ids"), F.col("m")), chat.dpo_pair(F.col("p"), F.col("r"), 5)).first()
    assert got[0] == [6, -1, 8]
    assert got[1].input_ids == [1, 97, 98, 99] and got[1].labels == [-1, -1, -1, 100]  # the wrapped prompt less one


@pytest.mark.parametrize(("x", "want"), [(449.0, 448.0), (0.0, 0.0), (1.0625, 1.0), (1.1875, 1.25), (2.0**-10, 0.0), (2.0**-9, 2.0**-9), (-300.0, -288.0)])
def test_e4m3(spark, x, want):
    assert spark.range(1).select(vector.e4m3(F.lit(x))).first()[0] == want


@pytest.mark.parametrize("nf4", [False, True])
def test_residual_beats_plain_fp8(spark, nf4):
    rng = random.Random(0)
    frame = spark.createDataFrame([([rng.gauss(0, 1) for _ in range(64)],), ([0.0] * 64,)], "x array<double>")
    q = frame.withColumn("q", vector.residual_quantize(F.col("x"), nf4=nf4))
    snr = q.select(vector.snr_db(F.col("x"), vector.residual_dequantize(F.col("q"), nf4=nf4)), vector.snr_db(F.col("x"), vector.fp8_cast(F.col("x")))).collect()
    assert snr[0][0] > snr[0][1] > 20 and snr[1][0] is None


def test_alignment_escalates(spark):
    frame = spark.createDataFrame([(1, i, -1.0) for i in range(12)], "k int, i int, v double")
    made = recurrence.alignment(frame, "k", ["i"], "v", 0.0, -0.1, 2, 3, 100, 200).orderBy("i").collect()
    assert [r.action for r in made][:6] == ["", "reset", "", "reset", "", "reset"]
    made = recurrence.alignment(frame, "k", ["i"], "v", 0.0, -0.1, 4, 99, 3, 2).orderBy("i").collect()
    assert [r.action for r in made] == ["", "", "highway", "", "plain", "", "", "", "", "", "", ""]


def test_spike_starts_quarantine(spark):
    frame = spark.createDataFrame([(1, i, 100.0 if i in (5, 60) else 1.0) for i in range(64)], "k int, i int, v double")
    got = {r.i: (r.corrupt, r.quarantine) for r in recurrence.spike_quarantine(frame, "k", ["i"], "v").collect()}
    assert got[5] == (True, 0) and got[60][0] and got[60][1] == 97 and got[61] == (False, 96)


def test_merges_and_round_trip(spark):
    docs = spark.createDataFrame([(1, "low lower lowest, naïve 12"), (2, ""), (3, None)], "doc_id int, text string")
    merges = tokenizer.learn_merges(tokenizer.pretoken_counts(docs), 10)
    assert merges[:2] == [(b"l", b"o"), (b"lo", b"w")] or merges[0] in {(b"l", b"o"), (b"o", b"w")}
    back = dict(tokenizer.decode(tokenizer.encode(docs, merges), merges).collect())
    assert back == {1: "low lower lowest, naïve 12", 2: "", 3: ""}


def test_execution_is_opt_in(spark):
    frame = spark.createDataFrame([("assert 1 + 1 == 2",), ("assert False",)], "program string")
    with pytest.raises(PermissionError):
        evaluate.executed(frame)
    assert [r.passed for r in evaluate.executed(frame, allow=True).collect()] == [True, False]


def test_files_and_token_tables(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/b.bin").write_text("no")
    (tmp_path / "src/node_modules/c.js").write_text("no")
    assert [r.path for r in files.repository(spark, f"{tmp_path}/src").collect()] == ["a.py"]
    assert files.local_files(spark, f"{tmp_path}/src").count() == 2
    tokens = spark.createDataFrame([(1, 0, 2, [1, 300])], files.TOKENS_SCHEMA)
    files.write_tokens(tokens, f"{tmp_path}/out", {"source": "test"})
    assert files.read_tokens(spark, f"{tmp_path}/out").first().ids == [1, 300]
    assert bytes(files.packed_uint16(tokens).first().bytes) == b"\x01\x00\x2c\x01"


def test_null_texts_have_no_ngrams(spark):
    from millrace.operators import decontam, dedup

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([("x y",)], "text string")
    assert {r.doc_id: r.ngrams for r in decontam.flags(docs, bench).collect()} == {1: 0, 2: 0, 3: 1}
    signed = dedup.signed(docs.select("doc_id", dedup.shingle_hashes(F.col("text")).alias("h")), num_perm=4)
    assert {r.doc_id: set(r.signature) == {dedup.MAX_HASH} for r in signed.collect()} == {1: True, 2: True, 3: False}


def test_mix_keeps_rows_without_a_language(spark):
    from millrace.operators import mix

    docs = spark.createDataFrame([(i, None if i % 3 == 0 else "en") for i in range(30)], "doc_id long, lang string")
    assert sorted(r.position for r in mix.mix_order(docs, {"en": 0.5}).collect()) == list(range(30))


def test_merges_of_spread_pieces(spark, monkeypatch):
    from millrace.operators import tokenizer

    counts = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3), ("aaaa", 4), ("née", 2)], "piece string, n long")
    want = tokenizer.learn_merges(counts, 9)
    monkeypatch.setattr(tokenizer, "PRETOKENS_ON_DRIVER", 3)
    monkeypatch.setattr(tokenizer, "WRITE_EVERY", 4)
    assert tokenizer.learn_merges(counts, 9) == want and len(want) == 9


def test_long_series_and_part_blocks(spark):
    from millrace.functions import vector
    from millrace.operators import recurrence

    log = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("x"))
    got, e = [r.ema for r in recurrence.ema(log, "k", ["step"], "x", 0.9).orderBy("step").collect()], None
    for i in range(1000):
        e = float(i % 7) if e is None else 0.9 * e + (1 - 0.9) * (i % 7)
        assert abs(got[i] - e) < 1e-9
    row = spark.range(1).select(F.size(vector.blocks(F.sequence(F.lit(1), F.lit(65)), 32)).alias("n")).first()
    assert row.n == 3


def test_contamination_is_a_row_for_each_row_with_and_without_broadcast(spark, monkeypatch):
    from millrace.operators import decontam

    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, item), (1, "of this " * 20), (1, None), (None, item), (2, item + " twelve")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(item,), (item,), (None,)], "text string")
    want = sorted([(1, 2, 2, True), (1, 2, 0, False), (1, 0, 0, False), (None, 2, 2, True), (2, 3, 2, True)], key=str)
    for bound in (decontam.BROADCAST_NGRAMS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_NGRAMS", bound)
        assert sorted(map(tuple, decontam.flags(docs, bench).collect()), key=str) == want
