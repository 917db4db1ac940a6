"""The pipeline against its stages done by brute force on a small table."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from conftest import SMALL
from millrace.llm import bpe, decontaminate, line_dedup
from millrace.llm.common import table
from test_llm_operators import brute_components, brute_leaks


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SMALL, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        out.append(docs.toPandas().sort_values("doc_id").reset_index(drop=True))
    return out


def test_columns_stay(spark, stages):
    assert all(list(s.columns) == table(spark, SMALL, "documents").columns for s in stages)


def test_language_stage_keeps_texts_with_letters(spark, stages):
    docs = table(spark, SMALL, "documents").toPandas()
    assert set(docs.doc_id) - set(stages[0].doc_id) <= set(docs.doc_id[~docs.text.str.contains(r"[^\W\d_]", regex=True)]) | set(docs.doc_id[docs.text.str.len() >= corpus_pipeline.LONG_ENOUGH])
    assert len(stages[0]) > 0.97 * len(docs)


def test_line_stage(stages):
    before, after = stages[:2]
    want = []
    for r in before.itertuples():
        peers = before[before.source == r.source]
        bad = lambda x, peers=peers: x.strip(" ") and (n := sum(x.strip(" ") in {y.strip(" ") for y in t.split("\n")} for t in peers.text)) >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * len(peers)
        want.append("\n".join(x for x in r.text.split("\n") if not bad(x)))
    assert list(after.text) == want and list(after.doc_id) == list(before.doc_id) and (after.n_chars == after.text.str.len()).all()


def test_near_duplicate_stage(stages):
    before, after = stages[1:3]
    want = {i for i, (n, c) in brute_components(list(zip(before.doc_id, before.text, strict=True))).items() if n == 0 or i == c}
    assert set(after.doc_id) == want and len(after) == len(want)


def test_decontamination_stage(spark, stages):
    before, after = stages[2:4]
    items = [(r.item_id, *decontaminate.split_item(r.text)) for r in table(spark, SMALL, "benchmark").collect()]
    leaks = {key for key, _ in brute_leaks(zip(before.doc_id, before.text, strict=True), items)}
    want = [i for i in before.doc_id if i not in leaks]
    assert list(after.doc_id) == want and len(want) < len(before)


def test_run(spark, stages):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(stages[-1].doc_id)
    coder = bpe.coder(bpe.public_model())
    for r in stages[-1].itertuples():
        ids = coder.encode(r.text)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_copies_of_a_third_of_a_source_stay_once(spark):
    body = "\n".join(f"line {k} of a text that many copies have" for k in range(6))
    rows = [(i, body if i % 3 == 0 else "\n".join([f"page {i} has words of its own, {i * 7919}", "Footer of the site", *(f"{i} {k} more {i * k}" for k in range(4))]), "en", "a", 0) for i in range(60)]
    rows += [(100 + i, "three copies\nin a small source of few rows", "en", "b", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.drop_boilerplate(spark, docs, SMALL)
    got = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, lines, SMALL).collect()}
    assert {i for i in got if i % 3 == 0 and i < 100} == {0} and got[0] == body
    assert got[100] == rows[60][1] and set(got) & {101, 102} == set()
    assert not any("Footer" in t for t in got.values()) and len(got) == 42


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one line of some text", None, None, 21), (3, "one line of some text", None, None, 21), (None, "an id that is null", "en", "a", 18), (4, "one line of some text", "en", "b", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 3]
    none = docs.limit(0)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0 and none.count() == 0


def test_rows_of_one_id_and_different_texts_stay(spark):
    a, b = "one text of seven words or so", "quite another text with nothing in common"
    rows = [(7, a, "en", "a", 0), (7, b, "en", "a", 0), (7, a, "en", "a", 0), (9, a, "en", "b", 0), (8, b + " there", "en", "b", 0), (7, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect())
    assert got == sorted([(7, a), (7, b), (8, b + " there"), (7, "")])


def test_clashing_columns_pass(spark):
    names = ["score", "lang_pred", "ambiguous", "margin", "__bad", "__host", "__kept", "__dropped", "__text", "cls", "n", "set_key", "first", "component_id", "__c0", "__known", "host"]
    rows = [(i, f"text {i} of a page\nwith words of its own like {i * i}", "en", "a", 0, *[f"{c}{i}" for c in names]) for i in range(6)]
    rows.append((3, "a repeated id\nof another text", "en", "a", 0, *[f"{c}9" for c in names]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    want = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        if stage is not corpus_pipeline.drop_boilerplate:
            assert docs.columns == want
    assert docs.count() == 7 and {r.score for r in docs.collect()} == {f"score{i}" for i in (0, 1, 2, 3, 4, 5, 9)}
    assert corpus_pipeline.byte_bpe(spark, docs, SMALL).count() == 7
