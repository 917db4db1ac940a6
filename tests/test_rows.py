"""A row for each row: repeated ids with equal and with different texts neither multiply nor decide for each other."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions.quality import quality_score
from millrace.functions.syntax import syntax_of
from millrace.functions.text import preprocessed
from millrace.operators import datasets, decontam, dedup, mix, tokenizer

BODY = "def area(width, height):\n    # multiplies the sides\n    return width * height\n\n\ndef {0}(first, second):\n    total = first + second\n    # adds the {0} of both\n    return total\n"
OTHER = "class Store{0}:\n    # keeps names in order\n    def put(self, name):\n        self.names.append(name)\n\n    def newest_{0}(self):\n        return self.names[-1]\n"
TEST = "the first words of a test item that a text may hold, which are many enough to be found again"


def rows(spark):
    data = [
        (1, "python", BODY.format("alpha")), (1, "python", OTHER.format("beta")), (1, "python", BODY.format("alpha")), (2, "python", BODY.format("alpha")),
        (2, "python", None), (2, "python", OTHER.format("beta")), (3, "go", OTHER.format("gamma") + f"# {TEST}\n" * 4), (3, "go", BODY.format("delta") * 2), (None, "go", BODY.format("epsilon") * 3), (None, None, "x"),
    ]
    return spark.createDataFrame(data, "doc_id long, lang string, text string").repartition(3), data


def similar(a, b):
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    return len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))


def test_deduplicated_is_a_row_for_each_row(spark):
    frame, data = rows(spark)
    got = Counter(map(tuple, dedup.deduplicated(frame).collect()))
    assert sum(got.values()) == len(data) and Counter(k for k, _ in got.elements()) == Counter(r[0] for r in data)
    kept, texts = [], Counter()  # in order of id, one of each kind of text stays
    for key, _, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        if not any(similar(text or "", k) for k in kept):
            kept.append(text or "")
            texts[key] += 1
    assert Counter(k for k, stays in got.elements() if stays) == texts


def test_the_row_column_tells_rows_apart(spark):
    frame, data = rows(spark)
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "nr long, doc_id long, lang string, text string")
    got = {r.nr: r.kept for r in dedup.deduplicated(numbered, row="nr").collect()}
    assert len(got) == len(data) and got[0] and not got[2] and not got[3] and got[1] and not got[5]


def test_funnel_is_a_row_for_each_row(spark):
    frame, data = rows(spark)
    bench = spark.createDataFrame([(1, TEST)], "item_id long, text string")
    staged = mix.funnel(frame, bench, fim_rate=0.0).collect()
    assert len(staged) == len(data)
    code = frame.select("doc_id", "lang", preprocessed(F.col("text")).alias("code"))
    code = code.withColumn("syntax", syntax_of(F.col("code"), F.col("lang")))
    quality = {(r.doc_id, r.code): r.q for r in code.select("doc_id", "code", quality_score(F.col("code"), F.col("lang"), F.col("syntax")).alias("q")).collect()}
    by = Counter((r.doc_id, r.stage) for r in staged)
    low = Counter(k for (k, c), q in quality.items() if c is None or q < 0.3)
    assert all(by[k, "quality_filtered"] >= n for k, n in low.items())
    assert by[1, "passed"] == 2 and by[1, "dedup_filtered"] == 1 and by[2, "dedup_filtered"] == 2 and by[2, "quality_filtered"] == 1
    assert by[3, "decontam_filtered"] == 1 and by[3, "passed"] + by[3, "quality_filtered"] == 1


def test_clean_judges_rows_of_one_id_each(spark):
    frame, data = rows(spark)
    bench = spark.createDataFrame([(1, TEST)], "item_id long, text string")
    got = decontam.clean(frame, bench)
    assert got.columns == ["doc_id", "lang", "text"] and got.count() == len(data) - 1
    assert [r.text for r in got.where("doc_id = 3").collect()] == [BODY.format("delta") * 2]


def test_compression_counts_each_row_once(spark):
    docs = spark.createDataFrame([(1, "en", "ab"), (1, "en", "ab"), (1, "fr", "xyz"), (2, None, None)], "doc_id long, lang string, text string")
    sizes = tokenizer.encoded_sizes(docs, [(b"a", b"b")])
    got = {r.lang: (r.bytes, r.tokens) for r in tokenizer.compression(sizes, overall="*").collect()}
    assert got == {"en": (4, 2), "fr": (3, 3), None: (0, 0), "*": (7, 5)}
    assert sizes.where("back").count() == 4
    out = tokenizer.report(spark, docs, [(b"a", b"b")]).first()
    assert (out.bytes_per_token, out.roundtrip_failures) == (7 / 5, 0)


def test_sequences_hold_each_row_once(spark):
    frame, _ = rows(spark)
    bench = spark.createDataFrame([(1, TEST)], "item_id long, text string")
    marked = lambda f: f.withColumn("ids", F.array(F.col("doc_id").cast("int")))
    out = datasets.mixed_sequences(frame, bench, {"python": 1.0}, marked, length=1, eos=-1, fim_rate=0.0).collect()
    passed = Counter(r.doc_id for r in mix.funnel(frame, bench, fim_rate=0.0).where("stage = 'passed' and doc_id is not null").collect())
    assert Counter(r.input_ids[0] for r in out if r.input_ids[0] is not None) == passed and passed[1] == 2


def test_settings_drive_the_run(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"data": {"language_weights": {"python": 2}, "quality_threshold": 0.0, "max_seq_len": 3, "fim_rate": 0}}))
    made = datasets.Settings.load(spark, f"file://{tmp_path}/run.json")
    assert made == datasets.Settings({"python": 2}, 0.0, 0.8, 0, 42, 3) and datasets.Settings.of({}).language_weights == mix.LANGUAGE_WEIGHTS
    frame, data = rows(spark)
    bench = spark.createDataFrame([(1, TEST)], "item_id long, text string")
    assert made.funnel(frame, bench).count() == len(data)
    marked = lambda f: f.withColumn("ids", F.array(F.lit(7), F.lit(8), F.lit(9)))
    out = made.sequences(frame, bench, marked).collect()
    assert out and all(r.input_ids == [7, 8, 9] and r.targets == [8, 9, made.eos_id] for r in out)
    for wrong in ({"seeds": 1}, {"language_weights": {}}, {"language_weights": {"go": 0}}, {"fim_rate": 1.5}, {"dedup_threshold": -0.1}, {"max_seq_len": 0}):
        with pytest.raises(ValueError):
            datasets.Settings.of(wrong)
