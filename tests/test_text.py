"""Literal cases of the string rules, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import quality, text


def one(spark, column, *values):
    names = ["a", "b", "c"][: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a\tb  \n\n\n\n\nc\r\n", "a    b\n\n\nc\n"),
        ("", "\n"),
        ("  x  ", "x\n"),
        ("x\n \n\t\n  \n \ny", "x\n\n\ny\n"),
    ],
)
def test_white_space(spark, given, want):
    assert one(spark, text.normalize_whitespace(F.col("a")), given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("/* MIT License */\ncode\n", "code\n"),
        ("/* plain */\ncode\n", "/* plain */\ncode\n"),
        ("# the license\n# more\nx = 1\n", "x = 1\n"),
        ("// LICENSE\n// more\nint x;\n", "int x;\n"),
        ("/* license */\n# license\nx", "x"),
        ("# nothing\nx", "# nothing\nx"),
        ("\n\nx", "x"),
    ],
)
def test_license_header(spark, given, want):
    assert one(spark, text.strip_license_header(F.col("a")), given) == want


@pytest.mark.parametrize(("given", "kept"), [(None, False), ("  \n ", False), ("one line", False), ("one\ntwo", True), ("a\n" + "x" * 1001, False), ("/* license */\n", False)])
def test_preprocess_filters(spark, given, kept):
    assert (one(spark, text.preprocessed(F.col("a")), given) is not None) is kept


@pytest.mark.parametrize(("path", "want"), [("a/b.py", "python"), ("x.R", "r"), ("x.tsx", "typescript"), ("x.PY", None), ("Makefile", None), ("a.py.txt", None)])
def test_language(spark, path, want):
    assert one(spark, text.language_of_path(F.col("a")), path) == want


@pytest.mark.parametrize(("given", "n", "want"), [("a b c d e f", 5, ["a b c d e", "b c d e f"]), ("a b", 5, ["a b"]), ("", 5, []), ("  ", 3, [])])
def test_word_ngrams(spark, given, n, want):
    assert one(spark, text.word_ngrams(text.words(F.col("a")), n), given) == want


def test_trims(spark):
    body = "    return 1\n\ndef other():\n    pass\ndef third():\n    pass"
    assert one(spark, text.trim_to_first_definition(F.col("a")), body) == "    return 1\n"
    assert one(spark, text.trim_to_second_def(F.col("a")), body) == "    return 1\n\ndef other():\n    pass"
    assert one(spark, text.fim_parts(F.col("a")), "x|||y")["suffix"] == "y"
    assert one(spark, text.fim_parts(F.col("a")), "x|||y|||z") is None


def test_repetition_counts_lines_that_come_more_than_twice(spark):
    score = quality.repetition_score(F.col("a"), F.size(text.lines(F.col("a"))))
    assert one(spark, score, "longer\nlonger\nother line\nx") == 1.0
    assert one(spark, score, "longer\nlonger\nlonger\nlonger\n" + "a\n" * 25 + "a") == pytest.approx(1 - 3 / 30 * 3)


def test_quality_of_python(spark):
    from millrace.functions.syntax import python_syntax_score

    code = "def add(first, second):\n    # sum of both numbers\n    return first + second"
    frame = spark.createDataFrame([(1, code), (2, code + "\n)("), (3, None)], "i int, a string")
    got = dict(frame.select("i", python_syntax_score(F.col("a"))).collect())
    assert got == {1: 1.0, 2: 0.1, 3: 0.1}
    assert one(spark, quality.quality_score(F.col("a"), F.lit("python")), "x\ny") == 0.0


def test_white_space_is_what_python_takes_for_it(spark):
    every = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert sorted(text.SPACE) == sorted(every)
    cases = [*(f"a{c}{c}b{c}" for c in every), *(f"{c}x" for c in every), "a​b", "", "　"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", text.words(F.col("t")).alias("w"), text.strip(F.col("t")).alias("s"), text.decontamination_form(F.col("t")).alias("d")).collect()
    for r in rows:
        assert (r.w, r.s, r.d) == (cases[r.i].split(), cases[r.i].strip(), " ".join(cases[r.i].lower().split()))


def test_greedy_packs_by_a_plain_loop(spark):
    from millrace.operators import pack

    sizes = [3, 90, 40, 5, 400, 7, 7, 30, 200, 1, 1, 60, 33, 90, 2, 500, 500, 8]
    files = spark.createDataFrame([("r", f"f{i:02}", "x" * n) for i, n in enumerate(sizes)] + [("q", "only", ""), (None, "lost", "y")], "repo string, path string, content string")
    got = pack.repository_packs(files, "repo", "path", "content", max_tokens=60, chars_per_token=3.5)
    budget, packs, chars, fresh = 210, [], 0, True
    for i, n in enumerate(sizes):
        own = len(f"<|file_sep|>f{i:02}\n") + n
        if own > budget or fresh or chars + own > budget:
            packs.append([])
            chars = len("<|repo_name|>r\n")
        packs[-1].append(i)
        chars, fresh = chars + own, own > budget
    rows = {(r.repo, r.pack): r.n_files for r in got.collect()}
    assert {k: n for k, n in rows.items() if k[0] == "r"} == {("r", i): len(p) for i, p in enumerate(packs)} and rows["q", 0] == 1
