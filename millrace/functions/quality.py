"""Quality and complexity scores of code as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import bind
from millrace.functions.text import BLANK, lines, strip

# Fixed values.
HASH, SLASH = "#", "//"
SLASH_LANGUAGES = ("javascript", "typescript", "java", "cpp", "c", "go", "rust")
STRUCTURE_WORDS = ("def", "class", "function", "fn", "func")
CONTROL_WORDS = ("if", "for", "while", "try", "except", "switch", "case", "match", "async", "await")
METHOD = r"(public|private|protected)\s+[\p{L}\p{N}_]+\s+[\p{L}\p{N}_]+\s*\("
WORD = r"[\p{L}\p{N}_]+"
#: A whole word that is an ASCII name.
NAME = r"(?<![\p{L}\p{N}_])[a-zA-Z_][a-zA-Z0-9_]*+(?![\p{L}\p{N}_])"


def line_length_score(body: Column, n: Column) -> Column:
    """By the mean length of the n lines of a text, whose newlines are the only characters outside of lines."""
    return bind((F.length(body) - n + 1) / n, lambda m: F.when(m.between(20, 100), 1.0).when((m < 10) | (m > 200), 0.2).otherwise(0.6))


def comment_score(body: Column, n: Column, language: Column) -> Column:
    """By the share of lines that begin with a comment, counted in the whole text at once."""
    count = lambda pattern: F.regexp_count(body, F.lit(rf"(?md)^{BLANK}*{pattern}"))
    found = F.when(language == "python", count(HASH)).when(language.isin(*SLASH_LANGUAGES), count(SLASH)).otherwise(count(f"(?:{HASH}|{SLASH})"))
    return bind(found / n, lambda r: F.when(r.between(0.05, 0.30), 1.0).when(r > 0.5, 0.3).when(r == 0, 0.6).otherwise(0.7))


def structure_score(code: Column) -> Column:
    named = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(STRUCTURE_WORDS)})\s+[\p{{L}}\p{{N}}_]"
    return F.when(code.rlike(named) | code.rlike(METHOD), 1.0).otherwise(0.5)


def repetition_score(body: Column, n: Column) -> Column:
    """Lines of more than five characters that come more than twice. Only texts whose lines repeat at all are sorted and
    counted, by one fold."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("repeated"))

    def step(acc: Column, line: Column) -> Column:
        run = F.when(acc["last"] == line, acc["run"] + 1).otherwise(1)
        more = F.when(run == 3, 2).when(run > 3, 1).otherwise(0)
        return F.struct(line.alias("last"), run.alias("run"), (acc["repeated"] + more).alias("repeated"))

    def repeated(kept: Column) -> Column:
        return F.when(F.size(kept) - F.size(F.array_distinct(kept)) < 2, 0).otherwise(F.aggregate(F.array_sort(kept), start, step)["repeated"])

    kept = F.filter(F.transform(lines(body), strip), lambda x: F.length(x) > 5)
    return F.greatest(F.lit(0.0), 1.0 - bind(kept, repeated) / n * 3)


def identifier_score(code: Column) -> Column:
    """By the mean length of the words that are ASCII names, found by one pattern in one pass."""
    size = bind(F.regexp_extract_all(code, F.lit(NAME), F.lit(0)), lambda names: F.length(F.array_join(names, "")) / F.nullif(F.size(names), F.lit(0)))
    return F.coalesce(F.least(F.lit(1.0), size / 5.0), F.lit(0.3))


def quality_score(code: Column, language: Column, syntax: Column | None = None) -> Column:
    """Mean of five scores, and a sixth for Python if its column is given; 0 for blank code or less than three lines."""

    def scored(c: Column, body: Column, n: Column) -> Column:
        total = line_length_score(body, n) + comment_score(body, n, language) + structure_score(c) + repetition_score(body, n) + identifier_score(c)
        mean = total / 5.0
        if syntax is not None:
            mean = F.when(language == "python", (total + syntax) / 6.0).otherwise(mean)
        return F.when(c.isNull() | (body == "") | (n < 3), 0.0).otherwise(F.least(F.lit(1.0), mean))

    def of_body(c: Column, body: Column) -> Column:
        return bind(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1, lambda n: scored(c, body, n))

    return bind(code, lambda c: bind(strip(c), lambda body: of_body(c, body)))


def complexity_score(code: Column) -> Column:
    """Half a point for each control word and up to five for the deepest indent in fours, out of twenty."""
    hits = F.size(F.filter(F.regexp_extract_all(code, F.lit(WORD), F.lit(0)), lambda w: w.isin(*CONTROL_WORDS)))
    indents = F.transform(lines(code), lambda x: F.when(~x.rlike(r"\A\s*\z"), F.length(x) - F.length(F.regexp_replace(x, r"\A\s+", ""))).otherwise(0))
    return F.least(F.lit(1.0), (hits * 0.5 + F.least(F.array_max(indents) / 4.0, F.lit(5.0))) / 20.0)
