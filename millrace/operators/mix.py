"""Language mix, quotas, the filter funnel and fill-in-the-middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.binding import bind
from millrace.functions.hashing import u01
from millrace.functions.quality import quality_score
from millrace.functions.syntax import syntax_of
from millrace.functions.text import FIM_MIDDLE, FIM_PREFIX, FIM_SUFFIX, lines, preprocessed, strip
from millrace.operators import decontam, dedup
from millrace.operators.pack import ordered_positions
from millrace.operators.storage import written

# Shares of the default mix; other languages have OTHER_WEIGHT.
LANGUAGE_WEIGHTS = {
    "python": 0.25, "javascript": 0.12, "typescript": 0.12, "java": 0.10, "cpp": 0.08, "c": 0.05, "go": 0.07,
    "rust": 0.07, "csharp": 0.04, "ruby": 0.03, "php": 0.03, "swift": 0.02, "kotlin": 0.02,
}
OTHER_WEIGHT = 0.01
STAGES = ("quality_filtered", "dedup_filtered", "decontam_filtered", "passed")


def weight_of(language: Column, weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(table[language], F.lit(OTHER_WEIGHT))


def mix_order(docs: DataFrame, weights: dict[str, float], seed: int = 42, key: str = "doc_id", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, lang, the columns of `keep`, position: a weighted random interleaving of the languages, each in order of key.

    Every language is a Poisson clock of its weight: the k-th row comes at the sum of k exponential gaps. The clocks
    together pick languages by weight, and the weights renormalise by themselves where one runs out. The sums run over
    ranges of each language's rows, the merge is a range sort.
    """
    gap = -F.log1p(-u01(seed, "mix", F.col(key))) / weight_of(F.col(lang), weights)
    drawn = docs.select(key, lang, *keep, gap.alias("gap"))
    timed = clocks(drawn, lang, key, "gap").withColumn("one", F.lit(1))
    return ordered_positions(timed, ["time", key, *keep], "one").select(key, lang, *keep, F.col("start").alias("position"))


def clocks(df: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """df with `time`: the sum of `size` up to and with each row, in order of key within each group; null is a group."""
    return running_sums(df, group, key, {"time": size})


def running_sums(df: DataFrame, group: str, key: str, sums: dict[str, str]) -> DataFrame:
    """df with columns that are each the sum of another one up to and with each row, in order of key within each group;
    null is a group.

    One pass over ranges of (group, key), however many groups; the totals, a row for each range and group, give where
    each range begins.
    """
    named = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    dealt = written(df.withColumn("__g", named).repartitionByRange("__g", key).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy("__g").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__g", "__range").agg(*[F.sum(size).alias(f"__t_{name}") for name, size in sums.items()])
    zero = {name: F.lit(0).cast(totals.schema[f"__t_{name}"].dataType) for name in sums}
    starts = totals.select("__g", "__range", *[F.coalesce(F.sum(f"__t_{name}").over(before), zero[name]).alias(f"__s_{name}") for name in sums])
    within = Window.partitionBy("__g", "__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"__own_{name}": F.sum(size).over(within) for name, size in sums.items()})
    out = own.join(starts, ["__g", "__range"]).withColumns({name: F.col(f"__s_{name}") + F.col(f"__own_{name}") for name in sums})
    return out.drop("__g", "__range", *[f"__{x}_{name}" for name in sums for x in ("own", "s")])


def quotas(weights: dict[str, float], total: int) -> dict[str, int]:
    """Whole rows of each language; the remainder goes to the heaviest."""
    whole = sum(weights.values())
    out = {k: int(total * w / whole) for k, w in weights.items()}
    out[max(weights, key=weights.get)] += total - sum(out.values())
    return out


def quota_sample(docs: DataFrame, weights: dict[str, float], total: int, key: str = "doc_id", lang: str = "lang", text: str = "text", least: int = 50, most_skips: int = 10_000) -> DataFrame:
    """key, lang, turn: the first rows of each language up to its quota, of `least` characters or more without the space
    around them; round-robin by turn. A language is given up at `most_skips` rows in a row that are too short.

    Rows and long ones are numbered by ranges of (language, key); the long rows alone, joined to their successors, tell
    how many were skipped between them. No task sees a whole language.
    """
    table = F.create_map(*[F.lit(x) for pair in quotas(weights, total).items() for x in pair])
    long = F.coalesce(F.length(strip(F.col(text))) >= least, F.lit(False))
    rows = docs.where(table[F.col(lang)] > 0).select(key, lang, long.cast("long").alias("__long"), F.lit(1).cast("long").alias("__one"))
    good = written(running_sums(rows, lang, key, {"place": "__one", "turn": "__long"}).where(F.col("__long") == 1).select(key, lang, "place", "turn"))
    earlier = good.select(F.col(lang).alias("__lang"), (F.col("turn") + 1).alias("turn"), F.col("place").alias("__before"))
    gaps = good.select(F.col(lang).alias("__lang"), "turn", "place").join(earlier, ["__lang", "turn"], "left")
    given_up = gaps.where(F.col("place") - F.coalesce("__before", F.lit(0)) > most_skips).groupBy("__lang").agg(F.min("turn").alias("__end"))
    taken = good.where(F.col("turn") <= table[F.col(lang)]).join(F.broadcast(given_up), F.col(lang) == F.col("__lang"), "left")  # a row a language
    return taken.where(F.col("__end").isNull() | (F.col("turn") < F.col("__end"))).select(key, lang, "turn")


def round_robin(docs: DataFrame, count: int, skip: int = 0, key: str = "doc_id", lang: str = "lang", text: str = "text", least: int = 50, threshold: float = 0.3) -> DataFrame:
    """key, lang, turn of the evaluation set: after `skip` raw rows of each language, rows of more than `least` stripped
    characters that pass preprocessing and quality, taken in turn over the languages until `count`.

    Scores are a map over the texts, of which no more goes on than id, language and verdict; those are numbered by ranges
    of (language, key).
    """
    code = docs.select(key, lang, text, preprocessed(F.col(text)).alias("code")).withColumn("syntax", syntax_of(F.col("code"), F.col(lang)))
    good = (F.length(strip(F.col(text))) > least) & F.col("code").isNotNull() & (quality_score(F.col("code"), F.col(lang), F.col("syntax")) >= threshold)
    judged = code.select(key, lang, F.coalesce(good, F.lit(False)).alias("__good"), F.lit(1).cast("long").alias("__one"))
    if skip:
        judged = running_sums(judged, lang, key, {"raw": "__one"}).where(F.col("raw") > skip).drop("raw")
    turns = running_sums(judged.where("__good"), lang, key, {"turn": "__one"}).where(F.col("turn") <= count)
    return turns.select(key, lang, F.col("turn").cast("int").alias("turn")).orderBy("turn", lang).limit(count)


def fim(code: Column, seed: int, key: Column) -> Column:
    """Prefix, suffix, middle around a span of lines drawn from the key; less than three lines stay as they are."""

    def cut(parts: Column) -> Column:
        n = F.size(parts)
        start = F.floor(u01(seed, "fim_start", key) * (n - 1)).cast("int")
        widest = F.least(start + F.greatest(F.floor(n / 4).cast("int"), F.lit(2)), n)
        end = F.least((start + 1 + F.floor(u01(seed, "fim_end", key) * (widest - start))).cast("int"), widest)
        join = lambda a, b: F.array_join(F.slice(parts, a + 1, F.greatest(b - a, F.lit(0))), "\n")
        whole = F.concat(F.lit(FIM_PREFIX), join(F.lit(0), start), F.lit(FIM_SUFFIX), join(end, n), F.lit(FIM_MIDDLE), join(start, end))
        return F.when(n < 3, code).otherwise(whole)

    return bind(lines(code), cut)


def fim_sample(code: Column, rate: float, seed: int, key: Column) -> Column:
    return F.when(u01(seed, "fim", key) < rate, fim(code, seed, key)).otherwise(code)


def funnel(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.3, similar: float = 0.8, num_perm: int = 128, bands: int = 16, seed: int = 42, key: str = "doc_id", text: str = "text", lang: str = "lang", fim_rate: float = 0.5) -> DataFrame:
    """key, lang, stage, code: preprocessing, quality, down-sampling, near-duplicates, decontamination and, for rows that
    pass, fill-in-the-middle at `fim_rate`, in that order.

    A contaminated row still removes its later duplicates. High quality rows are not repeated. Python rows have a sixth
    score, of their syntax. Each row gets a row, rows of one key too; the marks are joined by a number of the row.
    """
    scored = docs.select(key, lang, preprocessed(F.col(text)).alias("code"))
    scored = scored.withColumn("syntax", syntax_of(F.col("code"), F.col(lang)))
    scored = scored.withColumn("quality", quality_score(F.col("code"), F.col(lang), F.col("syntax"))).drop("syntax")
    low = F.col("code").isNull() | (F.col("quality") < threshold) | ((F.col("quality") < 0.5) & (u01(seed, "down", F.col(key)) < 0.3))
    scored = written(scored.withColumn("low", low).withColumn("__row", F.monotonically_increasing_id()))
    good = scored.where(~F.col("low"))
    kept = dedup.deduplicated(good, "code", key, similar, num_perm, bands=bands, row="__row").select("__row", "kept")
    marks = decontam.flags(good, benchmark, key, "code", row="__row").select("__row", "contaminated")  # a map: no text moves for it
    out = scored.join(kept.join(marks, "__row"), "__row", "left")
    stage = F.when(F.col("low"), STAGES[0]).when(~F.col("kept"), STAGES[1]).when(F.col("contaminated"), STAGES[2]).otherwise(STAGES[3])
    passed = F.when(stage == STAGES[3], fim_sample(F.col("code"), fim_rate, seed, F.col(key))).otherwise(F.col("code"))
    return out.select(key, lang, stage.alias("stage"), passed.alias("code"))


def funnel_stats(staged: DataFrame) -> DataFrame:
    """stage, rows, percent of all rows seen."""
    counts = staged.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("stage", "rows", F.round(100.0 * F.col("rows") / F.greatest("total", F.lit(1)), 6).alias("percent"))  # one row
