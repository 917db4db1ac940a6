"""Queries over logits, number formats, names, tokenizers and composed datasets, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import schedule, text, vector
from millrace.functions.hashing import u01, u01_sql
from millrace.operators import datasets, dedup, evaluate, metrics, mix, recurrence, tokenizer
from millrace.operators.storage import written
from millrace.plans import corpus
from millrace.plans.corpus import PREPROCESS_SQL, SOURCE_SQL, WEIGHTS, table
from millrace.plans.training import _ELEM, _SERIES, _VEC, ORACLES as TRAINING_SQL, _e4m3_sql, _events, _vectors, joined
from millrace.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def total(values):
    return F.round(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), 9)


def _float_sql(x: str, mantissa: int, least: int, top: float) -> str:
    clamped = f"greatest(least({x}, {top}), -{top})"
    u = f"pow(2.0, greatest(floor(log2(greatest(abs({clamped}), 1e-300))), {least}.0) - {mantissa})"
    return f"greatest(least(round_even({clamped} / {u}, 0) * {u}, {top}), -{top})"


# --- number formats --------------------------------------------------------------------------------------------------


@query(f"WITH {_ELEM}, s AS (SELECT vec_id, 57344.0 / greatest(max(abs(v)), 1e-12) AS k FROM el GROUP BY vec_id), c AS (SELECT vec_id, v, {_float_sql('(v * k)', 2, -14, 57344.0)} / k AS y FROM el JOIN s USING (vec_id)) SELECT vec_id, round(sum(y), 9) AS total, round(sum((v - y) * (v - y)), 9) AS error FROM c GROUP BY vec_id")
def fp8_wide_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "x", vector.fp8_cast(F.col("x"), "e5m2").alias("y"))
    return rows.select("vec_id", total(F.col("y")).alias("total"), total(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))).alias("error"))


@query(f"WITH {_ELEM}, s AS (SELECT vec_id, 448.0 / CASE WHEN stddev_samp(v) < 1e-6 THEN greatest(max(abs(v)), 1e-12) ELSE 3.0 * stddev_samp(v) END AS k FROM el GROUP BY vec_id), c AS (SELECT vec_id, v, {_e4m3_sql('(v * k)')} / k AS y FROM el JOIN s USING (vec_id)) SELECT vec_id, round(sum(y), 6) AS total, round(sum((v - y) * (v - y)), 6) AS error FROM c GROUP BY vec_id")
def sigma_cast_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "x", vector.sigma_cast(F.col("x")).alias("y"))
    return rows.select("vec_id", F.round(total(F.col("y")), 6).alias("total"), F.round(total(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))), 6).alias("error"))


@query(f"""WITH {_ELEM}, s AS (SELECT vec_id, 448.0 / greatest(max(abs(v)), 1e-12) AS k FROM el GROUP BY vec_id),
    a AS (SELECT vec_id, i, v, k, least(abs(v * k), 448.0) AS m, pow(2.0, greatest(floor(log2(greatest(least(abs(v * k), 448.0), 1e-300))), -6.0) - 3) AS ulp FROM el JOIN s USING (vec_id)),
    c AS (SELECT vec_id, v, sign(v * k) * least((floor(m / ulp) + CASE WHEN {u01_sql(42, 'round', 'vec_id', '(i - 1)')} < m / ulp - floor(m / ulp) THEN 1 ELSE 0 END) * ulp, 448.0) / k AS y FROM a)
    SELECT vec_id, round(sum(y), 9) AS total, round(sum((v - y) * (v - y)), 9) AS error FROM c GROUP BY vec_id""")
def stochastic_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "x", vector.stochastic_cast(F.col("x"), F.col("vec_id")).alias("y"))
    return rows.select("vec_id", total(F.col("y")).alias("total"), total(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))).alias("error"))


_SCALE = "pow(2.0, ceil(log2(greatest(max(abs({})), 1e-12) / 448.0)))"


@query(f"""WITH {_ELEM}, w AS (SELECT vec_id, b, i, v + v / 64 AS v FROM bl), s AS (SELECT vec_id, b, {_SCALE.format('v')} AS s FROM w GROUP BY vec_id, b),
    h AS (SELECT vec_id, b, i, v, {_e4m3_sql('(v / s)')} * s AS hi FROM w JOIN s USING (vec_id, b)), r AS (SELECT vec_id, b, {_SCALE.format('v - hi')} AS s FROM h GROUP BY vec_id, b),
    l AS (SELECT vec_id, hi, v - hi AS rest, {_e4m3_sql('((v - hi) / s)')} * s AS lo FROM h JOIN r USING (vec_id, b))
    SELECT vec_id, round(sum(hi), 9) AS hi, round(sum(lo), 9) AS lo, round(sum(rest - lo), 9) AS error FROM l GROUP BY vec_id""")
def dual_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _vectors(spark, sf_dir).select("vec_id", vector.dual(F.col("x"), F.transform("x", lambda v: v / 64)).alias("d"))
    return made.select("vec_id", *[total(F.col(f"d.{c}")).alias(c) for c in ("hi", "lo", "error")])


_BOOK = vector.nf4_codebook()
_MIDDLES = ", ".join(repr((p + q) / 2) for p, q in zip(_BOOK, _BOOK[1:], strict=False))


@query(f"""WITH {_ELEM}, z AS (SELECT vec_id, b, greatest(stddev_pop(v), 1e-12) AS sd, greatest(max(abs(v)), 1e-12) AS am FROM bl GROUP BY vec_id, b),
    s AS (SELECT vec_id, b, pow(2.0, ceil(log2(CASE WHEN sd < 1e-6 THEN am ELSE 3.0 * sd END / 448.0))) AS sc FROM z),
    m AS (SELECT vec_id, b, v, sc, {_e4m3_sql('(v / sc)')} AS main, v / sc AS w FROM bl JOIN s USING (vec_id, b)),
    r AS (SELECT vec_id, b, pow(2.0, ceil(log2(greatest(max(abs(w - main)), 1e-12)))) AS r FROM m GROUP BY vec_id, b),
    q AS (SELECT vec_id, v, sc, main, r, len(list_filter([{_MIDDLES}]::DOUBLE[], lambda t: t < greatest(least((w - main) / r, 1.0), -1.0))) AS k FROM m JOIN r USING (vec_id, b)),
    y AS (SELECT vec_id, v, k, (main + ([{', '.join(map(repr, _BOOK))}]::DOUBLE[])[k + 1] * r) * sc AS y FROM q)
    SELECT vec_id, sum(k)::BIGINT AS levels, round(10 * log10(avg(v * v) / avg((v - y) * (v - y))), 6) AS snr FROM y GROUP BY vec_id""")
def normal_levels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "x", vector.residual_quantize(F.col("x"), nf4=True, sigma=True).alias("q")).withColumn("y", vector.residual_dequantize(F.col("q"), nf4=True))
    levels = F.aggregate(F.col("q.resid"), F.lit(0), lambda a, v: a + v).cast("bigint")
    return rows.select("vec_id", levels.alias("levels"), F.round(vector.snr_db(F.col("x"), F.col("y")), 6).alias("snr"))


@query(f"""WITH s AS ({TRAINING_SQL['residual_roundtrip_snr']}), n AS (SELECT len(embedding) AS n, vec_id FROM embeddings WHERE len(embedding) > 0)
    SELECT count(*) AS layers, sum((n % 32 = 0)::INT)::BIGINT AS eligible, sum(n * 2)::BIGINT AS bytes_before, round(sum(n * 12.5::DOUBLE / 8), 6) AS bytes_after, round(100.0 * (1 - sum(n * 12.5::DOUBLE / 8) / sum(n * 2)), 6) AS savings_percent,
    round(min(snr), 4) AS min_snr, round(avg(snr), 4) AS mean_snr, sum((snr < 30)::INT)::BIGINT AS under_30_db FROM s JOIN n USING (vec_id)""")
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select(F.col("x").alias("weight"), vector.residual_dequantize(vector.residual_quantize(F.col("x"))).alias("restored"))
    out = metrics.diagnose(rows)
    digits = {"bytes_after": 6, "savings_percent": 6, "min_snr": 4, "mean_snr": 4}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


# --- logits ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_ELEM} SELECT vec_id, round(sum(CASE c WHEN 0 THEN v ELSE CASE WHEN v > 0 THEN v / 1.2 ELSE v * 1.2 END - 0.1 * c END), 9) AS total
    FROM (SELECT vec_id, v, (i - 1 = vec_id % 64)::INT * 2 + (i - 1 = (vec_id + 1) % 64)::INT AS c FROM el) GROUP BY vec_id""")
def penalised_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.transform(F.array(F.lit(0), F.lit(1), F.lit(0)), lambda d: ((F.col("vec_id") + d) % 64).cast("int"))
    return _vectors(spark, sf_dir).select("vec_id", total(vector.penalised(F.col("x"), seen, 1.2, 0.1)).alias("total"))


@query(f"""WITH {_ELEM}, h AS (SELECT vec_id, i, v / 0.8 AS v, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS r FROM el), k AS (SELECT vec_id, i, v, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM h WHERE r <= 50),
    n AS (SELECT vec_id, i, p, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
    c AS (SELECT vec_id, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) / sum(p) OVER (PARTITION BY vec_id) AS upto FROM n WHERE before < 0.95)
    SELECT vec_id, min(i - 1)::INT AS token FROM c WHERE upto > {u01_sql(42, 'draw', 'vec_id')} GROUP BY vec_id""")
def sampled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", vector.sampled_token(F.col("x"), u01(42, "draw", F.col("vec_id"))).alias("token"))


@query(f"""WITH {_VEC}, l AS (SELECT vec_id, ln(list_sum(list_transform(x, lambda z: exp(z)))) AS l, x[(vec_id % 64)::INT + 1] AS t FROM v)
    SELECT round(avg(l - t) FILTER (WHERE vec_id % 3 <> 0), 9) AS loss, round(1e-4 * avg(l * l), 9) AS z_loss FROM l""")
def masked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("vec_id") % 3 == 0, -1).otherwise((F.col("vec_id") % 64).cast("int"))
    rows = _vectors(spark, sf_dir)
    return rows.agg(F.round(vector.masked_loss(vector.softmax_loss(F.col("x"), target)), 9).alias("loss"), F.round(vector.z_loss(F.col("x")), 9).alias("z_loss"))


# --- presets, names, programs ----------------------------------------------------------------------------------------


@query("""SELECT item_id, md5(text || 'pass' || chr(10) || 'def check(f): pass' || chr(10) || 'check(f' || item_id || ')' || chr(10)) AS function_md5,
    md5(CASE WHEN item_id % 2 = 0 THEN 'import math' || chr(10) ELSE '' END || text || chr(10) || 'assert 1' || chr(10) || 'assert 2') AS asserted_md5 FROM benchmark""")
def test_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    whole = evaluate.function_program(F.col("text"), F.lit("pass"), F.lit("def check(f): pass"), F.concat(F.lit("f"), F.col("item_id").cast("string")))
    setup = F.when(F.col("item_id") % 2 == 0, "import math").otherwise("")
    asserted = evaluate.asserted_program(F.col("text"), F.array(F.lit("assert 1"), F.lit("assert 2")), setup)
    return items.select("item_id", F.md5(whole.cast("binary")).alias("function_md5"), F.md5(asserted.cast("binary")).alias("asserted_md5"))


@query("SELECT doc_id, path, row_number() OVER (ORDER BY path) - 1 AS position FROM (SELECT doc_id, source || '/f' || doc_id || '.txt' AS path FROM documents)")
def sorted_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return files.walked(paths).select("doc_id", "path", "position")


# --- series ----------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_SERIES}, r AS (SELECT user_id, event_id, rn, x + 1 AS main, x / (x + 1) AS ratio FROM e),
    g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, NULL::DOUBLE AS kept, NULL::DOUBLE AS predicted FROM r WHERE rn = 1
      UNION ALL SELECT r.user_id, r.event_id, r.rn, CASE WHEN r.rn = 1 THEN r.ratio WHEN r.rn % 5 = 0 THEN 0.9::DOUBLE * kept + (1 - 0.9::DOUBLE) * r.ratio ELSE kept END,
        greatest(main * coalesce(kept, 0.125), 1e-12) FROM g JOIN r ON r.user_id = g.user_id AND r.rn = g.rn + 1)
    SELECT user_id, event_id, round(kept, 9) AS ratio, round(predicted, 9) AS predicted FROM g WHERE rn > 0""")
def residual_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("main", F.col("value") + 1)
    out = recurrence.residual_ratio(e, "user_id", ["event_id"], "main", "value", 0.9, 5)
    return out.select("user_id", "event_id", F.round("ratio", 9).alias("ratio"), F.round("predicted", 9).alias("predicted"))


@query(f"""WITH RECURSIVE {_SERIES}, g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0.0::DOUBLE AS s, 0.0::DOUBLE AS b, 'defensive' AS phase FROM e WHERE rn = 1
    UNION ALL SELECT user_id, event_id, rn, CASE WHEN phase2 = 'offensive' AND b3 > 5 THEN 0.0 ELSE s2 END, b3, CASE WHEN phase2 = 'offensive' AND b3 > 5 THEN 'defensive' ELSE phase2 END FROM (
      SELECT *, CASE WHEN phase2 = 'offensive' THEN greatest(0.0, CASE WHEN turns THEN 0.0 ELSE b END - 1.875 + dev) ELSE b END AS b3 FROM (
        SELECT *, CASE WHEN turns THEN 'offensive' ELSE phase END AS phase2 FROM (
          SELECT *, phase = 'defensive' AND s2 > 10 AS turns FROM (
            SELECT e.user_id, e.event_id, e.rn, g.phase, g.b, (e.x / 10 - 1) * (e.x / 10 - 1) AS dev, greatest(0.0, g.s + 1.875 - (e.x / 10 - 1) * (e.x / 10 - 1)) AS s2 FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1)))))
    SELECT user_id, event_id, round(s, 6) AS statistic, round(b, 6) AS backward, phase FROM g WHERE rn > 0""")
def cusum_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("value", F.col("value") / 10)
    out = recurrence.cusum_phase(e, "user_id", ["event_id"], "value", reset=True)
    return out.select("user_id", "event_id", F.round("statistic", 6).alias("statistic"), F.round("backward", 6).alias("backward"), "phase")


@query("""WITH d AS (SELECT vec_id % 20 AS layer, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY vec_id % 20) AS n FROM embeddings WHERE len(embedding) = 64),
    e AS (SELECT layer, rn, n, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM d),
    s AS (SELECT layer, i, sum(v * CASE WHEN rn = 1 THEN pow(0.9::DOUBLE, n - 1) ELSE 0.1 * pow(0.9::DOUBLE, n - rn) END) AS b FROM e GROUP BY layer, i)
    SELECT layer, string_agg(CASE WHEN abs(b) < 1e-8 THEN 0 ELSE round(b * 1e6) END::BIGINT::VARCHAR, ',' ORDER BY i) AS bias_millionths FROM s GROUP BY layer""")
def gradient_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).where(F.size("x") == 64).withColumn("layer", F.col("vec_id") % 20)
    out = recurrence.vector_bias(rows, "layer", "vec_id", "x")
    return out.select("layer", joined(F.transform("bias", lambda b: F.round(b * 1e6).cast("bigint"))).alias("bias_millionths"))


# --- near-duplicates with a ring -------------------------------------------------------------------------------------

RING = 200


@query(f"""WITH RECURSIVE {corpus.signature_cte('documents', 'text')}, {corpus.pairs_cte()}, nb AS (SELECT b AS doc_id, list(a) AS before FROM sim WHERE estimate >= 0.8 GROUP BY b),
    node AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, coalesce(before, []) AS before FROM documents LEFT JOIN nb USING (doc_id)),
    g(rn, doc_id, kept, ring) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::BIGINT[] UNION ALL
      SELECT node.rn, node.doc_id, NOT list_has_any(ring, before), CASE WHEN list_has_any(ring, before) THEN ring ELSE list_slice(list_append(ring, node.doc_id), -{RING}, -1) END FROM g JOIN node ON node.rn = g.rn + 1)
    SELECT doc_id, kept FROM g WHERE rn > 0""")
def near_dups_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of 200, so that it turns over on small tables as well."""
    docs = table(spark, sf_dir, "documents")
    marks = written(dedup.signed_texts(docs, num_perm=corpus.PERMUTATIONS))
    return dedup.ring_kept(docs.select("doc_id"), dedup.similar_pairs(marks, 0.8, bands=corpus.BANDS), RING)


# --- composed datasets -----------------------------------------------------------------------------------------------


def _word_lengths(rows: DataFrame) -> DataFrame:
    """A stand-in for a tokenizer that SQL has too: each word's length."""
    return rows.withColumn("ids", F.transform(text.words(F.col("text")), F.length)).drop("text")


def _fim_sql(source: str, seed: int = 42) -> str:
    """fm(doc_id, code): the codes of a table after fill-in-the-middle at 0.5."""
    u = lambda tag: u01_sql(seed, tag, "doc_id")
    return f"""fs AS (SELECT doc_id, code, string_split(code, chr(10)) AS ls, len(string_split(code, chr(10))) AS n FROM {source}),
    fa AS (SELECT *, floor({u('fim_start')} * (n - 1))::INT AS st FROM fs), fw AS (SELECT *, least(st + greatest(floor(n / 4)::INT, 2), n) AS wide FROM fa),
    fe AS (SELECT *, least((st + 1 + floor({u('fim_end')} * (wide - st)))::INT, wide) AS en FROM fw),
    fm AS (SELECT doc_id, CASE WHEN n >= 3 AND {u('fim')} < 0.5 THEN '<|fim_prefix|>' || array_to_string(list_slice(ls, 1, st), chr(10)) || '<|fim_suffix|>' || array_to_string(list_slice(ls, en + 1, n), chr(10))
      || '<|fim_middle|>' || array_to_string(list_slice(ls, st + 1, en), chr(10)) ELSE code END AS code FROM fe)"""


def _packed_sql(source: str, order: str) -> str:
    return f"""pw AS (SELECT {order} AS o, list_append(list_transform(list_filter(regexp_split_to_array(code, '{text.SPACES_SQL}+'), lambda x: x <> ''), lambda x: length(x)::INT), 49090) AS ids FROM {source}),
    pr AS (SELECT o, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM pw WHERE len(ids) > 1), pp AS (SELECT id, row_number() OVER (ORDER BY o, i) - 1 AS pos FROM pr),
    pc AS (SELECT pos // 129 AS chunk, list(id ORDER BY pos) AS l FROM pp GROUP BY 1 HAVING count(*) = 129)
    SELECT chunk, md5(array_to_string(list_slice(l, 1, 128), ',')) AS input_md5, md5(array_to_string(list_slice(l, 2, 129), ',')) AS target_md5 FROM pc"""


def _digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.md5(joined(F.col("input_ids"))).alias("input_md5"), F.md5(joined(F.col("targets"))).alias("target_md5"))


@query(f"WITH {SOURCE_SQL}, {PREPROCESS_SQL}, ok AS (SELECT doc_id, code FROM p WHERE code IS NOT NULL), {_fim_sql('ok')}, {_packed_sql('fm', 'doc_id')}")
def code_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(datasets.code_sequences(table(spark, sf_dir, "documents"), _word_lengths, 128))


_CLOCK = f"""clock AS (SELECT doc_id, row_number() OVER (ORDER BY t, doc_id) AS place FROM (SELECT doc_id, sum(-ln(1 - {u01_sql(42, 'mix', 'doc_id')}) / CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 0.01 END) OVER (PARTITION BY lang ORDER BY doc_id) AS t FROM staged WHERE stage = 'passed'))"""


@query(f"{corpus._FUNNEL}, ok AS (SELECT doc_id, code FROM staged WHERE stage = 'passed'), {_fim_sql('ok')}, {_CLOCK}, fo AS (SELECT place, code FROM fm JOIN clock USING (doc_id)), {_packed_sql('fo', 'place')}")
def mixed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(datasets.mixed_sequences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WEIGHTS, _word_lengths, 128))


@query(f"{corpus._FUNNEL}, ok AS (SELECT doc_id, code FROM staged WHERE stage = 'passed'), {_fim_sql('ok')} SELECT doc_id, starts_with(code, '<|fim_prefix|>') AS transformed, md5(code) AS code_md5 FROM fm")
def filter_funnel_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = mix.funnel(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where(F.col("stage") == "passed")
    return passed.select("doc_id", F.col("code").startswith(text.FIM_PREFIX).alias("transformed"), F.md5(F.col("code").cast("binary")).alias("code_md5"))


# --- tokenizer -------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, array_to_string(list_concat([49089], l, [49090]), ',') AS marked, array_to_string(list_slice(list_concat(list_concat([49089], l, [49090]), list_resize([]::INT[], 24, 49088)), 1, 24), ',') AS padded
    FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x)::INT) AS l FROM documents)""".replace("\\s", text.SPACES_SQL))
def marked_and_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokenizer.marked(F.transform(text.words(F.col("text")), F.length), 49_089, 49_090)
    return table(spark, sf_dir, "documents").select("doc_id", joined(ids).alias("marked"), joined(tokenizer.padded(ids, 24, 49_088)).alias("padded"))


#: Merges of a full vocabulary: what is learned beyond the 256 bytes.
MERGES = schedule.BPE_SIZE - 256


def _learned(spark: SparkSession, sf_dir: str) -> list:
    return tokenizer.learn_merges(tokenizer.pretoken_counts(table(spark, sf_dir, "documents")), MERGES)


@query()
def tokenizer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.single_token_checks(spark, _learned(spark, sf_dir))


@query()
def tokenizer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.report(spark, table(spark, sf_dir, "documents"), _learned(spark, sf_dir))
