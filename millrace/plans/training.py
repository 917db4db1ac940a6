"""Queries over conversations, evaluation outcomes, vectors and metric series, each with its SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import schedule, text, vector
from millrace.operators import chat, metrics, recurrence, tokenizer
from millrace.plans.corpus import strip_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def joined(values, digits: int | None = None):
    item = (lambda v: F.format_string("%.9e", F.round(v, digits))) if digits is not None else (lambda v: v.cast("string"))
    return F.array_join(F.transform(values, item), ",")


# --- chat, SFT, DPO --------------------------------------------------------------------------------------------------

SYSTEM = chat.DEFAULT_SYSTEM


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


_RENDER = f"""r AS (SELECT conv_id, '<|system|>' || chr(10) || '{SYSTEM}<|end|>' || coalesce(string_agg(chr(10) || '<|' || role || '|>' || chr(10) || text || '<|end|>', '' ORDER BY turn) FILTER (WHERE role IN ('user', 'assistant')), '') AS t FROM conversations GROUP BY conv_id)"""


@query(f"WITH {_RENDER} SELECT conv_id, length(t) AS chars, md5(t || chr(10) || '<|assistant|>' || chr(10)) AS prompt_md5 FROM r")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chats(spark, sf_dir)
    plain, prompt = text.chat(F.lit(SYSTEM), F.col("messages")), text.chat(F.lit(SYSTEM), F.col("messages"), True)
    return c.select("conv_id", F.length(plain).cast("bigint").alias("chars"), F.md5(prompt.cast("binary")).alias("prompt_md5"))


@query("SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS chatml_md5 FROM conversations GROUP BY conv_id")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", F.md5(text.chatml(F.col("messages"), True).cast("binary")).alias("chatml_md5"))


@query(f"""WITH {_RENDER}, k AS (SELECT conv_id, t, least(length(t), 1500) AS kept FROM r WHERE length(t) >= 4),
    o AS (SELECT conv_id, role, length(text) AS n, {len('<|system|>') + 1 + len(SYSTEM) + len('<|end|>')} + coalesce(sum(1 + length(role) + 5 + length(text) + 7) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 + length(role) + 5 AS st
          FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT k.conv_id, (kept - 1)::INT AS n_input, coalesce(sum(greatest(least(st + n, kept) - least(st, kept), 0)) FILTER (WHERE role = 'assistant'), 0)::INT AS n_loss, md5(substr(t, 1, kept)) AS text_md5
    FROM k LEFT JOIN o USING (conv_id) GROUP BY k.conv_id, kept, t""")
def sft_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.sft_rows(_chats(spark, sf_dir), "conv_id", F.lit(SYSTEM), 1500)
    return rows.select("conv_id", "n_input", "n_loss", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH p AS (SELECT u.conv_id, u.text AS prompt, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND u.text <> '' AND a.text <> ''),
    c AS (SELECT conv_id, prompt, 1 || list_transform(string_split(prompt || response, ''), lambda x: unicode(x)) || 2 AS ids FROM (SELECT conv_id, prompt, response FROM p))
    SELECT conv_id, length(prompt) AS prompt_chars, (least(length(prompt) + length(response) + 2, 512) - 1)::INT AS n_input, least(length(prompt) + 1, least(length(prompt) + length(response) + 2, 512) - 1)::INT AS n_masked FROM p""")
def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    users = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    pairs = users.join(t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("chosen")), ["conv_id", "turn"]).withColumn("rejected", F.lit("no"))
    made = chat.complete_pairs(pairs).withColumn("x", chat.dpo_pair(F.col("prompt"), F.col("chosen"), 512))
    masked = F.size(F.filter("x.labels", lambda v: v == -1))
    return made.select("conv_id", F.length("prompt").cast("bigint").alias("prompt_chars"), F.size("x.input_ids").alias("n_input"), masked.alias("n_masked"))


@query("""SELECT round(avg(ln(1 + exp(-(w - l)))), 9) AS loss, round(avg(CASE WHEN w > l THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS accuracy, round(avg(w), 9) AS reward_chosen, round(avg(l), 9) AS reward_rejected, round(avg(w - l), 9) AS reward_margin
    FROM (SELECT 0.1::DOUBLE * (value / 10 - user_id / 50.0::DOUBLE) AS w, 0.1::DOUBLE * (event_id % 7 - event_id % 5)::DOUBLE AS l FROM events)""")
def dpo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    logs = e.select((F.col("value") / 10).alias("pi_chosen"), (F.col("user_id") / 50.0).alias("ref_chosen"), (F.col("event_id") % 7).cast("double").alias("pi_rejected"), (F.col("event_id") % 5).cast("double").alias("ref_rejected"))
    out = chat.dpo_metrics(logs)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"""SELECT conv_id, md5('<|system|>' || chr(10) || '{SYSTEM}<|end|>' || chr(10) || '<|user|>' || chr(10) || text || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || '```python' || chr(10) || 'pass' || chr(10) || '```' || chr(10) || chr(10) || 'done' || '<|end|>') AS task_md5
    FROM conversations WHERE role = 'user' AND turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id AND role = 'user')""")
def coding_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    reply = text.coding_task(F.lit("pass"), F.lit("done"), F.lit("python"))
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("assistant").alias("role"), reply.alias("content")))
    return t.select("conv_id", F.md5(text.chat(F.lit(SYSTEM), turns).cast("binary")).alias("task_md5"))


@query(rf"""WITH c AS (SELECT doc_id, string_split(replace(text, '. ', chr(10) || CASE doc_id % 3 WHEN 0 THEN 'def ' WHEN 1 THEN 'class ' ELSE '' END), chr(10)) AS ls FROM documents),
    s AS (SELECT doc_id, ls, list_min(list_filter(generate_series(2, greatest(len(ls), 2)), lambda i: regexp_matches(coalesce(ls[i], ''), '\A\s*(def |class )'))) AS f, list_filter(generate_series(1, len(ls)), lambda i: starts_with(ls[i], 'def ')) AS d FROM c)
    SELECT doc_id, md5(array_to_string(CASE WHEN f IS NULL THEN ls ELSE list_slice(ls, 1, f - 1) END, chr(10))) AS first_md5, md5(array_to_string(CASE WHEN len(d) < 2 THEN ls ELSE list_slice(ls, 1, d[2] - 1) END, chr(10))) AS second_md5 FROM s""")
def completion_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("doc_id") % 3 == 0, "def ").when(F.col("doc_id") % 3 == 1, "class ").otherwise("")
    made = table(spark, sf_dir, "documents").withColumn("c", F.replace(F.col("text"), F.lit(". "), F.concat(F.lit("\n"), word)))
    return made.select("doc_id", F.md5(text.trim_to_first_definition(F.col("c")).cast("binary")).alias("first_md5"), F.md5(text.trim_to_second_def(F.col("c")).cast("binary")).alias("second_md5"))


@query(f"""WITH m AS (SELECT conv_id, turn, text, 'p' || conv_id || ':' AS p FROM conversations) SELECT conv_id, turn, md5({strip_sql("string_split(substr(p || text || ' <|end|> tail', length(p) + 1), '<|end|>')[1]")}) AS reply_md5 FROM m""")
def chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").withColumn("p", F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit(":")))
    return m.select("conv_id", "turn", F.md5(text.chat_reply(F.concat("p", "text", F.lit(" <|end|> tail")), F.col("p")).cast("binary")).alias("reply_md5"))


# --- metrics ---------------------------------------------------------------------------------------------------------


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), (F.col("value") < 5).alias("passed"))


@query("""WITH t AS (SELECT user_id AS task_id, count(*) AS n, sum((value < 5)::INT) AS c FROM events GROUP BY user_id),
    k AS (SELECT k, CASE WHEN n - c < k THEN 1.0 ELSE 1.0 - list_product(list_transform(generate_series(0, k - 1), lambda i: (n - c - i)::DOUBLE / (n - i))) END AS p FROM t, (VALUES (1), (10), (50)) v(k) WHERE n >= k)
    SELECT k, count(*) AS problems, round(avg(p), 9) AS pass_at_k FROM k GROUP BY k""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pass_at_k_table(_outcomes(spark, sf_dir), (1, 10, 50)).withColumn("pass_at_k", F.round("pass_at_k", 9))


@query("SELECT user_id AS task_id, count(*) AS total, sum((value < 5)::INT)::BIGINT AS passed FROM events GROUP BY user_id")
def per_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_problem(_outcomes(spark, sf_dir))


@query("""WITH m AS (SELECT event_type, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type)
    SELECT event_type, round(avg(pow(value - m, 4)) / pow(any_value(v), 2) - 3, 6) AS kurtosis FROM events JOIN m USING (event_type) GROUP BY event_type""")
def excess_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.excess_kurtosis(table(spark, sf_dir, "events"), "event_type", "value").withColumn("kurtosis", F.round("kurtosis", 6))


@query("SELECT round(sqrt(sum(value * value)), 6) AS norm, count(*) AS parameters FROM events")
def global_grad_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.global_norm(table(spark, sf_dir, "events"), "value").withColumn("norm", F.round("norm", 6))


@query("SELECT round(max(m), 9) AS max_mean_abs, round(avg(m), 9) AS avg_mean_abs FROM (SELECT user_id, avg(abs(value)) AS m FROM events GROUP BY user_id)")
def layer_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.layer_magnitudes(table(spark, sf_dir, "events"), "user_id", "value")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("SELECT round(avg(value), 9) AS eval_loss FROM (SELECT value FROM events ORDER BY event_id LIMIT 50)")
def eval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.eval_loss(table(spark, sf_dir, "events"), "event_id", "value").withColumn("eval_loss", F.round("eval_loss", 9))


@query("SELECT 0.9::DOUBLE AS p, list_sort(list(value))[least(floor(0.9 * count(*))::BIGINT, count(*) - 1) + 1] AS cut FROM events")
def index_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.index_percentile(table(spark, sf_dir, "events"), "value", 0.9)


@query("SELECT event_type, event_id AS step FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("step"))
    return metrics.newest(steps, 3, group="event_type")


@query("SELECT max(event_id) AS step FROM events WHERE event_type = 'purchase'")
def resume_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_with(table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("event_type") == "purchase").alias("has")), "has")


@query("""SELECT user_id, event_id, round(step_ms, 3) AS step_ms, round(CASE WHEN step_ms > 0 THEN value / (step_ms / 1000) END, 6) AS tokens_per_sec FROM (SELECT user_id, event_id, value, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1000.0::DOUBLE AS step_ms FROM events)""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return metrics.throughput(log, "user_id", "event_id", "us", "value", 1_000_000).select("user_id", "event_id", F.round("step_ms", 3).alias("step_ms"), F.round("tokens_per_sec", 6).alias("tokens_per_sec"))


# --- vectors ---------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)
    return e.select("vec_id", vector.doubles(F.col("embedding")).alias("x"))


_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings WHERE len(embedding) > 0)"
_ELEM = f"{_VEC}, el AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM v), bl AS (SELECT *, (i - 1) // 32 AS b FROM el)"


def _e4m3_sql(x: str) -> str:
    u = f"pow(2.0, greatest(floor(log2(greatest(abs(greatest(least({x}, 448.0), -448.0)), 1e-300))), -6.0) - 3)"
    return f"greatest(least(round_even(greatest(least({x}, 448.0), -448.0) / {u}, 0) * {u}, 448.0), -448.0)"


@query(f"WITH {_ELEM}, s AS (SELECT vec_id, greatest(max(abs(v)) / 127.0, 1e-8) AS scale FROM el GROUP BY vec_id) SELECT vec_id, string_agg((greatest(least(round_even(v / scale, 0), 127), -127))::INT::VARCHAR, ',' ORDER BY i) AS q, round(any_value(scale), 12) AS scale FROM el JOIN s USING (vec_id) GROUP BY vec_id")
def absmax_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _vectors(spark, sf_dir).select("vec_id", joined(vector.absmax_quantize(x)).alias("q"), F.round(vector.absmax_scale(x), 12).alias("scale"))


@query(f"WITH {_ELEM}, s AS (SELECT vec_id, greatest(max(abs(v)) / 7.0, 1e-8) AS scale FROM el GROUP BY vec_id) SELECT vec_id, round(sum(abs(v - greatest(least(round_even(v / scale, 0), 7), -7) * scale)), 9) AS error FROM el JOIN s USING (vec_id) GROUP BY vec_id")
def absmax_int4_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    back = vector.dequantize(vector.absmax_quantize(x, 4), vector.absmax_scale(x, 4))
    rows = _vectors(spark, sf_dir).select("vec_id", "x", back.alias("y"))
    return rows.select("vec_id", F.round(F.aggregate(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v), 9).alias("error"))


@query(f"WITH {_ELEM}, s AS (SELECT vec_id, b, ceil(log2(greatest(max(abs(v)), 1e-12) / 448.0))::INT AS e FROM bl GROUP BY vec_id, b) SELECT vec_id, string_agg(e::VARCHAR, ',' ORDER BY b) AS exponents FROM s GROUP BY vec_id")
def block_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    exponents = F.transform(vector.block_scales(F.col("x")), lambda s: F.rint(F.log2(s)).cast("int"))
    return _vectors(spark, sf_dir).select("vec_id", joined(exponents).alias("exponents"))


@query(f"WITH {_ELEM}, s AS (SELECT vec_id, b, greatest(ceil(log2(greatest(max(abs(v)), 1e-12) / 448.0))::INT, -126) AS e FROM bl GROUP BY vec_id, b) SELECT vec_id, string_agg(e::VARCHAR, ',' ORDER BY b) AS exponents FROM s GROUP BY vec_id")
def block_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", joined(vector.block_exponents(F.col("x"))).alias("exponents"))


@query(f"WITH {_ELEM}, s AS (SELECT vec_id, b, greatest(stddev_pop(v), 1e-12) AS sd, greatest(max(abs(v)), 1e-12) AS am FROM bl GROUP BY vec_id, b) SELECT vec_id, string_agg(ceil(log2(CASE WHEN sd < 1e-6 THEN am ELSE 3.0 * sd END / 448.0))::INT::VARCHAR, ',' ORDER BY b) AS exponents FROM s GROUP BY vec_id")
def sigma_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    exponents = F.transform(vector.sigma_scales(F.col("x")), lambda s: F.rint(F.log2(s)).cast("int"))
    return _vectors(spark, sf_dir).select("vec_id", joined(exponents).alias("exponents"))


@query(f"WITH {_ELEM}, s AS (SELECT vec_id, 448.0 / greatest(max(abs(v)), 1e-12) AS k FROM el GROUP BY vec_id), c AS (SELECT vec_id, v, {_e4m3_sql('(v * k)')} / k AS y FROM el JOIN s USING (vec_id)) SELECT vec_id, round(sum(y), 9) AS total, round(sum((v - y) * (v - y)), 9) AS error FROM c GROUP BY vec_id")
def fp8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "x", vector.fp8_cast(F.col("x")).alias("y"))
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 9)
    return rows.select("vec_id", add(F.col("y")).alias("total"), add(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))).alias("error"))


@query(f"""WITH {_ELEM}, s AS (SELECT vec_id, b, pow(2.0, ceil(log2(greatest(max(abs(v)), 1e-12) / 448.0))) AS sc FROM bl GROUP BY vec_id, b),
    m AS (SELECT vec_id, b, i, v, sc, {_e4m3_sql('(v / sc)')} AS main, v / sc AS inner_v FROM bl JOIN s USING (vec_id, b)),
    rs AS (SELECT vec_id, b, pow(2.0, ceil(log2(greatest(max(abs(inner_v - main)), 1e-12) / 7.0))) AS r FROM m GROUP BY vec_id, b),
    q AS (SELECT vec_id, i, v, sc, main, r, greatest(least(round_even((inner_v - main) / r, 0), 7), -7) AS k FROM m JOIN rs USING (vec_id, b)),
    y AS (SELECT vec_id, v, k, (main + k * r) * sc AS y FROM q)
    SELECT vec_id, sum(k)::BIGINT AS resid_sum, round(10 * log10(avg(v * v) / avg((v - y) * (v - y))), 6) AS snr FROM y GROUP BY vec_id""")
def residual_roundtrip_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "x", vector.residual_quantize(F.col("x")).alias("q")).withColumn("y", vector.residual_dequantize(F.col("q")))
    total = F.aggregate(F.col("q.resid"), F.lit(0), lambda a, v: a + v).cast("bigint")
    return rows.select("vec_id", total.alias("resid_sum"), F.round(vector.snr_db(F.col("x"), F.col("y")), 6).alias("snr"))


@query(f"WITH {_ELEM} SELECT vec_id, round(ln(sum(exp(v))), 9) AS logsumexp, round(ln(sum(exp(v))) - any_value(x[vec_id % 64 + 1]), 9) AS loss FROM el JOIN v vv USING (vec_id) GROUP BY vec_id".replace("JOIN v vv", "JOIN v AS w").replace("any_value(x[", "any_value(w.x["))
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _vectors(spark, sf_dir).select("vec_id", F.round(vector.logsumexp(x), 9).alias("logsumexp"), F.round(vector.softmax_loss(x, (F.col("vec_id") % 64).cast("int")), 9).alias("loss"))


@query(f"WITH {_ELEM}, k AS (SELECT vec_id, v, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS r FROM el) SELECT vec_id, count(*)::INT AS kept, round(sum(v), 9) AS total FROM k WHERE r <= 5 GROUP BY vec_id")
def top_k_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", F.sort_array(F.filter(vector.top_k(F.col("x"), 5), lambda v: v.isNotNull())).alias("k"))
    return rows.select("vec_id", F.size("k").alias("kept"), F.round(F.aggregate("k", F.lit(0.0), lambda s, v: s + v), 9).alias("total"))


@query(f"WITH {_ELEM}, p AS (SELECT vec_id, v, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM el), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT vec_id, count(*)::INT AS kept FROM c WHERE before < 0.5 GROUP BY vec_id")
def top_p_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.size(F.filter(vector.top_p(F.col("x"), 0.5), lambda v: v.isNotNull())).alias("kept"))


@query(f"WITH {_ELEM} SELECT vec_id, round(sum(v / r), 9) AS total FROM el JOIN (SELECT vec_id, sqrt(avg(v * v) + 1e-6) AS r FROM el GROUP BY vec_id) USING (vec_id) GROUP BY vec_id")
def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(F.aggregate(vector.rms_norm(F.col("x")), F.lit(0.0), lambda s, v: s + v), 9).alias("total"))


# --- schedules and series --------------------------------------------------------------------------------------------


@query("SELECT event_id AS step, CASE WHEN event_id % 100 = 0 THEN 2 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS tier, event_id % 4 = 0 AS highway FROM events")
def step_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("event_id")
    return table(spark, sf_dir, "events").select(s.alias("step"), schedule.tier_for_step(s, 100, 10).alias("tier"), schedule.highway(s).alias("highway"))


_SERIES = "e AS (SELECT user_id, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")


@query(f"WITH RECURSIVE {_SERIES}, g AS (SELECT user_id, event_id, rn, x AS ema FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, 0.9::DOUBLE * ema + (1 - 0.9::DOUBLE) * x FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1) SELECT user_id, event_id, round(ema, 9) AS ema FROM g")
def ema_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recurrence.ema(_events(spark, sf_dir), "user_id", ["event_id"], "value", 0.9)
    return out.select("user_id", "event_id", F.round("ema", 9).alias("ema"))


@query(f"""WITH RECURSIVE {_SERIES}, g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, NULL::DOUBLE AS ema, 0.0::DOUBLE AS ratio, 0::INT AS q FROM e WHERE rn = 1
    UNION ALL SELECT n.user_id, n.event_id, n.rn, CASE WHEN n.ratio > 3 THEN ema ELSE 0.95::DOUBLE * coalesce(ema, x) + (1 - 0.95::DOUBLE) * x END, n.ratio,
      CASE WHEN n.ratio > 3 AND n.rn - 1 >= 10 AND greatest(n.q - 1, 0) = 0 THEN greatest(3, ceil(log2(greatest(n.ratio, 1.001)) / {math.log2(1.1)}::DOUBLE * 2)::INT) ELSE greatest(n.q - 1, 0) END
      FROM (SELECT e.user_id, e.event_id, e.rn, e.x, g.ema, g.q, e.x / greatest(coalesce(g.ema, e.x), 1e-12) AS ratio FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1) n)
    SELECT user_id, event_id, round(ratio, 6) AS spike_ratio, ratio > 3 AS corrupt, q AS quarantine FROM g WHERE rn > 0""")
def spike_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recurrence.spike_quarantine(_events(spark, sf_dir), "user_id", ["event_id"], "value", threshold=3.0, decay=0.95, warmup=10)
    return out.select("user_id", "event_id", F.round("spike_ratio", 6).alias("spike_ratio"), "corrupt", "quarantine")


@query(f"""WITH RECURSIVE {_SERIES}, g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0.0::DOUBLE AS s, 'defensive' AS phase FROM e WHERE rn = 1
    UNION ALL SELECT n.user_id, n.event_id, n.rn, n.s2, CASE WHEN n.phase = 'defensive' AND n.s2 > 10 THEN 'offensive' ELSE n.phase END
      FROM (SELECT e.user_id, e.event_id, e.rn, g.phase, greatest(0.0, g.s + 1.875 - (e.x / 10 - 1) * (e.x / 10 - 1)) AS s2 FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1) n)
    SELECT user_id, event_id, round(s, 6) AS statistic, phase FROM g WHERE rn > 0""")
def cusum_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("value", F.col("value") / 10)
    return recurrence.cusum_phase(e, "user_id", ["event_id"], "value").select("user_id", "event_id", F.round("statistic", 6).alias("statistic"), "phase")


_STABLE = "st AS (SELECT user_id, event_id, row_number() OVER w AS rn, CASE WHEN count(value) OVER f < 2 THEN 0.0 WHEN abs(avg(value) OVER f) < 1e-12 THEN 1.0 ELSE 1 / (1 + stddev_samp(value) OVER f / abs(avg(value) OVER f)) END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"


@query(f"WITH {_STABLE} SELECT user_id, event_id, round(s, 6) AS stability FROM st")
def rolling_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrence.stability(_events(spark, sf_dir), "user_id", ["event_id"], "value").select("user_id", "event_id", F.round("stability", 6).alias("stability"))


@query(f"WITH RECURSIVE {_STABLE}, g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0 AS phase FROM st WHERE rn = 1 UNION ALL SELECT st.user_id, st.event_id, st.rn, phase + CASE WHEN phase < 3 AND s >= ([0.0, 0.4, 0.5, 0.6])[phase + 2] THEN 1 ELSE 0 END FROM g JOIN st ON st.user_id = g.user_id AND st.rn = g.rn + 1) SELECT user_id, event_id, phase FROM g WHERE rn > 0")
def progressive_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrence.progressive_phase(_events(spark, sf_dir), "user_id", ["event_id"], "value", (0.0, 0.4, 0.5, 0.6)).select("user_id", "event_id", "phase")


@query(f"""WITH RECURSIVE {_SERIES}, g AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0.0::DOUBLE AS ema, false AS on_, 0 AS sh FROM e WHERE rn = 1
    UNION ALL SELECT n.user_id, n.event_id, n.rn, n.em, CASE WHEN n.sh > 0 THEN n.on_ WHEN NOT n.on_ AND n.em < 8 THEN true WHEN n.on_ AND n.em > 9 THEN false ELSE n.on_ END,
      CASE WHEN n.sh > 0 THEN n.sh - 1 WHEN (NOT n.on_ AND n.em < 8) OR (n.on_ AND n.em > 9) THEN 5 ELSE n.sh END
      FROM (SELECT e.user_id, e.event_id, e.rn, g.on_, g.sh, 0.8::DOUBLE * g.ema + (1 - 0.8::DOUBLE) * e.x AS em FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1) n)
    SELECT user_id, event_id, round(ema, 6) AS ema, on_ AS enabled, sh AS shield FROM g WHERE rn > 0""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recurrence.hysteresis(_events(spark, sf_dir), "user_id", ["event_id"], "value", 8.0, 9.0, 5, 0.8)
    return out.select("user_id", "event_id", F.round("ema", 6).alias("ema"), "enabled", "shield")


@query("SELECT user_id, event_id, round(sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)), 6) AS root_mean_square FROM events")
def rolling_mean_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrence.rolling_mean_square(_events(spark, sf_dir), "user_id", ["event_id"], "value").select("user_id", "event_id", F.round(F.sqrt("mean_square"), 6).alias("root_mean_square"))


@query("SELECT user_id, event_id, best, best IS NULL OR value < best AS improved FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrence.best_before(_events(spark, sf_dir), "user_id", ["event_id"], "value").select("user_id", "event_id", "best", "improved")


@query("SELECT user_id, event_id, first, n >= 2 AND abs(first) > 1e-6 AND coalesce(value / nullif(first, 0) > 2, false) AS doubled FROM (SELECT *, first_value(value) OVER w AS first, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW))")
def kurtosis_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recurrence.kurtosis_alerts(_events(spark, sf_dir), "user_id", "event_id", "value")
    return out.select("user_id", "event_id", "first", F.coalesce("doubled", F.lit(False)).alias("doubled"))


@query("""SELECT CASE WHEN rule IN ('grad_norm', 'buffer') THEN 'WARNING' ELSE 'CRITICAL' END AS level, layer, rule, value, step FROM (
    SELECT user_id::VARCHAR AS layer, event_id AS step, value, CASE WHEN event_type = 'view' AND event_id % 10 = 0 AND value > 20 THEN 'grad_norm' WHEN event_type <> 'view' AND event_id % 100 = 0 AND value > 50 THEN 'buffer_far' WHEN event_type <> 'view' AND event_id % 100 = 0 AND value > 5 THEN 'buffer' END AS rule FROM events) WHERE rule IS NOT NULL""")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "grad_norm").otherwise("buffer")
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("step"), F.col("user_id").cast("string").alias("layer"), kind.alias("kind"), "value")
    return recurrence.threshold_alerts(rows, 20.0, 5.0)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY 1, 2")
def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"))


# --- tokenizer -------------------------------------------------------------------------------------------------------


@query()
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.pretoken_counts(table(spark, sf_dir, "documents"))


def learned(spark: SparkSession, docs: DataFrame) -> list[tuple[bytes, bytes]]:
    return tokenizer.learn_merges(tokenizer.pretoken_counts(docs), schedule.BPE_SIZE - 256)


@query()
def tokenizer_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenizer.compression(tokenizer.encoded_sizes(docs, learned(spark, docs)), overall="*")


@query()
def tokenizer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenizer.encoded_sizes(docs, learned(spark, docs)).select("doc_id", F.col("t").alias("tokens"), F.col("back").alias("same"))
