"""Queries of runs that are taken up again, streams, sources by language and chats in tokens, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.hashing import u01_sql
from millrace.operators import chat, decontam, dedup, mix, pack, recurrence, tokenizer
from millrace.operators.storage import scratch, written
from millrace.plans import corpus, models
from millrace.plans.corpus import WEIGHTS, table
from millrace.sources import files
from millrace.streaming import near, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# --- token runs ------------------------------------------------------------------------------------------------------

_CLOCK = f"sum(-ln(1 - {u01_sql(42, 'mix', 'doc_id')}) / CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 0.01 END) OVER (PARTITION BY lang ORDER BY doc_id)"
_COUNTS = f"len(list_filter(regexp_split_to_array(text, '{text.SPACES_SQL}+'), lambda x: x <> ''))"
BUDGET = 150_000


def word_lengths(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ids", F.transform(text.words(F.col("text")), F.length))


@query(f"""WITH c AS (SELECT doc_id, {_COUNTS} AS n, {_CLOCK} AS t FROM documents), m AS (SELECT doc_id, n, row_number() OVER (ORDER BY t, doc_id) - 1 AS position FROM c),
    o AS (SELECT doc_id, position, n, sum(n) OVER (ORDER BY position) - n AS began FROM m WHERE n > 0)
    SELECT doc_id, position, began::BIGINT AS "offset", n::BIGINT AS length FROM o WHERE began < {BUDGET}""")
def resumed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run up to a budget that is cut twice and taken up again, with batches of other sizes: the index of one run."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), scratch(spark)
    for take, batches in ((70, 1), (130, 1), (1_000_000, None)):
        tokens.run(docs, path, word_lengths, WEIGHTS, take=take, batches=batches, max_tokens=BUDGET)
    return tokens.read(spark, path).select(F.col("key").alias("doc_id"), "position", "offset", "length")


@query(f"""SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS "offset", n::BIGINT AS length FROM (SELECT doc_id, {_COUNTS} AS n FROM documents) WHERE n > 0""")
def streamed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, written once as tokens; then the query starts again on its checkpoint and adds nothing.

    The token table's positions count texts without words too, those of the result only the texts that are written."""
    shape, path, checkpoint = table(spark, sf_dir, "documents").schema, scratch(spark), scratch(spark)
    for _ in range(2):
        source = spark.readStream.schema(shape).parquet(f"{sf_dir}/documents.parquet*")
        tokens.stream(source, path, checkpoint, word_lengths).awaitTermination()
    index = tokens.read(spark, path).select(F.col("key").alias("doc_id"), "position", "offset", "length", F.lit(1).alias("one"))
    return pack.ordered_positions(index, "position", "one").select("doc_id", F.col("start").alias("position"), "offset", "length")


@query(models.ORACLES["near_dups_ring"])
def near_dups_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring over documents as a stream, in order of id."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark)
    source = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")
    near.stream(source, path, scratch(spark), size=models.RING, num_perm=corpus.PERMUTATIONS, bands=corpus.BANDS).awaitTermination()
    stays = near.kept(spark, path).select(F.col("key").alias("doc_id"), F.lit(True).alias("k"))
    return docs.select("doc_id").join(stays, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(False)).alias("kept"))


# --- near-duplicates and contamination -------------------------------------------------------------------------------


@query(f"""WITH {corpus.signature_cte('documents', 'text')}, {corpus.pairs_cte()}
    SELECT doc_id, k::INT AS band, min(doc_id) OVER w AS first, count(*) OVER w AS members FROM band WINDOW w AS (PARTITION BY k, part)""")
def lsh_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets as stars: a row for each document and band, whatever the size of a bucket."""
    return dedup.memberships(written(dedup.signed_texts(table(spark, sf_dir, "documents"), num_perm=corpus.PERMUTATIONS)), bands=corpus.BANDS)


@query(corpus.ORACLES["decontam_flags"])
def decontam_flags_by_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontam_flags with a test set that counts as too large for a broadcast."""
    return decontam.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), broadcast=0)


# --- sources ---------------------------------------------------------------------------------------------------------

SKIPS, SHORT = 4, 900


@query(f"""WITH r AS (SELECT doc_id, lang, coalesce(length({corpus.strip_sql('text')}) >= {SHORT}, false) AS ok, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents),
    g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn, p - coalesce(lag(p) OVER (PARTITION BY lang ORDER BY doc_id), 0) - 1 AS skipped FROM r WHERE ok),
    e AS (SELECT lang, min(turn) AS stop FROM g WHERE skipped >= {SKIPS} GROUP BY lang)
    SELECT doc_id, g.lang, turn FROM g LEFT JOIN e USING (lang) WHERE turn < coalesce(stop, turn + 1) AND turn <= CASE g.lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in mix.quotas(WEIGHTS, 2001).items())} ELSE 0 END""")
def quota_given_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota whose languages are given up at a few short texts in a row."""
    return mix.quota_sample(table(spark, sf_dir, "documents"), WEIGHTS, 2001, least=SHORT, most_skips=SKIPS)


_BY_LANGUAGE = f"SELECT lower(lang) AS lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents WHERE lower(lang) IN ('de', 'fr') AND length({corpus.strip_sql('text')}) > 50 GROUP BY 1"


def _by_language(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(_BY_LANGUAGE)
def language_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two languages of documents, written by language and read by partition."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark)
    files.write_by_language(docs, path)
    return _by_language(files.language_samples(spark, path, docs.limit(0), ["FR", "De", "none"]))


@query(_BY_LANGUAGE)
def language_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where there is no table by language: the whole set is read."""
    return _by_language(files.language_samples(spark, scratch(spark), table(spark, sf_dir, "documents"), ["FR", "De", "none"]))


# --- chats -----------------------------------------------------------------------------------------------------------

#: Merges that the chat tokens are learned with; and tokens of a row.
CHAT_MERGES, CHAT_TOKENS = 500, 512


@query()
def sft_token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in tokens that are learned of them: inputs, positions that train, and a digest of both."""
    turns = table(spark, sf_dir, "conversations")
    merges = tokenizer.learn_merges(tokenizer.pretoken_counts(turns), CHAT_MERGES)
    rows = chat.sft_tokens(chat.conversations(turns), merges, "conv_id", F.lit(chat.DEFAULT_SYSTEM), CHAT_TOKENS)
    shown = F.concat_ws(";", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("input_ids", "targets")])
    return rows.select("conv_id", F.size("input_ids").alias("n_input"), F.size(F.filter("targets", lambda t: t >= 0)).alias("n_loss"), F.md5(shown.cast("binary")).alias("rows_md5"))


@query(f"""WITH t AS (SELECT conv_id, list({{'r': role, 'c': coalesce(text, '')}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, conv_id % 4 AS shape, m, list_filter(m, lambda x: x.r = 'user')[1].c AS q, list_filter(m, lambda x: x.r = 'assistant')[1].c AS a FROM t),
    s AS (SELECT conv_id, shape, CASE WHEN shape = 0 THEN m WHEN shape = 1 THEN list_filter(m, lambda x: x.r IN ('user', 'assistant'))
          WHEN q IS NOT NULL AND a IS NOT NULL THEN [{{'r': 'user', 'c': q}}, {{'r': 'assistant', 'c': a}}] END AS m FROM p)
    SELECT conv_id, len(m)::INT AS turns, CASE WHEN conv_id % 3 = 0 THEN 'be brief' ELSE '{chat.DEFAULT_SYSTEM}' END AS system, md5(array_to_string(list_transform(m, lambda x: x.r || ':' || x.c), '|')) AS chat_md5 FROM s WHERE len(m) > 0""")
def sft_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of four shapes, by id, and parsed again."""
    chats = chat.conversations(table(spark, sf_dir, "conversations"))
    said = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shared = F.transform(said, lambda m: F.struct(name(m["role"]).alias("from"), F.lit(None).cast("string").alias("role"), m["content"].alias("value"), F.lit(None).cast("string").alias("content")))
    first = lambda role: F.get(F.filter(said, lambda m: m["role"] == role), F.lit(0))["content"]
    shape = F.col("conv_id") % 4
    sides = {"instruction": (2, "user"), "response": (2, "assistant"), "problem": (3, "user"), "solution": (3, "assistant")}
    records = chats.select(
        "conv_id", F.when(shape == 0, said).alias("messages"), F.when(shape == 1, shared).alias("conversations"),
        *[F.when(shape == s, first(role)).alias(c) for c, (s, role) in sides.items()], F.when(F.col("conv_id") % 3 == 0, "be brief").alias("system"),
    )
    shown = F.array_join(F.transform("chat_messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return chat.parsed(records).select("conv_id", F.size("chat_messages").alias("turns"), "system", F.md5(shown.cast("binary")).alias("chat_md5"))


# --- alerts ----------------------------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN rule IN ('grad_norm', 'buffer') THEN 'WARNING' ELSE 'CRITICAL' END AS level, layer, rule, step FROM (
    SELECT user_id::VARCHAR AS layer, event_id AS step, CASE WHEN event_type = 'view' AND NOT isfinite(v) THEN 'non_finite_gradient' WHEN event_type = 'click' AND NOT isfinite(v) THEN 'non_finite_loss'
      WHEN event_type = 'view' AND event_id % 10 = 0 AND v > 20 THEN 'grad_norm' WHEN event_type NOT IN ('view', 'click') AND event_id % 100 = 0 AND v > 50 THEN 'buffer_far'
      WHEN event_type NOT IN ('view', 'click') AND event_id % 100 = 0 AND v > 5 THEN 'buffer' END AS rule
    FROM (SELECT *, CASE event_id % 97 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE ELSE value END AS v FROM events)) WHERE rule IS NOT NULL""")
def non_finite_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all three tiers, over events of which some have lost their value."""
    broken = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("event_id") % 97 == 1, float("inf")).when(F.col("event_id") % 97 == 2, float("-inf")).otherwise(F.col("value"))
    kind = F.when(F.col("event_type") == "view", "grad_norm").when(F.col("event_type") == "click", "loss").otherwise("buffer")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("user_id").cast("string").alias("layer"), kind.alias("kind"), broken.alias("value"))
    return recurrence.threshold_alerts(rows, 20.0, 5.0).select("level", "layer", "rule", "step")
