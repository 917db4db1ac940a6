"""Queries of the corpus pipeline, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import quality, text
from millrace.functions.hashing import u01_sql
from millrace.functions.syntax import syntax_of
from millrace.functions.text import BLANK_SQL, EXTENSION_LANGUAGE, SPACES_SQL
from millrace.operators import decontam, dedup, mix, pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Weights of the test tables' languages.
WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
SUFFIXES = [*list(EXTENSION_LANGUAGE), ".txt", ".PY", ""]


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL of the scalar functions -------------------------------------------------------------------------------------


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACES_SQL}+|{SPACES_SQL}+\z', '', 'g')"


def whitespace_sql(x: str) -> str:
    out = rf"regexp_replace(replace({x}, chr(9), '    '), '{BLANK_SQL}+(\n|\z)', '\1', 'g')"
    out = rf"regexp_replace({out}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"
    return f"({strip_sql(out)} || chr(10))"


#: A chain of CTEs from t(doc_id, lang, text) to p(doc_id, lang, text, code): header, white space, filters.
PREPROCESS_SQL = rf"""
h1 AS (SELECT *, regexp_extract(text, '(?s)\A/\*.*?\*/\s*\n') AS m1 FROM t),
l1 AS (SELECT *, CASE WHEN contains(lower(m1), 'license') THEN substr(text, length(m1) + 1) ELSE text END AS c1 FROM h1),
h2 AS (SELECT *, regexp_extract(c1, '(?i)\A#[^\n]*license[^\n]*\n(?:#[^\n]*\n)*') AS m2 FROM l1),
l2 AS (SELECT *, CASE WHEN contains(lower(m2), 'license') THEN substr(c1, length(m2) + 1) ELSE c1 END AS c2 FROM h2),
h3 AS (SELECT *, regexp_extract(c2, '(?i)\A//[^\n]*license[^\n]*\n(?://[^\n]*\n)*') AS m3 FROM l2),
l3 AS (SELECT *, regexp_replace(CASE WHEN contains(lower(m3), 'license') THEN substr(c2, length(m3) + 1) ELSE c2 END, '\A\n+', '') AS c3 FROM h3),
n1 AS (SELECT doc_id, lang, text, {whitespace_sql('c3')} AS w FROM l3),
p AS (SELECT doc_id, lang, text, CASE WHEN text IS NOT NULL AND NOT regexp_matches(text, '\A{SPACES_SQL}*\z')
      AND length(w) - length(replace(w, chr(10), '')) + 1 BETWEEN 3 AND 10000
      AND list_max(list_transform(string_split(w, chr(10)), lambda x: length(x))) <= 1000 THEN w END AS code FROM n1)"""

#: From p to q(doc_id, lang, code, quality).
QUALITY_SQL = rf"""
b0 AS (SELECT doc_id, lang, code, {strip_sql('code')} AS body FROM p WHERE code IS NOT NULL),
b1 AS (SELECT *, string_split(body, chr(10)) AS ls FROM b0),
b2 AS (SELECT *, len(ls) AS n, list_sum(list_transform(ls, lambda x: length(x))) / len(ls) AS al,
       len(list_filter(ls, lambda x: regexp_matches(x, '\A{BLANK_SQL}*(#|//)'))) / len(ls) AS cr FROM b1),
rl AS (SELECT doc_id, sum(c - 1) AS r FROM (SELECT doc_id, l, count(*) AS c FROM
       (SELECT doc_id, {strip_sql('u')} AS l FROM (SELECT doc_id, unnest(ls) AS u FROM b1)) WHERE length(l) > 5 GROUP BY doc_id, l) WHERE c > 2 GROUP BY doc_id),
ids AS (SELECT doc_id, avg(length(w)) AS il FROM (SELECT doc_id, unnest(regexp_extract_all(code, '[\p{{L}}\p{{N}}_]+')) AS w FROM b0)
        WHERE regexp_matches(w, '\A[a-zA-Z_][a-zA-Z0-9_]*\z') GROUP BY doc_id),
q AS (SELECT doc_id, lang, code, CASE WHEN body = '' OR n < 3 THEN 0.0 ELSE (
       CASE WHEN al BETWEEN 20 AND 100 THEN 1.0 WHEN al < 10 OR al > 200 THEN 0.2 ELSE 0.6 END::DOUBLE
     + CASE WHEN cr BETWEEN 0.05 AND 0.30 THEN 1.0 WHEN cr > 0.5 THEN 0.3 WHEN cr = 0 THEN 0.6 ELSE 0.7 END::DOUBLE
     + CASE WHEN regexp_matches(code, '(\A|[^\p{{L}}\p{{N}}_])(def|class|function|fn|func)\s+[\p{{L}}\p{{N}}_]')
              OR regexp_matches(code, '(public|private|protected)\s+[\p{{L}}\p{{N}}_]+\s+[\p{{L}}\p{{N}}_]+\s*\(') THEN 1.0 ELSE 0.5 END::DOUBLE
     + greatest(0.0, 1.0 - coalesce(r, 0)::DOUBLE / n * 3)
     + coalesce(least(1.0, il / 5.0), 0.3)::DOUBLE) / 5.0 END AS quality
     FROM b2 LEFT JOIN rl USING (doc_id) LEFT JOIN ids USING (doc_id))"""
SOURCE_SQL = "t AS (SELECT doc_id, lang, text FROM documents)"


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", text.preprocessed(F.col("text")).alias("code"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _processed(spark, sf_dir).where("code is not null").withColumn("syntax", syntax_of(F.col("code"), F.col("lang")))
    return code.withColumn("q", quality.quality_score(F.col("code"), F.col("lang"), F.col("syntax")))


@query(f"WITH {SOURCE_SQL}, {PREPROCESS_SQL}, {QUALITY_SQL} SELECT lang, count(*) AS docs, round(avg(quality), 9) AS mean_quality FROM q WHERE quality >= 0.35 GROUP BY lang")
def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.when(F.col("q") >= 0.35, F.col("q"))  # no filter: pushed below the score, it would compute it twice
    out = _scored(spark, sf_dir).groupBy("lang").agg(F.count(good).alias("docs"), F.round(F.avg(good), 9).alias("mean_quality"))
    return out.where("docs > 0")


@query(f"WITH {SOURCE_SQL}, {PREPROCESS_SQL} SELECT doc_id, code IS NOT NULL AS kept, length(code) AS chars, md5(code) AS code_md5 FROM p")
def preprocess_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(spark, sf_dir).select("doc_id", F.col("code").isNotNull().alias("kept"), F.length("code").cast("bigint").alias("chars"), F.md5(F.col("code").cast("binary")).alias("code_md5"))


@query(f"WITH {SOURCE_SQL}, {PREPROCESS_SQL}, {QUALITY_SQL} SELECT doc_id, round(quality, 9) AS quality, quality >= 0.3 AS passes FROM q")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return scored.select("doc_id", F.round("q", 9).alias("quality"), (F.col("q") >= 0.3).alias("passes"))


@query(rf"""SELECT doc_id, round(least(1.0, (0.5 * len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ({', '.join(repr(w) for w in quality.CONTROL_WORDS)})))
    + least(list_max(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '\A\s*\z') THEN 0 ELSE length(x) - length(regexp_replace(x, '\A\s+', '')) END)) / 4.0, 5.0)) / 20.0), 9)::DOUBLE AS complexity FROM documents""")
def complexity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.complexity_score(F.col("text")), 9).alias("complexity"))


def _paths() -> str:
    return ", ".join(repr(s) for s in SUFFIXES)


@query(f"""WITH s AS (SELECT doc_id, 'src/f' || doc_id || list_extract([{_paths()}], (doc_id % {len(SUFFIXES)} + 1)::INT) AS path FROM documents)
    SELECT doc_id, path, (MAP {{{', '.join(f"'{k}': '{v}'" for k, v in EXTENSION_LANGUAGE.items())}}})[nullif(regexp_extract(path, '(\\.[A-Za-z]+)\\z', 1), '')] AS language FROM s""")
def lang_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES)).cast("int"))
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return paths.withColumn("language", text.language_of_path(F.col("path")))


@query(f"SELECT doc_id, md5({whitespace_sql('text')}) AS ws_md5 FROM documents")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text")).cast("binary")).alias("ws_md5"))


@query("SELECT doc_id, lang, length(text)::BIGINT AS chars FROM documents WHERE lower(lang) = 'fr' AND length(regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g')) > 50".replace("\\s", SPACES_SQL))
def language_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.lower("lang") == "fr").where(F.length(text.strip(F.col("text"))) > 50)
    return docs.select("doc_id", "lang", F.length("text").cast("bigint").alias("chars"))


@query("""SELECT 'documents' AS origin, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL
    SELECT 'benchmark', count(*), sum(length(text))::BIGINT FROM benchmark UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations""")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("origin"), text.first_truthy(F.lit(None).cast("string"), F.lit(""), F.col("text")).alias("text")) for n in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


# --- decontamination -------------------------------------------------------------------------------------------------


def ngrams_sql(x: str, n: int, lower: bool) -> str:
    w = f"list_filter(regexp_split_to_array({'lower(' + x + ')' if lower else x}, '{SPACES_SQL}+'), lambda w: w <> '')"
    return f"(SELECT CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(generate_series(1, greatest(len(ws) - {n - 1}, 1)), lambda i: array_to_string(list_slice(ws, i, i + {n - 1}), ' ')) END FROM (SELECT {w} AS ws))"


def grams_cte(name: str, source: str, key: str, column: str, n: int, lower: bool) -> str:
    """name(key, g): exploded n-grams, by position."""
    x = f"lower({column})" if lower else column
    return f"""{name}_w AS (SELECT {key}, list_filter(regexp_split_to_array({x}, '{SPACES_SQL}+'), lambda w: w <> '') AS ws FROM {source}),
    {name} AS (SELECT {key}, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g FROM (SELECT {key}, ws, unnest(generate_series(1, greatest(len(ws) - {n - 1}, 1))) AS i FROM {name}_w WHERE len(ws) > 0))"""


def flags_cte(source: str, column: str) -> str:
    return f"""{grams_cte('bg', 'benchmark', 'item_id', 'text', 10, True)}, {grams_cte('dg', source, 'doc_id', column, 10, True)},
    dd AS (SELECT DISTINCT doc_id, g FROM dg), hit AS (SELECT doc_id, count(*) AS shared FROM dd WHERE g IN (SELECT g FROM bg) GROUP BY doc_id),
    tot AS (SELECT doc_id, count(*) AS ngrams FROM dd GROUP BY doc_id),
    flag AS (SELECT s.doc_id, coalesce(ngrams, 0) AS ngrams, coalesce(shared, 0) AS shared, coalesce(ngrams, 0) > 0 AND coalesce(shared, 0) / greatest(ngrams, 1) >= 0.1 AS contaminated
             FROM {source} s LEFT JOIN tot USING (doc_id) LEFT JOIN hit USING (doc_id))"""


@query(f"WITH {flags_cte('documents', 'text')} SELECT * FROM flag")
def decontam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"WITH {flags_cte('documents', 'text')} SELECT lang, count(*) AS docs FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM flag WHERE contaminated) GROUP BY lang")
def decontam_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.clean(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


# --- near-duplicates -------------------------------------------------------------------------------------------------

PERMUTATIONS, BANDS = 128, 16


def signature_cte(source: str, column: str, n: int = PERMUTATIONS) -> str:
    """sig(doc_id, signature): minima of each permutation in order."""
    a, b = dedup.family(n)
    values = ", ".join(f"({i}, {x}::HUGEINT, {y}::HUGEINT)" for i, (x, y) in enumerate(zip(a, b, strict=True)))
    return f"""{grams_cte('sg', source, 'doc_id', column, 5, False)},
    hs AS (SELECT DISTINCT doc_id, ('0x' || substr(s, 7, 2) || substr(s, 5, 2) || substr(s, 3, 2) || substr(s, 1, 2))::BIGINT AS h FROM (SELECT doc_id, sha1(g) AS s FROM sg)),
    perm(i, a, b) AS (VALUES {values}),
    mins AS (SELECT doc_id, i, min((((a * h + b) % {dedup.PRIME}::HUGEINT) % 4294967296)::BIGINT) AS v FROM hs, perm GROUP BY doc_id, i),
    sig AS (SELECT d.doc_id, coalesce(l, list_transform(generate_series(1, {n}), lambda x: {dedup.MAX_HASH}::BIGINT)) AS signature FROM {source} d LEFT JOIN (SELECT doc_id, list(v ORDER BY i) AS l FROM mins GROUP BY doc_id) USING (doc_id))"""


def pairs_cte(n: int = PERMUTATIONS, bands: int = BANDS) -> str:
    rows = n // bands
    return f"""band AS (SELECT doc_id, k, list_slice(signature, k * {rows} + 1, k * {rows} + {rows}) AS part FROM sig, generate_series(0, {bands - 1}) g(k)),
    cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM band x JOIN band y ON x.k = y.k AND x.part = y.part AND x.doc_id < y.doc_id),
    sim AS (SELECT a, b, len(list_filter(list_zip(x.signature, y.signature), lambda z: z[1] = z[2])) / {n}.0::DOUBLE AS estimate FROM cand JOIN sig x ON x.doc_id = a JOIN sig y ON y.doc_id = b)"""


GREEDY_CTE = """e AS (SELECT a, b FROM sim WHERE estimate >= 0.8), nb AS (SELECT b AS id, list(a) AS before FROM e GROUP BY b),
    node AS (SELECT row_number() OVER (ORDER BY id) AS rn, id, before FROM nb),
    g(rn, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT node.rn, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, id) ELSE dropped END FROM g JOIN node ON node.rn = g.rn + 1),
    gone AS (SELECT unnest(dropped) AS doc_id FROM g WHERE rn = (SELECT max(rn) FROM g))"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signed_texts(table(spark, sf_dir, "documents"), num_perm=PERMUTATIONS)


@query(f"WITH {grams_cte('sg', 'documents', 'doc_id', 'text', 5, False)} SELECT doc_id, count(*) AS shingles, count(DISTINCT g) AS distinct_shingles FROM sg GROUP BY doc_id")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = text.word_ngrams(text.words(F.col("text")), 5)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(grams).cast("bigint").alias("shingles"), F.size(F.array_distinct(grams)).cast("bigint").alias("distinct_shingles"))
    return rows.where("shingles > 0")


@query(f"WITH {signature_cte('documents', 'text')} SELECT doc_id, array_to_string(signature, ',') AS signature FROM sig")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query(f"WITH {signature_cte('documents', 'text')}, {pairs_cte()} SELECT a, b, estimate FROM sim")
def lsh_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(dedup.written(_signed(spark, sf_dir)), 0.0, bands=BANDS)


@query(f"WITH RECURSIVE {signature_cte('documents', 'text')}, {pairs_cte()}, {GREEDY_CTE} SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM documents")
def near_dups_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(table(spark, sf_dir, "documents"), num_perm=PERMUTATIONS, bands=BANDS)


@query("SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_FUNNEL = f"""WITH RECURSIVE {SOURCE_SQL}, {PREPROCESS_SQL}, {QUALITY_SQL},
    low AS (SELECT d.doc_id, d.lang, q.code, q.code IS NULL OR quality < 0.3 OR (quality < 0.5 AND {u01_sql(42, 'down', 'd.doc_id')} < 0.3) AS low FROM documents d LEFT JOIN q USING (doc_id)),
    good AS (SELECT doc_id, code FROM low WHERE NOT low), {signature_cte('good', 'code')}, {pairs_cte()}, {GREEDY_CTE},
    kept AS (SELECT * FROM good WHERE doc_id NOT IN (SELECT doc_id FROM gone)), {flags_cte('kept', 'code')},
    staged AS (SELECT low.doc_id, lang, low.code, CASE WHEN low THEN 'quality_filtered' WHEN low.doc_id IN (SELECT doc_id FROM gone) THEN 'dedup_filtered' WHEN contaminated THEN 'decontam_filtered' ELSE 'passed' END AS stage
               FROM low LEFT JOIN flag USING (doc_id))"""


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.funnel(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), num_perm=PERMUTATIONS, bands=BANDS)


@query(f"{_FUNNEL} SELECT doc_id, lang, stage FROM staged")
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir).select("doc_id", "lang", "stage")


@query(f"{_FUNNEL} SELECT stage, count(*) AS rows, round(100.0 * count(*) / (SELECT count(*) FROM staged), 6)::DOUBLE AS percent FROM staged GROUP BY stage")
def filter_funnel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.funnel_stats(_funnel(spark, sf_dir))


# --- mixing, FIM, packing --------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT doc_id, lang, sum(-ln(1 - {u01_sql(42, 'mix', 'doc_id')}) / CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 0.01 END) OVER (PARTITION BY lang ORDER BY doc_id) AS t FROM documents)
    SELECT doc_id, lang, row_number() OVER (ORDER BY t, doc_id) - 1 AS position FROM c""")
def weighted_mix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_order(table(spark, sf_dir, "documents"), WEIGHTS)


@query(f"""SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents WHERE length({strip_sql('text')}) >= 50)
    WHERE turn <= CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in mix.quotas(WEIGHTS, 201).items())} ELSE 0 END""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.quota_sample(table(spark, sf_dir, "documents"), WEIGHTS, 201)


@query(f"""WITH t AS (SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS raw FROM documents) WHERE raw > 5 AND length({strip_sql('text')}) > 50), {PREPROCESS_SQL}, {QUALITY_SQL}
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM q WHERE quality >= 0.3 ORDER BY turn, lang LIMIT 100""")
def eval_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.round_robin(table(spark, sf_dir, "documents"), 100, skip=5)


@query(f"""WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents),
    a AS (SELECT *, floor({u01_sql(7, 'fim_start', 'doc_id')} * (n - 1))::INT AS st FROM s),
    w AS (SELECT *, least(st + greatest(floor(n / 4)::INT, 2), n) AS wide FROM a),
    f AS (SELECT *, least((st + 1 + floor({u01_sql(7, 'fim_end', 'doc_id')} * (wide - st)))::INT, wide) AS en FROM w)
    SELECT doc_id, n >= 3 AND {u01_sql(7, 'fim', 'doc_id')} < 0.5 AS transformed, md5(CASE WHEN n >= 3 AND {u01_sql(7, 'fim', 'doc_id')} < 0.5 THEN
      '<|fim_prefix|>' || array_to_string(list_slice(ls, 1, st), chr(10)) || '<|fim_suffix|>' || array_to_string(list_slice(ls, en + 1, n), chr(10)) || '<|fim_middle|>' || array_to_string(list_slice(ls, st + 1, en), chr(10))
      ELSE text END) AS fim_md5 FROM f""")
def fim_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = mix.fim_sample(F.col("text"), 0.5, 7, F.col("doc_id"))
    return docs.select("doc_id", made.startswith(text.FIM_PREFIX).alias("transformed"), F.md5(made.cast("binary")).alias("fim_md5"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("length"))


@query("SELECT doc_id, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS offset, length(text)::BIGINT AS length FROM documents WHERE length(text) > 0")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.token_index(_lengths(spark, sf_dir))


@query('SELECT count(*) AS samples, sum(length)::BIGINT AS tokens FROM (SELECT length(text) AS length, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS "offset" FROM documents WHERE length(text) > 0) WHERE "offset" < 500000')
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.budget_prefix(pack.token_index(_lengths(spark, sf_dir)), 500_000).agg(F.count(F.lit(1)).alias("samples"), F.sum("length").alias("tokens"))


@query("""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x)::INT) AS ids FROM documents),
    r AS (SELECT doc_id, unnest(list_append(ids, 0)) AS id, generate_subscripts(list_append(ids, 0), 1) AS i FROM w WHERE len(ids) > 0),
    p AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM r),
    c AS (SELECT pos // 65 AS chunk, list(id ORDER BY pos) AS l FROM p GROUP BY 1 HAVING count(*) = 65)
    SELECT chunk, array_to_string(list_slice(l, 1, 64), ',') AS input_ids, array_to_string(list_slice(l, 2, 65), ',') AS targets FROM c""".replace("\\s", SPACES_SQL))
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(text.words(F.col("text")), F.length)
    out = pack.packed(table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")), 64)
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("input_ids", "targets")}
    return out.withColumns(joined)


@query(f"SELECT doc_id, position, (position % 4)::INT AS worker FROM (SELECT doc_id, row_number() OVER (ORDER BY {u01_sql(45, 'epoch', 'doc_id')}, doc_id) - 1 AS position FROM documents)")
def epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = pack.epoch_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42, 3)
    return pack.worker_split(order, 4).select("doc_id", "position", "worker")


@query("""WITH RECURSIVE f AS (SELECT source AS repo, 'f' || lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS path, text AS content FROM documents),
    s AS (SELECT *, length('<|file_sep|>' || path || chr(10)) AS o, length('<|repo_name|>' || repo || chr(10)) AS base, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM f),
    g AS (SELECT repo, rn, path, 0 AS pack, o + length(content) <= 7000 AS open, CASE WHEN o + length(content) > 7000 THEN 0 ELSE base + o + length(content) END AS chars FROM s WHERE rn = 1
      UNION ALL SELECT s.repo, s.rn, s.path, g.pack + CASE WHEN s.o + length(s.content) > 7000 OR NOT g.open OR g.chars + s.o + length(s.content) > 7000 THEN 1 ELSE 0 END,
        s.o + length(s.content) <= 7000,
        CASE WHEN s.o + length(s.content) > 7000 THEN 0 WHEN NOT g.open OR g.chars + s.o + length(s.content) > 7000 THEN base + s.o + length(s.content) ELSE g.chars + s.o + length(s.content) END
      FROM g JOIN s ON s.repo = g.repo AND s.rn = g.rn + 1)
    SELECT repo, pack, count(*)::INT AS n_files, md5('<|repo_name|>' || repo || chr(10) || string_agg('<|file_sep|>' || path || chr(10) || CASE WHEN o + length(content) > 7000 THEN substr(content, 1, 7000 - 100 - o) ELSE content END, chr(10) ORDER BY path)) AS text_md5
    FROM g JOIN s USING (repo, path) GROUP BY repo, pack""")
def repo_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    packs = pack.repository_packs(files, "repo", "path", "content", max_tokens=2000)
    return packs.select("repo", "pack", "n_files", F.md5(F.col("text").cast("binary")).alias("text_md5"))
