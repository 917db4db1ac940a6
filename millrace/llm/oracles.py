"""DuckDB SQL that says the same as queries of this subpackage, by plainer means: all pairs, all shards, list arithmetic."""

from __future__ import annotations

from millrace.llm import line_dedup, merkle, secret_scan

#: The 256 values of the CRC-32 table by its rule.
_CRC_TABLE = "tb AS (SELECT list_transform(generate_series(0, 255), lambda n: list_reduce(generate_series(1, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tbl)"


def _crc32(x: str) -> str:
    step = "lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])"
    return f"CASE WHEN {x} = '' THEN 0 ELSE xor(list_reduce(list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::BIGINT), {step}, 4294967295), 4294967295) END"


def shards(count: int, rows_per_bucket: int) -> str:
    return f"""
    WITH {_CRC_TABLE},
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
    u AS (SELECT r, s, ('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT AS u FROM d, generate_series(0, {count}) g(s)),
    best AS (SELECT r, arg_max(s, (u, -s)) FILTER (WHERE s < {count}) AS shard, arg_max(s, (u, -s)) AS grown FROM u GROUP BY r),
    z AS (SELECT d.doc_id, octet_length(encode(text)) + 16 AS size, {_crc32('text')} AS text_crc32, shard, grown,
          {_crc32("coalesce(doc_id::VARCHAR, '')")} % greatest(4, ceil((SELECT count(*) FROM d) / {count} / {rows_per_bucket}))::BIGINT AS bucket FROM d JOIN best USING (r), tb)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard FROM z"""


#: Shared shingles of all pairs, then reachability.
COMPONENTS = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
    z AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT z.b, r.c FROM r JOIN z ON z.a = r.doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c USING (doc_id)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(kind: str, pattern: str, least: int, group: int) -> str:
    p = _quoted(pattern)
    return f"""SELECT key, '{kind}' AS kind, began AS start, began + length(hit) AS stop, value FROM (
        SELECT key, hit, regexp_extract(hit, {p}, {group}) AS value,
               list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS began
        FROM (SELECT key, m, g, unnest(m) AS hit, generate_subscripts(m, 1) AS i FROM (SELECT key, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM t WHERE regexp_matches(text, {p})))) WHERE length(value) >= {least}"""


def secrets() -> str:
    base = " UNION ALL ".join(_kind(*rule) for rule in secret_scan.BASE)
    live = f"(length(regexp_replace(value, '[^0-9]', '', 'g')) >= {secret_scan.LEAST_DIGITS} AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= {secret_scan.LEAST_LETTERS} AND len(list_distinct(string_split(value, ''))) >= {secret_scan.LEAST_DISTINCT})"
    rank = "CASE kind WHEN 'assign' THEN 1 WHEN 'access' THEN 2 WHEN 'hex' THEN 3 ELSE 4 END"
    span = "kind || ':' || start || ':' || stop"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key FROM documents),
    t AS (SELECT DISTINCT key, text FROM d), b AS ({base}),
    o AS (SELECT * FROM ({_kind('owned', secret_scan.OWNED, 20, 0)}) x WHERE {live} AND NOT EXISTS (SELECT 1 FROM b WHERE b.key = x.key AND b.start < x.stop AND b.stop > x.start)),
    a AS (SELECT * FROM b UNION ALL SELECT * FROM o),
    c AS (SELECT value, count(DISTINCT owner) AS owners FROM a JOIN d USING (key) GROUP BY value),
    v AS (SELECT a.*, CASE WHEN owners > {secret_scan.MAX_OWNERS} THEN 'example' WHEN {live} THEN 'live' ELSE 'weak' END AS verdict FROM a JOIN c USING (value)),
    k AS (SELECT * FROM v WHERE kind <> 'owned' OR verdict = 'live'),
    s AS (SELECT key, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
          coalesce(string_agg({span}, ',' ORDER BY start, {rank}) FILTER (WHERE kind <> 'owned'), '') AS base, string_agg({span}, ',' ORDER BY start, {rank}) AS spans,
          count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example FROM k GROUP BY key)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN s USING (key)"""


#: Plain grouping by client: no vectors, no salts.
def cohort_cells() -> str:
    return f"""
    WITH {_CRC_TABLE},
    e AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
    h AS (SELECT *, {_crc32("click_id::VARCHAR")} AS h FROM e, tb),
    k AS (SELECT client_id, epoch_us(ts) AS us, kind = 'purchase' AS buys, CASE WHEN isfinite(value) THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END AS cents,
          coalesce(arrived_at + to_days((CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END)::INT) < TIMESTAMP '2024-03-01', false) AS early FROM h),
    s AS (SELECT client_id, min(us) FILTER (WHERE buys AND early) AS s0, min(us) FILTER (WHERE buys) AS s1 FROM k GROUP BY 1),
    z AS (SELECT client_id, 0 AS state, s0 AS start FROM s WHERE s0 IS NOT NULL UNION ALL SELECT client_id, 1, s1 FROM s WHERE s1 IS NOT NULL),
    a AS (SELECT z.client_id, z.state, start // 259200000000 AS cohort, (us - start) // 259200000000 AS period,
          coalesce((s0 // 259200000000 <> s1 // 259200000000)::INT, 0) AS moved, cents
          FROM k JOIN z USING (client_id) JOIN s USING (client_id) WHERE us >= start AND (state = 1 OR early)),
    p AS (SELECT client_id, state, cohort, period, moved, sum(cents) AS cents FROM a GROUP BY ALL),
    g AS (SELECT client_id, arg_max(coalesce(city, ''), (coalesce(updated_at, TIMESTAMP '0001-01-01'), coalesce(city, ''))) AS segment FROM clients GROUP BY 1)
    SELECT state, coalesce(segment, '') AS segment, cohort::BIGINT AS cohort, period::BIGINT AS period, count(*) AS users, sum({_crc32("p.client_id::VARCHAR")})::BIGINT AS users_crc32,
           sum(moved)::BIGINT AS moved, sum(cents)::BIGINT AS cents FROM p LEFT JOIN g USING (client_id), tb GROUP BY ALL"""


def all_of_them(shard_count: int, rows_per_bucket: int) -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.report_sql("documents", "doc_id", "source"),
        "op7_rendezvous_shards": shards(shard_count, rows_per_bucket),
        "op8_ngram_jaccard_join": COMPONENTS,
        "op10_secret_ownership": secrets(),
        "op11_merkle_manifest": merkle.manifest_sql(),
        "op13_cohort_retention": cohort_cells(),
    }
