"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: A line in more than this share of a host's pages, and in LEAST_PAGES pages at least, is boilerplate.
#: A template on one page of ten is to be found in every host: at half of that, three standard errors of the measured
#: share (0.3 / sqrt(pages) each) fit between from 324 pages on.
RATIO, LEAST_PAGES = 0.05, 3
#: Boilerplate lines (8 bytes each) that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000
#: Tasks that a host's pages go to where its lines are joined by a shuffle.
SALTS = 64


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """host, line: hashes of the lines that are in more than `ratio` of the host's pages, each page counted once.

    Lines count without the spaces around them; blank lines never count. Rows of a (host, line) are summed on the map
    side first, so a host or line of a third of all rows moves one row a task. A null host is a host of its own. With
    `copies_once` pages of the same text are one page, in the count of a line and in that of the host.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    page = F.xxhash64(text).alias("page")
    number = F.count_distinct("page") if copies_once else F.count(F.lit(1))
    totals = pages.select(site, page).groupBy("host").agg(number.alias("pages"))
    own = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _line_hash))
    counts = pages.select(site, page, F.explode(own).alias("line")).groupBy("host", "line").agg(number.alias("with_line")).where(F.col("with_line") >= least_pages)
    return counts.join(totals, "host").where(F.col("with_line") > ratio * F.col("pages")).select("host", "line")


def clean(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """pages with `__kept`, the text without its host's boilerplate lines, and `__dropped`, how many went.

    A null text stays null and drops nothing; a text all of whose lines go becomes empty. Repeated rows are pages of
    their own (one with `copies_once`) and give equal rows; an empty table gives no rows. Columns of pages pass,
    whatever their names, but for such as are called `__kept` or `__dropped`: the results have these names.

    A host's boilerplate lines are at most its mean number of lines a page / ratio, so they fit into one array beside
    its pages. Texts don't move, unless the arrays of all hosts are too many to send; then a host's pages are dealt to
    SALTS tasks, each with a copy of its array.
    """
    names = [c for c in pages.columns if c not in ("__kept", "__dropped")]
    plain = {c: f"__p{i}" for i, c in enumerate(names)}
    bad = stored(boilerplate(pages, host, text, ratio, least_pages, copies_once), "boilerplate")
    by_host = bad.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias("__bad"))
    rows = pages.select(*[F.col(c).alias(p) for c, p in plain.items()])
    rows = rows.withColumn("__host", F.coalesce(F.col(plain[host]).cast("string"), F.lit("")))
    body = plain[text]
    if bad.count() <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(by_host), "__host", "left")
    else:
        by_host = by_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64(body), F.lit(SALTS)).cast("int")).join(by_host, ["__host", "__salt"], "left")
    kept = F.filter(_lines(body), lambda x: (F.trim(x) == "") | ~F.array_contains("__bad", _line_hash(x)))
    joined = joined.withColumn("__lines", F.when(F.col("__bad").isNull(), _lines(body)).otherwise(kept))
    dropped = F.when(F.col(body).isNull(), 0).otherwise(F.coalesce(F.size(_lines(body)) - F.size("__lines"), F.lit(0)))
    return joined.select(*[F.col(p).alias(c) for c, p in plain.items()], F.array_join("__lines", "\n").alias("__kept"), dropped.alias("__dropped"))


def report(pages: DataFrame, key: str, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """key, host, lines, dropped_lines, clean_text_md5 of every page; null texts have 0 lines and a null digest."""
    out = clean(pages.select(key, host, text), host, text, ratio, least_pages)
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text)))
    return out.select(key, host, lines.cast("long").alias("lines"), F.col("__dropped").cast("long").alias("dropped_lines"), F.md5(F.col("__kept").cast("binary")).alias("clean_text_md5"))


def report_sql(table: str, key: str, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """The same in DuckDB's SQL, by joins on the lines themselves."""
    return f"""
    WITH page AS (SELECT row_number() OVER () AS r, {key}, {host}, text, coalesce(CAST({host} AS VARCHAR), '') AS h FROM {table}),
    line AS (SELECT r, h, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM page WHERE text IS NOT NULL),
    total AS (SELECT h, count(*) AS pages FROM page GROUP BY h),
    bad AS (SELECT h, trim(l) AS b FROM line JOIN total USING (h) WHERE trim(l) <> '' GROUP BY h, trim(l), pages
            HAVING count(DISTINCT r) >= {least_pages} AND count(DISTINCT r) > {ratio} * pages),
    marked AS (SELECT r, l, i, b FROM line LEFT JOIN bad ON line.h = bad.h AND trim(l) = b),
    kept AS (SELECT r, count(*) AS lines, count(b) AS dropped, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE b IS NULL), '') AS t FROM marked GROUP BY r)
    SELECT {key}, {host}, coalesce(lines, 0) AS lines, coalesce(dropped, 0) AS dropped_lines, md5(t) AS clean_text_md5
    FROM page LEFT JOIN kept USING (r)"""
