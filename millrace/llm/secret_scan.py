"""Secret scan with corpus-wide ownership frequency. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

# Fixed values of the base rule: kind, pattern, least length, the group that length is of.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
#: Wider candidates, kept as spans only if ownership speaks for them.
OWNED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value in more owners than this is a widely copied example.
MAX_OWNERS = 2
#: Tasks that share the spans of one value, or the documents of one text.
SALTS = 64
#: A live-looking value has at least so many digits, letters and distinct characters.
LEAST_DIGITS, LEAST_LETTERS, LEAST_DISTINCT = 4, 4, 10


def _looks_live(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return (digits >= LEAST_DIGITS) & (letters >= LEAST_LETTERS) & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)


def _parts(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """One struct for each match of the pattern: kind, pos, gap (code points since the match before), size, value.

    The text splits at the matches; a match starts where the parts and matches before it end. Counting code points
    of the parts gives positions without a function of the regex engine that would return them. The value is null
    where the match fails, but its size still moves those behind it.
    """

    def part(p: Column, i: Column) -> Column:
        value = F.regexp_extract(p["hit"], pattern, group) if group else p["hit"]
        holds = F.length(value) >= least
        if kind == "owned":
            holds = holds & _looks_live(value)
        return F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("size"), F.when(holds, value).alias("value"))

    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    return F.transform(F.filter(pairs, lambda p: p["hit"].isNotNull()), part)


def _found(texts: DataFrame) -> DataFrame:
    """key, kind, start, end, value of every match that holds, of a table of key and parts: running sums by text."""
    rows = texts.select("key", F.explode("parts").alias("part")).select("key", "part.*")
    upto = Window.partitionBy("key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(upto)
    rows = rows.withColumn("end", end).where(F.col("value").isNotNull())
    return rows.select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _salt(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SALTS))


def spans(docs: DataFrame, repository: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Every candidate of every distinct text: key (md5 of the text), kind, start, end, value_hash, owners,
    repositories, verdict.

    verdict: `example` if more than max_owners owners have the value, `live` if it looks random and few have it,
    else `weak`. Base kinds are always listed; kind `owned`, the wider candidates, only with verdict `live` and
    away from base spans. Owners are counted over all documents: (value, repository, owner) first, so that a value
    of a third of all rows is reduced on the map side. A null repository or owner counts as one of its own.
    """
    return _spans(docs.where(F.col("text").isNotNull()).withColumn("__salt", F.lit(0)), repository, owner, max_owners)[1]


def _spans(docs: DataFrame, repository: str, owner: str, max_owners: int) -> tuple[DataFrame, DataFrame]:
    """The key and __salt of each document with candidates, and the spans."""
    text = F.col("text")
    some = text.rlike("[0-9]") & text.rlike(OWNED)  # a live-looking value has digits
    for _, pattern, _, _ in BASE:
        some = some | text.rlike(pattern)
    parts = F.concat(*[_parts(text, *rule) for rule in (*BASE, ("owned", OWNED, 20, 0))])
    who = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((repository, "repository"), (owner, "owner"))]
    # Texts go no further: what is stored and moved is their matches.
    hits = stored(docs.where(some).select(text_key(text).alias("key"), "__salt", *who, parts.alias("parts")), "secret-hits")
    where = hits.groupBy("key", "repository", "owner").agg(F.count(F.lit(1)).alias("copies"))
    found = _found(hits.select("key", "parts").dropDuplicates(["key"]))
    found = found.withColumn("value_hash", F.sha2(F.col("value").cast("binary"), 256))
    # An owned span that touches a base span of its text goes: ends so far, in order of start, and the next start.
    base_end = F.when(F.col("kind") != "owned", F.col("end"))
    base_start = F.when(F.col("kind") != "owned", F.col("start"))
    order = Window.partitionBy("key").orderBy("start", "end")
    found = found.withColumns({
        "__before": F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "__after": F.min(base_start).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    away = (F.coalesce(F.col("__before"), F.lit(0)) <= F.col("start")) & (F.col("__after").isNull() | (F.col("__after") >= F.col("end")))
    found = found.where((F.col("kind") != "owned") | away).withColumn("live", _looks_live(F.col("value")))
    found = stored(found.withColumn("salt", _salt("key")).drop("__before", "__after", "value"), "secret-spans")
    held = found.select("key", "value_hash").distinct().join(where, "key").groupBy("value_hash", "repository", "owner").agg(F.sum("copies").alias("copies"))
    by_owner = held.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("copies").alias("copies"))
    counts = by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("copies").alias("copies"))
    # A value that many texts share meets its counts once for each salt, and its spans by value and salt.
    counts = found.select("value_hash", "salt").distinct().join(counts, "value_hash")
    out = found.join(counts, ["value_hash", "salt"])
    verdict = F.when(F.col("owners") > max_owners, "example").when(F.col("live"), "live").otherwise("weak")
    out = out.withColumn("verdict", verdict).where((F.col("kind") != "owned") | (F.col("verdict") == "live"))
    return hits.select("key", "__salt"), out.select("key", "kind", "start", "end", "value_hash", "owners", "repositories", "copies", "verdict")


def _joined(only: Column | None = None) -> Column:
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct(F.col("start"), rank.alias("rank"), F.concat_ws(":", F.col("kind"), F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))
    listed = F.collect_list(item if only is None else F.when(only, item))
    return F.array_join(F.transform(F.array_sort(listed), lambda x: x["span"]), ",")


def scan(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans, and how many of
    its spans are `live` and `example` in the corpus.

    Null and empty texts have no spans: counts 0, `spans` empty, the digest of the empty string. Matches of
    equal texts count once each for their text; repeated rows get a row each.
    """
    base = F.col("kind") != "owned"
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(name)
    salted = docs.withColumn("__salt", _salt("doc_id"))
    holders, found = _spans(salted, repository, owner, MAX_OWNERS)
    by_text = found.groupBy("key").agg(
        *[count(F.col("kind") == k, f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined().alias("spans"),
        count(F.col("verdict") == "live", "n_live"), count(F.col("verdict") == "example", "n_example"),
    )
    # Copies of one text meet its spans by key and salt, so that a large group of them isn't one task.
    by_text = holders.distinct().join(by_text, "key")
    keyed = salted.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("key"), "__salt")
    out = keyed.join(by_text, ["key", "__salt"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex", "n_live", "n_example")}
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", zero["n_assign"], zero["n_access"], zero["n_hex"], F.coalesce("base_sha256", empty).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero["n_live"], zero["n_example"])
