"""MinHash near-duplicates: signatures, LSH candidate pairs, greedy removal in arrival order."""

from __future__ import annotations

import random
from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import sha1_le32
from millrace.functions.text import word_ngrams, words
from millrace.operators.pack import ordered_positions
from millrace.operators.storage import scratch, written

# Fixed values of the hash family.
PRIME = (1 << 61) - 1
MAX_HASH = (1 << 32) - 1
SEED = 42
#: Hashes that go through all permutations at a time: 128 permutations of them take 512 KB.
BLOCK_HASHES = 512
#: Edges of a block that one task goes through in order.
BLOCK_EDGES = 500_000
#: Candidate pairs that are compared at once; buckets with more of them are settled by stars first.
PAIRS_AT_ONCE = 5_000_000


def family(num_perm: int = 128, seed: int = SEED) -> tuple[list[int], list[int]]:
    """Multipliers, then addends, in the order that Python's generator gives them."""
    rng = random.Random(seed)
    a = [rng.randint(1, PRIME - 1) for _ in range(num_perm)]
    return a, [rng.randint(0, PRIME - 1) for _ in range(num_perm)]


def _minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min over h of ((a*h + b) mod 2^61-1) & 0xFFFFFFFF, exactly: a is split at 32 bits, products fold at 61.

    It goes by blocks that fit a core's cache, in the same three arrays; a remainder is folded no further than its low 32
    bits need.
    """
    out = np.full(len(a), MAX_HASH, dtype=np.uint32)
    high, low, add = (a >> np.uint64(32))[:, None], (a & np.uint64(MAX_HASH))[:, None], b[:, None]
    width = min(BLOCK_HASHES, max(len(hashes), 1))
    space = [np.empty((len(a), width), dtype=np.uint64) for _ in range(3)]
    for at in range(0, len(hashes), width):
        h = hashes[None, at : at + width]
        x, y, z = (s[:, : h.shape[1]] for s in space)
        # high * h * 2^32: of the product's 61 bits, the low 29 go up by 32 places and the rest comes round.
        np.multiply(high, h, out=x)
        np.right_shift(x, np.uint64(29), out=z)
        np.bitwise_and(x, np.uint64((1 << 29) - 1), out=x)
        np.left_shift(x, np.uint64(32), out=x)
        x += z
        np.multiply(low, h, out=y)
        np.right_shift(y, np.uint64(61), out=z)
        y &= np.uint64(PRIME)
        x += y
        x += z
        x += add  # under 2^63: three terms of 61 bits
        np.right_shift(x, np.uint64(61), out=z)
        x &= np.uint64(PRIME)
        x += z
        # x is under PRIME + 8 now; from PRIME on, x + 1 has the low bits of x - PRIME.
        np.add(x, np.uint64(1), out=z)
        z >>= np.uint64(61)
        x += z
        np.minimum(out, x.astype(np.uint32).min(axis=1), out=out)
    return out.astype(np.int64)


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """Distinct hashes of a text's word shingles; duplicates don't change a minimum."""
    return F.array_distinct(F.transform(word_ngrams(words(text), n), sha1_le32))


def signed(rows: DataFrame, hashes: str = "h", key: str = "doc_id", num_perm: int = 128, seed: int = SEED) -> DataFrame:
    """key, signature: num_perm minima as bigint; all 2^32-1 for a text without words."""
    a, b = (np.array(x, dtype=np.uint64) for x in family(num_perm, seed))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "signature": [_minima(np.asarray(h, dtype=np.uint64), a, b) for h in frame[hashes]]})

    return rows.select(key, hashes).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, signature array<bigint>")


def signed_texts(rows: DataFrame, text: str = "text", key: str = "doc_id", num_perm: int = 128, ngram: int = 5, seed: int = SEED) -> DataFrame:
    """signed over shingle_hashes of a text, in one map: a shingle is a slice of the words joined by spaces, so neither
    shingles nor hashes are rows or arrays of their own."""
    a, b = (np.array(x, dtype=np.uint64) for x in family(num_perm, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_minima(_hashes(whole.as_py(), ngram), a, b) for whole in batch.column(1)]
            flat = pa.array(np.concatenate(marks) if marks else np.zeros(0, dtype=np.int64))
            ends = pa.array(np.arange(len(marks) + 1, dtype=np.int32) * num_perm)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=[key, "signature"])

    joined = F.coalesce(F.array_join(words(F.col(text)), " "), F.lit("")).cast("binary").alias("__words")
    return rows.select(key, joined).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, signature array<bigint>")


def _hashes(whole: bytes, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words of a text with single spaces; of the one run of all with fewer words."""
    if not whole:
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(np.frombuffer(whole, dtype=np.uint8) == 32).tolist() + [len(whole)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    runs = zip(starts, ends[n - 1 :], strict=False) if len(ends) >= n else [(0, len(whole))]
    digests = b"".join([sha1(whole[i:j]).digest()[:4] for i, j in runs])
    return np.unique(np.frombuffer(digests, dtype="<u4")).astype(np.uint64)


def jaccard_estimate(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v) / F.size(x)


def banded(signatures: DataFrame, key: str = "doc_id", bands: int = 16) -> DataFrame:
    """key, band, part: a row for each band of each signature; part is a hash of the band's rows."""
    rows = F.size("signature") / bands
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("signature", (i * rows + 1).cast("int"), rows.cast("int"))))
    return signatures.select(key, F.posexplode(cut).alias("band", "part"))


def memberships(signatures: DataFrame, key: str = "doc_id", bands: int = 16) -> DataFrame:
    """key, band, first, members: the buckets as stars, a row for each key and band, however large a bucket is.

    `first` is the least key of the bucket, `members` its number of rows. Every candidate pair shares a bucket;
    `pairs_within` gives the pairs of the buckets that one asks for.
    """
    rows = banded(signatures, key, bands)
    heads = rows.groupBy("band", "part").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("members"))
    return rows.join(heads, ["band", "part"]).select(key, "band", "first", "members")


def pairs_within(members: DataFrame, key: str = "doc_id", since: object = None) -> DataFrame:
    """a < b of the same bucket (band and first) of memberships, each pair once; with `since`, b is no less than it."""
    side = members.where(F.col("members") > 1)
    right = side if since is None else side.where(F.col(key) >= F.lit(since))
    pairs = side.select(F.col(key).alias("a"), "band", "first").join(right.select(F.col(key).alias("b"), "band", "first"), ["band", "first"])
    return pairs.where(F.col("a") < F.col("b")).select("a", "b").distinct()


def candidate_pairs(signatures: DataFrame, key: str = "doc_id", bands: int = 16, since: object = None) -> DataFrame:
    """a < b whose signatures agree in a band: an equi-join on (band, rows of the band), each pair once.

    Callers take copies away first, and near copies too (see deduplicated): a group gives all its pairs.
    """
    rows = banded(signatures, key, bands)
    right = rows if since is None else rows.where(F.col(key) >= F.lit(since))
    pairs = rows.withColumnRenamed(key, "a").join(right.withColumnRenamed(key, "b"), ["band", "part"])
    return pairs.where(F.col("a") < F.col("b")).select("a", "b").distinct()


def estimated(pairs: DataFrame, signatures: DataFrame, threshold: float, key: str = "doc_id") -> DataFrame:
    """a, b, estimate of the pairs that reach the threshold."""
    side = lambda name: signatures.select(F.col(key).alias(name), F.col("signature").alias(f"s_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.withColumn("estimate", jaccard_estimate(F.col("s_a"), F.col("s_b"))).where(F.col("estimate") >= threshold).select("a", "b", "estimate")


def similar_pairs(signatures: DataFrame, threshold: float = 0.8, key: str = "doc_id", bands: int = 16, since: object = None) -> DataFrame:
    """a < b, estimate: candidate pairs whose estimate reaches the threshold."""
    return estimated(candidate_pairs(signatures, key, bands, since), signatures, threshold, key)


def _settled(group: pa.Table) -> pa.Table:
    """n, kept of the rows of a block that are decided there. In each edge a comes before n, and is null where it isn't in
    the block (outside) or n has none."""
    before: dict[int, list[int | None]] = {}
    for n, a, outside in zip(group["n"].to_pylist(), group["a"].to_pylist(), group["outside"].to_pylist(), strict=True):
        own = before.setdefault(n, [])
        if a is not None or outside:
            own.append(a)
    kept: dict[int, bool | None] = {}
    for n in sorted(before):
        known = [None if a is None else kept[a] for a in before[n]]
        kept[n] = False if True in known else None if None in known else True
    sure = [(n, k) for n, k in kept.items() if k is not None]
    return pa.table({"n": pa.array([n for n, _ in sure], pa.int64()), "kept": pa.array([k for _, k in sure], pa.bool_())})


def greedy_kept(nodes: DataFrame, edges: DataFrame, key: str = "doc_id", block: int = BLOCK_EDGES) -> DataFrame:
    """key, kept: a row is kept if no kept row before it is similar; a dropped row drops none itself. Edges are a < b.

    Rounds over open edges: rows with edges are dealt in their order to blocks of about `block` edges. A task goes
    through its block in order and settles whatever doesn't hang on an open row of a block before; then kept rows drop
    their neighbours in other blocks. So the first block is settled in each round, and of the others all that chains
    from outside don't reach: a chain of n links takes about n / block rounds at most. What is settled goes to one
    table, a folder a round; only open edges are carried on.
    """
    edges = written(edges.select("a", "b"))
    count = edges.count()
    if not count:
        return nodes.select(key, F.lit(True).alias("kept"))
    # Keys become their places in the order of keys, so that blocks are runs of numbers, whatever a key's type.
    ends = edges.select(F.col("a").alias("k")).unionByName(edges.select(F.col("b").alias("k"))).distinct()
    if dict(edges.dtypes)["a"] in ("int", "bigint"):
        places = ends.select("k", F.col("k").cast("long").alias("n"))
    else:
        places = written(ordered_positions(ends.withColumn("one", F.lit(1)), "k", "one").select("k", F.col("start").alias("n")))
    at = lambda side, name: places.select(F.col("k").alias(side), F.col("n").alias(name))
    if dict(edges.dtypes)["a"] in ("int", "bigint"):
        left = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    else:
        left = written(edges.join(at("a", "na"), "a").join(at("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))
    if count <= block:  # one task settles all
        every = left.select(F.col("b").alias("n"), "a", F.lit(False).alias("outside")).unionByName(left.select(F.col("a").alias("n"), F.lit(None).cast("long").alias("a"), F.lit(False).alias("outside")))
        settled = every.withColumn("block_b", F.lit(0)).groupBy("block_b").applyInArrow(_settled, "n long, kept boolean")
    else:
        settled = _settled_by_rounds(left, count, block)
    marks = settled.where(~F.col("kept")).select("n").join(places, "n").select(F.col("k").alias(key), F.lit(False).alias("__k"))
    return nodes.select(key).join(marks, key, "left").select(key, F.coalesce("__k", F.lit(True)).alias("kept"))


def _settled_by_rounds(left: DataFrame, count: int, block: int) -> DataFrame:
    """n, kept of all nodes of the edges; see greedy_kept."""
    spark, path, rounds = left.sparkSession, scratch(left.sparkSession), 0
    while count:
        into = left.groupBy(F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("size"))
        rows = left.select(F.col("a").alias("n"), F.lit(0).cast("long").alias("size")).distinct().unionByName(into).groupBy("n").agg((F.sum("size") + 1).alias("size"))
        blocks = written(ordered_positions(rows, "n", "size").select("n", F.floor(F.col("start") / block).cast("long").alias("block")))
        of = lambda side: blocks.select(F.col("n").alias(side), F.col("block").alias(f"block_{side}"))
        outside = F.col("block_a") != F.col("block_b")
        inside = left.join(of("a"), "a").join(of("b"), "b").select("block_b", F.col("b").alias("n"), F.when(~outside, F.col("a")).alias("a"), outside.alias("outside"))
        every = inside.unionByName(blocks.select(F.col("block").alias("block_b"), "n", F.lit(None).cast("long").alias("a"), F.lit(False).alias("outside"))).distinct()
        done = written(every.groupBy("block_b").applyInArrow(_settled, "n long, kept boolean"))
        open_edges = left.join(done.select(F.col("n").alias("b")), "b", "left_anti")
        hit = open_edges.join(done.where("kept").select(F.col("n").alias("a")), "a", "left_semi").select(F.col("b").alias("n"), F.lit(False).alias("kept")).distinct()
        settled = written(done.unionByName(hit))
        settled.write.parquet(f"{path}/round={rounds}")
        rounds += 1
        gone = settled.where(~F.col("kept")).select("n")
        left = written(open_edges.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b"))
        count = left.count()
    return spark.read.parquet(path).select("n", "kept")


def settled_by_stars(marks: DataFrame, threshold: float = 0.8, key: str = "doc_id", bands: int = 16, pairs: int = PAIRS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """Rows that are kept for sure, and those that are still open, once the buckets have few enough candidate pairs.

    A row that is the first in all its buckets is kept, whatever comes after it; what is similar to it is dropped, and
    what isn't stays open without it. So a group of near copies is settled without any of its pairs but those with its
    first. Rounds go on until `pairs` candidate pairs are left, or a round leaves more than half of those before it.
    """
    kept, left, before = marks.limit(0).select(key), marks, None
    while True:
        members = written(memberships(left, key, bands))
        to_come = members.agg(F.coalesce(F.sum((F.col("members") - 1) / 2), F.lit(0.0))).first()[0]
        if to_come <= pairs or (before is not None and to_come > before / 2):
            return kept, left
        before = to_come
        sure = written(members.groupBy(key).agg(F.bool_and(F.col(key) == F.col("first")).alias("sure")).where("sure").select(key))
        stars = members.where(F.col(key) > F.col("first")).join(sure.withColumnRenamed(key, "first"), "first", "left_semi").select(F.col("first").alias("a"), F.col(key).alias("b")).distinct()
        dropped = estimated(stars, left, threshold, key).select(F.col("b").alias(key))
        kept = written(kept.unionByName(sure))
        left = written(left.join(sure.unionByName(dropped).distinct(), key, "left_anti"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, num_perm: int = 128, ngram: int = 5, bands: int = 16, row: str | None = None) -> DataFrame:
    """key, kept for rows in order of key, one for each row; rows of one key come in order of their words' digest.

    `row` names a column that tells rows apart; the result has it, to join on. Texts of the same words have estimate 1,
    so all but the first row of them goes, by one aggregation; only the rest is signed and joined. A removed copy would
    have removed nothing that its first doesn't. Groups of near copies are settled by stars, the rest by pairs.
    """
    mark = F.col(row) if row else F.monotonically_increasing_id()
    same = F.md5(F.array_join(words(F.col(text)), " "))
    rows = written(docs.select(F.col(key).alias("k"), mark.alias("r"), F.coalesce(same, F.lit("")).alias("w")))
    firsts = rows.groupBy("w").agg(F.min(F.struct("k", "r")).alias("first"))
    order = written(ordered_positions(firsts.select("w", "first.k", "first.r", F.lit(1).alias("one")), ["k", "w"], "one").select("w", "k", "r", F.col("start").alias("at")))
    marked = written(signed_texts(docs.select(F.coalesce(same, F.lit("")).alias("w"), text), text, "w", num_perm, ngram))
    marks = written(marked.groupBy("w").agg(F.first("signature").alias("signature")).join(order.select("w", "at"), "w").select("at", "signature"))
    sure, left = settled_by_stars(marks, threshold, "at", bands)
    kept = greedy_kept(left, similar_pairs(left, threshold, "at", bands), "at").where("kept")
    stay = order.join(kept.select("at").unionByName(sure), "at").select("w", F.col("r").alias("first"))
    out = rows.join(stay, "w", "left").withColumn("kept", F.coalesce(F.col("r") == F.col("first"), F.lit(False)))
    return out.select(F.col("k").alias(key), *([F.col("r").alias(row)] if row else []), "kept")


def ring_kept(nodes: DataFrame, edges: DataFrame, size: int = 500_000, key: str = "doc_id") -> DataFrame:
    """greedy_kept where a row meets the last `size` kept rows before it only, as if a ring held them.

    A row's fate depends on rows before it alone: each round takes the ranks of the last one's kept rows, lets edges
    between rows within reach count, and decides anew; the first row that was wrong is right after it. With fewer rows
    than the ring holds, one round is all.
    """
    edges = written(edges.select("a", "b"))
    live = edges
    kept = written(greedy_kept(nodes, live, key))
    if kept.where("kept").count() <= size:
        return kept
    while True:
        ranks = written(ordered_positions(kept.withColumn("__one", F.col("kept").cast("int")), key, "__one").select(key, "start"))
        at = lambda side: ranks.select(F.col(key).alias(side), F.col("start").alias(f"__{side}"))
        now = written(edges.join(at("a"), "a").join(at("b"), "b").where(F.col("__b") - F.col("__a") <= size).select("a", "b"))
        both = live.join(now, ["a", "b"], "left_semi").count()
        if both == live.count() == now.count():
            return kept
        live = now
        kept = written(greedy_kept(nodes, live, key))


def ring_window(kept: DataFrame, size: int = 500_000, key: str = "doc_id") -> DataFrame:
    """kept rows with the rank at which a ring of `size` would evict each: a row compares with those less than that
    many kept rows before it. Ranks come from range buckets, not from one task."""
    ranked = ordered_positions(kept.where("kept").select(key, F.lit(1).alias("one")), key, "one")
    return ranked.select(key, (F.col("start") + 1).alias("kept_rank"), (F.col("start") + 1 + size).alias("evicted_at"))
