"""Merkle manifest of a dataset: recursive traversals of aligned blocks, whose roots feed the next distributed traversal."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

FANOUT = 16
#: Levels of the tree in one block: a task's group has FANOUT ** LEVELS nodes at most.
LEVELS = 2
#: Tasks over which the blocks of one tree are dealt when they meet its path to the root.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODES = "tree string, pos long, size long, digest string"
_PATHS = "tree string, pos long, places array<int>, siblings array<array<string>>, top string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row's fields: `-` for null, else UTF-8 byte count, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def traverse(digests: list[str], height: int, paths: list[list] | None = None, first: int = 0, last: int | None = None) -> str:
    """The root of digests[first:last], a subtree of the given height, in postorder.

    While it unwinds, each contained leaf's path gets (place in its run, the run's other digests), lowest level first.
    """
    last = len(digests) if last is None else last
    if height == 0:
        return digests[first]
    width = FANOUT ** (height - 1)
    kids = [(at, min(at + width, last)) for at in range(first, last, width)]
    roots = [traverse(digests, height - 1, paths, a, b) for a, b in kids]
    if paths is not None:
        for place, (a, b) in enumerate(kids):
            step = place, roots[:place] + roots[place + 1 :]
            for at in range(a, b):
                paths[at].append(step)
    return digest("".join(roots))


def height_of(size: int, levels: int) -> int:
    """Levels of a block in a tree of so many nodes: runs are hashed while several nodes remain."""
    height = 0
    while height < levels and FANOUT**height < size:
        height += 1
    return height


def fold(start: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its path give."""
    for place, others in path:
        start = digest("".join([*others[:place], start, *others[place:]]))
    return start


def folded(start: Column, places: Column, siblings: Column) -> Column:
    """`fold` as a native expression over the columns of `prove`, for whoever verifies rows against a root."""
    steps = F.zip_with(places, siblings, lambda p, s: F.struct(p.alias("p"), s.alias("s")))

    def up(at: Column, step: Column) -> Column:
        left = F.slice(step["s"], F.lit(1), step["p"])
        right = F.slice(step["s"], step["p"] + 1, F.size(step["s"]))
        return F.sha2(F.array_join(F.concat(left, F.array(at), right), ""), 256)

    return F.aggregate(steps, start, up)


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes with `pos` (from 0 in their tree, by `order`) and `size` (nodes of the tree).

    Rows are range-partitioned by tree and order, whatever their number in one tree; tasks number their own rows, and
    sums over the tasks of a tree move each number to its place. Rows that are equal in the order share no task by need.
    """
    tie = nodes.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["tree", *order, "__tie"]
    ranged = tie.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__row", F.monotonically_increasing_id())
    here = stored(ranged.withColumn("__part", F.shiftright("__row", 33)).withColumn("__row", F.col("__row").bitwiseAND((1 << 33) - 1)), "numbered")
    runs = here.groupBy("tree", "__part").agg(F.min("__row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__base"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return here.join(runs, ["tree", "__part"]).withColumn("pos", F.col("__row") + F.col("__base")).drop("__part", "__row", "__base")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels * (FANOUT.bit_length() - 1)))


def _sorted_digests(group: pa.Table, levels: int) -> tuple[pa.Table, list[str], int]:
    group = group.sort_by("pos")
    return group, group["digest"].to_pylist(), height_of(group["size"][0].as_py(), levels)


def roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes so many levels higher: tree, pos, size, digest of each aligned block."""

    def up(group: pa.Table) -> pa.Table:
        group, digests, height = _sorted_digests(group, levels)
        size = -(-group["size"][0].as_py() // FANOUT**levels)
        return pa.table({"tree": group["tree"].slice(0, 1), "pos": group["block"].slice(0, 1), "size": [size], "digest": [traverse(digests, height)]})

    return _blocks(nodes, levels).select("tree", "block", "pos", "size", "digest").groupBy("tree", "block").applyInArrow(up, _NODES)


def descend(nodes: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The path of each node to its tree's top: its own in the block, then that of the block's root."""

    def down(group: pa.Table, over: pa.Table) -> pa.Table:
        group, digests, height = _sorted_digests(group, levels)
        paths: list[list] = [[] for _ in digests]
        traverse(digests, height, paths)
        places, siblings, top = over["places"][0].as_py(), over["siblings"][0].as_py(), over["top"][0].as_py()
        out = {
            "places": pa.array([[p for p, _ in x] + places for x in paths], pa.list_(pa.int32())),
            "siblings": pa.array([[s for _, s in x] + siblings for x in paths], pa.list_(pa.list_(pa.string()))),
            "top": pa.array([top] * len(paths)),
        }
        return pa.table({"tree": group["tree"], "pos": group["pos"]} | out)

    left = _blocks(nodes, levels).select("tree", "block", "pos", "size", "digest").groupBy("tree", "block")
    return left.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(down, _PATHS)


def ascend(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree, pos, places, siblings, top of each block root above the nodes: its path to its tree's top.

    Every round has a FANOUT ** levels-th of the rows of the one before, and trees that have come to one node leave.
    """
    made = stored(roots(nodes, levels), "roots")
    ends = made.where(F.col("size") == 1).select("tree", "pos", F.array().cast("array<int>").alias("places"), F.array().cast("array<array<string>>").alias("siblings"), F.col("digest").alias("top"))
    more = made.where(F.col("size") > 1)
    if more.limit(1).count():
        ends = ends.unionByName(descend(more, ascend(more, levels), levels))
    return stored(ends, "paths")


def block_paths(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """For each block of leaves its path via the subroot of its tree to the root of all trees: tree, block, places,
    siblings, subroot, root. Trees follow each other in bytewise order."""
    blocks = ascend(leaves, levels)
    sub = blocks.groupBy("tree").agg(F.min("top").alias("digest"), F.count(F.lit(1)).alias("blocks"))
    top = stored(numbered(sub.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "blocks"), ["name"]), "subroots")
    paths = top.join(descend(top, ascend(top, levels), levels).withColumnRenamed("top", "root"), ["tree", "pos"])
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("blocks") - 1, F.lit(SALTS - 1).cast("long"))))
    paths = paths.select(F.col("name").alias("tree"), salt.alias("salt"), F.col("places").alias("p2"), F.col("siblings").alias("s2"), "root")
    joined = blocks.withColumn("salt", F.pmod("pos", F.lit(SALTS).cast("long"))).join(paths, ["tree", "salt"])
    return joined.select("tree", F.col("pos").alias("block"), F.concat("places", "p2").alias("places"), F.concat("siblings", "s2").alias("siblings"), F.col("top").alias("subroot"), "root")


def tree_of(source: Column) -> Column:
    """A text that isn't null and sorts as its source does: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def leaves_of(docs: DataFrame, forged: Column | None = None, key: str = "doc_id", source: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """tree, pos, size, digest, forged, key: every row's leaf in its place. Only digests and keys leave the scan.

    `forged` is the leaf of the row as it is found later, null where nothing was changed.
    """
    rows = docs.select(tree_of(F.col(source)).alias("tree"), leaf([F.col(c) for c in fields]).alias("digest"), (F.lit(None).cast("string") if forged is None else forged).alias("forged"), F.col(key).alias("key"))
    return numbered(rows, ["key", "digest"])


def prove(docs: DataFrame, forged: Column | None = None, key: str = "doc_id", detail: bool = False, levels: int = LEVELS, **names) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row; with `detail` places and siblings too.

    Rows of one source ascend by key (null first), rows of one key by leaf; equal rows have places of their own. A null
    source is a tree of its own, before the others; very long texts are hashed whole; null fields differ from empty
    ones; an empty table gives no rows. Other columns of docs are not looked at, whatever their names. A task's group
    has FANOUT ** levels leaves.
    """
    nodes = stored(leaves_of(docs, forged, key, **names), "leaves")
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", places array<int>, siblings array<array<string>>" if detail else ""

    def down(group: pa.Table, over: pa.Table) -> pa.Table:
        group, digests, height = _sorted_digests(group, levels)
        paths: list[list] = [[] for _ in digests]
        traverse(digests, height, paths)
        upper = list(zip(over["places"][0].as_py(), over["siblings"][0].as_py(), strict=True))
        ending = "".join("".join(s) for _, s in upper)
        subroot, root = over["subroot"][0].as_py(), over["root"][0].as_py()
        proofs = [digest("".join("".join(s) for _, s in x) + ending) for x in paths]
        ends = [fold(f or d, x + upper) for f, d, x in zip(group["forged"].to_pylist(), digests, paths, strict=True)]
        n = len(digests)
        out = {key: group["key"], "leaf": group["digest"], "subroot": pa.array([subroot] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(proofs), "folded_root": pa.array(ends), "verified": pa.array([e == root for e in ends])}
        if detail:
            out["places"] = pa.array([[p for p, _ in x + upper] for x in paths], pa.list_(pa.int32()))
            out["siblings"] = pa.array([[s for _, s in x + upper] for x in paths], pa.list_(pa.list_(pa.string())))
        return pa.table(out)

    above = block_paths(nodes, levels).groupBy("tree", "block")
    return _blocks(nodes, levels).groupBy("tree", "block").cogroup(above).applyInArrow(down, schema)


def lower_cased(docs_text: str = "text", key: str = "doc_id", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text")) -> Column:
    """The leaf of a row whose text came back with its A-Z lower-cased, where 5 divides the crc32 of the decimal key; else null."""
    changed = F.translate(F.col(docs_text), _UPPER, _LOWER)
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf([changed if c == docs_text else F.col(c) for c in fields]))


def manifest_sql(levels: int = 8) -> str:
    """DuckDB SQL of the query, run by run and level by level, for trees of up to FANOUT ** levels nodes."""
    def h(*cols: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in cols) + ")"

    names = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"]
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    crc = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    parts = [
        "tb AS (SELECT list_transform(generate_series(0, 255), lambda n: list_reduce(generate_series(1, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tbl)",
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {h(*names, 'text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {h(*names, lower)} END AS forged FROM documents, tb)",
        "v0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS h, coalesce(forged, leaf) AS f, '' AS proof FROM d)",
    ]

    def level(k: int, src: str) -> str:
        # arr: the distinct nodes of a run in order; every leaf below the run carries its node, place and the proof so far
        return f"""v{k} AS (SELECT doc_id, tree, leaf, own, pos // {FANOUT} AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n,
            CASE WHEN n > 1 THEN sha256(array_to_string(arr, '')) ELSE h END AS h,
            CASE WHEN n > 1 THEN sha256(array_to_string(list_concat(list_append(arr[1:pos % {FANOUT}], f), arr[pos % {FANOUT} + 2:]), '')) ELSE f END AS f,
            CASE WHEN n > 1 THEN proof || array_to_string(list_concat(arr[1:pos % {FANOUT}], arr[pos % {FANOUT} + 2:]), '') ELSE proof END AS proof
            FROM {src} JOIN (SELECT tree AS t, pos // {FANOUT} AS run, list(h ORDER BY pos) AS arr FROM (SELECT DISTINCT tree, pos, h FROM {src}) GROUP BY 1, 2) r ON r.t = tree AND r.run = pos // {FANOUT})"""

    parts[-1] = parts[-1].replace("SELECT *,", "SELECT doc_id, tree, leaf, tree AS own,")
    parts += [level(k, f"v{k - 1}") for k in range(1, levels + 1)]
    top = f"v{levels}"
    parts.append(f"v{levels + 1} AS (SELECT doc_id, '' AS tree, leaf, h AS own, dense_rank() OVER (ORDER BY tree) - 1 AS pos, (SELECT count(DISTINCT tree) FROM {top}) AS n, h, f, proof FROM {top})")
    parts += [level(levels + 1 + k, f"v{levels + k}") for k in range(1, levels + 1)]
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, own AS subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM v{2 * levels + 1}"
