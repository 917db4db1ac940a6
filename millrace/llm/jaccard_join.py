"""Exact n-gram Jaccard join with PartEnum signatures, and its connected components.

Two sets link when 100 * |intersection| >= 80 * |union|; then their symmetric difference has (a + b) / 9 elements at
most. The steps, each of which loses no link:

1. Equal sets become one class, known by its least doc_id.
2. Shingles that no other class has can't be in an intersection. A class with more than a fifth of such shingles links
   with nothing and goes; a fixed part of the domain is looked at.
3. PartEnum: for a band of sizes with difference k at most, the domain is dealt into n1 parts, so that some part differs
   by one element at most; each part into three, of which then two agree. Every pair of those three makes a signature.
4. In each group of one signature every member is compared with the least one, and links are contracted.
5. Groups that still hold several components compare the members of different ones, behind exact bounds (sizes, the
   parity sketch's distance); what passes is compared as sets. A few of the groups first, whose links join most
   components of near copies with few pairs; then all groups, with all pairs that are left.

Sets are made once and written once, with their signatures and sketches; what a step has read for the last time goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, slices, small_batches, stored
from millrace.llm.shingle_sets import mix, set_key, shingle_set

#: Sets up to SMALL shingles show all of them in step 2; their partners, up to a quarter larger, do so as well.
SMALL = 64
#: Of larger sets, the shingles whose hash mod 10 is below this.
PROBED = 3
#: Shown shingles that a task holds before equal ones become one row, and keys of sets that it remembers.
HELD, SEEN = 1 << 20, 1 << 17
#: Bits of the smallest and largest parity sketch, as powers of two; between them two to four for each shingle.
SKETCH_LEAST, SKETCH_MOST = 10, 17
#: Members of a group that one task compares; a larger group is dealt into blocks, each two of which are one task's.
GROUP = 2048
#: Pairs that a task holds before they leave.
PAIRS = 1 << 16
#: One group of so many is looked at in the first pass over groups of several components.
FIRST_PASS = 16
#: Rows of ids that are sent to all executors at most (24 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _in_part(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)) % np.uint64(10) < PROBED


def _sent(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast if their number is within the bound."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _profile(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, cls, n: each document's set as a key, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            sets = [(set_key(s), len(s)) for s in map(shingle_set, part.column(1).to_pylist())]
            cls, n = zip(*sets, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int64())], names=["__key", "cls", "n"])

    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"__key {dict(docs.dtypes)[key]}, cls long, n long")


def merged(h: np.ndarray, cls: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each h, in order: state 2 if several classes have it."""
    order = np.lexsort((cls, h))
    h, cls, state = h[order], cls[order], state[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(first[1:], len(h)) - 1
    return h[first], cls[first], np.where(cls[first] != cls[last], np.uint8(2), np.maximum.reduceat(state, first))


def _probe_rows(docs: DataFrame, text: str) -> DataFrame:
    """h, cls, state: the shingles that each set shows; state 1 if its class counts it, 0 if it only shows it to
    partners, 2 if the task has seen it in several classes.

    A task's equal shingles become one row for each HELD of them, so a phrase of a third of all documents moves few
    rows. A set that is shown twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, cls, state = merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            order = np.argsort(cls, kind="stable")  # runs of one class are small once compressed
            h, cls, state = h[order], cls[order], state[order]
            for at in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 16)].view(np.int64)), pa.array(cls[at : at + (1 << 16)]), pa.array(state[at : at + (1 << 16)].astype(np.int8))], names=["h", "cls", "state"])

        for part in slices(batches, "__text", 1 << 20):
            for t in part.column(0).to_pylist():
                s = shingle_set(t)
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                shown = s if len(s) <= 2 * SMALL else s[_in_part(s)]
                counted = np.ones(len(shown), dtype=np.uint8) if len(s) <= SMALL else _in_part(shown).astype(np.uint8)
                held.append((shown, np.full(len(shown), key, dtype=np.int64), counted))
                size += len(shown)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select(F.col(text).alias("__text")).mapInArrow(run, "h long, cls long, state byte")


def _alive(profile: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes (cls, n, least, times, docs), and those of them that may have a partner. least: the least id, times: how
    many rows have it."""
    copies = profile.where(F.col("n") > 0).groupBy("cls", "n", "__key").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.when(F.col("__key").isNotNull(), F.struct(F.col("__key").cast("long").alias("id"), "times")))
    classes = copies.groupBy("cls", "n").agg(first.alias("first"), F.sum("times").alias("docs"))
    classes = stored(classes.select("cls", "n", F.col("first.id").alias("least"), F.col("first.times").alias("times"), "docs"), "classes")
    shown = _probe_rows(docs, text).repartition("h").groupBy("h").agg(F.min("cls").alias("cls"), F.max("cls").alias("high"), F.max("state").alias("state"))
    alone = shown.where((F.col("cls") == F.col("high")) & (F.col("state") == 1)).groupBy("cls").agg(F.count(F.lit(1)).alias("alone"))
    few = 5 * F.coalesce("alone", F.lit(0)) <= F.col("n")
    return classes, stored(classes.where(F.col("least").isNotNull()).join(alone, "cls", "left").where(few).select("cls", "n", "least", "times"), "alive")


def _sets(docs: DataFrame, text: str, key: str, alive: DataFrame) -> DataFrame:
    """node, n, shingles, sketch, brief, sigs of each class that may have a partner, from the document of its least id.

    A task holds the sets of a megabyte of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", 1 << 20):
            sets = [(cls, shingle_set(t)) for cls, t in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            sets = [s for cls, s in sets if set_key(s) == cls]  # an id may stand for other texts too
            if sets:
                marks = [sketch(s) for s in sets]
                arrays = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), pa.array(marks, pa.binary()), pa.array([folded(m, brief_size(len(s))).tobytes() for m, s in zip(marks, sets, strict=True)], pa.binary()), _lists([signatures(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "shingles", "sketch", "brief", "sigs"])

    chosen = docs.select(F.col(key).cast("long").alias("least"), F.col(text).alias("__text")).join(_sent(alive.select("least", "cls")), "least").select("cls", "__text")
    sets = chosen.mapInArrow(run, "node long, n long, shingles array<long>, sketch binary, brief binary, sigs array<long>")
    if alive.where(F.col("times") > 1).limit(1).count():  # rows of the same id and set
        sets = sets.dropDuplicates(["node"])
    return stored(sets, "sets")


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def _bands() -> np.ndarray:
    """Least sizes of the bands: linked sets are in the same band or in bands next to each other."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out, dtype=np.int64)


BANDS = _bands()


def signatures(shingles: np.ndarray) -> np.ndarray:
    """All PartEnum signatures of a set, those of its own band's scheme and of the band's below.

    The scheme of a band serves pairs within it and pairs with the next one. There a + b <= 9/4 of the smaller set, so
    k = a quarter of the band's largest size bounds the difference. n1 parts, more than k / 2, have one that differs by
    one element at most, and of its three parts two agree. A signature of less than two elements says little; it is
    left out where enough parts are rich to guarantee another one: parts that differ by two or more are k / 2 at most.
    If that holds for either set of a pair, they share a signature of two elements; if for neither, both give all.
    """
    m, out = len(shingles), []
    band = int(np.searchsorted(BANDS, m, side="right")) - 1
    for scheme in (band, band - 1):
        if scheme < 0 or not m:
            continue
        k = int(BANDS[scheme + 1] - 1) // 4
        n1 = k // 2 + 1 + (k + 5) // 6
        seeded = mix(shingles ^ np.uint64(0x51ED270B * (scheme + 1)))
        cell = (seeded % np.uint64(n1)).astype(np.int64) * 3 + (seeded >> np.uint64(33)).astype(np.int64) % 3
        value = mix(seeded + np.uint64(0x632BE59BD9B4E019))
        order = np.argsort(cell, kind="stable")
        filled, first = np.unique(cell[order], return_index=True)
        sums, counts = np.zeros(3 * n1, dtype=np.uint64), np.zeros(3 * n1, dtype=np.int64)
        sums[filled] = np.add.reduceat(value[order], first)
        counts[filled] = np.diff(np.append(first, m))
        sums, counts = sums.reshape(n1, 3), counts.reshape(n1, 3)
        pairs = np.stack([mix(sums[:, a] + np.uint64(a + 1)) + mix(sums[:, b] ^ np.uint64(0xABCD << b)) for a, b in ((0, 1), (0, 2), (1, 2))], axis=1)
        size = np.stack([counts[:, a] + counts[:, b] for a, b in ((0, 1), (0, 2), (1, 2))], axis=1)
        rich = (size >= 2).all(axis=1).sum()
        keep = size >= 2 if n1 - k // 2 > n1 - rich else np.ones_like(size, dtype=bool)
        place = np.arange(3 * n1, dtype=np.uint64).reshape(n1, 3)
        out.append(mix(pairs + mix(place + np.uint64(scheme << 40)))[keep])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the number of elements in each cell: two sketches differ in as many bits as the sets differ in
    elements at most. Cells are a power of two, so a sketch folds to half by the exclusive or of its halves."""
    bits = 1 << min(SKETCH_MOST, max(SKETCH_LEAST, (2 * len(shingles)).bit_length()))
    cells = np.bincount((mix(shingles + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def folded(mark: bytes, size: int) -> np.ndarray:
    """A sketch of `size` bytes."""
    out = np.frombuffer(mark, dtype=np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def brief_size(n: int) -> int:
    """Bytes of the sketch that moves with each group of a set of n: one to two bits for each shingle, 512 at least.
    Near copies below the threshold are told apart by it as well, not only sets that share a passage."""
    return max(64, (1 << n.bit_length()) // 8)


def _folded_int(mark: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        mark = (mark & ((1 << bits) - 1)) ^ (mark >> bits)
    return mark


def _may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    """The exact bounds on a pair: sizes, and the sketches' distance."""
    size = min(len(x), len(y))
    return 5 * min(n, m) >= 4 * max(n, m) and 9 * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= n + m


def _signed(sets: DataFrame) -> DataFrame:
    """sig, node, low, many: members of groups of one signature, the least of them, and their number.

    Groups of the same members are one group: near copies share hundreds of signatures. Members that a collision of
    groups' hashes adds are only more to compare.
    """
    group = Window.partitionBy("sig")
    rows = sets.select(F.explode("sigs").alias("sig"), "node").repartition("sig")
    rows = rows.withColumns({"low": F.min("node").over(group), "high": F.max("node").over(group), "all": F.bit_xor(F.xxhash64("node")).over(group), "many": F.count(F.lit(1)).over(group)})
    return rows.where(F.col("low") != F.col("high")).select(F.xxhash64("all", "many", "low", "high").alias("sig"), "node", "low", "many").distinct()


def _crossing(signed: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """sig, i, j, block, node, label, n, brief: members of groups that still hold several components.

    The least member has been compared with all others, so the components of the others count. A group of more than
    GROUP members is dealt into blocks; each two blocks, and each one with itself, are a task of their own, so no task
    holds more than 2 * GROUP members or so.
    """
    group = Window.partitionBy("sig")
    marked = signed.where((F.col("many") > 2) & (F.col("node") != F.col("low"))).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    still = marked.withColumn("__low", F.min("label").over(group)).withColumn("__high", F.max("label").over(group)).where(F.col("__low") != F.col("__high"))
    blocks = F.ceil(F.col("many") / GROUP).cast("int")
    still = still.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    still = still.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")
    return still.join(sets.select("node", "n", "brief"), "node").select("sig", "i", "j", "block", "node", "label", "n", "brief")


def near(rows: list[tuple], between: bool) -> Iterator[tuple[int, int]]:
    """Places i < j of rows of different labels that no bound excludes. rows: block, node, label, n, sketch;
    `between`: of different blocks only."""
    if len(rows) < 48:
        whole = [(block, label, n, int.from_bytes(x, "big"), 8 * len(x)) for block, _, label, n, x in rows]
        for i, (block, label, n, x, bits) in enumerate(whole):
            for j in range(i + 1, len(whole)):
                other, its, m, y, its_bits = whole[j]
                if label == its or 5 * min(n, m) < 4 * max(n, m) or (between and block == other):
                    continue
                size = min(bits, its_bits)
                if 9 * (_folded_int(x, bits, size) ^ _folded_int(y, its_bits, size)).bit_count() <= n + m:
                    yield i, j
        return
    size = min(len(row[-1]) for row in rows)
    block, _, label, n = (np.array(c) for c in list(zip(*rows, strict=True))[:4])
    marks = np.stack([folded(row[-1], size) for row in rows]).view(np.uint64)
    for i in range(len(rows) - 1):
        total = n[i] + n[i + 1 :]
        ok = (label[i + 1 :] != label[i]) & (9 * np.minimum(n[i + 1 :], n[i]) >= 4 * total)
        if between:
            ok &= block[i + 1 :] != block[i]
        at = i + 1 + np.flatnonzero(ok)
        if len(at):
            differ = np.bitwise_count(marks[at] ^ marks[i]).sum(axis=1, dtype=np.int64)
            for j in at[9 * differ <= total[at - i - 1]].tolist():
                yield i, j


class _Joined:
    """Components that pairs have joined, as far as a task knows."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def top(self, label: int) -> int:
        while (up := self.above.get(label, label)) != label:
            self.above[label] = label = self.above.get(up, up)
        return label

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.top(a), self.top(b)
        self.above[a] = b
        return a != b


def _cross_pairs(rows: DataFrame, spanning: bool) -> DataFrame:
    """a, b: pairs of members in different components that may link.

    With `spanning` a task names only pairs that join components which its pairs haven't joined yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        last, group = None, []
        known = _Joined()

        def emit() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            for i, j in near(group, last[1] != last[2]):
                (_, a, x, *_), (_, b, y, *_) = group[i], group[j]
                if spanning and not known.join(x, y):
                    continue
                found.add((min(a, b), max(a, b)))
                if len(found) >= PAIRS:
                    yield emit()

        for batch in slices(batches, "brief"):
            for sig, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sig, i, j) != last and group:
                    yield from close()
                    group = []
                last = (sig, i, j)
                group.append(tuple(row))
        if group:
            yield from close()
        yield emit()

    return rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs a, b by their components."""
    side = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    out = pairs.join(side, "a", "left").join(side.toDF("b", "y"), "b", "left")
    return out.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))


def _raised(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """labels after their components were joined: `upper` has the labels of labels, and of nodes that had none."""
    nodes = labels.unionByName(upper).groupBy("node").agg(F.min("label").alias("label"))
    out = nodes.join(upper.toDF("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = stored(out, "labels")
    discard(labels, upper)
    return out


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that no bound excludes: their sketches move, not their sets."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sketch_a"):
            columns = [c.to_pylist() for c in batch.columns[2:]]
            keep = [_may_link(n, m, x, y) for n, x, m, y in zip(*columns, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b").select("b", "n_b"), "b").where(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    both = both.join(side("b").select("b", "sketch_b"), "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    return both.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets link, by comparing the sets themselves."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("shingles").alias(f"s_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * common >= 80 * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component, for nodes with edges; by alternating large and small stars.

    Each round writes its edges to the shared folder and takes away those of the round before. Rounds grow with the
    logarithm of a component's size.
    """
    current, before = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        ends = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = ends.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).where(F.col("a") != F.col("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        made = stored(small, "edges")
        discard(current)
        current = made
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    nodes = current.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    labels = stored(nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "labels")
    discard(current)
    return labels


def with_set_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column `set_key` of `join`'s detail; a column of docs that has this name goes."""
    names = [c for c in docs.columns if c != "set_key"]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            keys = [set_key(shingle_set(t)) for t in part.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], names=[*names, "set_key"])

    return docs.select(*names).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", set_key long")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", detail: bool = False) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id.

    Texts without words, and null texts, have no shingles and are components of their own. Very long texts are hashed
    part by part and compared whole. Equal sets are in one component, repeated rows too; ties go to the least id. A
    null id links with nothing but the rows of equal sets, whose least id it gets (null if none has one). Ids are whole
    numbers. An empty table gives no rows. Other columns of docs, whatever their names, are not looked at.

    With `detail` also set_key, equal for equal sets, and `first`: whether the row's set is the one that stands for its
    component, one of those that have the least id. Where ids repeat, id and set_key tell rows of different sets apart.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(key, text)
    profile = stored(_profile(docs, text, key), "profile")
    classes, alive = _alive(profile, docs, text)
    sets = _sets(docs, text, key, alive)
    signed = stored(_signed(sets), "signed")
    star = signed.where(F.col("node") != F.col("low")).select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(_plausible(star, sets), "pairs")
    links = stored(_linked(pairs, sets), "links")
    discard(pairs)
    labels = components(links)
    discard(links)
    for part in (signed.where(F.pmod("sig", F.lit(FIRST_PASS)) == 0), signed):
        close = stored(_cross_pairs(_crossing(part, labels, sets), part is not signed), "pairs")
        pairs = stored(_plausible(close, sets), "pairs")
        labels = _raised(labels, components(_named(_linked(pairs, sets), labels)))
        discard(close, pairs)
    discard(signed, sets)
    top = labels.select(F.col("node").alias("cls"), "label")
    found = alive.join(top, "cls").select("cls", "n", "least", "label")
    ids = found.groupBy("label").agg(F.min(F.struct("least", "cls")).alias("first"))
    linked = found.join(ids, "label").select("cls", "n", F.col("first.least").alias("component"), (F.col("first.cls") == F.col("cls")).alias("first"))
    answers = classes.join(linked, ["cls", "n"], "left").select("cls", "n", "docs", F.col("least").alias("own"), F.coalesce("component", "least").alias("component"), F.coalesce("first", F.lit(True)).alias("first"))
    # A class of one document that has no partner is its own answer. The rest is a table of its own, so that the join
    # with a class of a third of all documents can be split.
    answers = stored(answers.where((F.col("docs") > 1) | (F.col("own") != F.col("component")) | ~F.col("first")).select("cls", "n", "component", "first"), "answers")
    discard(classes, alive, labels)
    own = F.col("__key").cast("long")
    out = profile.join(_sent(answers.withColumn("__known", F.lit(True))), ["cls", "n"], "left")
    component = F.when((F.col("n") == 0) | F.col("__known").isNull(), own).otherwise(F.col("component"))
    more = [F.col("cls").alias("set_key"), F.coalesce("first", F.lit(True)).alias("first")] if detail else []
    return out.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), *more)
