"""Document fingerprints by context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices

#: Bytes of the rolling window, least block size, the signature's usual number of characters.
WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
#: Characters in a row that two signatures must share.
COMMON = 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
#: Bytes that are hashed at once.
CHUNK = 1 << 20


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each byte; zeros stand before the text."""
    x = np.concatenate([np.zeros(WINDOW - 1, dtype=np.uint32), data.astype(np.uint32) + 1])
    h, n = np.zeros(len(data), dtype=np.uint32), len(data)
    for j in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += x[j : j + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _signature(hashes: np.ndarray, block: int) -> str:
    """A character for each piece. A piece ends where the rolling hash hits the block size; its character comes from
    the sum of the mixed rolling hashes in it, each times an odd number of its place in the piece, so it depends on the
    piece, its order, and the few bytes before it only."""
    n = len(hashes)
    ends = np.flatnonzero(hashes % np.uint32(block) == block - 1) + 1
    starts = np.concatenate([[0], ends])
    if starts[-1] == n:
        starts = starts[:-1]
    mixed = (hashes ^ (hashes >> np.uint32(13))) * np.uint32(0x5BD1E995)
    place = np.arange(n, dtype=np.uint32) - np.repeat(starts, np.diff(np.append(starts, n))).astype(np.uint32)
    sums = np.add.reduceat(mixed * (place * np.uint32(2) + np.uint32(1)), starts, dtype=np.uint32)
    sums ^= sums >> np.uint32(16)
    sums *= np.uint32(0x9E3779B1)
    return _LETTERS[sums >> np.uint32(26)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """`block:signature:signature of twice the block`, over every byte of the text. `3::` for an empty one.

    The block size is the least of 3, 6, 12, ... with no more than LENGTH blocks in the text. It follows from the length
    alone, so that a text and its edit, whose lengths are near, always have a block size in common.
    """
    if not text:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(text, dtype=np.uint8)
    hashes = np.concatenate([_rolling(data[max(0, at - WINDOW + 1) : at + CHUNK])[min(at, WINDOW - 1) :] for at in range(0, len(data), CHUNK)])
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    return f"{block}:{_signature(hashes, block)}:{_signature(hashes, 2 * block)}"


def _edits(a: str, b: str) -> int:
    """Insertions and deletions between two strings, by a bit-parallel longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


def _likeness(a: str, b: str) -> float:
    """1 less the edits by the characters. 0 without a common run of COMMON characters (half of a shorter signature):
    single characters meet by chance."""
    if not a or not b:
        return float(a == b)
    run = max(1, min(COMMON, min(len(a), len(b)) // 2))
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - _edits(a, b) / (len(a) + len(b))


def compare(a: str, b: str) -> float:
    """0 to 1: the best likeness of signatures of the same block size; 1 for equal fingerprints, 0 where block sizes
    are more than a factor of two apart."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    if m == n:
        return max(_likeness(a1, b1), _likeness(a2, b2) if a2 and b2 else 0.0)
    if int(m) == 2 * int(n):
        return _likeness(a1, b2)
    return _likeness(a2, b1) if 2 * int(m) == int(n) else 0.0


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, fingerprint of every whole text; null acts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            marks = [fingerprint(t.encode("utf-8", "replace")) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, F.coalesce(text, F.lit("")).alias("__text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _cuts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Ids that part the rows into about equal buckets. Any ids would do; they only balance the work."""
    if buckets < 2:
        return np.zeros(0, dtype=np.int64)
    found = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    return np.array(sorted({int(x) for x in found}), dtype=np.int64)


def bucket_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """Descending ids in ascending buckets; null ids in the last one."""
    down = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts), down).astype(np.int32)


def neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """__bucket, __guest, doc_id, __text: documents in buckets of consecutive ids, a text once.

    The first row of a bucket also goes, as a guest, to the bucket before it, whose last row it follows; the last
    bucket gets the first row of all. Equal ids follow each other in order of their texts, nulls come last. The driver
    holds one id for each bucket; a row finds its bucket by binary search.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"))
    cuts = _cuts(rows, buckets)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0), cuts)), batch.column(0)], names=["b", "i"])

    first = {r.b: r.i for r in rows.select("doc_id").mapInArrow(places, "b int, i long").groupBy("b").agg(F.max("i").alias("i")).collect()}
    order = sorted(first)
    before = {b: order[at - 1] for at, b in enumerate(order)}  # the first's is the last, around the end

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 16 << 20):
            own = bucket_of(batch.column(0), cuts)
            lead = [at for at, (b, i) in enumerate(zip(own.tolist(), batch.column(0).to_pylist(), strict=True)) if i == first[b]]
            for where, guest in ((slice(None), False), (lead, True)):
                part = batch.take(pa.array(lead, pa.int64())) if guest else batch
                bucket = np.array([before[b] for b in own[where].tolist()], dtype=np.int32) if guest else own
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(part.num_rows, guest)), *part.columns], names=["__bucket", "__guest", "doc_id", "__text"])

    return rows.mapInArrow(deal, "__bucket int, __guest boolean, doc_id long, __text string")


def edit_report(docs: DataFrame) -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of the next lower doc_id, after the last the first; equal ids follow each other in
    order of text, null ids come last. A table of one row is followed by itself, an empty one gives no rows. Null texts
    act as empty ones; very long ones are hashed whole. Ids are whole numbers. Other columns of docs are not looked at.
    Rows are shuffled once, a bucket of consecutive ids to each of spark.sql.shuffle.partitions tasks; a task keeps one
    row and its Arrow batch.
    """
    kind = "bigint"
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    near = neighbours(docs, buckets).repartitionById(buckets, F.col("__bucket"))
    ordered = near.sortWithinPartitions("__bucket", "__guest", F.col("doc_id").desc_nulls_last(), "__text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # the row that waits for its next one
        for part in slices(batches, "__text"):
            out: list[tuple] = []
            for bucket, guest, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if guest and (held is None or bucket != held[0]):
                    continue  # more guests of equal ids: the first one, least in text, is the next document
                mark = fingerprint(text.encode("utf-8", "replace"))
                if held is not None and held[0] == bucket:
                    _, own_id, own_text, own_mark = held
                    changed = edited(own_text, text).encode("utf-8", "replace")
                    changed_mark = fingerprint(changed)
                    out.append((own_id, len(own_text), hashlib.sha256(changed).hexdigest(), own_mark, changed_mark, compare(own_mark, changed_mark), compare(own_mark, mark)))
                held = None if guest else (bucket, doc_id, text, mark)
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.schema.field(2).type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:5]), *(pa.array(c, pa.float64()) for c in columns[5:])], names=names)

    return ordered.mapInArrow(run, schema)
