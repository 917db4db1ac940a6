"""Katz backoff: Good-Turing discounted word pairs over discounted words, with exactly normalised backoff weights.

A corpus becomes chunks of whole documents, coded by a dictionary of their own. A chunk sends each distinct word, and
then each distinct pair, once to the cell that counts it, and gets the count back in the same order; so a word or pair
of a third of all rows is one entry a chunk. Cells write the count tables; chunks evaluate their own tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, stored
from millrace.llm.shingle_sets import _BYTES, _powers, mix

#: Tokens of a chunk, about (more if one document has more), and of a cell. Contexts with more tokens are dealt to several cells.
CHUNK_TOKENS, CELL_TOKENS = 2_000_000, 1_000_000
#: Counts up to this are discounted, if the counts of counts allow it; see `discounts`.
LARGEST_DISCOUNTED = 5
#: Words of more than 1/COMMON of all training tokens are sent by number; so their list, which is broadcast, has COMMON
#: entries of 8 bytes at most, in any corpus.
COMMON = 1 << 20
#: Bytes of text whose words are hashed at once.
PIECE_BYTES = 1 << 20
#: What follows a text's last word, and what precedes its first one.
END, START = np.uint64(0x51ED270B9F6A3C15), np.uint64(0xA24BAED4963EE407)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNTS = LARGEST_DISCOUNTED + 1  # counts of counts that are kept: of 1, 2, ...


def pack(values: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, byte by place, compressed."""
    if values.dtype.kind == "f":
        code = "d"
    else:
        top = int(values.max()) if len(values) else 0
        code = "B" if top < 1 << 8 else "H" if top < 1 << 16 else "I" if top < 1 << 32 else "Q"
    flat = np.ascontiguousarray(values.astype(code))
    planes = flat.view(np.uint8).reshape(len(flat), flat.itemsize).T
    return code.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(chr(data[0]))
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(kind.itemsize, -1)
    flat = np.ascontiguousarray(planes.T).view(kind).ravel()
    return flat if kind.kind == "f" else flat.astype(np.uint64 if kind.itemsize == 8 else np.int64)


def pack_words(words: np.ndarray, common: np.ndarray) -> bytes:
    """Hashes, those of common words by their number."""
    place = np.minimum(np.searchsorted(common, words), max(len(common) - 1, 0))
    known = common[place] == words if len(common) else np.zeros(len(words), dtype=bool)
    numbers = pack(np.where(known, place + 1, 0))
    return len(numbers).to_bytes(4, "little") + numbers + pack(words[~known])


def unpack_words(data: bytes, common: np.ndarray) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    numbers = unpack(data[4 : 4 + size])
    out = np.empty(len(numbers), dtype=np.uint64)
    out[numbers > 0] = common[numbers[numbers > 0] - 1]
    out[numbers == 0] = unpack(data[4 + size :])
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, in order, and the number of words of each text; null is empty.

    A-Z count as a-z; words are runs of other bytes than space and U+0009 to U+000D.
    """
    data = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    inside = inside.view(np.int8)
    begins, stops = np.flatnonzero(inside[1:-1] > inside[:-2]), np.flatnonzero(inside[1:-1] > inside[2:]) + 1
    cuts = ends[1:-1]  # a text that doesn't begin with a space may follow one that doesn't end with one
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    begins, stops = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([stops, cuts]))
    out = np.empty(len(begins), dtype=np.uint64)
    at = 0
    while at < len(begins):
        upto = max(at + 1, int(np.searchsorted(stops, begins[at] + PIECE_BYTES, side="right")))
        low, high = begins[at], stops[upto - 1]
        powers, inverses = _powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTES[_LOWER[raw[low:high]]] * powers[: high - low], out=sums[1:])
        b, e = begins[at:upto] - low, stops[at:upto] - low
        out[at:upto] = mix((sums[e] - sums[b]) * inverses[b])
        at = upto
    return out, np.diff(np.searchsorted(begins, ends))


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """What share of a count r = 0, 1, ... stays: Katz's form of Good-Turing for counts up to k, all of larger ones.

    k is the largest up to LARGEST_DISCOUNTED for which every share is in (0, 1]; if there is none, nothing is taken.
    """
    n = dict(enumerate(counts_of_counts, 1))
    for k in range(LARGEST_DISCOUNTED, 1, -1):
        if min(n[r] for r in range(1, k + 1)) > 0 and (rest := (k + 1) * n[k + 1] / n[1]) < 1:
            shares = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)]
            if all(0 < d <= 1 for d in shares):
                return np.array([1.0, *shares, *[1.0] * (LARGEST_DISCOUNTED - k)])
    return np.ones(LARGEST_DISCOUNTED + 1)


@dataclass
class Words:
    """The lower order: counts of words, discounted; what is taken goes to one outcome, a word that training lacks."""

    tokens: int
    types: int
    counts_of_counts: list[int]

    def __post_init__(self):
        self.shares = discounts(self.counts_of_counts)
        taken = sum((1 - self.shares[r]) * r * self.counts_of_counts[r - 1] for r in range(1, LARGEST_DISCOUNTED + 1))
        self.total = self.tokens if taken > 0 else self.tokens + 1
        self.unknown = (taken if taken > 0 else 1) / self.total

    def probability(self, count: np.ndarray) -> np.ndarray:
        share = self.shares[np.where(count <= LARGEST_DISCOUNTED, count, 0)]
        return np.where(count > 0, share * count / self.total, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def backoff(shares: np.ndarray, total: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and backoff weight of contexts: `total` tokens, seen[r - 1] successors of count r, `lower` the sum of
    the lower order's probabilities of all successors. A context whose counts lose nothing gives as much as one token;
    one that training lacks leaves all to the lower order."""
    taken = sum((1 - shares[r]) * r * seen[r - 1] for r in range(1, LARGEST_DISCOUNTED + 1))
    none = taken <= 0
    denominator = np.where(none, total + 1, total).astype(np.float64)
    weight = np.where(none, 1.0, taken) / denominator / (1 - lower)
    return denominator, np.where(total > 0, weight, 1.0)


def chunks(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The corpus by chunks: words (hashes), ids (each token's place in them, END after each text), lens, train, docs.

    The first two words of a chunk are END and START. Documents are never cut.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"chunk long, tokens long, words binary, ids binary, lens binary, train binary, docs array<{kind}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def row(parts: list[tuple]) -> pa.RecordBatch:
            own, n, flags, keys = [np.concatenate(x) for x in zip(*[h[:3] for h in parts], strict=True)] + [pa.concat_arrays([h[3] for h in parts])]
            words, place, times = np.unique(own, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), dtype=np.int64)
            order = np.argsort(-times, kind="stable")
            rank[order] = np.arange(2, len(words) + 2)
            ids = np.zeros(len(own) + len(n), dtype=np.int64)
            is_word = np.ones(len(ids), dtype=bool)
            is_word[np.cumsum(n + 1) - 1] = False
            ids[is_word] = rank[place]
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            blobs = [pa.array([pack(x)], pa.binary()) for x in (np.concatenate([[END, START], words[order]]).astype(np.uint64), ids, n + 1, flags)]
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([len(ids)]), *blobs, lists], names=["chunk", "tokens", "words", "ids", "lens", "train", "docs"])

        sizes: list[int] = []
        for batch in batches:
            for part in slices(iter([batch]), "__text", PIECE_BYTES):
                hashes, n = word_hashes(part.column(1))
                held.append((hashes, n, np.asarray(part.column(2).cast(pa.int8())).astype(np.int64), part.column(0)))
                sizes.append(len(hashes) + len(n))
                if sum(sizes) >= 1.5 * chunk_tokens:  # so that the last chunk isn't a small one
                    upto = int(np.searchsorted(np.cumsum(sizes), chunk_tokens)) + 1
                    yield row(held[:upto])
                    held, sizes, made = held[upto:], sizes[upto:], made + 1
        if held:
            yield row(held)

    return docs.select(key, F.col(text).alias("__text"), train.alias("__train")).mapInArrow(run, schema)


def _cut(places: np.ndarray, cells: int) -> list[np.ndarray]:
    """Which entries go to each cell, in their order."""
    order = np.argsort(places, kind="stable")
    return np.split(order, np.searchsorted(places[order], np.arange(1, cells)))


def _word_cells(words: np.ndarray, cells: int) -> np.ndarray:
    return (mix(words) % np.uint64(cells)).astype(np.int64)


def _trained(row: dict) -> np.ndarray:
    """Whether each token of a chunk counts."""
    return np.repeat(unpack(row["train"]), unpack(row["lens"]))


def ask_words(made: DataFrame, cells: int) -> DataFrame:
    """cell, chunk, words, n: each chunk's words and how often its training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack(row["words"])
                n = np.bincount(unpack(row["ids"]), weights=_trained(row), minlength=len(words)).astype(np.int64)
                parts = [(c, at) for c, at in enumerate(_cut(_word_cells(words, cells), cells)) if len(at)]
                out = [[c for c, _ in parts], [row["chunk"]] * len(parts), [pack(words[at]) for _, at in parts], [pack(n[at]) for _, at in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["cell", "chunk", "words", "n"])

    return made.select("chunk", "words", "ids", "lens", "train").mapInArrow(run, "cell int, chunk long, words binary, n binary")


_ANSWERS = "kind string, cell int, chunk long, a binary, b binary, c binary, d binary, e binary, stats array<long>"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())]
    names = ["kind", "cell", "chunk", "a", "b", "c", "d", "e", "stats"]
    filled = [(*r[:3], *r[3], *[None] * (5 - len(r[3])), r[4]) for r in rows]
    return pa.table({n: pa.array(x, t) for n, x, t in zip(names, zip(*filled, strict=True), kinds, strict=True)})


def _stats(counts: np.ndarray) -> list[int]:
    seen = counts[counts > 0]
    return [int(seen.sum()), len(seen), *np.bincount(np.minimum(seen, _COUNTS + 1), minlength=_COUNTS + 2)[1 : _COUNTS + 1].tolist()]


def count_words(asked: DataFrame) -> DataFrame:
    """Rows of kind `words` (a cell's table: a words, b counts) and `word` (answers to a chunk: a counts in its order)."""

    def run(group: pa.Table) -> pa.Table:
        cell, lists = group["cell"][0].as_py(), [unpack(x) for x in group["words"].to_pylist()]
        words, place = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([unpack(x) for x in group["n"].to_pylist()])).astype(np.int64)
        answers = np.split(counts[place], np.cumsum([len(x) for x in lists])[:-1])
        known = counts > 0
        out = [("word", cell, chunk, [pack(a)], None) for chunk, a in zip(group["chunk"].to_pylist(), answers, strict=True)]
        return _rows([("words", cell, None, [pack(words[known]), pack(counts[known])], _stats(counts)), *out])

    return asked.groupBy("cell").applyInArrow(run, _ANSWERS)


class Chunk:
    """One chunk with the counts of its words: its distinct pairs, and the cells that these go to."""

    def __init__(self, row: dict, answers: list[dict], cells: int, cell_tokens: int):
        self.words, ids, self.lens = unpack(row["words"]), unpack(row["ids"]), unpack(row["lens"])
        n = len(self.words)
        self.counts = np.zeros(n, dtype=np.int64)
        parts = _cut(_word_cells(self.words, cells), cells)
        for a in answers:
            if a["kind"] == "word":
                self.counts[parts[a["cell"]]] = unpack(a["a"])
        self.ids, self.first = ids, np.cumsum(self.lens) - self.lens
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[self.first] = 1
        keys, self.pair_of = np.unique(before * n + ids, return_inverse=True)
        self.h, self.w = keys // n, keys % n
        self.totals = self.counts.copy()  # tokens after each word, START and END changed
        self.totals[1], self.totals[0] = self.counts[0], 0
        split = -(-self.totals // cell_tokens)
        place = lambda h, part: (mix(self.words[h] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(cells)).astype(np.int64)
        part = np.where(split[self.h] > 1, (mix(self.words[self.w]) % np.maximum(split[self.h], 1).astype(np.uint64)).astype(np.int64), 0)
        cell = place(self.h, part)
        self.by_cell = np.argsort(cell, kind="stable")
        here = np.unique(self.h)
        self.wide = split > 1
        wide = here[self.wide[here]]  # contexts of several cells ask all of them
        each = split[wide]
        probes = np.repeat(wide, each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        entries = np.unique(np.concatenate([cell * n + self.h, place(*probes) * n + probes[0]]))
        self.entry_cell, self.entry_h = entries // n, entries % n
        self.pair_cell = cell[self.by_cell]
        self.runs = np.bincount(np.searchsorted(entries, cell * n + self.h), minlength=len(entries))

    def spans(self) -> Iterator[tuple[int, slice, slice]]:
        """Each asked cell with its contexts (in entry order) and its pairs (in by_cell order)."""
        asked = np.unique(self.entry_cell)
        e = np.searchsorted(self.entry_cell, [asked, asked + 1])
        p = np.searchsorted(self.pair_cell, [asked, asked + 1])
        for i, cell in enumerate(asked.tolist()):
            yield cell, slice(e[0][i], e[1][i]), slice(p[0][i], p[1][i])

    def questions(self, trained: np.ndarray) -> Iterator[tuple]:
        times = np.bincount(self.pair_of, weights=trained, minlength=len(self.h)).astype(np.int64)
        for cell, contexts, pairs in self.spans():
            at = self.by_cell[pairs]
            own, place = np.unique(self.w[at], return_inverse=True)
            yield cell, [self.words[self.entry_h[contexts]], self.runs[contexts], self.wide[self.entry_h[contexts]], self.words[own], self.counts[own], place, times[at]]


def backing_off(wide: np.ndarray, runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The contexts whose backoff weight a chunk needs: those of several cells, and such as have a pair without a count."""
    missing = np.bincount(np.repeat(np.arange(len(runs)), runs), weights=counts == 0, minlength=len(runs)) > 0
    return np.flatnonzero(missing | (wide > 0))


def _cogrouped(made: DataFrame, answers: DataFrame):
    return made.groupBy("chunk").cogroup(answers.groupBy("chunk"))


def common_words(tables: DataFrame, lower: Words) -> np.ndarray:
    """The hashes of the words with more than 1/COMMON of all tokens, in order."""
    least = lower.tokens // COMMON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(words)[unpack(counts) > least].astype(np.uint64).view(np.int64))], names=["word"])

    found = tables.select("a", "b").mapInArrow(run, "word long").toArrow().column("word")
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def ask_pairs(made: DataFrame, answers: DataFrame, cells: int, cell_tokens: int, shared) -> DataFrame:
    """cell, chunk and a chunk's pairs there: contexts, pairs of each, whether a context has several cells, words, their
    counts, each pair's word and times."""
    names = ["contexts", "runs", "wide", "words", "counts", "place", "n"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        rows = list(Chunk(row, right.to_pylist(), cells, cell_tokens).questions(_trained(row)))
        out = {"cell": pa.array([c for c, _ in rows], pa.int32()), "chunk": pa.array([row["chunk"]] * len(rows), pa.int64())}
        coded = lambda n, x: pack_words(x, shared.value) if n in ("contexts", "words") else pack(x)
        return pa.table(out | {n: pa.array([coded(n, x[k]) for _, x in rows], pa.binary()) for k, n in enumerate(names)})

    return _cogrouped(made.drop("docs", "tokens"), answers.select("chunk", "kind", "cell", "a")).applyInArrow(run, "cell int, chunk long, " + ", ".join(f"{n} binary" for n in names))


def count_pairs(asked: DataFrame, words: Words, shared) -> DataFrame:
    """Rows of kind `pairs` (a cell's table: a contexts, b pairs of each, c words, d each pair's word, e counts) and
    `pair` (answers: a counts of pairs; c the contexts' successors of count 1, 2, ...; b the lower order's sum of those
    contexts that back off)."""

    def run(group: pa.Table) -> pa.Table:
        cell, rows = group["cell"][0].as_py(), []
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for r in group.to_pylist():
            contexts, own = (unpack_words(r[k], shared.value) for k in ("contexts", "words"))
            runs, wide, counts, place = (unpack(r[k]) for k in ("runs", "wide", "counts", "place"))
            rows.append((r["chunk"], contexts, runs, wide))
            for column, values in zip(columns, (np.repeat(contexts, runs), own[place], counts[place], unpack(r["n"])), strict=True):
                column.append(values)
        h, w, lower, n = (np.concatenate(columns.pop(0)) for _ in range(4))
        _, first, of = np.unique(mix(h * np.uint64(0x9E3779B97F4A7C15) + w), return_index=True, return_inverse=True)
        counts = np.bincount(of, weights=n, minlength=len(first)).astype(np.int64)
        seen = np.flatnonzero(counts > 0)
        contexts, ctx = np.unique(h[first[seen]], return_inverse=True)
        sums = np.append(np.bincount(ctx, weights=words.probability(lower[first[seen]]), minlength=len(contexts)), 0.0)
        small = counts[seen] <= LARGEST_DISCOUNTED
        few = np.zeros((len(contexts) + 1, LARGEST_DISCOUNTED), dtype=np.int64)
        np.add.at(few, (ctx[small], counts[seen][small] - 1), 1)
        out, at = [], 0
        for chunk, asked_contexts, runs, wide in rows:
            own = counts[of[at : at + int(runs.sum())]]
            at += len(own)
            place = np.minimum(np.searchsorted(contexts, asked_contexts), max(len(contexts) - 1, 0))
            known = contexts[place] == asked_contexts if len(contexts) else np.zeros(len(place), dtype=bool)
            place = np.where(known, place, len(contexts))
            out.append(("pair", cell, chunk, [pack(own), pack(sums[place[backing_off(wide, runs, own)]]), pack(few[place].T.ravel())], None))
        order = np.argsort(ctx, kind="stable")
        types, which = np.unique(w[first[seen]][order], return_inverse=True)
        table = [contexts, np.bincount(ctx, minlength=len(contexts)), types, which, counts[seen][order]]
        return _rows([("pairs", cell, None, [pack(x) for x in table], _stats(counts)), *out])

    return asked.groupBy("cell").applyInArrow(run, _ANSWERS)


def evaluate(made: DataFrame, answers: DataFrame, cells: int, cell_tokens: int, words: Words, shares: np.ndarray, key: str, kind: str, named: str) -> DataFrame:
    """The scores of the chunks' documents from the answers to their words and pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, given = left.to_pylist()[0], right.to_pylist()
        own = Chunk(row, given, cells, cell_tokens)
        counts, lower, few = np.zeros(len(own.h), dtype=np.int64), np.zeros(len(own.words)), np.zeros((LARGEST_DISCOUNTED, len(own.words)), dtype=np.int64)
        told = {a["cell"]: a for a in given if a["kind"] == "pair"}
        for cell, contexts, pairs in own.spans():
            a = told[cell]
            times, asked = unpack(a["a"]), own.entry_h[contexts]
            counts[own.by_cell[pairs]] = times
            lower[asked[backing_off(own.wide[asked], own.runs[contexts], times)]] += unpack(a["b"])
            few[:, asked] += unpack(a["c"]).reshape(LARGEST_DISCOUNTED, -1)
        denominator, weight = backoff(shares, own.totals, few, lower)
        kept = shares[np.where(counts <= LARGEST_DISCOUNTED, counts, 0)] * counts / denominator[own.h]
        p = np.where(counts > 0, kept, weight[own.h] * words.probability(own.counts)[own.w])
        per_doc = lambda values: np.add.reduceat(values, own.first)
        scores = {"base_score": per_doc(words.base(own.counts)[own.ids]), "score": per_doc(np.log10(p)[own.pair_of])}
        known = per_doc((own.counts > 0)[own.ids].astype(np.int64))
        n = len(own.lens)
        flat = left["docs"].combine_chunks().flatten()
        out = {key: flat, named: pa.array(unpack(row["train"]) == 0), "n_tokens": own.lens.astype(np.int64), "n_known": known, "train_tokens": np.full(n, words.tokens, dtype=np.int64)}
        return pa.table(out | scores)

    schema = f"`{key}` {kind}, {named} boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _cogrouped(made.drop("tokens"), answers.select("chunk", "kind", "cell", "a", "b", "c")).applyInArrow(run, schema)


@dataclass
class Tables:
    """What training leaves: the tables by cell, packed, and their counts of counts."""

    words: DataFrame
    pairs: DataFrame
    lower: Words
    shares: np.ndarray


def _summed(table: DataFrame) -> list[int]:
    each = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(_COUNTS + 2)]
    return list(table.where(F.col("stats").isNotNull()).agg(*each).first())


def unpacked(tables: Tables) -> DataFrame:
    """context, word (hashes), count: the pairs of the tables as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                contexts, runs, words, place, counts = (unpack(r[k]) for k in "abcde")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(contexts, runs).astype(np.uint64).view(np.int64)), pa.array(words[place].astype(np.uint64).view(np.int64)), pa.array(counts.astype(np.int64))], names=["context", "word", "count"])

    return tables.pairs.select("a", "b", "c", "d", "e").mapInArrow(run, "context long, word long, count long")


def score(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", named: str = "held_out", chunk_tokens: int = CHUNK_TOKENS, cell_tokens: int = CELL_TOKENS) -> tuple[DataFrame, Tables]:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; and the tables.

    Rows where `train` holds teach, all are scored. A null or empty text is its end alone; a null key is as any other;
    repeated rows teach and are scored each; very long texts are whole; without training rows every token is the one
    unknown outcome (score 0); an empty table gives no rows. Other columns are not looked at, whatever their names.

    Words are known by 64-bit hashes. Pairs of a context of more than cell_tokens tokens go to several cells.
    """
    made = stored(chunks(docs, F.coalesce(train, F.lit(False)), text, key, chunk_tokens), "chunks")
    cells = max(1, -(-(made.agg(F.sum("tokens")).first()[0] or 0) // cell_tokens))
    words = stored(count_words(ask_words(made, cells)), "words")
    tokens, types, *few = _summed(words)
    lower = Words(tokens, types, few)
    told = words.where(F.col("kind") == "word")
    tables = words.where(F.col("kind") == "words")
    shared = docs.sparkSession.sparkContext.broadcast(common_words(tables, lower))
    pairs = stored(count_pairs(ask_pairs(made, told, cells, cell_tokens, shared), lower, shared), "pairs")
    shares = discounts(_summed(pairs)[2:])
    answers = told.unionByName(pairs.where(F.col("kind") == "pair"))
    learned = Tables(tables, pairs.where(F.col("kind") == "pairs"), lower, shares)
    return evaluate(made, answers, cells, cell_tokens, lower, shares, key, dict(docs.dtypes)[key], named), learned
