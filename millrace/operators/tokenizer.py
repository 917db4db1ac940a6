"""Tokenizer operators: pre-tokens, byte-level pair merges, compression, checks."""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.storage import written

# Fixed value: the pattern of pre-tokens, single digits, contractions in either case.
PRETOKEN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
# The same for Python's engine: white space is ASCII's and contractions are of ASCII letters, as in the JVM.
PRETOKEN_HERE = (
    r"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^ \t\n\x0B\f\r\p{L}\p{N}]+[\r\n]*"
    r"|[ \t\n\x0B\f\r]*[\r\n]+|[ \t\n\x0B\f\r]+(?![^ \t\n\x0B\f\r])|[ \t\n\x0B\f\r]+"
)
#: Characters of the pieces that an encoder remembers, about, and of the longest of them.
CACHED_CHARACTERS, LONGEST_CACHED = 16_000_000, 256
#: With so many new pieces at once, an encoder merges them side by side.
SIDE_BY_SIDE = 20_000
#: Distinct pre-tokens that the merge loop holds on the driver at most; with more of them, they stay where they are and
#: the driver gets the totals of so many pairs, and the pieces of the first of these at a time.
PRETOKENS_ON_DRIVER, PAIRS_ON_DRIVER = 200_000, 50_000
#: With fewer leading pairs than this in the pieces that the driver may hold, a round goes by totals alone.
LEAST_HERE = 40
#: Leading pairs of the first round; and how many times as many a round may take as the one before.
FIRST_LEADING, MORE_LEADING = 64, 8
#: A round's pieces on the driver, as a multiple of PRETOKENS_ON_DRIVER: most of them are two or three tokens.
TIMES_AT_ONCE = 3
#: Merges after which the spread loop writes its pieces down.
WRITE_EVERY = 50
#: Pieces of a task of the spread loop, and tokens that it looks at together, about.
PIECES_A_TASK, TOKENS_AT_ONCE = 100_000, 2_000_000


def pretokens(text: Column) -> Column:
    """Pieces that, joined, give the text again."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(pretokens(F.col(text))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def learn_merges(counts: DataFrame, merges: int, least: int = 2) -> list[tuple[bytes, bytes]]:
    """Pair merges by frequency over pre-token counts; ties go to the pair that sorts first.

    All distinct pieces take part: on the driver up to PRETOKENS_ON_DRIVER of them, else spread over the cluster with
    few jobs for each run of merges. Both ways give the same merges.
    """
    counts = written(counts)
    if counts.count() > PRETOKENS_ON_DRIVER:
        return _learn_spread(counts, merges, least)
    rows = counts.collect()
    pieces = [([bytes([b]) for b in r.piece.encode("utf-8", "replace")], r.n) for r in rows]
    where: dict[tuple[bytes, bytes], set[int]] = {}
    totals: Counter = Counter()
    for at, (parts, n) in enumerate(pieces):
        for pair in zip(parts, parts[1:], strict=False):
            totals[pair] += n
            where.setdefault(pair, set()).add(at)
    # The heap holds each pair's totals, old ones too; an entry counts only if it is the pair's total of now.
    heap = [(-n, pair) for pair, n in totals.items()]
    heapq.heapify(heap)
    made: list[tuple[bytes, bytes]] = []
    while len(made) < merges and heap:
        n, pair = heapq.heappop(heap)
        if totals.get(pair) != -n:
            continue
        if -n < least:
            break
        made.append(pair)
        change: Counter = Counter()
        for at in where.pop(pair):
            parts, n = pieces[at]
            joined = _joined(parts, pair)
            if len(joined) == len(parts):
                continue
            for old in zip(parts, parts[1:], strict=False):
                change[old] -= n
            for new in zip(joined, joined[1:], strict=False):
                change[new] += n
                where.setdefault(new, set()).add(at)
            parts[:] = joined
        del totals[pair]
        for other, by in change.items():
            if by and other != pair:
                totals[other] += by
                heapq.heappush(heap, (-totals[other], other))
    return made


def _joined(parts: list, pair: tuple) -> list:
    out, i = [], 0
    while i < len(parts):
        step = 2 if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair else 1
        out.append(parts[i] + parts[i + 1] if step == 2 else parts[i])
        i += step
    return out


class PairTable:
    """Totals of neighbouring pairs, with what the sequential order of merges needs: the best pair, and what is certain
    to follow it. Ties go to the pair that sorts first."""

    def __init__(self, totals: dict[tuple, int]):
        self.totals: Counter = Counter()
        self.before: dict = {}
        self.after: dict = {}
        self.heap: list = []
        self.add(totals)

    def add(self, change: dict[tuple, int]) -> None:
        for pair, by in change.items():
            self.totals[pair] += by
            if self.totals[pair] > 0:
                self.after.setdefault(pair[0], set()).add(pair[1])
                self.before.setdefault(pair[1], set()).add(pair[0])
                heapq.heappush(self.heap, (-self.totals[pair], pair))
            else:
                del self.totals[pair]
                self.after.get(pair[0], set()).discard(pair[1])
                self.before.get(pair[1], set()).discard(pair[0])

    def certain(self, least: int, most: int) -> list[tuple]:
        """The next merges of the sequential order, as many as the totals of now prove.

        A merge of (a, b) changes no pair without a and b, takes from those that have one of them, and makes pairs
        (x, ab) and (ab, y) of at most as many as (x, a) and (b, y) were. So the next best pair comes next if it has no
        token of the merges before it and no such new pair could come before it; a new pair of two new tokens sorts
        behind the one with the first of them and the second's own first token, which bounds its total too.
        """
        out: list[tuple] = []
        taken: set = set()
        top: list[tuple] = []  # the best that new pairs could be: (-total, pair), a heap
        while self.heap and len(out) < most:
            n, pair = heapq.heappop(self.heap)
            if self.totals.get(pair) != -n:
                continue
            if -n < least or taken.intersection(pair) or (top and top[0] < (n, pair)):
                heapq.heappush(self.heap, (n, pair))
                break
            a, b = pair
            out.append(pair)
            taken.update(pair)
            for x in self.before.get(a, ()):
                heapq.heappush(top, (max(n, -self.totals[x, a]), (x, a + b)))
            for y in self.after.get(b, ()):
                heapq.heappush(top, (max(n, -self.totals[b, y]), (a + b, y)))
            if a == b:
                break
        for pair in out:
            heapq.heappush(self.heap, (-self.totals[pair], pair))
        return out


def _merged(parts: list, pairs: list[tuple]) -> list:
    for pair in pairs:
        if pair[0] in parts:
            parts = _joined(parts, pair)
    return parts


class PieceRound:
    """A run of merges over the pieces that hold any of some leading pairs.

    `known` has the first pairs of the order and their totals, the last of them `rest` (0: all pairs), of which `here` are those
    whose pieces are all at hand. A token that is new in this run is made in these pieces only, so its pairs are here
    too. A merge is made only if it is the next of the sequential order and all its pieces are here; the run ends before
    one that isn't.
    """

    def __init__(self, known: dict[tuple, int], here: set[tuple], rest: int, tokens: set[str]):
        self.totals, self.here, self.rest, self.tokens = Counter(known), here, rest, tokens
        self.last = max((pair for pair, n in known.items() if n == rest), default=None)
        self.heap = [(-n, pair) for pair, n in known.items()]
        heapq.heapify(self.heap)
        self.gained: Counter = Counter()  # of pairs that are not known
        self.pieces: list[tuple[list, int]] = []
        self.where: dict[tuple, list[int]] = {}

    def add(self, parts: list[str], n: int) -> None:
        for pair in self.here.intersection(zip(parts, parts[1:], strict=False)):
            self.where.setdefault(pair, []).append(len(self.pieces))
        self.pieces.append((parts, n))

    def run(self, least: int, most: int) -> list[tuple]:
        made: list[tuple] = []
        fresh: set[str] = set()
        floor = self.rest  # what a pair that is not known could have
        while len(made) < most and self.heap:
            n, pair = heapq.heappop(self.heap)
            if self.totals.get(pair) != -n:
                continue
            if -n < least or -n < floor or pair not in self.here:
                break
            if -n == floor and not (floor == self.rest and self.last is not None and pair <= self.last):
                break
            made.append(pair)
            if pair[0] + pair[1] not in self.tokens:
                fresh.add(pair[0] + pair[1])
            change: Counter = Counter()
            for at in dict.fromkeys(self.where.pop(pair)):
                parts, times = self.pieces[at]
                joined = _joined(parts, pair)
                if len(joined) == len(parts):
                    continue
                for old in zip(parts, parts[1:], strict=False):
                    change[old] -= times
                for new in zip(joined, joined[1:], strict=False):
                    change[new] += times
                    if new[0] in fresh or new[1] in fresh:
                        self.here.add(new)
                    if new in self.here:
                        self.where.setdefault(new, []).append(at)
                parts[:] = joined
            del self.totals[pair]
            for other, by in change.items():
                if not by or other == pair:
                    continue
                if other in self.totals or other in self.here:
                    self.totals[other] += by
                    heapq.heappush(self.heap, (-self.totals[other], other))
                elif self.rest:
                    self.gained[other] += by
                    floor = max(floor, self.rest + self.gained[other])
        return made


def _learn_spread(counts: DataFrame, merges: int, least: int) -> list[tuple[bytes, bytes]]:
    """learn_merges over a table of pieces that stays distributed, as arrays of token numbers; on the driver tokens are
    hexadecimal text, whose order is theirs.

    A round counts the pairs in the cluster, takes the first PAIRS_ON_DRIVER of their order and a floor among their
    totals, and makes all merges whose total is the floor or more. Pieces are cut for it between tokens whose pair has
    a smaller total: what is made of a token's bytes is the same wherever these become that token, so a pair that comes
    up later lies over one pair of now in all its places, and has no larger total. What remains is equal far more often
    than pieces are, so the cluster adds up its counts and the driver learns from as many different ones as
    PRETOKENS_ON_DRIVER allows; the floor follows from how many there were. Then the cluster makes the same merges.

    Where that leaves too few pairs, the whole pieces of as many pairs as PRETOKENS_ON_DRIVER allows come to the driver,
    which makes all merges that these decide (PieceRound), or else the merges are made that the totals alone prove to
    come next (PairTable). The driver's share has a bound either way.
    """
    names = [f"{b:02X}" for b in range(256)]
    number = {name: i for i, name in enumerate(names)}
    raw = counts.where(F.octet_length("piece") > 1).select("piece", "n").repartition(-(-counts.count() // PIECES_A_TASK), "piece")
    table = written(raw.select(F.encode("piece", "UTF-8").alias("parts"), "n").mapInArrow(_numbered, "parts array<int>, n long"))
    made: list[tuple] = []
    pending: list[tuple[int, int, int]] = []
    most_here, leading = TIMES_AT_ONCE * PRETOKENS_ON_DRIVER, FIRST_LEADING

    def add(fresh: list[tuple]) -> None:
        for a, b in fresh:
            if a + b not in number:
                number[a + b] = len(names)
                names.append(a + b)
            made.append((a, b))
            pending.append((number[a], number[b], number[a + b]))

    def made_here(rows: DataFrame, known: dict[tuple, int], here: set[tuple], rest: int, floor: int) -> list[tuple]:
        work = PieceRound(known, set(here), rest, set(names))
        for batch in rows.toArrow().to_batches():  # most_here rows at most
            for parts, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                work.add([names[i] for i in parts], n)
        return work.run(floor, merges - len(made))

    while len(made) < merges:
        if len(pending) >= WRITE_EVERY:
            table, pending, leading = written(_made(table, pending)), [], max(leading, LEAST_HERE)
        ordered = sorted(names)
        sums = _pairs(table, pending, names).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("n") >= least)
        found = sums.orderBy(F.desc("n"), "a", "b").limit(PAIRS_ON_DRIVER).toArrow()
        rows = zip(*(found.column(c).to_pylist() for c in ("a", "b", "n", "m")), strict=True)
        top = sorted((((ordered[a], ordered[b]), n, m) for a, b, n, m in rows), key=lambda r: (-r[1], r[0]))
        if not top:
            break
        rest = top[-1][1] if len(top) == PAIRS_ON_DRIVER else 0
        known = {pair: n for pair, n, _ in top}
        fresh: list[tuple] = []
        while not fresh and leading >= min(LEAST_HERE, len(top)):
            floor = max(top[min(leading, len(top)) - 1][1], rest + 1)
            alive = {pair for pair, n in known.items() if n >= floor}
            if not alive:
                break
            if pending:
                table, pending = written(_made(table, pending)), []
            parts = written(_between(table, {(number[a], number[b]) for a, b in alive}).groupBy("parts").agg(F.sum("n").alias("n")))
            held = parts.count()
            if held > most_here:
                leading = min(leading, len(alive)) // 2
                continue
            fresh = made_here(parts, {pair: known[pair] for pair in alive}, alive, 0, floor)
            leading = max(LEAST_HERE, int(len(alive) * min(MORE_LEADING, most_here / 2 / held)))
        if not fresh:
            here, held = set(), 0
            for pair, _, m in top:
                held += m
                if held > most_here:
                    break
                here.add(pair)
            if len(here) < LEAST_HERE and len(here) < len(top):
                fresh = [pair for pair in PairTable(known).certain(least, merges - len(made)) if known[pair] > rest]
            else:
                if pending:
                    table, pending = written(_made(table, pending)), []
                fresh = made_here(written(_holding(table, {(number[a], number[b]) for a, b in here})), known, here, rest, least)
        add(fresh or [top[0][0]])  # the first pair comes next in any case
    return [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in made]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes as their numbers."""
    for batch in batches:
        data, n = batch.column(0), batch.column(1)
        sizes = np.asarray(pc.binary_length(data), dtype=np.int64)
        flat = np.frombuffer(b"".join(data.to_pylist()), dtype=np.uint8).astype(np.int32)
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([parts, n], names=["parts", "n"])


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pieces of a task, TOKENS_AT_ONCE tokens or little more at a time: tokens with -1 behind each piece, and counts."""
    held, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            lists = batch.column(0)
            ends = np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64) + 1)
            tokens = np.full(ends[-1], -1, dtype=np.int32)
            inside = np.ones(ends[-1], dtype=bool)
            inside[ends - 1] = False
            tokens[inside] = lists.flatten().to_numpy()
            held.append((tokens, batch.column(1).to_numpy()))
            size += len(tokens)
        if held and (batch is None or size >= TOKENS_AT_ONCE):
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0


def _merge_all(tokens: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """Tokens after merges (left, right, new) in their order, each from left to right.

    Each merge looks only at the places of one of its tokens; tokens that are merged away are stepped over."""
    if not merges or not len(tokens):
        return tokens
    tokens = tokens.copy()
    order = np.argsort(tokens, kind="stable")
    begins = np.cumsum(np.bincount(tokens + 1))  # of each token's places in this order, behind those of -1
    after, before = np.arange(1, len(tokens) + 1), np.arange(-1, len(tokens) - 1)
    places: dict[int, np.ndarray] = {}
    none = order[:0]

    def of(token: int) -> np.ndarray:
        if token not in places:
            places[token] = order[begins[token] : begins[token + 1]] if token + 1 < len(begins) else none
        return places[token]

    for a, b, new in merges:
        if not len(of(a)) or not len(of(b)):
            continue
        if len(of(a)) <= len(of(b)):
            places[a] = at = of(a)[tokens[of(a)] == a]
            at = at[tokens[after[at]] == b]
        else:
            places[b] = at = of(b)[tokens[of(b)] == b]
            at = before[at]  # -1 before all: the last one, which ends a piece
            at = at[tokens[at] == a]
        if a == b and len(at) > 1:  # in a run of them every second one
            number = np.arange(len(at))
            first = np.concatenate([[True], after[at[:-1]] != at[1:]])
            at = at[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]
        if len(at):
            gone = after[at]
            tokens[at], tokens[gone] = new, -2
            after[at] = after[gone]
            before[after[at]] = at
            places[new] = np.union1d(of(new), at) if len(of(new)) else at
    return tokens[tokens != -2]


def _listed(tokens: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
    """The wanted pieces as a batch."""
    ends = tokens == -1
    sizes = np.diff(np.flatnonzero(ends), prepend=-1) - 1
    kept = tokens[np.repeat(wanted, sizes + 1) & ~ends]
    parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[wanted])]), pa.int32()), pa.array(kept, pa.int32()))
    return pa.RecordBatch.from_arrays([parts, pa.array(n[wanted], pa.int64())], names=["parts", "n"])


def _pairs(table: DataFrame, pending: list[tuple[int, int, int]], names: list[str]) -> DataFrame:
    """a, b, n, m: totals and places of neighbouring tokens after the pending merges, summed by task; tokens are numbered
    in the order of their names."""
    size = len(names)
    place = np.empty(size, dtype=np.int64)
    place[sorted(range(size), key=names.__getitem__)] = np.arange(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n in _laid(batches):
            tokens = _merge_all(tokens, pending)
            piece = np.cumsum(tokens == -1)
            at = np.flatnonzero((tokens[:-1] >= 0) & (tokens[1:] >= 0))
            codes, places = np.unique(tokens[at].astype(np.int64) * size + tokens[at + 1], return_inverse=True)
            totals = np.zeros(len(codes), dtype=np.int64)
            np.add.at(totals, places, n[piece[at]])
            columns = (place[codes // size], place[codes % size], totals, np.bincount(places, minlength=len(codes)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n", "m"])

    return table.mapInArrow(run, "a long, b long, n long, m long")


def _between(table: DataFrame, pairs: set[tuple[int, int]]) -> DataFrame:
    """parts, n: the pieces, cut between all neighbouring tokens that are none of the pairs, without single tokens."""
    wanted = np.array(sorted(a << 32 | b for a, b in pairs), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n in _laid(batches):
            codes = tokens[:-1].astype(np.int64) << 32 | tokens[1:]
            stays = (wanted[np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)] == codes) & (tokens[:-1] >= 0)
            edges = np.diff(np.concatenate([[0], stays.view(np.int8), [0]]))
            first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # tokens at both ends
            inside = np.concatenate([stays, [False]]) | np.concatenate([[False], stays])
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(last - first + 1)]), pa.int32()), pa.array(tokens[inside]))
            yield pa.RecordBatch.from_arrays([parts, pa.array(n[np.cumsum(tokens == -1)[first]], pa.int64())], names=["parts", "n"])

    return table.mapInArrow(run, "parts array<int>, n long")


def _holding(table: DataFrame, pairs: set[tuple[int, int]]) -> DataFrame:
    """The pieces that hold any of the pairs."""
    wanted = np.array(sorted(a << 32 | b for a, b in pairs), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n in _laid(batches):
            hit = np.isin(tokens[:-1].astype(np.int64) << 32 | tokens[1:], wanted) & (tokens[:-1] >= 0)
            piece = np.cumsum(tokens == -1)
            yield _listed(tokens, n, np.bincount(piece[:-1][hit], minlength=len(n)) > 0)

    return table.mapInArrow(run, "parts array<int>, n long")


def _made(table: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """The table after a run of merges, without pieces of one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n in _laid(batches):
            tokens = _merge_all(tokens, merges)
            yield _listed(tokens, n, np.diff(np.flatnonzero(tokens == -1), prepend=-1) > 2)

    return table.mapInArrow(run, "parts array<int>, n long")


def vocabulary(merges: list[tuple[bytes, bytes]]) -> dict[bytes, int]:
    """Bytes, then merged tokens in order."""
    return {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}


class Encoder:
    """Ids of pieces by merges in order of rank, with the pieces seen before at hand."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.ranks = {p: i for i, p in enumerate(merges)}
        self.ids = vocabulary(merges)
        self.cache: dict[str, list[int]] = {}
        self.cached = 0
        # No merge makes a token that one before it has taken or made: then the lowest rank first is rank by rank.
        seen = {bytes([b]) for b in range(256)}
        self.in_order = all(a in seen and b in seen and a + b not in seen and not seen.add(a + b) for a, b in merges)
        self.numbered = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges] if self.in_order else []

    def piece(self, piece: str) -> list[int]:
        found = self.cache.get(piece)
        return found if found is not None else self._kept(piece, self._merge([bytes([b]) for b in piece.encode("utf-8", "replace")]))

    def _kept(self, piece: str, ids: list[int]) -> list[int]:
        if len(piece) <= LONGEST_CACHED:
            if self.cached > CACHED_CHARACTERS:
                self.cache.clear()
                self.cached = 0
            self.cache[piece] = ids
            self.cached += len(piece) + 64
        return ids

    def many(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each of different pieces."""
        found = [self.cache.get(piece) for piece in pieces]
        new = [i for i, ids in enumerate(found) if ids is None]
        if len(new) < SIDE_BY_SIDE or not self.in_order:
            for i in new:
                found[i] = self.piece(pieces[i])
            return found
        tokens = np.frombuffer(b"".join(pieces[i].encode("utf-8", "replace") + b"\xff" for i in new), dtype=np.uint8).astype(np.int32)
        tokens[tokens == 0xFF] = -1  # a byte that no text has
        tokens = _merge_all(tokens, self.numbered)
        flat, start = tokens.tolist(), 0
        for i, end in zip(new, np.flatnonzero(tokens == -1).tolist(), strict=True):
            found[i] = self._kept(pieces[i], flat[start:end])
            start = end + 1
        return found

    def rows(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of pieces, one row behind the other, and the number of ids before each row and behind the last:
        each different piece of the batch is looked up once."""
        coded = pieces.flatten().dictionary_encode()
        found = self.many(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        known = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        many = sizes[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = known[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], many) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(pieces), dtype=np.int64))])]

    def _merge(self, parts: list[bytes]) -> list[int]:
        """The lowest rank first, the leftmost of it first; a heap of neighbours, so that time is n log n."""
        n = len(parts)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), list(map(len, parts))
        heap = [(r, i, size[i], size[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if size[i] != left or j >= n or size[j] != right:
                continue  # one of them has been merged since
            parts[i] += parts[j]
            size[i], size[j] = left + right, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, size[x], size[y]))
        return [self.ids[p] for p, k in zip(parts, size, strict=True) if k]


def encode(docs: DataFrame, merges: list[tuple[bytes, bytes]], key: str = "doc_id", text: str = "text", bos: int | None = None, eos: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of `keep`, ids: pre-tokens natively, merges in Arrow batches with a cache of pieces; optional
    marks at either end. A row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(merges)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            ids, ends = coder.rows(batch.column(batch.num_columns - 1))
            for mark, side in ((bos, slice(None, -1)), (eos, slice(1, None))):
                if mark is not None:
                    ids, ends = np.insert(ids, ends[side], mark), ends + np.arange(len(ends))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[key, *keep, "ids"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", ids array<int>"
    return docs.select(key, *keep, pretokens(F.coalesce(text, F.lit(""))).alias("__p")).mapInArrow(run, schema)


def encode_spans(rows: DataFrame, merges: list[tuple[bytes, bytes]], text: str, spans: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `keep`, ids, mask: ids of the text, and which of them lie in one of its spans (start and length in
    characters), in order.

    A span's tokens run from the number of tokens of the text before it to that of the text up to its end, both encoded
    by themselves: so a token that crosses a border belongs to the side that its number says. Only the pieces at a
    border are split and merged anew: a piece that ends two characters before a cut is the same without what follows.
    """
    import regex

    shared = rows.sparkSession.sparkContext.broadcast(merges)
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, split = Encoder(shared.value), regex.compile(PRETOKEN_HERE)
        for frame in frames:
            ids, masks = [], []
            for whole, pieces, parts in zip(frame["__t"], frame["__p"], frame["__s"], strict=True):
                row, ends, counts = [], [0], [0]
                for piece in pieces:
                    row += coder.piece(piece)
                    ends.append(ends[-1] + len(piece))
                    counts.append(len(row))

                def upto(cut: int, whole=whole, ends=ends, counts=counts) -> int:
                    at = max(0, bisect.bisect_right(ends, cut - 2) - 1)
                    return counts[at] + sum(len(coder.piece(p)) for p in split.findall(whole[ends[at] : cut]))

                mask = [False] * len(row)
                for start, length in parts:
                    first, last = upto(start), min(upto(start + length), len(row))
                    mask[first:last] = [True] * max(0, last - first)
                ids.append(row)
                masks.append(mask)
            yield pd.DataFrame({c: frame[c] for c in keep} | {"ids": ids, "mask": masks})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids array<int>, mask array<boolean>"
    whole = F.coalesce(text, F.lit(""))
    pairs = F.transform(F.coalesce(spans, F.array()), lambda s: F.array(s["start"], s["length"]))
    return rows.select(*keep, whole.alias("__t"), pretokens(whole).alias("__p"), pairs.alias("__s")).mapInPandas(run, schema)


def decode(rows: DataFrame, merges: list[tuple[bytes, bytes]], key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of `keep`, text; a row for each row."""
    shared = rows.sparkSession.sparkContext.broadcast({i: t for t, i in vocabulary(merges).items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            yield pd.DataFrame({c: frame[c] for c in (key, *keep)} | {"text": [b"".join(table.get(i, b"") for i in row).decode("utf-8", "replace") for row in frame[ids]]})

    kinds = dict(rows.dtypes)
    return rows.select(key, *keep, ids).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", text string")


def encoded_sizes(docs: DataFrame, merges: list[tuple[bytes, bytes]], key: str = "doc_id", by: str = "lang", text: str = "text") -> DataFrame:
    """key, by, b, t, back: bytes and tokens of each row, and whether the tokens give its text again; null acts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(merges)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        named = {i: token for token, i in coder.ids.items()}
        tokens = pa.array([named.get(i, b"") for i in range(256 + len(shared.value))], pa.large_binary())
        sizes = np.asarray(pc.binary_length(tokens), dtype=np.int64)
        for batch in batches:
            ids, ends = coder.rows(batch.column(3))
            whole = batch.column(2).cast(pa.binary())
            # the tokens' bytes lie one behind the other: cut at the ends of rows they are the decoded texts
            cuts = np.concatenate([[0], np.cumsum(sizes[ids])])[ends]
            decoded = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(cuts), tokens.take(pa.array(ids)).buffers()[2]])
            columns = [batch.column(0), batch.column(1), pc.binary_length(whole), pa.array(np.diff(ends), pa.int32()), pc.equal(decoded, whole.cast(pa.large_binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, by, "b", "t", "back"])

    whole = docs.select(key, by, F.coalesce(text, F.lit("")).alias("__t")).withColumn("__p", pretokens(F.col("__t")))
    return whole.mapInArrow(run, f"`{key}` {kinds[key]}, `{by}` {kinds[by]}, b int, t int, back boolean")


def compression(sizes: DataFrame, by: str = "lang", overall: str | None = None) -> DataFrame:
    """by, bytes, tokens, bytes_per_token (0 without tokens) of encoded_sizes; with `overall`, a row of that name for all.

    A row counts once, whatever its key."""
    if overall is not None:
        sizes = sizes.select(F.explode(F.array(F.col(by), F.lit(overall))).alias(by), "b", "t")
    out = sizes.groupBy(by).agg(F.sum("b").alias("bytes"), F.sum("t").alias("tokens"))
    return out.withColumn("bytes_per_token", F.when(F.col("tokens") > 0, F.col("bytes") / F.col("tokens")).otherwise(0.0))


def padded(ids: Column, length: int, pad: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def marked(ids: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def tokens_of(rows: DataFrame, vocab: DataFrame, ids: str = "token_id", tokens: str = "token") -> DataFrame:
    """rows with the token of each id, null for an id that there isn't. vocab: token, token_id; a vocabulary, hence small."""
    return rows.join(vocab.select(F.col("token_id").alias(ids), F.col("token").alias(tokens)), ids, "left")


def ids_of(rows: DataFrame, vocab: DataFrame, unknown: int, tokens: str = "token", ids: str = "token_id") -> DataFrame:
    """rows with the id of each token; `unknown` for one that the vocabulary hasn't."""
    known = vocab.select(F.col("token").alias(tokens), F.col("token_id").alias("__id"))
    return rows.join(known, tokens, "left").withColumn(ids, F.coalesce("__id", F.lit(unknown))).drop("__id")


# What a tokenizer of code should have as single tokens.
INDENTS = {"4-space": "    ", "2-space": "  ", "tab": "\t"}
OPERATORS = ("==", "!=", ">=", "<=", "->", "=>", "::", "**", "//")
KEYWORDS = {
    "cross-language": ("def", "function", "fn", "func", "void", "int", "return", "class", "import", "use"),
    "python": ("def", "class", "import", "from", "return", "if", "else", "elif", "for", "while", "try", "except",
        "with", "as", "yield", "lambda", "pass", "break", "continue", "raise", "async", "await", "None", "True",
        "False", "self"),
    "javascript": ("function", "const", "let", "var", "return", "if", "else", "for", "while", "class", "import",
        "export", "async", "await", "try", "catch", "throw", "new", "this", "typeof"),
    "rust": ("fn", "let", "mut", "impl", "struct", "enum", "trait", "pub", "use", "mod", "match", "self", "async",
        "await"),
    "go": ("func", "var", "const", "type", "struct", "interface", "return", "if", "else", "for", "range", "switch",
        "case", "go", "chan", "defer", "package", "import"),
}


def single_token_checks(spark, merges: list[tuple[bytes, bytes]]) -> DataFrame:
    """kind, probe, single, space_prefixed: whether indents, operators and keywords are one token, bare and after a space."""
    probes = [("indent", p) for p in INDENTS.values()] + [("operator", p) for p in OPERATORS] + [(k, w) for k, ws in KEYWORDS.items() for w in ws]
    rows = [(i, kind, probe, f"{lead}{probe}", bool(lead)) for i, (kind, probe) in enumerate(probes) for lead in ("", " ")]
    table = spark.createDataFrame([(2 * i + lead, kind, probe, shown, lead) for i, kind, probe, shown, lead in rows], "at int, kind string, probe string, shown string, lead boolean").coalesce(1)
    ids = encode(table, merges, "at", "shown").select("at", (F.size("ids") == 1).alias("one"))
    return table.join(ids, "at").groupBy("kind", "probe").agg(F.max(F.expr("NOT lead AND one")).alias("single"), F.max(F.expr("lead AND one")).alias("space_prefixed"))


def report(spark, docs: DataFrame, merges: list[tuple[bytes, bytes]], key: str = "doc_id", by: str = "lang", text: str = "text", low: float = 3.5, high: float = 4.5) -> DataFrame:
    """One row: learned, bytes_per_token, in_range, roundtrip_failures, single, space_prefixed of the checks above."""
    sizes = written(encoded_sizes(docs, merges, key, by, text))
    size = sizes.agg(F.when(F.sum("t") > 0, F.sum("b") / F.sum("t")).otherwise(0.0).alias("bytes_per_token"), F.count_if(~F.col("back")).alias("roundtrip_failures"))
    single = single_token_checks(spark, merges).agg(F.count_if("single").alias("single"), F.count_if("space_prefixed").alias("space_prefixed"))
    out = size.crossJoin(single)  # one row each
    return out.select(F.lit(256 + len(merges)).alias("learned"), "bytes_per_token", F.col("bytes_per_token").between(low, high).alias("in_range"), "roundtrip_failures", "single", "space_prefixed")


def save(merges: list[tuple[bytes, bytes]], path: str) -> None:
    """Merges as JSON, hexadecimal, by a temporary file beside it that then takes its name."""
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp", delete=False) as out:
        json.dump({"merges": [[a.hex(), b.hex()] for a, b in merges]}, out)
    os.replace(out.name, path)


def load(path: str) -> list[tuple[bytes, bytes]]:
    with open(path) as file:
        return [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in json.load(file)["merges"]]
