"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import slices

K1, B = 1.2, 0.75
#: A passage is a candidate at this score: the least that a passage with enough of a question's shingles can have.
THRESHOLD = 1.0
#: Shares of the question's and the answer's shingles that a leak must have; see `contaminated`.
OVERLAP, BOTH = 0.5, 0.3
SHINGLE = 5
#: Postings of one block; words of an index entry, longer items have several.
BLOCK, PART_WORDS = 8, 128
#: Items, and characters of items, of one index on the driver and in a broadcast, about; more of them make several
#: indexes, each with a scan of its own.
ITEMS, ITEM_CHARS = 20_000, 8_000_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that comes as one text: its last sentence is the answer, if it isn't the only one."""
    sentences = re.findall(r"[^.!?\n]+[.!?]*", text.strip())
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")


def _shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _wanted(text: str) -> tuple[int, set[tuple[str, ...]]]:
    """A text's shingles and their words: SHINGLE, or all of a shorter text."""
    words = words_of(text)
    size = min(SHINGLE, len(words))
    return size, _shingles(words, size) if words else set()


def _sides(question: str, answer: str) -> tuple[str, str]:
    """A question of fewer than SHINGLE words is no sign by itself: it and its answer count as one question."""
    return (f"{question} {answer}", "") if len(words_of(question)) < SHINGLE and words_of(answer) else (question, answer)


def _terms(words: list[str] | tuple[str, ...]) -> list[tuple[str, ...]]:
    """What the index holds of a run of words: its pairs of neighbours; of a single word the word."""
    return list(zip(words, words[1:], strict=False)) if len(words) > 1 else [tuple(words)] * len(words)


def _least_score(shingles: list[tuple[str, ...]], parts: dict[tuple[str, ...], float], share: float) -> float:
    """A bound: no text with this share of the shingles has terms that score less.

    A term's score is dealt over the shingles that hold it, so a set of shingles scores at least the sum of its deals.
    """
    holders = Counter(t for s in shingles for t in set(_terms(s)))
    deals = sorted(sum(parts[t] / holders[t] for t in set(_terms(s))) for s in shingles)
    return sum(deals[: max(1, math.ceil(share * len(deals) - 1e-9))]) * (1 - 1e-9)


@dataclass
class Entry:
    item: int
    terms: Counter
    length: int
    shingles: list[tuple[str, ...]]


class BlockMaxIndex:
    """Postings of each term in order of entry, in blocks that know their highest impact. Terms are pairs of words.

    Every leak has BOTH of the question's shingles at least, so entries are questions, or their parts. An impact is the
    term's BM25 part of an entry's score, divided by the least score of a passage with that share of the entry's
    shingles: so one threshold holds for all entries and passes every such passage.
    """

    def __init__(self, items: list[tuple[object, str, str]]):
        pairs = [(i, *_sides(q, a)) for i, q, a in items]
        self.items = [(i, _wanted(q), _wanted(a)) for i, q, a in pairs]
        entries: list[Entry] = []
        for number, (_, question, _) in enumerate(pairs):
            words, (size, wanted) = words_of(question), self.items[number][1]
            left = set(wanted)  # each shingle counts in the first part that holds it, so one part has the share that the whole has
            for at in range(0, len(words), PART_WORDS - SHINGLE + 1):
                part = words[at : at + PART_WORDS]
                own = _shingles(part, size) & left
                left -= own
                if own:
                    entries.append(Entry(number, Counter(_terms(part)), len(part), sorted(own)))
        self.owner = [e.item for e in entries]
        self.longest = max((e.length for e in entries), default=1)
        mean = sum(e.length for e in entries) / max(1, len(entries))
        df = Counter(t for e in entries for t in e.terms)
        n = len(entries)
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        postings: dict[tuple[str, ...], list[tuple[int, float]]] = {t: [] for t in df}
        self.needs: list[float] = []  # the threshold as a share of an entry's score for itself
        for number, e in enumerate(entries):
            norm = K1 * (1 - B + B * e.length / mean)
            parts = {t: idf[t] * tf * (K1 + 1) / (tf + norm) for t, tf in e.terms.items()}
            least = _least_score(e.shingles, parts, BOTH if self.items[e.item][2][1] else OVERLAP)
            self.needs.append(least / sum(parts.values()))
            for t, x in parts.items():
                postings[t].append((number, x / least))
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in postings for w in t}))}
        ordered = sorted(postings, key=self._number)
        self.terms = {t: i for i, t in enumerate(ordered)}
        self.numbers = np.array([self._number(t) for t in ordered], dtype=np.int64)
        self.lists = [postings[t] for t in ordered]
        self.tops = np.array([max(x for _, x in p) for p in self.lists])
        self.block_tops = [[max(x for _, x in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)] for p in self.lists]

    def _number(self, term: tuple[str, ...]) -> int:
        """One number for a pair of known words; a negative one for a word that is a whole item."""
        first = self.vocabulary[term[0]]
        return first * len(self.vocabulary) + self.vocabulary[term[1]] if len(term) == 2 else -1 - first

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Entries whose score for the distinct terms reaches the threshold: block-max WAND, document at a time."""
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # entry, place in the list, term
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += self.tops[t]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            here, after = 0.0, None  # the blocks that could hold the pivot, and where the first of them ends
            for _, at, t in cursors[: pivot + 1]:
                posting, k = self.lists[t], at // BLOCK
                while (k + 1) * BLOCK < len(posting) and posting[(k + 1) * BLOCK - 1][0] < entry:
                    k += 1
                here += self.block_tops[t][k]
                end = posting[min((k + 1) * BLOCK, len(posting)) - 1][0]
                after = end if after is None or end < after else after
            if here < threshold - 1e-9:
                target = max(after + 1, entry + 1) if pivot + 1 >= len(cursors) else max(entry + 1, min(after + 1, cursors[pivot + 1][0]))
                cursors = self._forward(cursors, target, pivot)
            elif cursors[0][0] == entry:
                score = sum(self.lists[t][at][1] for e, at, t in cursors if e == entry)
                if score >= threshold - 1e-9:
                    found.append((entry, score))
                cursors = self._forward(cursors, entry + 1, pivot)
            else:
                cursors = self._forward(cursors, entry, pivot)
        return found

    def _forward(self, cursors: list, target: int, upto: int) -> list:
        out = []
        for i, (entry, at, t) in enumerate(cursors):
            if i <= upto and entry < target:
                posting = self.lists[t]
                while at < len(posting) and posting[at][0] < target:
                    at = (at // BLOCK + 1) * BLOCK if (at // BLOCK + 1) * BLOCK < len(posting) and posting[(at // BLOCK + 1) * BLOCK - 1][0] < target else at + 1
                if at == len(posting):
                    continue
                entry = posting[at][0]
            out.append([entry, at, t])
        return out

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the text has terms of the index, and which."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        numbers = ids[at] * len(self.vocabulary) + ids[at + 1]
        if self.numbers[0] < 0:
            singles = np.flatnonzero(ids >= 0)
            at, numbers = np.concatenate([singles, at]), np.concatenate([-1 - ids[singles], numbers])
        place = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        hit = self.numbers[place] == numbers
        return at[hit], place[hit]

    def retrieve(self, words: list[str]) -> dict[int, tuple[float, bool]]:
        """Each item whose threshold a passage of the text reaches: its best score as a share of the item's score for
        itself, and whether only the text as a whole reaches it.

        Passages are twice the longest entry and begin one longest entry apart: each entry's copy lies whole in one. The
        text is a passage too, as a leak's pieces may lie apart; so no leak is missed. The sum of its terms' upper bounds,
        WAND's first test, is taken of all passages at once.
        """
        best: dict[int, tuple[float, bool]] = {}
        if not words or not self.lists:
            return best
        at, terms = self._known(words)
        if self.tops[np.unique(terms)].sum() < THRESHOLD - 1e-9:
            return best  # the bound of the text bounds its passages too
        half = at // self.longest
        count = max(1, -(-len(words) // self.longest))
        sums = np.bincount(half, weights=self.tops[terms], minlength=count + 1)
        for number in np.flatnonzero(sums[:-1] + sums[1:] >= THRESHOLD - 1e-9).tolist():
            self._search(terms[(half == number) | (half == number + 1)], best, False)
        if count > 2:
            self._search(terms, best, True)
        return best

    def _search(self, terms: np.ndarray, best: dict[int, tuple[float, bool]], whole: bool) -> None:
        for entry, score in self.search(np.unique(terms).tolist()):
            item, share = self.owner[entry], score * self.needs[entry]
            old = best.get(item)
            if old is None or (share > old[0] and old[1] == whole):
                best[item] = share, whole

    def _shares(self, words: list[str]) -> Callable[[int], tuple[float, float | None]]:
        """A function that gives an item's question and answer overlap with the whole text."""
        have: dict[int, set[tuple[str, ...]]] = {}

        def share(item: int, side: int) -> float | None:
            size, want = self.items[item][side]
            if want and size not in have:
                have[size] = _shingles(words, size)
            return len(want & have[size]) / len(want) if want else None

        return lambda item: (share(item, 1) or 0.0, share(item, 2))

    def leaked(self, text: str | None) -> list[tuple[int, float, bool, float, float | None]]:
        """item number, score, whether its pieces lie apart, question overlap, answer overlap: what is retrieved for the
        text and verified by the overlaps with the whole text."""
        words = words_of(text)
        found = self.retrieve(words)
        if not found:
            return []
        shares = self._shares(words)
        rows = [(i, *found[i], *shares(i)) for i in sorted(found)]
        return [r for r in rows if contaminated(*r[3:])]


def contaminated(question: float, answer: float | None) -> bool:
    """Half of the question's shingles, or three tenths of the question's and of the answer's."""
    return question >= OVERLAP or (answer is not None and min(question, answer) >= BOTH)


def indexes(benchmark: DataFrame, item: str = "item_id", question: str = "text", answer: str | None = None) -> Iterator[BlockMaxIndex]:
    """One index for each block of about ITEMS items or ITEM_CHARS characters; test sets are small, but their size is looked at.

    Items without words, null ones among them, match nothing. Without an answer column the last sentence is the answer.
    """
    columns = [F.col(item).alias("i"), F.col(question).alias("q"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")]
    rows = benchmark.select(*columns).where(F.col("q").isNotNull())
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("q") + F.length(F.coalesce("a", F.lit("")))), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-chars // ITEM_CHARS))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block) if blocks > 1 else rows
        yield BlockMaxIndex([(r.i, r.q, r.a or "") if answer else (r.i, *split_item(r.q)) for r in sorted(part.collect(), key=lambda r: (str(r.i), r.q))])


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", answer: str | None = None) -> DataFrame:
    """key, item, score, apart, question_overlap, answer_overlap of every document and test item that it leaks.

    Each block of test items is searched with every passage of every text, in a map without a shuffle; `apart` says that
    only the text as a whole came up, as the item's pieces lie in passages apart. Null and empty texts leak nothing; a
    null answer_overlap means an item without an answer. Repeated rows give their rows again; other columns of docs are
    not looked at, whatever their names.
    """
    names = ["score", "apart", "question_overlap", "answer_overlap"]
    kinds = dict(docs.dtypes), dict(benchmark.dtypes)
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    out = None
    for index in indexes(benchmark, item, answer=answer):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for part in slices(batches, "__text"):
                rows = [(at, own.items[i][0], *more) for at, t in enumerate(part.column(1).to_pylist()) for i, *more in own.leaked(t)]
                if rows:
                    at, ids, *more = zip(*rows, strict=True)
                    types = pa.float64(), pa.bool_(), pa.float64(), pa.float64()
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(ids, item_type), *map(pa.array, more, types)], names=[key, item, *names])

        schema = f"`{key}` {kinds[0][key]}, `{item}` {kinds[1][item]}, score double, apart boolean, question_overlap double, answer_overlap double"
        found = docs.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of docs whose text leaks no test item, with all their columns. Rows stay where they are."""
    for index in indexes(benchmark, item):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for part in slices(batches, text):
                at = part.schema.get_field_index(text)
                keep = [not own.leaked(t) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
