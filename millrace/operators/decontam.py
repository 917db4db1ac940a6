"""Word n-gram decontamination."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import decontamination_form, word_ngrams, words
from millrace.operators.storage import written

N, THRESHOLD = 10, 0.1
#: Test n-grams that are sent to all executors at most.
BROADCAST_NGRAMS = 2_000_000
#: Bits of the Bloom filter for each test n-gram, its hash functions, and the most bits that it has (32 MB).
BITS_EACH, SEEDS, MOST_BITS = 12, 4, 1 << 28
#: N-grams of an Arrow batch, about.
GRAMS_AT_ONCE = 200_000

# Signatures of a public benchmark.
HUMANEVAL_SIGNATURES = (
    "def has_close_elements(numbers: List[float], threshold: float) -> bool:",
    "def separate_paren_groups(paren_string: str) -> List[str]:",
    "def truncate_number(number: float) -> float:",
    "def below_zero(operations: List[int]) -> bool:",
    "def mean_absolute_deviation(numbers: List[float]) -> float:",
    "def intersperse(numbers: List[int], delimeter: int) -> List[int]:",
    "def parse_nested_parens(paren_string: str) -> List[int]:",
    "def filter_by_substring(strings: List[str], substring: str) -> List[str]:",
    "def sum_product(numbers: List[int]) -> Tuple[int, int]:",
    "def rolling_max(numbers: List[int]) -> List[int]:",
    "def is_palindrome(string: str) -> bool:",
    "def make_palindrome(string: str) -> str:",
    "def string_xor(a: str, b: str) -> str:",
    "def longest(strings: List[str]) -> Optional[str]:",
    "def greatest_common_divisor(a: int, b: int) -> int:",
    "def all_prefixes(string: str) -> List[str]:",
    "def string_sequence(n: int) -> str:",
    "def count_distinct_characters(string: str) -> int:",
    "def parse_music(music_string: str) -> List[int]:",
    "def how_many_times(string: str, substring: str) -> int:",
)


def ngram_set(text: Column, n: int = N) -> Column:
    """Distinct word n-grams of the normal form; texts of fewer words have one."""
    return F.array_distinct(word_ngrams(words(decontamination_form(text)), n))


def _grams(form: str, n: int) -> list[str]:
    """Distinct runs of n words of a text in normal form, as slices of it."""
    if not form:
        return []
    starts = list(accumulate((len(w) + 1 for w in form.split(" ")), initial=0))
    return list(dict.fromkeys(form[a : b - 1] for a, b in zip(starts, starts[n:], strict=False))) if len(starts) > n else [form]


def with_ngram_sets(rows: DataFrame, keep: list[str], text: Column, n: int = N) -> DataFrame:
    """The columns of `keep`, gs: ngram_set of the text, as slices of its normal form in one map."""
    formed = rows.select(*keep, decontamination_form(text).alias("__form"))
    kinds = dict(formed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, sets = 0, 0, []
            for i, form in enumerate(batch.column(len(keep)).to_pylist(), 1):
                sets.append(_grams(form or "", n))
                size += len(sets[-1])
                if size >= GRAMS_AT_ONCE or i == batch.num_rows:
                    part = batch.slice(begin, i - begin)
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], pa.array(sets, pa.list_(pa.string()))], names=[*keep, "gs"])
                    begin, size, sets = i, 0, []

    return formed.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", gs array<string>")


def benchmark_ngrams(benchmark: DataFrame, text: str = "text", n: int = N) -> DataFrame:
    """g: the union of the problems' n-grams."""
    return benchmark.select(F.explode(ngram_set(F.col(text), n)).alias("g")).distinct()


def bloom_bits(grams: DataFrame, bits: int, seeds: int = SEEDS, column: str = "g") -> np.ndarray:
    """A Bloom filter of the column's values as 64-bit words: set bits are OR-ed word by word in the cluster, and of the
    words no more than bits / 64 come to the driver, however many values there are."""
    places = F.array(*[F.pmod(F.xxhash64(F.lit(i), column), F.lit(bits)) for i in range(seeds)])
    words_of = grams.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    table = words_of.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("mask")).toArrow()
    out = np.zeros(-(-bits // 64), dtype=np.uint64)
    out[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return out


def possible(rows: DataFrame, wanted: DataFrame, keep: list[str], grams: str = "gs") -> DataFrame:
    """The columns of `keep`, gs: of each row's n-grams those that a Bloom filter of the wanted ones lets pass: all that
    are wanted, and few others. The filter has BITS_EACH bits for each wanted n-gram, and MOST_BITS at most."""
    bits = int(min(max(BITS_EACH * wanted.count(), 64), MOST_BITS))
    shared = rows.sparkSession.sparkContext.broadcast(bloom_bits(wanted, bits))
    place = lambda seed: lambda g: F.pmod(F.xxhash64(F.lit(seed), g), F.lit(bits))
    marked = rows.select(*keep, grams, *[F.transform(grams, place(i)).alias(f"__h{i}") for i in range(SEEDS)])
    kinds = dict(marked.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            lists = batch.column(len(keep))
            hit = np.ones(len(lists.flatten()), dtype=bool)
            for i in range(SEEDS):
                at = batch.column(len(keep) + 1 + i).flatten().to_numpy()
                hit &= (filled[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            row = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(sizes)))])
            left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten().filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], left], names=[*keep, "gs"])

    return marked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", gs array<string>")


def flags(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, row: str | None = None, broadcast: int | None = None) -> DataFrame:
    """key, ngrams, shared, contaminated: the share is of the sample's own distinct n-grams. A row for each row; `row`
    names a column that tells rows apart, which the result then has.

    One pass: n-grams are made once, exploded, marked and summed by row, in the map task first, so that only sums
    move. The test set is broadcast if it has no more than `broadcast` n-grams. If not, a Bloom filter of it goes to the map tasks: only the
    n-grams that pass it are joined, so what shuffles grows with the hits and not with the corpus.
    """
    wanted = benchmark_ngrams(benchmark, n=n)
    mark = F.col(row) if row else F.monotonically_increasing_id()
    own = docs.select(key, mark.alias("__row"), ngram_set(F.col(text), n).alias("gs"))
    if (size := wanted.count()) <= (BROADCAST_NGRAMS if broadcast is None else broadcast):
        rows = own.select(key, "__row", F.explode_outer("gs").alias("g"))
        hits = rows.join(F.broadcast(wanted.withColumn("__hit", F.lit(1))), "g", "left")
        sums = hits.groupBy(key, "__row").agg(F.count("g").alias("ngrams"), F.count("__hit").alias("shared"))
    else:
        wanted = written(wanted.repartition(max(1, size // 1_000_000), "g"))
        own = with_ngram_sets(docs.withColumn("__row", mark), [key, "__row"], F.col(text), n)
        counted = own.withColumn("ngrams", F.greatest(F.size("gs"), F.lit(0)).cast("long"))
        held = written(possible(counted, wanted, [key, "__row", "ngrams"]))
        hits = held.select("__row", F.explode("gs").alias("g")).join(wanted, "g").groupBy("__row").agg(F.count(F.lit(1)).alias("shared"))
        sums = held.select(key, "__row", "ngrams").join(hits, "__row", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    share = F.col("shared") / F.greatest("ngrams", F.lit(1))
    named = [F.col("__row").alias(row)] if row else []
    return sums.select(key, *named, "ngrams", "shared", ((F.col("ngrams") > 0) & (share >= threshold)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without contaminated rows; rows of one key and different texts are judged each."""
    named = docs.withColumn("__text_of", F.xxhash64(F.coalesce(F.col(how.get("text", "text")), F.lit(""))))
    bad = flags(named, benchmark, "__text_of", **how).where("contaminated").select("__text_of").distinct()
    return named.join(bad, "__text_of", "left_anti").drop("__text_of")
