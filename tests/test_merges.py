"""Merges learned in rounds against the plain loop over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from millrace.operators import tokenizer
from test_models import merges_by_hand


def by_rounds(counts, merges):
    """PairTable over pieces in memory: merges, and how many rounds they took."""
    pieces = [([bytes([b]) for b in p.encode()], n) for p, n in counts.items()]
    pairs = tokenizer.PairTable(Counter({q: sum(n * list(zip(p, p[1:], strict=False)).count(q) for p, n in pieces) for q in {q for p, _ in pieces for q in zip(p, p[1:], strict=False)}}))
    made, rounds = [], 0
    while len(made) < merges and (fresh := pairs.certain(2, merges - len(made))):
        change = Counter()
        for at, (old, n) in enumerate(pieces):
            new = tokenizer._merged(old, fresh)
            for q in zip(old, old[1:], strict=False):
                change[q] -= n
            for q in zip(new, new[1:], strict=False):
                change[q] += n
            pieces[at] = new, n
        pairs.add({q: n for q, n in change.items() if n})
        made, rounds = made + fresh, rounds + 1
    return made, rounds


@pytest.mark.parametrize("seed", range(12))
def test_certain_merges_are_those_of_the_plain_loop(seed):
    draw = random.Random(seed)
    letters = ("ab", "abc", "abcdef", "etaoin shrdlu")[seed % 4]
    counts = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 12))): draw.randint(1, (2, 9)[seed % 2]) for _ in range(80)}
    counts |= {"aaaaaaaa": 3, "abababab": 3}
    assert by_rounds(counts, 10_000)[0] == merges_by_hand(counts, 10_000)


def test_spread_merges_of_a_table_take_few_rounds(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = tokenizer.written(tokenizer.pretoken_counts(docs).where(F.col("n") > 3))
    want = tokenizer.learn_merges(counts, 150)
    rounds, certain = [], tokenizer.PairTable.certain
    monkeypatch.setattr(tokenizer.PairTable, "certain", lambda *a: rounds.append(certain(*a)) or rounds[-1])
    monkeypatch.setattr(tokenizer, "PRETOKENS_ON_DRIVER", 10)
    assert tokenizer.learn_merges(counts, 150) == want and len(want) == 150
    assert len(rounds) < 75 and max(map(len, rounds)) > 4


@pytest.mark.parametrize("seed", range(8))
def test_merges_over_laid_tokens_are_those_of_each_piece(seed):
    draw = random.Random(seed)
    pieces = [[draw.randint(0, 2) for _ in range(draw.randint(1, 14))] for _ in range(60)]
    merges = [(0, 0, 3), (1, 2, 4), (3, 3, 5), (4, 0, 6), (2, 2, 7), (7, 1, 8)]
    draw.shuffle(merges)
    want = []
    for parts in pieces:
        for a, b, new in merges:
            out, i = [], 0
            while i < len(parts):
                step = 2 if parts[i : i + 2] == [a, b] else 1
                out.append(new if step == 2 else parts[i])
                i += step
            parts = out
        want += [*parts, -1]
    assert tokenizer._merge_all(np.array([x for p in pieces for x in [*p, -1]], dtype=np.int32), merges).tolist() == want


def test_spread_merges_over_tasks_and_looks(spark, monkeypatch):
    texts = {"aaaaaaa": 9, "abababab": 7, "é\U0001f600é\U0001f600": 5, "banana": 4, "bananas": 3, "x": 50, "": 3, "aab": 8, "baa": 8, "nana": 2}
    counts = spark.createDataFrame(list(texts.items()), "piece string, n long")
    want = tokenizer.learn_merges(counts, 40)
    for name, value in {"PRETOKENS_ON_DRIVER": 2, "PIECES_A_TASK": 3, "TOKENS_AT_ONCE": 5, "WRITE_EVERY": 2}.items():
        monkeypatch.setattr(tokenizer, name, value)
    assert tokenizer.learn_merges(counts, 40) == want == merges_by_hand(texts, 40)


def test_spread_merges_to_the_end_take_few_rounds(spark, monkeypatch):
    """Cut pieces: all merges of a table with few of its pieces on the driver, in few rounds."""
    counts = tokenizer.written(tokenizer.pretoken_counts(spark.read.parquet(f"{SMALL}/documents.parquet")).where(F.col("n") > 1))
    want = tokenizer.learn_merges(counts, 100_000)
    rounds, held, pairs, run = [], [], tokenizer._pairs, tokenizer.PieceRound.run
    monkeypatch.setattr(tokenizer, "_pairs", lambda *a: rounds.append(1) or pairs(*a))
    monkeypatch.setattr(tokenizer.PieceRound, "run", lambda work, *a: held.append(len(work.pieces)) or run(work, *a))
    monkeypatch.setattr(tokenizer, "PRETOKENS_ON_DRIVER", 1_000)
    got = tokenizer.learn_merges(counts, 100_000)
    assert got == want and len(want) > 3_000 < counts.count()
    assert len(rounds) < 15 and max(held) <= 3_000


@pytest.mark.parametrize("seed", range(4))
def test_cut_pieces_give_the_merges_of_whole_ones(spark, monkeypatch, seed):
    draw = random.Random(seed)
    letters = ("ab", "abc", "aabé", "etaoin shrdlu")[seed]
    counts = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 14))): draw.randint(1, 9) for _ in range(150)} | {"a" * 13: 4, "ab" * 7: 3}
    for name, value in {"PRETOKENS_ON_DRIVER": 30, "LEAST_HERE": 1, "FIRST_LEADING": 2, "MORE_LEADING": 2, "PIECES_A_TASK": 40}.items():
        monkeypatch.setattr(tokenizer, name, value)
    assert tokenizer.learn_merges(spark.createDataFrame(list(counts.items()), "piece string, n long"), 300) == merges_by_hand(counts, 300)


def test_more_ties_than_the_driver_holds(spark, monkeypatch):
    texts = {a + b: 3 for a in "dcba" for b in "zyx"} | {"dzw": 3, "q": 9}
    monkeypatch.setattr(tokenizer, "PRETOKENS_ON_DRIVER", 2)
    for pairs in (1, 4):
        monkeypatch.setattr(tokenizer, "PAIRS_ON_DRIVER", pairs)
        assert tokenizer.learn_merges(spark.createDataFrame(list(texts.items()), "piece string, n long"), 9) == merges_by_hand(texts, 9)
