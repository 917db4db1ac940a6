"""Token masks of chats against encoding each prefix anew; the encoder against merging one pair at a time."""

import random

from pyspark.sql import functions as F

from conftest import SMALL
from millrace.functions.text import chatml
from millrace.operators import chat, tokenizer



def test_encoder_merges_the_lowest_rank_first():
    draw = random.Random(1)
    for _ in range(300):
        merges, known = [], [bytes([b]) for b in b"abc"]
        for _ in range(draw.randint(0, 12)):
            pair = draw.choice(known), draw.choice(known)
            if pair not in merges and pair[0] + pair[1] not in known:
                merges.append(pair)
                known.append(pair[0] + pair[1])
        coder = tokenizer.Encoder(merges)
        for _ in range(5):
            piece = "".join(draw.choice("abc") for _ in range(draw.randint(0, 40)))
            parts, ranks = [bytes([b]) for b in piece.encode()], {p: i for i, p in enumerate(merges)}
            while len(parts) > 1:
                rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == len(ranks):
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            assert coder.piece(piece) == [coder.ids[p] for p in parts]


def test_a_long_piece_takes_no_square_of_its_length():
    coder = tokenizer.Encoder([(b"a", b"a"), (b"aa", b"aa"), (b"aaaa", b"aaaa")])
    assert len(coder.piece("a" * 400_000)) == 50_000 and not coder.cache


def test_pieces_are_those_of_the_jvm(spark):
    import regex

    draw = random.Random(5)
    texts = ["".join(draw.choice(" \n\t\r'sStTrReEvVmMlLdD19aé\u3000\x0b\u017f>=-_") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokenizer.pretokens(F.col("t")).alias("p")).collect()
    here = regex.compile(tokenizer.PRETOKEN_HERE)
    assert all(here.findall(texts[r.i]) == r.p for r in rows)


def check(spark, chats, merges, max_len=10_000):
    """Rows of sft_tokens against masks from prefixes that are encoded each by themselves."""
    said = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    rows = chats.select("conv_id", chat.chat(F.lit("be brief"), said).alias("t"), chat.assistant_spans(F.lit("be brief"), said).alias("s")).collect()
    cuts = {(r.conv_id, c): r.t[:c] for r in rows for s in r.s for c in (s.start, s.start + s.length)} | {(r.conv_id, -1): r.t for r in rows}
    made = tokenizer.encode(spark.createDataFrame([(k, c, t) for (k, c), t in cuts.items()], "k long, c int, t string"), merges, "k", "t", keep=("c",))
    ids = {(r.k, r.c): r.ids for r in made.collect()}
    want = {}
    for r in rows:
        whole = ids[r.conv_id, -1]
        mask = [False] * len(whole)
        for s in r.s:
            for i in range(len(ids[r.conv_id, s.start]), min(len(ids[r.conv_id, s.start + s.length]), len(whole))):
                mask[i] = True
        whole, mask = whole[:max_len], mask[:max_len]
        if len(whole) >= 4:
            want[r.conv_id] = whole[:-1], [i if m else -1 for i, m in zip(whole[1:], mask[1:], strict=True)]
    got = {r.conv_id: (r.input_ids, r.targets) for r in chat.sft_tokens(chats, merges, "conv_id", F.lit("be brief"), max_len).collect()}
    assert got == want
    return got


def test_masks_of_conversations(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    merges = tokenizer.learn_merges(tokenizer.pretoken_counts(turns), 400)
    got = check(spark, chat.conversations(turns), merges)
    assert sum(t != -1 for _, ts in got.values() for t in ts) > 1000
    check(spark, chat.conversations(turns), merges, 50)


def test_masks_where_merges_cross_borders(spark):
    draw = random.Random(8)
    merges = [(b"\n", b"\n"), (b">", b"\n"), (b" ", b" "), (b"|", b">"), (b"|>", b"\n"), (b"|>\n", b"\n"), (b"  ", b"  "), (b" ", b"<"), (b" <", b"|"), (b"'", b"s"), (b"a", b"b"), (b"b", b"<"), (b"-", b"<"), (b"-<", b"|"), (b"\n", b"<")]
    text = lambda: "".join(draw.choice(" \n'sab-<|>1\u3000") for _ in range(draw.randint(0, 9)))
    data = [(i, [(draw.choice(("user", "assistant", "assistant", "tool")), draw.choice((text(), text(), None))) for _ in range(draw.randint(0, 5))]) for i in range(400)]
    check(spark, spark.createDataFrame(data, "conv_id long, messages array<struct<role:string,content:string>>"), merges)


def test_chatml_keeps_turns_without_content(spark):
    row = spark.createDataFrame([([("user", None), ("assistant", "x")],)], "m array<struct<role:string,content:string>>").select(chatml(F.col("m")).alias("t")).first()
    assert row.t.count("user") == 1 and row.t.count("assistant") == 1


def test_pieces_merged_side_by_side_are_those_merged_one_by_one(monkeypatch):
    draw = random.Random(4)
    merges = [(b"a", b"a"), (b"aa", b"a"), (b"b", b"a"), (b"ba", b"aaa"), (b"\xc3", b"\xa9"), (b"aaa", b"aaa"), (b" ", b"ba")]
    pieces = list({"".join(draw.choice("aab é") for _ in range(draw.randint(0, 12))) for _ in range(500)} | {"", "a" * 3_001})
    want = [tokenizer.Encoder(merges).piece(p) for p in pieces]
    monkeypatch.setattr(tokenizer, "SIDE_BY_SIDE", 1)
    coder = tokenizer.Encoder(merges)
    assert coder.in_order and coder.many(pieces[:100]) == want[:100] and coder.many(pieces) == want and len(coder.cache) == len(pieces) - 1
    mixed = [(b"ab", b"c"), (b"a", b"b"), (b"b", b"c")]  # the first can only follow the second
    assert not tokenizer.Encoder(mixed).in_order and tokenizer.Encoder(mixed).many(["abc"]) == [tokenizer.Encoder(mixed).piece("abc")]


def test_ids_and_sizes_of_texts(spark):
    texts = ["it's a cat", None, "", " \n\n", "été \U0001f600 cat cat", "1234", "a" * 500, "it's a cat"]
    docs = spark.createDataFrame([(i, "en" if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(2)
    merges = [(b"a", b"t"), (b"c", b"at"), (b" ", b"cat"), (b"a", b"a"), (b"aa", b"aa")]
    pieces = {r.doc_id: r.p for r in docs.select("doc_id", tokenizer.pretokens(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    coder = tokenizer.Encoder(merges)
    want = {i: [x for p in pieces[i] for x in coder.piece(p)] for i in pieces}
    assert {r.doc_id: r.ids for r in tokenizer.encode(docs, merges).collect()} == want
    assert {r.doc_id: (r.lang, r.ids) for r in tokenizer.encode(docs, merges, bos=7, eos=9, keep=("lang",)).collect()} == {i: ("en" if i % 2 else None, [7, *want[i], 9]) for i in want}
    sizes = tokenizer.encoded_sizes(docs, merges).collect()
    assert {r.doc_id: (r.lang, r.b, r.t, r.back) for r in sizes} == {i: ("en" if i % 2 else None, len((t or "").encode()), len(want[i]), True) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in tokenizer.decode(tokenizer.encode(docs, merges), merges).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_a_text_that_does_not_come_back_is_told(spark, monkeypatch):
    monkeypatch.setattr(tokenizer, "pretokens", lambda text: F.split(text, "x"))  # pieces that lose a character
    docs = spark.createDataFrame([(1, "en", "axb"), (2, "en", "ab"), (3, "en", "xxxx"), (4, "en", "")], "doc_id long, lang string, text string").coalesce(1)
    assert {r.doc_id: (r.b, r.t, r.back) for r in tokenizer.encoded_sizes(docs, [(b"a", b"b")]).collect()} == {1: (3, 2, False), 2: (2, 1, True), 3: (4, 0, False), 4: (0, 0, True)}
