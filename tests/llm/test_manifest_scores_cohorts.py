"""The Merkle manifest, Katz backoff and cohort retention against plain recursions, loops and sums."""

import datetime
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from millrace.llm import cohorts, katz, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, pos long, block long, key string"
LONG = "the quick brown fox jumps over a lazy dog " * 2000
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, "  \n \n", "en", "a", 5), (4, LONG, "en", "a", 1), (5, "Same text here", "en", "a", 1), (5, "Same text here", "en", "a", 1),
    (5, "another text of the id", "en", "a", 1), (None, "an id that is Null", "en", None, 1), (8, "12 34 !!", "en", "", 1), (9, "naïve É ü 𝒳", "fr", "é", 1), (10, "x", "fr", "z", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "d", "t", 7, 3, "k") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def oracle(name):
    con = duckdb.connect()
    for t in ("documents", "clicks", "clients"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con.execute(queries.ORACLES[name]).fetchdf()


def rows_of(frame):
    return sorted(tuple(None if v != v else v for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


# 11


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(docs):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: H(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(t))

    def tree(nodes):
        """root and, for each node, its path of (place, others)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, p in enumerate(paths):
                run = level[at[i] // 16 * 16 : at[i] // 16 * 16 + 16]
                p.append((at[i] % 16, run[: at[i] % 16] + run[at[i] % 16 + 1 :]))
            level = [H(*level[k : k + 16]) for k in range(0, len(level), 16)]
            at = [a // 16 for a in at]
        return level[0], paths

    groups = defaultdict(list)
    for r in docs:
        groups[r[3]].append((leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(g, key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])) for s, g in groups.items()}
    trees = {s: tree([d for d, _ in own[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (d, r), path in zip(own[s], trees[s][1], strict=True):
            at = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else d
            for place, others in path + top:
                at = H(*others[:place], at, *others[place:])
            out.append((r[0], d, trees[s][0], root, H(*[x for _, o in path + top for x in o]), at, at == root))
    return out


def test_manifest_by_plain_recursion(spark, odd, empty):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in merkle.prove(odd, merkle.lower_cased()).select(*names).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(ROWS), key=key)
    assert merkle.prove(empty, merkle.lower_cased()).count() == 0
    many = [(i, f"Text {i}", "en", f"s{i % 40}" if i % 3 else "hot", i) for i in range(900)]  # several rounds and blocks
    frame = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in merkle.prove(frame, merkle.lower_cased(), levels=1).select(*names).collect()]
    assert sorted(got) == sorted(plain_manifest(many)) and {r[-1] for r in got} == {True, False}


def test_manifest_sql(spark):
    assert rows_of(queries.op11_merkle_manifest(spark, SMALL).toPandas()) == rows_of(oracle("op11_merkle_manifest"))


def test_rows_prove_themselves(odd):
    """Whoever has a row's places and siblings needs no more than the root."""
    got = merkle.prove(odd, detail=True).select("root", merkle.folded(F.col("leaf"), F.col("places"), F.col("siblings")).alias("again"), "verified").collect()
    assert len(got) == len(ROWS) and all(r.again == r.root and r.verified for r in got)


# 12


def plain_katz(docs):
    """Katz's model with dictionaries; checks that what it learned sums to one."""
    tokens = lambda x: (x or "").encode().lower().split() + [b"\0end"]
    one, two, after = Counter(), Counter(), defaultdict(set)
    for d, x in docs:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            h = b"\0start"
            for w in tokens(x):
                one[w] += 1
                two[h, w] += 1
                after[h].add(w)
                h = w

    def shares(counts):
        n = Counter(counts.values())
        for k in range(5, 1, -1):
            if all(n[r] for r in range(1, k + 1)) and (a := (k + 1) * n[k + 1] / n[1]) < 1:
                d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)}
                if all(0 < x <= 1 for x in d.values()):
                    return d
        return {}

    N, V, d1, d2 = sum(one.values()), len(one), shares(one), shares(two)
    taken = sum((1 - d1.get(c, 1)) * c for c in one.values())
    total, rest = (N, taken / N) if taken > 0 else (N + 1, 1 / (N + 1))
    word = lambda w: d1.get(one[w], 1) * one[w] / total if w in one else rest
    ahead = Counter()
    for (h, _), c in two.items():
        ahead[h] += c
    context = {}
    for h, ws in after.items():
        taken = sum((1 - d2.get(two[h, w], 1)) * two[h, w] for w in ws)
        size, left = (ahead[h], taken) if taken > 0 else (ahead[h] + 1, 1)
        context[h] = size, left / size / (1 - sum(word(w) for w in ws))
    p = lambda h, w: d2.get(two[h, w], 1) * two[h, w] / context[h][0] if (h, w) in two else context.get(h, (0, 1.0))[1] * word(w)
    for h in list(after)[:20]:
        assert abs(sum(p(h, w) for w in one) + p(h, b"\0unknown") - 1) < 1e-9
    out = []
    for d, x in docs:
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        h, score = b"\0start", 0.0
        for w in tokens(x):
            score, h = score + math.log10(p(h, w)), w
        base = sum(math.log10((one[w] + 0.5) / (N + 0.5 * (V + 1))) for w in tokens(x))
        out.append((d, held, len(tokens(x)), sum(w in one for w in tokens(x)), N, base, score))
    return out


TEACHES = "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 5 <> 1"
NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("sizes", [(2_000_000, 1_000_000), (9_000, 2_500)])  # one chunk and cell; many, with split contexts
def test_katz_by_dictionaries(spark, sizes):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = katz.score(docs, F.expr(TEACHES), chunk_tokens=sizes[0], cell_tokens=sizes[1])[0].select(*NAMES).collect()
    same(got, plain_katz([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)  # both negative: nearer to 0


def test_katz_tables_hold_every_pair(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    _, tables = katz.score(docs, F.expr(TEACHES))
    want = Counter()
    for r in docs.where(TEACHES).collect():
        words = [b"S", *r.text.encode().lower().split(), b"E"] if r.text else [b"S", b"E"]
        want.update(zip(words, words[1:], strict=False))
    got = katz.unpacked(tables).toPandas()
    assert Counter(got["count"]) == Counter(want.values()) and not got.duplicated(["context", "word"]).any()
    assert tables.lower.tokens == sum(want.values())


def test_katz_of_odd_rows(spark, odd, empty):
    same(katz.score(odd, F.expr(TEACHES))[0].select(*NAMES).collect(), plain_katz([r[:2] for r in ROWS]))
    assert katz.score(empty, F.expr(TEACHES))[0].count() == 0
    got = katz.score(odd, F.lit(None).cast("boolean"))[0].collect()  # nothing teaches
    assert len(got) == len(ROWS) and all(r.held_out and r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in got)


def test_words_of_texts_side_by_side():
    import pyarrow as pa

    texts = ["ab c", "d", None, "", " e\tf\v", "g\fh\r\n", "é\x1cx", "AB", "ab"]
    for column in (pa.array(texts), pa.array(["zz", *texts])[1:]):
        hashes, n = katz.word_hashes(column)
        words = [w for t in texts for w in (t or "").encode().lower().split()]
        assert n.tolist() == [len((t or "").encode().lower().split()) for t in texts]
        assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
        assert [hashes.tolist().index(h) for h in hashes.tolist()] == [words.index(w) for w in words]


def test_packed_numbers_come_back():
    import numpy as np

    for x in ([], [0, 3], [70000, 2, 255], [1 << 63], [1 << 40, 5]):
        assert katz.unpack(katz.pack(np.array(x, dtype=np.uint64))).tolist() == x
    assert katz.unpack(katz.pack(np.array([0.5, -1e300]))).tolist() == [0.5, -1e300]
    common = np.array([3, 1 << 60, (1 << 64) - 1], dtype=np.uint64)
    for x in ([], [3], [4, 3, (1 << 64) - 1, 3, 1 << 63]):
        for known in (common, common[:0]):
            assert katz.unpack_words(katz.pack_words(np.array(x, dtype=np.uint64), known), known).tolist() == x


# 13

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, state int, salt int, client string"
CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, segment string"


def plain_cells(clicks, clients, days=3):
    day, epoch = datetime.timedelta(days=1), datetime.datetime(1970, 1, 1)
    micro = lambda t: (t - epoch) // datetime.timedelta(microseconds=1)
    crc = lambda x: zlib.crc32(str(x).encode())
    city, cells = {}, defaultdict(lambda: [set(), 0])
    for c in sorted((r for r in clients if r[0] is not None), key=lambda r: (r[3] is not None, r[3] or epoch, r[6] or "")):
        city[c[0]] = c[6] or ""
    rows = [r for r in set(clicks) if r[1] is not None and r[3] is not None]
    cut = datetime.datetime(2024, 3, 1)

    def early(r):
        h = crc(r[0]) if r[0] is not None else 1
        return r[2] is not None and r[2] + (day * (h % 100) if h % 3 == 0 else day * 0) < cut

    start = [{}, {}]
    for r in rows:
        for s in (0, 1):
            if r[4] == "purchase" and (s or early(r)):
                start[s][r[3]] = min(start[s].get(r[3], r[1]), r[1])
    cohort = lambda t: micro(t) // (days * 86_400_000_000)
    for r in rows:
        for s in (0, 1):
            if r[3] in start[s] and (s or early(r)) and r[1] >= start[s][r[3]]:
                begun = start[s][r[3]]
                cell = cells[s, city.get(r[3], ""), cohort(begun), (micro(r[1]) - micro(begun)) // (days * 86_400_000_000)]
                cell[0].add(r[3])
                cell[1] += math.floor(100 * r[5] + 0.5) if r[5] is not None else 0
    moved = {c for c in start[0] if cohort(start[0][c]) != cohort(start[1][c])}
    return sorted((*k, len(u), sum(map(crc, u)), len(u & moved), cents) for k, (u, cents) in cells.items())


def test_cohorts_sql(spark):
    got, want = queries.op13_cohort_retention(spark, SMALL).toPandas(), oracle("op13_cohort_retention")
    assert rows_of(got) == rows_of(want) and got.moved.sum() > 0


def test_cohorts_by_plain_sums(spark, monkeypatch):
    t = lambda d, s=0, us=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, seconds=s, microseconds=us)
    rows = [(i, t(i % 140, i * 37, i), t(i % 140, i * 37 + 5), 7 if i % 3 == 0 else i % 11, ("purchase", "view", None)[i % 5 % 3], i / 7, "{}") for i in range(600)]
    rows += rows[:50]  # repeated
    rows += [(900, None, t(1), 7, "purchase", 1.0, "{}"), (901, t(1), t(1), None, "purchase", 1.0, "{}"), (902, t(2), None, 20, "purchase", None, None), (None, t(3), t(3), 21, "purchase", 1.005, None)]
    rows += [(903, t(10), t(10), 22, "purchase", 1.0, "x"), (904, t(13, -1, 999_999), t(10), 22, "view", 1.0, "x"), (905, t(13), t(10), 22, "view", 1.0, "x"), (906, t(9), t(10), 22, "view", 5.0, "x")]
    rows += [(907, datetime.datetime(1969, 12, 31, 23, 59, 59, 999_999), t(1), 23, "purchase", -1.5, "x"), (908, datetime.datetime(2300, 1, 1), t(1), 23, "view", -0.004, "y" * 100_000)]
    clients = [(7, 7, "a", t(1), "n", "e", "Town", "s"), (7, 7, "a", t(2), "n", "e", "City", "s"), (22, 1, "a", None, None, None, None, None), (None, 1, "a", t(1), None, None, "Nowhere", None), (1, 1, "a", t(1), "n", "e", "É", "s"), (1, 1, "a", t(1), "n", "e", "A", "s")]
    one = spark.createDataFrame([(*r, 5, 6, "c") for r in rows], CLICKS)
    two = spark.createDataFrame(clients, CLIENTS)
    run = lambda: sorted(map(tuple, cohorts.matrix(one, two, cohorts.late_arrival(), [queries.CUT_US]).collect()))
    want = plain_cells(rows, clients)
    assert run() == want
    monkeypatch.setattr(cohorts, "HOT", 10_000_000), monkeypatch.setattr(cohorts, "SALTS", 3)  # every client is salted
    assert run() == want


def test_cohorts_of_empty_tables(spark):
    one, two = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert cohorts.matrix(one, two, cohorts.late_arrival(), [queries.CUT_US]).count() == 0
    some = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), None, 3, "purchase", None, None, 0, 0, "")], CLICKS)
    assert [tuple(r) for r in cohorts.matrix(some, two, cohorts.late_arrival(), [queries.CUT_US]).collect()] == [(1, "", 6574, 0, 1, zlib.crc32(b"3"), 0, 0)]


def test_wall_clock_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    moment = datetime.datetime(2024, 3, 31, 2, 30, 0, 123_456)  # a time that clocks in some zones skip
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        frame = spark.createDataFrame([(moment,)], "ts timestamp_ntz")
        assert frame.select(cohorts.micros(F.col("ts"))).first()[0] == (moment - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
