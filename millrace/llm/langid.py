"""Language ID by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, small_batches

UNKNOWN = "und"
ORDERS = (2, 3, 4)
#: Buckets that n-grams hash to.
BUCKETS = 1 << 15
#: Bytes whose n-grams are looked up at once.
CHUNK = 1 << 19
#: Bound of the training sample: documents of each language, and the characters that are taken of each.
SAMPLE_PER_LANG, SAMPLE_CHARS = 800, 20_000
#: The nearest two codewords' losses closer than this share of the larger: ambiguous.
AMBIGUOUS = 0.05

_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def folded(text: str) -> np.ndarray:
    """Lower-case UTF-8 bytes with one space for each run of ASCII that isn't letters, and one at either end."""
    words = text.lower().encode("utf-8", "replace").translate(_FOLD).split()
    return np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)


def _hashed(data: np.ndarray, order: int) -> np.ndarray:
    n = len(data) - order + 1
    h = np.full(max(n, 0), order * 0x632BE5AB & 0xFFFFFFFF, dtype=np.uint32)
    for j in range(order if n > 0 else 0):
        h = (h ^ data[j : j + n]) * _MULTIPLIERS[j]
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of CHUNK bytes that overlap so that each n-gram of the highest order is in one; lower orders' ends may count twice."""
    step = CHUNK - max(ORDERS) + 1
    for at in range(0, max(1, len(data) - max(ORDERS) + 1), step):
        yield data[at : at + CHUNK]


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Rows of +-1. Up to six classes: every split of the classes once. More: the best of random codes."""
    if classes < 2:
        return np.ones((classes, 1), dtype=np.float32)
    if classes <= 6:
        rest = itertools.product((1, -1), repeat=classes - 1)
        columns = [(1, *c) for c in rest if -1 in c]
        return np.array(columns, dtype=np.float32).T
    rng, bits, best, apart = np.random.default_rng(seed), math.ceil(10 * math.log2(classes)), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), size=(classes, bits))
        if (np.abs(code.sum(axis=0)) == classes).any():
            continue
        distance = ((bits - code @ code.T) / 2 + np.eye(classes) * bits).min()
        if distance > apart:
            best, apart = code, distance
    return best


@dataclass
class LanguageCoder:
    """langs; code: langs x bits; table: bucket x bits, what an n-gram says for each bit; loss_weight: of each bit."""

    langs: list[str]
    code: np.ndarray
    table: np.ndarray
    scale: np.ndarray
    loss_weight: np.ndarray

    def outputs(self, text: str) -> np.ndarray:
        """The bits' real-valued outputs: each n-gram's evidence, averaged over the whole text."""
        data, total, n = folded(text), np.zeros(self.table.shape[1], dtype=np.float64), 0
        for part in _parts(data):
            for order in ORDERS:
                at = _hashed(part, order)
                total += self.table[at].sum(axis=0, dtype=np.float64)
                n += len(at)
        return total / max(n, 1) * self.scale

    def losses(self, outputs: np.ndarray) -> np.ndarray:
        """Loss-weighted distance to each codeword: the logistic loss of each bit, weighted by how good that bit is."""
        return np.logaddexp(0, -self.code * outputs) @ self.loss_weight

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score, ambiguous, margin. `und`, 0, true, 0 for null or a text without letters."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False, 1.0
        loss = self.losses(self.outputs(text))
        order = np.argsort(loss, kind="stable")
        p = np.exp((loss.min() - loss) * len(self.loss_weight))
        margin = float((loss[order[1]] - loss[order[0]]) / max(loss[order[1]], 1e-12))
        return self.langs[order[0]], float(p[order[0]] / p.sum()), margin < AMBIGUOUS, margin


def train(texts: list[str], langs: list[str]) -> LanguageCoder:
    """Counts n-grams of each language, then gives each bit its two sides' log ratio of smoothed shares."""
    names = sorted(set(langs))
    code = codewords(len(names))
    counts = np.zeros((len(names), BUCKETS), dtype=np.float64)
    for text, lang in zip(texts, langs, strict=True):
        row = counts[names.index(lang)]
        for part in _parts(folded(text)):
            for order in ORDERS:
                row += np.bincount(_hashed(part, order), minlength=BUCKETS)
    share = (counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True) if names else counts
    bits = code.shape[1]
    table = np.zeros((BUCKETS, bits), dtype=np.float32)
    if len(names) > 1:
        for b in range(bits):
            table[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    model = LanguageCoder(names, code, table, np.ones(bits), np.ones(bits) / bits)
    if len(names) > 1:
        target = code[[names.index(x) for x in langs]]
        out = np.stack([model.outputs(t) for t in texts])
        model.scale = 3.0 / np.maximum(np.median(np.abs(out), axis=0), 1e-6)
        right = (np.sign(out) == target).mean(axis=0)
        weight = np.clip(right - 0.5, 0.01, None)
        model.loss_weight = weight / weight.sum()
    return model


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = SAMPLE_PER_LANG, max_chars: int = SAMPLE_CHARS) -> LanguageCoder:
    """Learns from about per_lang usable rows of each language, at most twice as many, up to max_chars characters each.

    The rows are those whose key hashes lowest, so the sample is the same at every run. The counts come from one
    narrow scan, the sample from another; only the sample reaches the driver.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & (F.length(text) > 0))
    totals = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not totals:
        return train([], [])
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("sample"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    rate = F.lit(0.0)
    for name, n in sorted(totals.items()):
        rate = F.when(F.col(lang) == name, min(1.0, per_lang / n)).otherwise(rate)
    sample = rows.where(draw < rate).select(F.col(lang).alias("l"), F.substring(text, 1, max_chars).alias("t"), draw.alias("d")).orderBy("d", "t").limit(2 * per_lang * len(totals)).collect()
    return train([r.t for r in sample], [r.l for r in sample])


def predict(docs: DataFrame, model: LanguageCoder, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score, ambiguous, margin for every whole text. A map over Arrow batches, without a shuffle.

    A null text, and one without letters, the empty one too, is `und` with score 0, ambiguous, margin 0. Very long
    texts are read part by part to their end. Ties go to the language first in order. Repeated rows get equal answers;
    an empty table gives no rows. A kept column that is called like one of the four results goes: the result has the
    name. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    keep = tuple(k for k in keep if k not in ("lang_pred", "score", "ambiguous", "margin"))
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keep) + "lang_pred string, score double, ambiguous boolean, margin double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "__text", index=len(keep)):
            found = [own.predict(t) for t in part.column(len(keep)).to_pylist()]
            lang, score, odd, margin = zip(*found, strict=True)
            arrays = [*(part.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(odd, pa.bool_()), pa.array(margin, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "ambiguous", "margin"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
