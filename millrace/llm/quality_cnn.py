"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, small_batches

#: Filter width and step in bytes, embedding size, filters.
WIDTH, STEP, EMBED, FILTERS = 8, 2, 8, 24
#: A chunk is CHUNK positions of the filters; the next one begins half a chunk later.
CHUNK = 128
HALF = CHUNK // 2
#: Bytes that go through the network at once.
BLOCK = 1 << 20
#: Bound of the training sample: rows, and the characters that are taken of each. Chunks of a document that one step uses.
SAMPLE_ROWS, SAMPLE_CHARS, STEP_CHUNKS = 3000, 20_000, 6
EPOCHS, BATCH, RATE = 6, 64, 4e-3


@dataclass
class ByteCnn:
    """embed: 256 x EMBED; kernel: WIDTH*EMBED x FILTERS; head: weights of the mean and of the maximum over chunks."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float
    empty: float = 0.5
    moments: dict = field(default_factory=dict, repr=False)

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Halves of chunks x FILTERS: the highest response of each filter in each half; data has whole halves."""
        x = self.embed[data].reshape(-1)
        n = (len(data) - WIDTH) // STEP + 1
        windows = np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STEP * EMBED * 4, 4))
        out = windows @ self.kernel
        out += self.bias
        np.maximum(out, 0, out=out)
        return out.reshape(-1, HALF, FILTERS).max(axis=1)

    def features(self, text: bytes) -> np.ndarray:
        """Mean and maximum over all overlapping chunks of the whole document."""
        total, top, n, last = np.zeros(FILTERS), np.zeros(FILTERS, dtype=np.float32), 0, None
        for part in _padded(text):
            halves = self.pooled(part)
            if last is not None:
                halves = np.concatenate([last, halves])
            chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves[:0]
            if len(chunks):
                total += chunks.sum(axis=0, dtype=np.float64)
                top = np.maximum(top, chunks.max(axis=0))
                n += len(chunks)
            last = halves[-1:]
        if not n:  # less than two halves: the one chunk there is
            total, top, n = last[0].astype(np.float64), last[0], 1
        return np.concatenate([total / n, top]).astype(np.float32)

    def score(self, text: bytes) -> float:
        """Probability of label 1; the training rows' share of label 1 for an empty text."""
        if not text:
            return self.empty
        return float(1 / (1 + np.exp(-(self.features(text) @ self.head + self.offset))))


def _padded(text: bytes) -> Iterator[np.ndarray]:
    """Parts of about BLOCK bytes of whole halves; the windows at a part's end see the next part's first bytes."""
    data, half = np.frombuffer(text, dtype=np.uint8), HALF * STEP
    size = BLOCK // half * half
    for at in range(0, max(len(data), 1), size):
        part = data[at : at + size + WIDTH - STEP]
        halves = -(-min(len(data) - at, size) // half)
        yield np.concatenate([part, np.zeros(max(0, halves * half + WIDTH - STEP - len(part)), dtype=np.uint8)])


def _chunks(data: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """STEP_CHUNKS chunks of a document for one training step, drawn over its whole length."""
    size = CHUNK * STEP + WIDTH - STEP
    data = np.concatenate([data, np.zeros(max(0, size - len(data)), dtype=np.uint8)])
    starts = rng.integers(0, len(data) - size + 1, STEP_CHUNKS)
    return data[starts[:, None] + np.arange(size)]


def train(texts: list[bytes], labels: list[int], seed: int = 11, epochs: int = EPOCHS) -> ByteCnn:
    """Adam on the logistic loss, by backpropagation through head, pooling, filters and embedding."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"embed": f32(256, EMBED, scale=0.5), "kernel": f32(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), "bias": np.zeros(FILTERS, np.float32), "head": np.zeros(2 * FILTERS, np.float32), "offset": np.zeros(1, np.float32)}
    pairs = [(np.frombuffer(t, dtype=np.uint8), y) for t, y in zip(texts, labels, strict=True) if t]
    share = float(np.mean(labels)) if labels else 0.5
    if not pairs or share in (0.0, 1.0):
        p["offset"][0] = 0.0 if not pairs else (3.0 if share else -3.0)
        return ByteCnn(p["embed"], p["kernel"], p["bias"], p["head"], float(p["offset"][0]), share)
    p["offset"][0] = np.log(share / (1 - share))
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    y_all = np.array([y for _, y in pairs], dtype=np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(pairs))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            data = np.stack([_chunks(pairs[i][0], rng) for i in rows])  # rows x chunks x bytes
            b, c, n = data.shape
            where = np.arange(CHUNK)[:, None] * STEP + np.arange(WIDTH)
            index = data.reshape(b * c, n)[:, where]  # chunk x position x WIDTH
            x = p["embed"][index].reshape(b * c * CHUNK, WIDTH * EMBED)
            out = (x @ p["kernel"] + p["bias"]).reshape(b * c, CHUNK, FILTERS)
            best = out.argmax(axis=1)
            raw = np.take_along_axis(out, best[:, None], axis=1)[:, 0]
            pool = np.maximum(raw, 0).reshape(b, c, FILTERS)
            top = pool.argmax(axis=1)
            feats = np.concatenate([pool.mean(axis=1), np.take_along_axis(pool, top[:, None], axis=1)[:, 0]], axis=1)
            z = feats @ p["head"] + p["offset"]
            dz = (1 / (1 + np.exp(-z)) - y_all[rows]) / b
            g = {"head": feats.T @ dz + 1e-4 * p["head"], "offset": np.array([dz.sum()], np.float32)}
            dfeat = dz[:, None] * p["head"]
            dpool = np.repeat(dfeat[:, None, :FILTERS] / c, c, axis=1)
            np.put_along_axis(dpool, top[:, None], np.take_along_axis(dpool, top[:, None], axis=1) + dfeat[:, None, FILTERS:], axis=1)
            draw = dpool.reshape(b * c, FILTERS) * (raw > 0)
            # Only the position that won the pooling takes part.
            won = x.reshape(b * c, CHUNK, WIDTH * EMBED)[np.arange(b * c)[:, None], best]  # chunk x filter x inputs
            g["kernel"] = np.einsum("cfi,cf->if", won, draw)
            g["bias"] = draw.sum(axis=0)
            dx = (draw[:, :, None] * p["kernel"].T).reshape(-1, EMBED)
            g["embed"] = np.zeros_like(p["embed"])
            at_bytes = index[np.arange(b * c)[:, None], best].reshape(-1)
            for e in range(EMBED):
                g["embed"][:, e] = np.bincount(at_bytes, weights=dx[:, e], minlength=256)
            t += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model = ByteCnn(p["embed"], np.ascontiguousarray(p["kernel"]), p["bias"], p["head"], float(p["offset"][0]), share)
    return _refit_head(model, pairs, share)


def _refit_head(model: ByteCnn, pairs: list, share: float) -> ByteCnn:
    """The head once more, by Newton's method on whole documents: training steps saw some chunks of each."""
    x = np.stack([model.features(d.tobytes()) for d, _ in pairs]).astype(np.float64)
    y = np.array([l for _, l in pairs], dtype=np.float64)  # noqa: E741
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag(ridge), a.T @ (q - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.head = (w[:-1] / spread).astype(np.float32)
    model.offset = float(w[-1] - (w[:-1] / spread) @ mean)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> ByteCnn:
    """Learns from at most `rows` labelled rows, up to max_chars characters each: those whose key hashes lowest.

    Keys are chosen in the narrow table of labels first, so texts of other rows are never shuffled. Rows without
    label or text are not used; of a key with several labels the largest counts.
    """
    draw = F.md5(F.concat_ws(":", F.lit("sample"), F.col(key).cast("string")).cast("binary"))
    chosen = labels.where(usable & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__y")).withColumn("__d", draw).orderBy("__d").limit(rows)
    texts = docs.where(usable & F.col(text).isNotNull()).select(key, F.substring(text, 1, max_chars).alias("__t"))
    sample = texts.join(F.broadcast(chosen), key).orderBy("__d", "__t").limit(2 * rows).collect()  # chosen has `rows` rows at most
    return train([r["__t"].encode("utf-8", "replace") for r in sample], [r["__y"] for r in sample])


def predict(docs: DataFrame, model: ByteCnn, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score for every whole text; null and empty texts get the share of label 1. A map without a shuffle.

    Very long texts go through the network part by part to their end. Repeated rows get equal scores; an empty table
    gives no rows. A kept column that is called `score` goes: the result has the name. Others are not looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    keep = tuple(k for k in keep if k != "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "__text", index=len(keep)):
            scores = [own.score(t.encode("utf-8", "replace")) for t in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text")).mapInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keep) + "score double")
