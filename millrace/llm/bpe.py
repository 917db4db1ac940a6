"""Byte-level BPE over Arrow batches: encoding with offsets, decoding that survives split characters."""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices

#: Pieces whose ids a worker remembers; then it starts anew. About 100 MB at most.
CACHE_PIECES = 300_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the rest follow from U+0100 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank. It is read on the driver only."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The pair whose merge makes the token: what the merges of lower rank leave of its bytes."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            raise ValueError(f"no two merges make {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    """Vocabulary, merges and pattern as text, which executors get instead of a path."""
    table = byte_chars()
    shown = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [[shown[x] for x in _halves(t, ranks)] for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    return json.dumps({"vocab": {shown[t]: r for t, r in ranks.items()}, "merges": merges, "pattern": pattern})


class ByteBpe:
    """Encodes and decodes in one process. The pattern splits a text; each piece is merged by itself."""

    def __init__(self, model: str):
        from tokenizers.models import BPE

        spec, table = json.loads(model), byte_chars()
        self._pieces = regex.compile(spec["pattern"]).findall
        self._bpe = BPE(vocab=spec["vocab"], merges=[tuple(m) for m in spec["merges"]])
        self._shown = {b: c for b, c in enumerate(table)}
        back = {c: b for b, c in enumerate(table)}
        self._bytes = [b""] * (max(spec["vocab"].values()) + 1)
        for token, i in spec["vocab"].items():
            self._bytes[i] = bytes(back[c] for c in token)
        self._cache: dict[str, bytes] = {}

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces, cache = self._pieces(text), self._cache
        missing = [p for p in set(pieces) if p not in cache]
        if len(cache) + len(missing) > CACHE_PIECES:
            cache.clear()
            missing = set(pieces)
        for p in missing:
            shown = p.encode("utf-8").decode("latin-1").translate(self._shown)
            cache[p] = np.array([t.id for t in self._bpe.tokenize(shown)], dtype="<u4").tobytes()
        return b"".join(map(cache.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), dtype="<u4")

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Start and end of each token in code points of the text; a token that holds a part of a character covers it."""
        ends = np.cumsum([len(self._bytes[i]) for i in ids.tolist()], dtype=np.int64)
        starts = np.concatenate([ends[:0], [0], ends[:-1]])[: len(ends)]
        lead = (np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead) - 1  # of each byte
        return np.stack([char[starts], char[ends - 1] + 1], axis=1) if len(ids) else np.zeros((0, 2), dtype=np.int64)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """An id outside of the vocabulary is an error."""
        return b"".join(map(self._bytes.__getitem__, ids))

    def decode_parts(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of parts of an id sequence; bytes of a character that a cut splits wait for the next part.

        Bytes that never make a character become U+FFFD.
        """
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield decoder.decode(self.decode_bytes(ids))
        if rest := decoder.decode(b"", True):
            yield rest


@functools.lru_cache(maxsize=2)
def coder(model: str) -> ByteBpe:
    """One for each Python worker and model."""
    return ByteBpe(model)


@functools.lru_cache(maxsize=4)
def load_model(path: str, pattern: str) -> str:
    return model_json(read_ranks(path), pattern)


def encode(df: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, ids, starts, ends: the ids of every whole text and each token's code points. Null texts act as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>, starts array<int>, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for part in slices(batches, "__text"):
            ids, starts, ends = [], [], []
            for t in part.column(1).to_pylist():
                ids.append(own.encode(t).astype(np.int32))
                at = own.offsets(t, ids[-1]).astype(np.int32)
                starts.append(at[:, 0])
                ends.append(at[:, 1])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, kind), pa.array(starts, kind), pa.array(ends, kind)], names=[id_col, "ids", "starts", "ends"])

    return df.select(id_col, F.coalesce(text, F.lit("")).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id_col, text: the reverse of encode. Null ids give the empty text; cut sequences end in U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for part in batches:
            texts = ["".join(own.decode_parts([x or []])) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string")


def roundtrip(df: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes and decodes every whole text in one pass: id_col, n_tokens, ids_sha256, decoded_sha256.

    The same code as encode and decode; ids stay in the worker, only digests leave it. Null texts act as empty ones:
    0 tokens and the digests of no bytes. Repeated rows get a row each; an empty table gives none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for part in slices(batches, "__text"):
            n, packed, decoded = [], [], []
            for t in part.column(1).to_pylist():
                ids = own.encode_packed(t)
                n.append(len(ids) // 4)
                packed.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(packed), pa.array(decoded)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, F.coalesce(text, F.lit("")).alias("__text")).mapInArrow(run, schema)


def lengths(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """n_tokens of every whole text; a null text has 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for part in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(own.encode_packed(t)) // 4 for t in part.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return df.select(F.coalesce(text, F.lit("")).alias("__text")).mapInArrow(run, "n_tokens long")


def public_model(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary of the installed public files, with their pattern."""
    import public_tokenizers

    return load_model(public_tokenizers.path(name), public_tokenizers.PATTERN)
