"""Flat token files as a Spark data source: tokens.bin (unsigned 16-bit) with index.npy (offset, length of each sample)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "row bigint, offset bigint, length bigint, ids array<int>"
#: Bytes that one task reads, about; samples of one Arrow batch.
PARTITION_BYTES, BATCH = 64 << 20, 1024


@dataclass
class Layout:
    """What the two files say of themselves: samples, bytes of the index before the first, bytes of a number, tokens."""

    samples: int
    head: int
    kind: str
    tokens: int


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder: local, or any that pyarrow opens by its URI (hdfs, s3, gs, ...)."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def layout(folder: str) -> Layout:
    """Reads the index's header and the files' sizes; an error if a file isn't there or the index hasn't two columns."""
    store, root = _opened(folder.rstrip("/"))
    sizes = {}
    for name in ("tokens.bin", "index.npy"):
        info = store.get_file_info(f"{root}/{name}")
        if info.type != fs.FileType.File:
            raise FileNotFoundError(f"{folder}/{name}")
        sizes[name] = info.size
    with store.open_input_file(f"{root}/index.npy") as file:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, columns_first, kind = read(file)
        head = file.tell()
    if shape != (0,) and (len(shape) != 2 or shape[1] != 2 or columns_first):
        raise ValueError(f"the index has shape {shape}, not (n, 2)")
    return Layout(shape[0], head, kind.str, sizes["tokens.bin"] // 2)


class Samples(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, folder: str, names: list[str], size: int):
        self.folder, self.names, self.size = folder.rstrip("/"), names, size

    def partitions(self) -> list[Samples]:
        """Runs of samples: as many as the bytes to be read need. Without ids the tokens aren't read, nor counted."""
        plan = layout(self.folder)
        total = plan.samples * 2 * np.dtype(plan.kind).itemsize + (plan.tokens * 2 if "ids" in self.names else 0)
        parts = min(max(1, -(-total // self.size)), max(1, plan.samples))
        cuts = [plan.samples * i // parts for i in range(parts + 1)]
        return [Samples(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Samples) -> Iterator[pa.RecordBatch]:
        plan, (store, root) = layout(self.folder), _opened(self.folder)
        width = 2 * np.dtype(plan.kind).itemsize
        index = store.open_input_file(f"{root}/index.npy")
        tokens = store.open_input_file(f"{root}/tokens.bin") if "ids" in self.names else None
        for first in range(partition.first, partition.last, BATCH):
            last = min(first + BATCH, partition.last)
            own = np.frombuffer(index.read_at((last - first) * width, plan.head + first * width), dtype=plan.kind).reshape(-1, 2).astype(np.int64)
            columns = {"row": np.arange(first, last), "offset": own[:, 0], "length": own[:, 1]}
            if tokens is not None:
                columns["ids"] = self._ids(tokens, own, plan.tokens)
            kinds = {"ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.int64())) if n != "ids" else columns[n] for n in self.names], names=self.names)

    @staticmethod
    def _ids(tokens, own: np.ndarray, total: int) -> pa.Array:
        """The samples' tokens: neighbours in the file by one read; what lies beyond its end is missing, as in a slice."""
        begin = np.clip(own[:, 0], 0, total)
        end = np.clip(own.sum(axis=1), begin, total)
        parts, at = [], 0
        while at < len(own):
            upto = at + 1
            while upto < len(own) and begin[upto] == end[upto - 1]:
                upto += 1
            parts.append(np.frombuffer(tokens.read_at(int(end[upto - 1] - begin[at]) * 2, int(begin[at]) * 2), dtype="<u2"))
            at = upto
        flat = np.concatenate(parts).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]), pa.int32()), pa.array(flat))


class TokenFiles(DataSource):
    """`spark.read.format("token_files").load(folder)`; a schema of fewer columns reads no others, and the tokens only
    with `ids`. Option `bytes`: what one task reads, about."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.fieldNames(), int(self.options.get("bytes", PARTITION_BYTES)))


def read(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("row", "offset", "length", "ids"), size: int = PARTITION_BYTES):
    """The samples of a folder with the columns that are asked for. Missing files and malformed indexes are errors here,
    not in the first task; an empty index gives no rows."""
    layout(folder)
    spark.dataSource.register(TokenFiles)
    kinds = dict(field.split() for field in SCHEMA.split(", "))
    return spark.read.format("token_files").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).option("bytes", size).load(folder)
