"""Token budgets, sequence packing, epoch shuffles and repository packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import u01
from millrace.functions.text import FILE_SEP, REPO_NAME, repo_context
from millrace.operators.storage import written

#: Tokens of a block at least: what lies in one is cut in its place.
LEAST_BLOCK = 4_096


def ordered_positions(df: DataFrame, order: str | list[str], size: str) -> DataFrame:
    """df with `start`: the sum of `size` over all rows before it in `order`.

    Range partitions are numbered and summed by themselves; their totals, one row each, give where each begins. No
    task sees more than its own range, however long the table.
    """
    keys = [order] if isinstance(order, str) else order
    dealt = written(df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__range").agg(F.sum(size).alias("__total")).select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__own", F.coalesce(F.sum(size).over(within), F.lit(0))).join(F.broadcast(starts), "__range")  # a row a partition
    return placed.withColumn("start", (F.col("__start") + F.col("__own")).cast("bigint")).drop("__range", "__own", "__start")


def token_index(tokens: DataFrame, order: str = "doc_id", length: str = "length") -> DataFrame:
    """order, offset, length: where each sample's tokens begin."""
    return ordered_positions(tokens.where(F.col(length) > 0), order, length).select(order, F.col("start").alias("offset"), F.col(length).cast("bigint").alias("length"))


def budget_prefix(index: DataFrame, max_tokens: int) -> DataFrame:
    """Samples up to the one that crosses the budget, which is still written."""
    return index.where(F.col("offset") < max_tokens)


def packed(tokens: DataFrame, length: int, order: str | list[str] = "doc_id", ids: str = "ids", eos: int = 0) -> DataFrame:
    """chunk, input_ids, targets: ids and an end mark of all samples in order, cut into runs of length + 1; the rest goes.

    Samples are made and written once, then dealt by ranges of the order, in which their tokens are laid end to end in
    blocks. With the ranges' totals, a row each, blocks are cut where they are; only what is left at either end of a
    block moves, to meet the rest of its chunk. No token is a row of its own.
    """
    width, keys = length + 1, [order] if isinstance(order, str) else list(order)
    block = max(LEAST_BLOCK, 4 * width)
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    made = written(tokens.select(*own, F.col(ids).alias("__ids"))).where(F.size("__ids") > 0)
    run = made.withColumn("__ids", F.concat("__ids", F.array(F.lit(eos))))
    kind = run.schema["__ids"].dataType.simpleString()
    named = [f"__k{i}" for i in range(len(keys))]
    dealt = run.repartitionByRange(*named).sortWithinPartitions(*named).select("__ids", F.spark_partition_id().alias("range"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of a range, each with its place in it and as many tokens of both its ends as a chunk has."""

        def blocks(values: pa.Array, size: int) -> pa.RecordBatch:
            many = len(values) // size
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(values) + 1, size), pa.int32()), values)
            places = pa.array(range(at, at + len(values), size), pa.int64())
            head, tail = pc.list_slice(lists, 0, min(width, size)), pc.list_slice(lists, max(size - width, 0), size)
            columns = [pa.array([number] * many, pa.int32()), places, pa.array([size] * many, pa.int64()), lists, head, tail]
            return pa.RecordBatch.from_arrays(columns, names=["range", "place", "n", "tokens", "head", "tail"])

        held, at, number = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                number = batch.column(1)[0].as_py()
                held.append(batch.column(0).flatten())
            if sum(map(len, held)) >= block:
                values = pa.concat_arrays(held)
                whole = len(values) // block * block
                yield blocks(values[:whole], block)
                held, at = [values[whole:]], at + whole
        if sum(map(len, held)):
            values = pa.concat_arrays(held)
            yield blocks(values, len(values))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks that lie in one block."""
        for batch in batches:
            lists, numbers, parts = batch.column(1), [], []
            for i, start in enumerate(batch.column(0).to_pylist()):
                values, first = lists[i].values, -start % width
                many = (len(values) - first) // width
                if many > 0:
                    numbers.append(np.arange(many) + (start + first) // width)
                    parts.append(values[first : first + many * width])
            if parts:
                number, values = np.concatenate(numbers), pa.concat_arrays(parts)
                whole = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1) * width, pa.int32()), values)
                columns = [pa.array(number, pa.int64()), pc.list_slice(whole, 0, length), pc.list_slice(whole, 1, width)]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "input_ids", "targets"])

    laid = written(dealt.mapInArrow(lay, f"range int, place long, n long, tokens {kind}, head {kind}, tail {kind}"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("range").agg(F.sum("n").alias("total")).select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("__start"))
    placed = laid.join(F.broadcast(starts), "range").withColumn("start", F.col("__start") + F.col("place"))  # a row a range
    inside = placed.select("start", "tokens").mapInArrow(cut, f"chunk long, input_ids {kind}, targets {kind}")

    end = F.col("start") + F.col("n")
    first, last = F.least(F.pmod(-F.col("start"), F.lit(width)), "n").cast("int"), F.pmod(end, F.lit(width)).cast("int")
    piece = lambda at, part: F.struct(F.floor(at / width).alias("chunk"), at.alias("start"), part.alias("part"))
    left = F.when(first > 0, piece(F.col("start"), F.slice("head", F.lit(1), first)))
    right = F.when((last > 0) & (first < F.col("n")), piece(end - last, F.slice("tail", -last, last)))
    ends = placed.select(F.explode(F.array(left, right)).alias("p")).where(F.col("p").isNotNull()).select("p.*")
    rows = ends.groupBy("chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])).alias("all"))
    across = rows.where(F.size("all") == width).select("chunk", F.slice("all", 1, length).alias("input_ids"), F.slice("all", 2, length).alias("targets"))
    return inside.unionByName(across)


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """df with `position`: its place in the epoch's permutation, which seed + epoch and the key decide."""
    drawn = df.withColumn("__u", u01(seed + epoch, "epoch", F.col(key))).withColumn("__one", F.lit(1))
    return ordered_positions(drawn, ["__u", key], "__one").withColumnRenamed("start", "position").drop("__u", "__one")


def worker_split(df: DataFrame, workers: int, position: str = "position") -> DataFrame:
    """Every n-th row of the order belongs to a worker."""
    return df.withColumn("worker", F.pmod(F.col(position), F.lit(workers)).cast("int"))


def repository_packs(files: DataFrame, repo: str, path: str, content: str, max_tokens: int = 8192, chars_per_token: float = 3.5) -> DataFrame:
    """repo, pack, n_files, text: files in order of path, greedily as many as fit into the budget of characters.

    A file beyond the budget stands alone, cut; what was open before it is closed first. The greedy fold runs over the
    lengths of a repository's files alone, in one pass; contents are only moved once, to their pack. Files without a
    repository or path have no pack.
    """
    budget = int(max_tokens * chars_per_token)
    base = F.length(F.concat(F.lit(REPO_NAME), F.col(repo), F.lit("\n")))
    overhead = F.length(F.concat(F.lit(FILE_SEP), F.col(path), F.lit("\n")))
    sized = files.select(repo, path, (overhead + F.coalesce(F.length(content), F.lit(0))).alias("chars"))
    kind = dict(sized.dtypes)

    def fold(group: pa.Table) -> pa.Table:
        """The greedy choice over one repository's lengths, in one pass."""
        group = group.sort_by("path")
        packs, pack, opened, chars = [], -1, False, 0
        for size, base in zip(group["chars"].to_pylist(), group["base"].to_pylist(), strict=True):
            alone = size > budget
            if alone or not opened or chars + size > budget:
                pack, chars = pack + 1, base
            chars, opened = chars + size, not alone
            packs.append(pack)
        return pa.table({"repo": group["repo"], "path": group["path"], "pack": pa.array(packs, pa.int32())})

    narrow = sized.where(F.col(repo).isNotNull() & F.col(path).isNotNull()).select(F.col(repo).alias("repo"), F.col(path).alias("path"), "chars", base.alias("base"))
    places = narrow.groupBy("repo").applyInArrow(fold, f"repo {kind[repo]}, path {kind[path]}, pack int").toDF(repo, path, "pack")
    whole = files.join(places, [repo, path])
    kept = F.when(overhead + F.length(content) > budget, F.substring(F.col(content), F.lit(1), F.lit(budget - 100) - overhead)).otherwise(F.col(content))
    grouped = whole.groupBy(repo, "pack").agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), kept.alias("content")))).alias("files"))
    return grouped.select(repo, "pack", F.size("files").alias("n_files"), repo_context(F.col(repo), F.col("files")).alias("text"))
