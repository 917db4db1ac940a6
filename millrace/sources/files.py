"""Files, JSON lines and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import u01
from millrace.functions.text import first_truthy, strip
from millrace.operators.chat import SFT_SCHEMA
from millrace.operators.pack import ordered_positions
from millrace.sources import token_files

# Fixed values.
CODE_SUFFIXES = ("py", "js", "ts", "java", "cpp", "c", "h", "go", "rs", "rb", "php", "cs", "kt", "swift")
REPO_SUFFIXES = ("py", "js", "ts", "tsx", "java", "cpp", "c", "h", "hpp", "go", "rs", "rb", "php", "cs", "kt", "swift", "scala", "sh", "bash", "sql", "lua", "jl", "r")
SKIPPED_FOLDERS = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build", ".tox", ".eggs", "vendor")
DPO_SCHEMA = "prompt string, chosen string, rejected string"
HUMANEVAL_SCHEMA = "task_id string, prompt string, canonical_solution string, test string, entry_point string"
MBPP_SCHEMA = "task_id int, text string, code string, test_list array<string>, test_setup_code string"
TOKENS_SCHEMA = "doc_id bigint, offset bigint, length bigint, ids array<int>"


def local_files(spark: SparkSession, *paths: str, suffixes: tuple[str, ...] = CODE_SUFFIXES) -> DataFrame:
    """path, content, position: files that are named, whatever their suffix, and those below folders that are named, by
    suffix, case and all. In order of the arguments, a folder's files in order of their paths.

    Bytes that aren't UTF-8 are replaced, unreadable files skipped, a path that isn't there is an error.
    """
    hadoop, out = spark._jvm.org.apache.hadoop.fs, None
    for number, path in enumerate(paths):
        place = hadoop.Path(path)
        folder = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).isDirectory()
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
        wanted = files.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*suffixes)) if folder else files
        one = wanted.select(F.lit(number).alias("__argument"), "path", F.col("content").cast("string").alias("content"))
        out = one if out is None else out.unionByName(one)
    return ordered_positions(out.withColumn("__one", F.lit(1)), ["__argument", "path"], "__one").select("path", "content", F.col("start").alias("position"))


def repository(spark: SparkSession, path: str, suffixes: tuple[str, ...] = REPO_SUFFIXES, largest: int = 100_000) -> DataFrame:
    """path, content, size of a repository's files, without large ones and the folders that hold no source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    relative = F.replace(F.substring_index("path", root + "/", -1), F.lit("\\"), F.lit("/"))
    skipped = "(^|/)(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/"
    kept = files.where(F.col("length") <= largest).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    return kept.select(relative.alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size")).where(~F.col("path").rlike(skipped))


def raw_samples(*sources: DataFrame) -> DataFrame:
    """text, lang of several sources, one after the other; the first of content, code and text that isn't empty."""
    out = None
    for df in sources:
        names = [c for c in ("content", "code", "text") if c in df.columns]
        langs = [F.nullif(F.col(c), F.lit("")) for c in ("lang", "language") if c in df.columns]
        one = df.select(first_truthy(*[F.col(c) for c in names]).alias("text"), F.lower(F.coalesce(*langs, F.lit(""))).alias("lang"))
        out = one if out is None else out.unionByName(one)
    return out


def write_by_language(docs: DataFrame, path: str, lang: str = "lang") -> None:
    """docs as a table with a partition for each language, by its lower-cased name; no text moves for it."""
    docs.withColumn("__language", F.lower(F.coalesce(F.col(lang), F.lit("")))).write.partitionBy("__language").mode("overwrite").parquet(path)


def language_samples(spark: SparkSession, path: str, whole: DataFrame, languages: list[str], least: int = 50) -> DataFrame:
    """text, lang of samples of more than `least` characters without the space around them, in the languages asked for.

    They come from the partitions of a table by language, of which no others are read; a language that has none gives
    nothing. If there is none for any of them, the whole set is read and filtered by its own language column.
    """
    wanted = sorted({x.lower() for x in languages})
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = spark.read.parquet(path) if store.exists(hadoop) else None
    found = there.where(F.col("__language").isin(*wanted)) if there is not None and "__language" in there.columns else None
    if found is not None and found.select("__language").limit(1).count():
        rows = found.select(first_truthy(*[F.col(c) for c in ("content", "code", "text") if c in found.columns]).alias("text"), F.col("__language").alias("lang"))
    else:
        rows = raw_samples(whole).where(F.col("lang").isin(*wanted))
    return rows.where(F.length(strip(F.col("text"))) > least)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of a fixed schema; lines that don't parse are dropped, or an error if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def sft_records(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, SFT_SCHEMA)


def dpo_records(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, DPO_SCHEMA)


def humaneval(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, HUMANEVAL_SCHEMA, strict=True)


def mbpp(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, MBPP_SCHEMA, strict=True)


def write_tokens(tokens: DataFrame, path: str, manifest: dict | None = None) -> None:
    """A table of offsets, lengths and ids, and a manifest of one JSON row; a run that is repeated replaces both."""
    tokens.write.mode("overwrite").parquet(f"{path}/tokens")
    totals = tokens.agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    totals.withColumns({k: F.lit(v) for k, v in (manifest or {}).items()}).withColumn("complete", F.lit(True)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS_SCHEMA).parquet(f"{path}/tokens")


def packed_uint16(tokens: DataFrame) -> DataFrame:
    """doc_id, bytes: ids as little-endian unsigned 16-bit integers, for readers of flat token files."""
    hexes = F.transform("ids", lambda i: F.concat(F.lpad(F.hex(i % 256), 2, "0"), F.lpad(F.hex(F.floor(i / 256)), 2, "0")))
    return tokens.select("doc_id", F.unhex(F.array_join(hexes, "")).alias("bytes"))


def synthetic_tokens(spark: SparkSession, rows: int, length: int, vocab: int, seed: int = 42) -> DataFrame:
    """row, input_ids, targets: ids drawn evenly from the vocabulary, the targets one place further."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(length)), lambda i: F.floor(u01(seed, "synthetic", F.col("id"), i) * vocab).cast("int"))
    made = spark.range(rows).select(F.col("id").alias("row"), ids.alias("ids"))
    return made.select("row", F.slice("ids", 1, length).alias("input_ids"), F.slice("ids", 2, length).alias("targets"))


def flat_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """row, offset, length, ids of tokens.bin and index.npy; see token_files."""
    return token_files.read(spark, folder)


def write_results(df: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines; a run that is repeated replaces them."""
    df.write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines, added to those that are there."""
    df.write.mode("append").json(path)


def walked(files: DataFrame, path: str = "path") -> DataFrame:
    """files with `position`: their place in order of path."""
    return ordered_positions(files.withColumn("__one", F.lit(1)), path, "__one").withColumnRenamed("start", "position").drop("__one")
