"""The corpus pipeline: five stages, each by one operator of the training-data subpackage.

Each stage takes (spark, docs, sf_dir), works on every row that the one before it kept, and is written as Parquet
before the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard_join, langid, line_dedup
from millrace.llm.common import held_out, stored, table

#: A text of so many characters whose language stays ambiguous is junk; shorter ones are kept.
LONG_ENOUGH = 200
#: Ids of documents that go (8 bytes each) which are sent to all executors at most; more of them are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*like.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (`und`; null and empty texts too) and long texts whose language is ambiguous.

    Very long texts are read whole; repeated rows share their fate; an empty table stays empty. Columns of docs that
    are called like the operator's (`score`, ...) pass unchanged.
    """
    model = langid.fit(docs, ~held_out())
    plain = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    text = plain.columns[docs.columns.index("text")]
    out = langid.predict(plain, model, text=text, keep=tuple(plain.columns))
    junk = F.col("ambiguous") & (F.length(text) >= LONG_ENOUGH)
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & ~junk).select(*plain.columns).toDF(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are in too large a share of their source's documents; no document goes. n_chars follows.

    Documents of the same text count once: a group of copies makes no boilerplate, the next stage keeps one of it.
    Null and empty texts stay as they are, texts of nothing but boilerplate become empty, a null source is a source of
    its own, an empty table stays empty. Columns of docs that are called like the operator's pass unchanged.
    """
    out = line_dedup.clean(docs, "source", copies_once=True)
    changed = F.col("__dropped") > 0
    out = out.withColumn("text", F.when(changed, F.col("__kept")).otherwise(F.col("text")))
    return _columns(out.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: that of the least doc_id, and of its rows one if the id repeats.

    Documents without words, null texts among them, and documents without an id stay. Rows of one id and different
    sets are different documents; of those in one component the set that stands for it stays. An empty table stays
    empty; other columns pass, whatever their names. Only the ids that go are joined, so texts stay where they are
    while those are within the bound.
    """
    found = stored(jaccard_join.join(docs, detail=True).where(F.col("doc_id").isNotNull()), "components")
    stays = ((F.col("doc_id") == F.col("component_id")) & F.col("first")) | (F.col("n_shingles") == 0)
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__times")).where(F.col("__times") > 1).select("doc_id")
    leave = stored(found.where(~stays).select("doc_id").unionByName(repeated).distinct(), "leaving")
    several = repeated.limit(1).count() > 0
    out = docs.join(F.broadcast(leave) if leave.count() <= BROADCAST_IDS else leave, "doc_id", "left_anti")
    if several:  # one row of each id and set
        names = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
        key, text = (names.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
        again = jaccard_join.with_set_key(names.join(repeated.toDF(key), key, "left_semi").select(*names.columns), text)
        kept = found.where(stays).select(F.col("doc_id").alias(key), "set_key", "n_shingles").distinct()
        again = again.join(kept, [key, "set_key"])
        words = again.where(F.col("n_shingles") > 0).dropDuplicates([key, "set_key"])
        again = words.unionByName(again.where(F.col("n_shingles") == 0)).select(*names.columns).toDF(*docs.columns)
        out = _columns(out, docs).unionByName(again)
    return _columns(out, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak an item of the benchmark.

    Whole texts are searched, however long; null and empty ones leak nothing; repeated rows share their fate. An empty
    table, or an empty benchmark, changes nothing. Other columns pass, whatever their names.
    """
    return _columns(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes what is left, a row for each row.

    Null texts act as empty ones: no tokens, digests of no bytes. Other columns of docs are not looked at.
    """
    return bpe.roundtrip(docs, bpe.public_model())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Classifier, BM25 and byte-pair merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
