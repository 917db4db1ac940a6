"""The registered queries of this subpackage: thin forms of the operators over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, cohorts, decontaminate, fingerprints, jaccard_join, katz, langid, line_dedup, merkle, oracles, quality_cnn, secret_scan, sharding, token_counts
from millrace.llm.common import held_out, stored, table

SHARDS = 40
#: State 0 of op13 knows what arrives before 2024-03-01 00:00.
CUT_US = 19_783 * cohorts.DAY_US
QUALITY_THRESHOLD = 0.7


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole text and its decoding: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text acts as the empty one (no tokens, digests of no bytes); very long texts are whole; repeated rows get a
    row each; an empty table gives none; other columns are not looked at.
    """
    return bpe.roundtrip(table(spark, sf_dir, "documents"), bpe.public_model())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that it leaks: doc_id, item_id, score, apart, question_overlap, answer_overlap.

    Rows come by retrieval above the threshold, with every passage of a text and the text as a whole, and are verified
    by the overlaps; `apart` marks what only the whole text brings up.

    Null and empty texts and items without words leak nothing; very long texts are searched whole; several items of a
    document are rows of their own, repeated rows repeat theirs; an empty table or benchmark gives no
    rows; other columns of documents are not looked at, whatever their names.
    """
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's lines, how many went as its host's boilerplate, and the digest of the rest; a source is a host.

    A null text has 0 lines and a null digest, an empty one a single blank line that stays; a null source is a host of
    its own; a line repeated in a page counts once, one on exactly the ratio of the pages stays; very long texts are read
    to their end; repeated rows are pages; an empty table gives no rows; other columns are not looked at.
    """
    return line_dedup.report(table(spark, sf_dir, "documents"), "doc_id", "source")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score, ambiguous, margin.

    `und` with score 0 for null texts and texts without letters; ties go to the language first in order; very long
    texts are read to their end; repeated rows get equal rows; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    out = langid.predict(docs, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous", "margin")


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text: doc_id, held_out, score, predicted.

    Null and empty texts score the share of label 1 among the training rows; very long texts are read to their end; of
    several labels of a document the largest counts; repeated rows get equal rows; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    predicted = F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0)
    return quality_cnn.predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths with its suffix sums.

    Null and empty texts have length 0; very long ones a row of their own length; repeated rows count each; documents
    of one length are one row; an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    lengths = bpe.lengths(table(spark, sf_dir, "documents"), bpe.public_model())
    return token_counts.suffix_table(stored(token_counts.histogram(lengths), "lengths"))  # a few rows, used twice


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document under the law `key`.

    A null text has size 16 and the checksum of no bytes; a null id has a shard as any other; repeated rows get slots
    of their own, in order of bucket, id, checksum and size; very long texts count by their bytes; an empty table gives no
    rows; other columns are not looked at, whatever their names.
    """
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and component: doc_id, n_shingles, component_id.

    Documents without words are components of their own; equal texts and repeated rows share one; very long texts are
    compared whole; a null id links with nothing but equal sets; an empty table gives no rows.
    """
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    Null texts act as empty ones; equal ids follow each other in order of text, null ids come last; a table of one row
    is followed by itself; an empty one gives no rows.
    """
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every whole text: counts and digest of the base spans, and all spans.

    Null and empty texts have none: counts 0, the digest of the empty text; repeated rows get a row each, and their
    copies count for ownership once for each owner; spans of one start go by kind; very long texts are searched to their
    end; an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle proof of every document and whether its row, as it is found later, still gives the root.

    Null ids come first in their source and are never tampered with; rows of one id go by their leaves, equal rows have
    places of their own; a null source is a tree of its own, null fields aren't empty ones; very long texts are hashed
    whole; an empty table gives no rows; other columns are not looked at.
    """
    return merkle.prove(table(spark, sf_dir, "documents"), merkle.lower_cased())


def op12_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every whole text by a pair model with backoff: see `katz.score`.

    Null and empty texts are their end alone; a null id counts as the empty text for its remainder; very long texts are
    whole; repeated rows teach and are scored each; an empty table gives no rows; other columns are not looked at.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return katz.score(table(spark, sf_dir, "documents"), remainder != 1)[0]


def op13_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retention cells of the clicks in two states of knowledge: see `cohorts.matrix`.

    Equal rows count once, rows without ts or client_id not at all; a null value is 0 cents, a null arrived_at is known
    to state 1 only, a null click_id isn't late; long or null props matter for equality alone; empty tables give no rows.
    """
    clicks, clients = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients")
    return cohorts.matrix(clicks, clients, cohorts.late_arrival(), [CUT_US])


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_token_counts": op6_token_counts,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_piecewise_fingerprints": op9_piecewise_fingerprints,
    "op10_secret_ownership": op10_secret_ownership,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_katz_backoff": op12_katz_backoff,
    "op13_cohort_retention": op13_cohort_retention,
}

ORACLES = oracles.all_of_them(SHARDS, sharding.ROWS_PER_BUCKET)
