"""Named queries of the operators: thin contracts over their general interfaces, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.llm import ann, bpe, conversation, exact_dedup, html_extract, langid, merkle, mixing, quality, secret_scan, simhash, substring, toxicity
from driftwise.llm.common import table
from driftwise.llm.conversation_sql import REPAIR_SQL
from driftwise.llm.merkle_sql import MANIFEST_SQL


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by wrapper induction per host."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube-method mix of all documents: source targets by weights 1, 2, 3, stopped at three times the source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest embeddings by inner product for every vec_id divisible by 20, from NN-descent and greedy search."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies over all documents through the cuckoo-filter index; the largest doc_id of a group stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a review log: values in documents outside the held-out third whose kind is plain from their form.

    Label 1: key ids of a public cloud (AKIA...), values assigned to a password or token.  Label 0: telephone numbers,
    dates, digits only, identifiers in e-mail or web addresses, and lower-case words in quotes or after other names.
    """
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False)))
    secret = F.concat(F.regexp_extract_all(text, F.lit("\\b(AKIA[0-9A-Z]{16})\\b"), F.lit(1)),
                      F.regexp_extract_all(text, F.lit("(?i)\\b(?:password|passwd|secret|token|api_?key)\\s*[=:]\\s*[\"']?(" + secret_scan.SIGNED + ")"), F.lit(1)))
    other = F.concat(F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9_+/-])([0-9]{1,4}(?:-[0-9]{2,4})+)(?![A-Za-z0-9_+/-])"), F.lit(1)),
                     F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9_+/-])([0-9]{8,})(?![A-Za-z0-9_+/-])"), F.lit(1)),
                     F.regexp_extract_all(text, F.lit("(?:@|://|www\\.)[^\\s]*?([A-Za-z0-9_+/-]{8,})"), F.lit(1)),
                     F.regexp_extract_all(text, F.lit("(?i)(?<!password|passwd|secret|token|key)(?:[=:][ \\t]{0,2}[\"'`]?|[ \\t][\"'`])([a-z]{8,})(?![^\\s\"'`.,;])"), F.lit(1)))
    rows = docs.select("doc_id", secret.alias("s"), other.alias("o"))
    each = F.concat(F.transform("s", lambda v: F.struct(v.alias("value"), F.lit(1).alias("label"))),
                    F.transform("o", lambda v: F.struct(v.alias("value"), F.lit(0).alias("label"))))
    return rows.select("doc_id", F.explode_outer(each).alias("f")).filter("f is not null").select("doc_id", "f.value", "f.label")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates in all documents, scored by a random forest trained on labelled findings."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), _findings(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 3-word shingles over all documents and components of links at 2 or fewer bits."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents that share near-duplicate passages of 50 words or more, by compact windows."""
    return substring.passage_classes(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by bit-sliced n-gram filters, learnt outside the held-out third."""
    return langid.language_predictions(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by maximum-scoring segments, learnt from the labels outside the held-out third."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents by the streaming transducer, and the text decoded from them, as digests."""
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by language, with proofs and the verdict on tampered texts."""
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by zstandard dictionaries, learnt from the labels outside the held-out fifth."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, audit and repair of all conversations by the persistent audit DP."""
    return conversation.repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_html, op2_mixing, op3_nearest, op4_exact_dedup, op5_secrets, op6_simhash, op7_substring, op8_langid, op9_toxicity, op10_bpe,
                                   op11_merkle, op12_quality, op13_conversation)}

ORACLE_SQL = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op11_merkle": MANIFEST_SQL,
    "op13_conversation": REPAIR_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE_SQL)
