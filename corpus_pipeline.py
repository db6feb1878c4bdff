"""The corpus pipeline: documents in, encoded documents out, each stage written and read again.

Stages in order: quality (what the classifier rejects goes), near-duplicates (one document of each group stays),
decontamination (a document that holds any window of a benchmark item goes), PII (entities become surrogates), encoding.

Every stage but the last returns the columns of its input. Rows with a null doc_id are judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import bpe, decontaminate, near_dup, pii, quality
from attestor.llm.common import BROADCAST_IDS, maybe_broadcast, save, scratch, table

#: Words that a worker's encoder keeps here, where executors also hold what the stages before have left in memory.
CACHE_WORDS = 150_000


def _without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is not in dropped, a stored table of one column. While a count shows that the list may be
    broadcast, no text moves."""
    return docs.join(maybe_broadcast(dropped, dropped.count(), BROADCAST_IDS), key, "left_anti").select(*(c for c in docs.columns if c != "_own"))


def _own(docs: DataFrame) -> DataFrame:
    """docs with _own: doc_id, or for a null one a number below all of them from the text."""
    return docs.withColumn("_own", F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64("text") % (1 << 60)) - (1 << 60)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the document with the smallest id of each group; repeated rows of one id stay once."""
    found = save(near_dup.near_duplicates(docs).select("doc_id", "kept"), "kept")
    copies = save(found.where("not kept").select("doc_id").distinct(), "copies")
    kept = _without(docs, copies, "doc_id")
    repeated = save(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if (n := repeated.count()) == 0:  # the usual case: texts need not meet by id once more
        return kept
    repeated = maybe_broadcast(repeated, n, BROADCAST_IDS)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents in which no window of a benchmark item occurs."""
    own = _own(docs)
    found = decontaminate.search(own.select(F.col("_own").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = save(found.where(F.size("items") >= 1).select(F.col("doc_id").alias("_own")).distinct(), "leaks")
    return _without(own, leaks, "_own")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents with surrogates, under the session's key if it has one; n_chars, where there is one, is that
    of the new text."""
    rows = pii.replace(docs, None if spark.conf.get(pii.KEY_SETTING, None) else pii.QUERY_KEY).drop("_kinds")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the ids of what is left, hashed, and the hash of what they decode to."""
    return bpe.encode(docs, bpe.vocabulary_path(), digests=True, cache_words=CACHE_WORDS)


STAGES = [
    ("quality", good),
    ("near_dup", distinct),
    ("decontaminate", clean),
    ("pii", private),
    ("bpe", encoded),
]

#: No SQL expresses the classifier, so the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is written; what a stage wrote besides is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(save(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
