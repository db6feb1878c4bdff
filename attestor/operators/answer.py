"""Answers over claims: retrieve, verify evidence, expand, synthesise, judge. The synthesiser is a function of the
caller's; `first_evidence` is a deterministic one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.scoring import answer_confidence
from attestor.functions.text import states
from attestor.operators import graph
from attestor.operators.lexical import bm25

DOCUMENTS, EVIDENCE, RELATED_CONFIDENCE = 8, 40, 0.6

Synthesiser = Callable[[DataFrame], DataFrame]


def retrieve(index: DataFrame, stats: DataFrame, questions: DataFrame, known: DataFrame, k: int = DOCUMENTS) -> DataFrame:
    """The first k documents that exist, of three times as many hits."""
    hits = bm25(index, stats, questions, 3 * k).join(known.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy("qid").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evidence(found: DataFrame, claims: DataFrame, bodies: DataFrame) -> DataFrame:
    """found (qid, id, rank), claims (claim_id, dsid, ..., quote), bodies (dsid, body): each question's claims whose quote
    still stands in the document, numbered e0, e1, ... by rank and claim, at most EVIDENCE of them."""
    rows = found.withColumnRenamed("id", "dsid").join(claims, "dsid").join(bodies, "dsid")
    rows = rows.where((F.col("quote") != "") & F.contains("body", F.col("quote"))).drop("body")
    w = Window.partitionBy("qid").orderBy("rank", "claim_id")
    rows = rows.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < EVIDENCE)
    return rows.withColumn("evidence_id", F.concat(F.lit("e"), F.col("place").cast("string")))


def related(found: DataFrame, references: DataFrame, claims: DataFrame) -> DataFrame:
    """qid, dsid, claim_id of documents that share a ticket with a retrieved one, which come after all other evidence."""
    near = graph.related_by_ticket(found.select(F.col("id").alias("dsid")), references)
    rows = found.join(near, found["id"] == near["anchor"]).select("qid", "dsid").distinct()
    rows = rows.join(found.select("qid", F.col("id").alias("dsid")), ["qid", "dsid"], "left_anti")
    return rows.join(claims.select("dsid", "claim_id"), "dsid").withColumn("confidence", F.lit(RELATED_CONFIDENCE))


def first_evidence(rows: DataFrame, limit: int = 3) -> DataFrame:
    """qid, answer, used (evidence ids): the first few pieces of evidence, put in a row."""
    said = F.concat_ws(" ", "subject", "predicate", "object")
    some = rows.where(F.col("place") < limit).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "evidence_id", said.alias("said")))).alias("e"))
    return some.select("qid", F.array_join("e.said", "; ").alias("answer"), F.col("e.evidence_id").alias("used"))


def trace(found: DataFrame, rows: DataFrame, answers: DataFrame, judged: DataFrame) -> DataFrame:
    """qid, operation, results: what each step of an answer came to, for every question that was judged."""
    def step(name: str, df: DataFrame) -> DataFrame:
        n = df.groupBy("qid").agg(F.count("*").alias("results"))
        return judged.select("qid").join(n, "qid", "left").select("qid", F.lit(name).alias("operation"), F.coalesce("results", F.lit(0)).alias("results"))

    cited = answers.select("qid", F.explode("used").alias("evidence_id")).distinct()
    known = cited.join(rows.select("qid", "evidence_id").distinct(), ["qid", "evidence_id"], "left_semi")
    parts = [("retrieve", found), ("evidence", rows), ("cite", known), ("reject", cited.join(known, ["qid", "evidence_id"], "left_anti")), ("dispute", judged.where("answerability = 'conflicting'"))]
    out = step(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(step(*p))
    return out


def judge(questions: DataFrame, rows: DataFrame, answers: DataFrame, conflicts: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a question: the answer, the documents cited, supported, conflicting or insufficient, the confidence. Cited
    ids that are no evidence do not count; an answer without any that is gets the verdict insufficient and carries
    nothing. A dispute counts if it is over a claim that was used and the answer says the claim's value."""
    cited = answers.select("qid", "answer", F.explode("used").alias("evidence_id")).distinct()
    used = cited.join(rows, ["qid", "evidence_id"])
    rivals = graph.contested(used, conflicts, claims)
    disputes = used.join(rivals, "claim_id").where((F.col("object") != F.col("other_object")) & states(F.col("answer"), F.col("object")))
    disputed = disputes.groupBy("qid").agg(F.array_sort(F.slice(F.array_sort(F.collect_set("other_object")), 1, graph.DISPUTES)).alias("alternatives"), F.collect_set("other_dsid").alias("rivals"))
    told = used.groupBy("qid", "answer").agg(F.collect_set("dsid").alias("documents"), F.countDistinct("evidence_id").alias("n_used"), F.countDistinct("dsid").alias("cited"))
    out = questions.select("qid").distinct().join(told, "qid", "left").join(disputed, "qid", "left")
    has, fought = F.col("n_used").isNotNull(), F.col("alternatives").isNotNull()
    empty = F.array().cast("array<string>")
    documents = F.array_sort(F.array_union("documents", F.coalesce("rivals", F.array().cast(used.select(F.array("dsid")).schema[0].dataType))))
    return out.select(
        "qid",
        F.when(has, F.col("answer")).otherwise("").alias("answer"),
        F.when(has, documents).alias("document_ids"),
        F.when(has & fought, "conflicting").when(has, "supported").otherwise("insufficient").alias("answerability"),
        F.when(has, answer_confidence(F.col("cited"), F.col("n_used"), fought)).otherwise(0.0).alias("confidence"),
        F.coalesce("alternatives", empty).alias("alternatives"),
    )


def with_related(found: DataFrame, references: DataFrame) -> DataFrame:
    """found (qid, id, rank) and, after them, documents that share a ticket with one, by the retrieved document's rank and their id."""
    near = graph.related_by_ticket(found.select(F.col("id").alias("dsid")), references)
    more = found.join(near, found["id"] == near["anchor"]).groupBy("qid", F.col("dsid").alias("id")).agg(F.min("rank").alias("_r"))
    more = more.join(found.select("qid", "id"), ["qid", "id"], "left_anti")
    last = found.groupBy("qid").agg(F.max("rank").alias("_last"))
    w = Window.partitionBy("qid").orderBy("_r", "id")
    more = more.join(last, "qid").select("qid", "id", (F.col("_last") + F.row_number().over(w)).alias("rank"))
    return found.select("qid", "id", "rank").unionByName(more)


def answer(questions: DataFrame, index: DataFrame, stats: DataFrame, bodies: DataFrame, claims: DataFrame, conflicts: DataFrame, synthesise: Synthesiser = first_evidence, references: DataFrame | None = None) -> DataFrame:
    """questions (qid, terms) to judged answers; with references (dsid, ticket), documents that share a ticket with a retrieved
    one bring their claims after all others."""
    found = retrieve(index, stats, questions, bodies.select(F.col("dsid").alias("id")))
    rows = evidence(found if references is None else with_related(found, references), claims, bodies)
    return judge(questions, rows, synthesise(rows), conflicts, claims)
