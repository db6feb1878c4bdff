"""Evidence spans: whether extracted claims quote their document word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("subject", "predicate", "object", "evidence_span", "confidence")


def validate(claims: DataFrame) -> DataFrame:
    """claims (claim_id, the FIELDS as strings, text) with reason (null if accepted), span_start, span_end (first
    occurrence, code points). Reasons in order: missing_field, empty_span, confidence_not_numeric, confidence_out_of_range,
    span_not_verbatim."""
    confidence = F.col("confidence").cast("string").try_cast("double")
    at = F.instr(F.coalesce("text", F.lit("")), F.col("evidence_span"))
    missing = F.lit(False)
    for f in ("subject", "predicate", "object", "confidence"):
        missing = missing | F.col(f).isNull()
    reason = (
        F.when(missing | F.col("evidence_span").isNull(), "missing_field")
        .when(F.trim("evidence_span") == "", "empty_span")
        .when(confidence.isNull() | F.isnan(confidence), "confidence_not_numeric")
        .when((confidence < 0) | (confidence > 1), "confidence_out_of_range")
        .when(at == 0, "span_not_verbatim")
    )
    rows = claims.withColumn("reason", reason)
    start = F.when(F.col("reason").isNull(), at - 1).cast("long")
    return rows.withColumn("span_start", start).withColumn("span_end", start + F.length("evidence_span"))


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
