"""Weights and confidences, as Column expressions with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import casefold, sql_casefold

#: How much each signal counts, for facts that may change and for those that may not.
MUTABLE = {"authority": 0.45, "corroboration": 0.13, "directness": 0.12, "recency": 0.30}
IMMUTABLE = {"authority": 0.45, "corroboration": 0.25, "directness": 0.20, "recency": 0.10}
DECISIVE_MARGIN, MIN_DATED_VERSIONS = 0.15, 2
#: What marks hearsay.
HEARSAY = ("said", "told", "heard", "apparently", "i think", "believe", "reportedly", "rumour", "rumor")
#: The confidence of each way to resolve a mention.
CONFIDENCE = {"strong_key": 1.0, "token_set_exact": 0.95, "token_subset_unique": 0.85, "graph_evidence": 0.80, "graph_proposed": 0.70, "unresolved": 0.0}
CO_OCCURRENCE_WEIGHT, PARTICIPATION_WEIGHT = 3, 1
#: Slack for comparing sums of products with a limit.
EPSILON = 1e-9


def weighted(authority: Column, corroboration: Column, directness: Column, recency: Column, mutable: Column) -> Column:
    def total(w: dict[str, float]) -> Column:
        return authority * w["authority"] + corroboration * w["corroboration"] + directness * w["directness"] + recency * w["recency"]

    return F.when(mutable, total(MUTABLE)).otherwise(total(IMMUTABLE))


def directness(quote: Column, source_type: Column) -> Column:
    """A first-hand statement, an ordinary one, or hearsay."""
    q = casefold(F.coalesce(quote, F.lit("")))
    hearsay = F.rlike(q, F.lit("|".join(HEARSAY)))
    return F.when(hearsay, 0.3).when(source_type.isin("gmail", "fireflies"), 1.0).otherwise(0.7)


def sql_directness(quote: str, source_type: str) -> str:
    return f"case when regexp_matches({sql_casefold(f'coalesce({quote}, {chr(39) * 2})')}, '{'|'.join(HEARSAY)}') then 0.3::double when {source_type} in ('gmail', 'fireflies') then 1.0::double else 0.7::double end"


def source_authority(ranked: Column, source_type: Column) -> Column:
    """1 for the first system of record, 0.15 less for each place after it, 0.25 for others; 0.5 where none is named."""
    place = F.array_position(ranked, source_type)
    return F.when(F.size(ranked) == 0, 0.5).when(place > 0, F.lit(1.0) - F.lit(0.15) * (place - 1)).otherwise(0.25)


def graph_confidence(weight: Column, runner_up: Column) -> Column:
    """0.5 to 0.95 by how far the best candidate leads."""
    return F.lit(0.5) + F.lit(0.45) * ((weight - runner_up) / weight)


def answer_confidence(cited: Column, used: Column, disputed: Column) -> Column:
    value = F.least(F.lit(0.95), F.lit(0.4) + F.lit(0.1) * cited + F.lit(0.05) * F.least(used, F.lit(6)))
    return F.when(disputed, F.least(value, F.lit(0.6))).otherwise(value)


def ten_thousandths(c: Column) -> Column:
    """A score as a whole number of ten-thousandths: the same in every engine, unlike their rounding of doubles."""
    return F.floor(c * 10000 + 0.5 + EPSILON).cast("long")


def sql_ten_thousandths(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5 + {EPSILON})::bigint"
