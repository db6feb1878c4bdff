"""Recorded decisions: every mention ends with a status, a method and a reason; rebuilding and checking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.ids import edge_id
from attestor.functions.text import email_domain, organisation_root, same_organisation
from attestor.operators.resolve import CANDIDATES_KEPT


def record(tiers: DataFrame, graph: DataFrame, proposed: DataFrame) -> DataFrame:
    """One row a mention: status, method, confidence, entity, candidates, reason. tiers (mention_id, entity, method,
    confidence, candidates), graph and proposed (mention_id, entity, method, confidence): a strong or unique match counts
    first, then what the graph prefers among several, then what structure proposes where no name offered anybody."""
    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.select("mention_id", *(F.col(c).alias(f"{tag}_{c}") for c in ("entity", "method", "confidence")))

    rows = tiers.join(renamed(graph, "g"), "mention_id", "left").join(renamed(proposed, "p"), "mention_id", "left")
    direct = F.col("method") != "unresolved"
    by_graph = ~direct & (F.col("candidates") > 1) & F.col("g_entity").isNotNull()
    by_structure = ~direct & (F.col("candidates") == 0) & F.col("p_entity").isNotNull()

    def pick(c: str, other):
        return F.when(direct, F.col(c)).when(by_graph, F.col(f"g_{c}")).when(by_structure, F.col(f"p_{c}")).otherwise(other)

    reason = (
        F.when(direct, F.col("method")).when(by_graph, "shared context decides").when(by_structure, "sole neighbour that the short form fits")
        .when(F.col("candidates") > 1, "context does not separate the candidates").otherwise("no candidate shares this surface's tokens")
    )
    return rows.select(
        "mention_id",
        F.when(direct | by_graph | by_structure, "resolved").otherwise("unresolved").alias("status"),
        pick("method", F.lit("unresolved")).alias("method"),
        pick("confidence", F.lit(0.0)).alias("confidence"),
        pick("entity", F.lit(None)).alias("entity"),
        "candidates",
        reason.alias("reason"),
    )


def candidate_edges(scored: DataFrame, names: DataFrame, keep: int = CANDIDATES_KEPT) -> DataFrame:
    """The best candidates that the graph weighed for each mention, as edges."""
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), "name", "entity")
    rows = scored.join(names, "entity").withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
    eid = edge_id("CANDIDATE_FOR", F.col("mention_id"), F.col("entity"))
    return rows.select(eid.alias("eid"), "mention_id", "entity", "score", F.col("co").alias("co_occurrences"), F.col("part").alias("participations"), "place")


def resolves_to(recorded: DataFrame) -> DataFrame:
    rows = recorded.where("status = 'resolved'")
    return rows.select(edge_id("RESOLVES_TO", F.col("mention_id"), F.col("entity")).alias("eid"), F.col("mention_id").alias("src"), F.col("entity").alias("dst"), "method", "confidence", "candidates")


def rebuilt(persisted: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a rebuild changes in the edges (eid, src, dst, ...): those to add, those to drop, those that stay."""
    want = resolves_to(recorded)
    add = want.join(persisted.select("eid"), "eid", "left_anti")
    drop = persisted.join(want.select("eid"), "eid", "left_anti")
    return add, drop, persisted.join(want.select("eid"), "eid", "left_semi")


def violations(recorded: DataFrame, edges: DataFrame, entities: DataFrame, detected: DataFrame, persisted: DataFrame) -> DataFrame:
    """check, n: how often each rule of the store is broken; 0 everywhere in a sound one. recorded: record();
    edges: resolves_to(); entities (entity, name, emails); detected and persisted conflict edges (eid)."""
    def count(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))

    unexplained = recorded.where("status = 'resolved' and (method is null or confidence is null or confidence <= 0)")
    pending = recorded.where("status not in ('resolved', 'unresolved')")
    target = recorded.join(edges.select(F.col("src").alias("mention_id"), "dst"), "mention_id", "left")
    astray = target.where("not (entity <=> dst)")
    roots = F.array_distinct(F.filter(F.transform("emails", lambda e: organisation_root(email_domain(e))), lambda r: r != ""))
    own = entities.where(F.size(F.split("name", " ")) > 1).select("entity", "name", F.explode(roots).alias("root")).distinct()
    other = own.select(F.col("entity").alias("e2"), "name", F.col("root").alias("r2"))
    twice = own.join(other, "name").where((F.col("entity") < F.col("e2")) & same_organisation(F.col("root"), F.col("r2")))
    missing, surplus = detected.join(persisted, "eid", "left_anti"), persisted.join(detected, "eid", "left_anti")
    parts = [("resolution_explained", unexplained), ("nothing_pending", pending), ("entity_is_edge_target", astray), ("one_identity_per_organisation", twice), ("no_edge_missing", missing), ("no_edge_surplus", surplus)]
    out = count(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(count(*p))
    return out
