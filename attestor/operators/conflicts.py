"""Contradictory claims: facts, versions, trust, decisions, edges.

A fact is who or what a claim is about (the resolved identity, else the name) with a canonical single-valued relation.
Versions of a fact are its distinct normalised objects; two or more contradict each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.ids import edge_id
from attestor.functions.scoring import DECISIVE_MARGIN, EPSILON, IMMUTABLE, MIN_DATED_VERSIONS, MUTABLE, directness, source_authority, weighted
from attestor.functions.text import casefold, normalise_object
from attestor.operators.ontology import align, relations
from attestor.sources.shared import counted, parted, stored

#: claims: claim_id, dsid, source_type, subject, predicate, object, confidence, quote, timestamp (null if not dated).


def facts(claims: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """Claims that can be contested, with relation, who, value and the relation's properties.
    identity: dsid, surface (case-folded), entity; the greatest entity wins where a surface has several."""
    spark = claims.sparkSession
    # predicates that hold a catalogue word; spellings grow with the claims, so a count decides how to join them: few spellings have
    # many claims each, which a join by predicate would gather in as few tasks
    known = align(claims.select("predicate")).join(F.broadcast(relations(spark)), "relation").where("single").select("predicate", "relation", "mutable", "authority")
    rows = claims.join(counted(stored(known)), "predicate").withColumn("surface", casefold(F.trim("subject")))
    rows = rows.where((F.col("surface") != "") & F.col("subject").isNotNull())
    who = F.concat(F.lit("name:"), F.col("surface"))
    if identity is not None:
        one = identity.groupBy("dsid", "surface").agg(F.max("entity").alias("entity"))
        rows = rows.join(one, ["dsid", "surface"], "left")
        who = F.when(F.col("entity").isNotNull(), F.concat(F.lit("entity:"), F.col("entity").cast("string"))).otherwise(who)
    return rows.withColumn("who", who).withColumn("value", normalise_object(F.col("object")))


def recency(claims: DataFrame) -> DataFrame:
    """dsid, position (0 for the oldest dated document, 1 for the newest), by timestamp, then dsid. The position is a rank
    over all dated documents: within each day by a window, before each day by a running total of the days' sizes."""
    dated = claims.where("timestamp is not null").groupBy("dsid").agg(F.min("timestamp").alias("timestamp"))
    dated = dated.withColumn("_day", F.floor(F.col("timestamp") / 86400))
    local = dated.withColumn("_r", F.row_number().over(Window.partitionBy("_day").orderBy("timestamp", "dsid")) - 1)
    # one row a day, so this window is short
    days = dated.groupBy("_day").agg(F.count("*").alias("size"))
    whole = Window.orderBy("_day")
    days = days.select("_day", (F.sum("size").over(whole) - F.col("size")).alias("_before"), F.sum("size").over(Window.partitionBy()).alias("_n"))
    position = F.when(F.col("_n") > 1, (F.col("_before") + F.col("_r")) / (F.col("_n") - 1)).otherwise(0.5)
    return local.join(days, "_day").select("dsid", position.cast("double").alias("position"))


def support(rows: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """rows: facts() with values, stored. One row for each version of each contested fact: who, relation, value, documents, n_versions,
    corroboration. Documents and quotes are told apart each by its own key, so that a task holds a part of them by their number,
    however few facts and values there are."""
    n = rows.count()
    if canonical is not None:
        rows = rows.join(canonical.select(F.col("id").alias("dsid"), "representative"), "dsid", "left")
    else:
        rows = rows.withColumn("representative", F.lit(None).cast(rows.schema["dsid"].dataType))
    rows = rows.withColumn("independent", F.coalesce("representative", "dsid")).withColumn("told", casefold(F.trim("quote")))
    fact, by = ["who", "relation"], ["who", "relation", "value"]

    def different(*c: str) -> DataFrame:
        return parted(rows.select(*c), n, *c).distinct()

    told = different(*by, "independent").unionByName(different(*by, "told").where("told <> ''"), allowMissingColumns=True)
    grouped = told.groupBy(*by).agg(F.count("independent").alias("documents"), F.count("told").alias("quotes"))
    # documents of the whole fact, over claims and not over versions, as one document may assert several
    totals = different(*fact, "dsid").groupBy(*fact).agg(F.count("dsid").alias("total"))
    out = grouped.join(totals, fact).withColumn("n_versions", F.count("*").over(Window.partitionBy(*fact))).where("n_versions >= 2")
    independent = F.when((F.col("quotes") > 0) & (F.col("quotes") < F.col("documents")), F.col("quotes")).otherwise(F.col("documents"))
    return out.select(*by, "documents", "n_versions", F.least(F.lit(1.0), independent / F.greatest("total", F.lit(2))).alias("corroboration"))


def versions(rows: DataFrame, ordering: DataFrame | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """rows: facts(), stored. One row for each version of each contested fact, with its trust and its place by trust.
    ordering: recency(); canonical: id, representative of near-duplicate documents."""
    rows = rows.where("value <> ''")
    by, supported = ["who", "relation", "value"], support(rows, canonical)
    if ordering is not None:
        n = rows.count()
        rows = parted(rows, n, "dsid").join(parted(ordering, n, "dsid"), "dsid", "left")
    else:
        rows = rows.withColumn("position", F.lit(None).cast("double"))
    first = F.min(F.struct("claim_id", "object", "subject"))
    grouped = rows.groupBy(*by).agg(
        F.first("mutable").alias("mutable"),
        first.alias("first"),
        F.max(source_authority(F.col("authority"), F.col("source_type"))).alias("authority"),
        F.max(directness(F.col("quote"), F.col("source_type"))).alias("directness"),
        F.max("position").alias("position"),
        F.max(F.array_contains("authority", F.col("source_type"))).alias("of_record"),
        F.count("*").alias("claims"),
        F.min(F.when(F.array_contains("authority", F.col("source_type")), F.struct("claim_id", "source_type"))).alias("record"),
    )
    out = grouped.join(supported, by).withColumn("dated", F.count("position").over(Window.partitionBy("who", "relation")))
    out = out.withColumn("recency", F.when(F.col("mutable") & (F.col("dated") >= MIN_DATED_VERSIONS) & F.col("position").isNotNull(), F.col("position")).otherwise(0.5))
    out = out.withColumn("score", weighted(F.col("authority"), F.col("corroboration"), F.col("directness"), F.col("recency"), F.col("mutable")))
    place = Window.partitionBy("who", "relation").orderBy(F.desc("score"), F.col("first.claim_id"))
    out = out.withColumn("place", F.row_number().over(place))
    names = ["authority", "corroboration", "directness", "recency", "score", "documents", "claims", "of_record", "n_versions", "place"]
    return out.select(*by, "mutable", F.col("first.object").alias("display"), F.col("first.subject").alias("subject"), F.col("first.claim_id").alias("claim_id"), F.col("record.source_type").alias("record_source"), *names)


def decisions(found: DataFrame) -> DataFrame:
    """found: versions(). One row a fact: the best version or none, the margin, and what decided."""
    parts = ["authority", "corroboration", "directness", "recency"]
    v = F.struct("place", "value", "display", "claim_id", "score", "of_record", "record_source", *parts)
    facts_ = found.groupBy("who", "relation").agg(
        F.first("mutable").alias("mutable"),
        F.count("*").alias("n_versions"),
        F.min(F.struct("claim_id", "subject")).alias("told"),
        F.array_sort(F.collect_list(v)).alias("v"),
    )
    records = F.filter("v", lambda x: x.of_record)
    single = F.size(records) == 1
    best = F.when(single, records[0]).otherwise(F.col("v")[0])
    rows = facts_.withColumn("single", single).withColumn("best", best)
    rows = rows.withColumn("rival", F.filter("v", lambda x: x.place != F.col("best.place"))[0])
    rows = rows.withColumn("margin", F.col("best.score") - F.col("rival.score"))
    decisive = F.col("margin") >= DECISIVE_MARGIN - EPSILON

    def delta(c: str):
        w = F.when(F.col("mutable"), MUTABLE[c]).otherwise(IMMUTABLE[c])
        return (F.col(f"best.{c}") - F.col(f"rival.{c}")) * w

    label = {"authority": "source authority"}
    # of equal deltas the first in this order leads
    lead = F.array_max(F.array(*(F.struct(delta(c).alias("d"), F.lit(-i).alias("i"), F.lit(label.get(c, c)).alias("name")) for i, c in enumerate(parts))))
    component = F.when(lead["d"] > 0, lead["name"]).otherwise("a combination of components")
    basis = F.when(F.col("single"), "authority").when(~decisive, "").when(F.col("mutable") & (F.col("best.recency") > F.col("rival.recency")), "recency").otherwise(component)
    decided = F.col("single") | decisive
    return rows.select(
        "who", "relation", F.trim("told.subject").alias("subject"), "n_versions", decided.alias("decided"), basis.alias("basis"), "margin",
        F.when(decided, F.col("best.value")).alias("best_value"), F.when(decided, F.col("best.display")).alias("best_display"),
    )


def detect(claims: DataFrame, identity: DataFrame | None = None, canonical: DataFrame | None = None, ordering: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The versions and the decision of every contested fact. ordering: recency() of more claims than these."""
    rows = stored(facts(claims, identity).where("value <> ''"))  # read several times
    found = versions(rows, recency(claims) if ordering is None else ordering, canonical)
    return found, decisions(found)


def contract(claims: DataFrame, identity: DataFrame | None = None, canonical: DataFrame | None = None, ordering: DataFrame | None = None) -> DataFrame:
    """One nested row a conflict, as reports hand it on: who, relation, subject, mutable, decided, basis, supersession, margin
    and versions (value, documents, sources, claims, trust, best_supported), those with most versions first."""
    rows = stored(facts(claims, identity).where("value <> ''"))  # read twice
    found = stored(versions(rows, recency(claims) if ordering is None else ordering, canonical))
    decided = decisions(found)
    told = rows.groupBy("who", "relation", "value").agg(F.array_sort(F.collect_set("dsid")).alias("documents"), F.array_sort(F.collect_set("source_type")).alias("sources"))
    trust = F.struct("authority", "corroboration", "directness", "recency", F.col("score").alias("total"))
    judged = found.drop("documents").join(told, ["who", "relation", "value"]).join(decided.select("who", "relation", "best_value"), ["who", "relation"])
    best = F.coalesce(F.col("value") == F.col("best_value"), F.lit(False)).alias("best_supported")
    version = F.struct("place", F.col("display").alias("value"), "documents", "sources", "claims", trust.alias("trust"), best)
    nested = judged.groupBy("who", "relation").agg(F.first("mutable").alias("mutable"), F.array_sort(F.collect_list(version)).alias("versions"))
    out = decided.join(nested, ["who", "relation"])
    return out.select("who", "relation", "subject", "mutable", "decided", "basis", (F.col("basis") == "recency").alias("supersession"), "margin", "versions").orderBy(F.desc(F.size("versions")), "who", "relation")


def version_pairs(found: DataFrame) -> DataFrame:
    """found: versions(). who, relation, a, b, edges: contradicting versions and the number of claim pairs between them;
    with the claims' own versions this says what edges() says without writing the pairs out."""
    left = found.select("who", "relation", F.col("value").alias("a"), F.col("place").alias("pa"), F.col("claims").alias("na"))
    right = found.select("who", "relation", F.col("value").alias("b"), F.col("place").alias("pb"), F.col("claims").alias("nb"))
    return left.join(right, ["who", "relation"]).where("pa < pb").select("who", "relation", "a", "b", (F.col("na") * F.col("nb")).alias("edges"))


def edges(claims: DataFrame, identity: DataFrame | None = None, canonical: DataFrame | None = None, ordering: DataFrame | None = None) -> DataFrame:
    """One edge for each two claims of one fact with different values, from the lower id to the higher.
    What is asked for is the pairs themselves, so their number is the output's size."""
    rows = stored(facts(claims, identity).where("value <> ''"))  # read three times
    decided = decisions(versions(rows, recency(claims) if ordering is None else ordering, canonical))
    left = rows.select("who", "relation", F.col("claim_id").alias("src"), F.col("value").alias("a"), F.col("subject").alias("subject"))
    right = rows.select("who", "relation", F.col("claim_id").alias("dst"), F.col("value").alias("b"))
    pairs = left.join(right, ["who", "relation"]).where("src < dst and a <> b").select("who", "relation", "src", "dst")
    told = decided.select("who", "relation", F.substring("subject", 1, 200).alias("subject"), "decided", "margin")
    out = pairs.join(told, ["who", "relation"])
    return out.select(edge_id("CONFLICTS_WITH", F.col("src"), F.col("dst"), F.col("relation")).alias("eid"), "src", "dst", F.col("relation").alias("predicate"), "subject", "decided", "margin")


def touched(claims: DataFrame, documents: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """All claims of every fact that the given documents (dsid) say anything about."""
    rows = facts(claims, identity)
    keys = rows.join(documents.select("dsid").distinct(), "dsid", "left_semi").select("who", "relation").distinct()
    return rows.join(keys, ["who", "relation"], "left_semi").select(*claims.columns)


def reconcile(claims: DataFrame, documents: DataFrame, persisted: DataFrame, identity: DataFrame | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """The edges after new documents: those of touched facts anew, the others as they were. Recency ranks are over all
    claims, as a new document can move them; so a fact is touched too if its claims' decision could move with them."""
    rows = stored(facts(claims, identity).select("claim_id", "dsid", "who", "relation", "timestamp", "mutable"))  # read three times
    keys = rows.join(documents.select("dsid").distinct(), "dsid", "left_semi").select("who", "relation").distinct()
    moved = rows.where("timestamp is not null and mutable").select("who", "relation").distinct()
    again = rows.join(keys.unionByName(moved).distinct(), ["who", "relation"], "left_semi").select("claim_id").distinct()
    again = stored(again)
    # whole facts are judged anew, with ranks over all claims; the others keep their edges
    fresh = edges(claims.join(again, "claim_id", "left_semi"), identity, canonical, recency(claims))
    return persisted.join(again.withColumnRenamed("claim_id", "src"), "src", "left_anti").select(*persisted.columns).unionByName(fresh.select(*persisted.columns))


def stale(persisted: DataFrame, current: DataFrame) -> DataFrame:
    """Edges (eid) that no longer hold."""
    return persisted.join(current.select("eid"), "eid", "left_anti")


def unmapped(claims: DataFrame, limit: int = 8) -> DataFrame:
    """The most frequent predicates that the catalogue does not know."""
    loose = align(claims.select("predicate")).where("relation is null").select("predicate")
    said = claims.join(loose, "predicate", "left_semi").select(casefold(F.trim("predicate")).alias("predicate"))
    return said.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(limit)
