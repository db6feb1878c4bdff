"""Fixed patterns over graph tables, as joins: evidence, shared tickets, disputes, structure, paths.

Tables: asserts(dsid, claim_id), supported_by(claim_id, span_id), mentioned_in(mention_id, dsid),
resolves_to(mention_id, entity), participated_in(entity, channel), references(dsid, ticket), conflicts(src, dst, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.scoring import CO_OCCURRENCE_WEIGHT, CONFIDENCE, PARTICIPATION_WEIGHT, graph_confidence
from attestor.functions.text import SHORT_FORM_MIN, casefold, name_tokens, short_form_parts, short_form_pattern
from attestor.sources.shared import BROADCAST_ROWS, counted, parted, stored

RELATED, DISPUTES = 6, 6


def evidence(documents: DataFrame, asserts: DataFrame, claims: DataFrame, supported_by: DataFrame, spans: DataFrame) -> DataFrame:
    """Claims of the documents (dsid) with the spans that support them."""
    return documents.select("dsid").join(asserts, "dsid").join(claims, "claim_id").join(supported_by, "claim_id").join(spans, "span_id")


def co_occurrence(resolves_to: DataFrame, mentioned_in: DataFrame) -> DataFrame:
    """entity, dsid, n: mentions of an entity in a document."""
    return resolves_to.join(mentioned_in, "mention_id").groupBy("entity", "dsid").agg(F.count("*").alias("n"))


def participation(participated_in: DataFrame) -> DataFrame:
    return participated_in.groupBy("entity", "channel").agg(F.count("*").alias("n"))


def related_by_ticket(anchors: DataFrame, references: DataFrame, limit: int = RELATED) -> DataFrame:
    """anchor, ticket, dsid: other documents that name a ticket of the anchor, the first few by ticket and id. A document
    among an anchor's first few is among the first few of that ticket, itself left out: whoever stands before it there stands before
    it here. So a ticket hands on its first limit + 1, and an anchor's tickets end with the first that can fill all places."""
    references = stored(references.select("dsid", "ticket").where("dsid is not null and ticket is not null").distinct())
    firsts = references.withColumn("_n", F.row_number().over(Window.partitionBy("ticket").orderBy("dsid"))).where(F.col("_n") <= limit + 1)
    firsts = stored(firsts.groupBy("ticket").agg(F.collect_list("dsid").alias("first")))  # limit + 1 at most
    full = firsts.select("ticket", (F.size("first") > limit).alias("_full"))
    mine = references.join(anchors.select("dsid").distinct(), "dsid", "left_semi").join(full, "ticket")
    last = F.min(F.when(F.col("_full"), F.col("ticket"))).over(Window.partitionBy("dsid"))
    mine = mine.withColumn("_last", last).where("_last is null or ticket <= _last").select(F.col("dsid").alias("anchor"), "ticket")
    pairs = mine.join(firsts, "ticket").select("anchor", "ticket", F.explode("first").alias("dsid")).where("dsid <> anchor")
    first = pairs.groupBy("anchor", "dsid").agg(F.min("ticket").alias("ticket"))
    w = Window.partitionBy("anchor").orderBy("ticket", "dsid")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def shared_tickets(references: DataFrame) -> DataFrame:
    """Tickets that two or more documents name."""
    return references.groupBy("ticket").agg(F.countDistinct("dsid").alias("documents")).where("documents >= 2")


def contested(used: DataFrame, conflicts: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, other, predicate, decided: rivals of the used claims (claim_id) in either direction, with what they say."""
    conflicts = stored(conflicts.select("src", "dst", "predicate", "decided"))  # edges are made once and read in both directions
    both = conflicts.select(F.col("src").alias("claim_id"), F.col("dst").alias("other"), "predicate", "decided").unionByName(
        conflicts.select(F.col("dst").alias("claim_id"), F.col("src").alias("other"), "predicate", "decided")
    )
    rivals = both.join(used.select("claim_id").distinct(), "claim_id", "left_semi")
    said = claims.select(F.col("claim_id").alias("other"), F.col("object").alias("other_object"), F.col("dsid").alias("other_dsid"))
    return rivals.join(said, "other").distinct()


def candidate_scores(candidates: DataFrame, co: DataFrame, part: DataFrame) -> DataFrame:
    """candidates (mention_id, dsid, channel, entity) to their score: three for each mention of the entity in the
    document, one for each participation in the channel."""
    rows = candidates.join(co.select("entity", "dsid", F.col("n").alias("co")), ["entity", "dsid"], "left")
    rows = rows.join(part.select("entity", "channel", F.col("n").alias("part")), ["entity", "channel"], "left")
    rows = rows.fillna(0, ["co", "part"])
    return rows.withColumn("score", CO_OCCURRENCE_WEIGHT * F.col("co") + PARTICIPATION_WEIGHT * F.col("part"))


def graph_tier(scored: DataFrame, names: DataFrame) -> DataFrame:
    """One row a mention: the entity that the graph prefers, or none if nothing speaks for one or two are level.
    names: entity, name, for the order of equals."""
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), "name", "entity")
    rows = scored.join(names, "entity").withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("place = 1")
    runner_up = F.coalesce("next", F.lit(0))
    wins = (F.col("score") > 0) & (F.col("score") > runner_up)
    return rows.select(
        "mention_id",
        F.when(wins, F.col("entity")).alias("entity"),
        F.when(wins, "graph_evidence").otherwise("unresolved").alias("method"),
        F.when(wins, graph_confidence(F.col("score"), runner_up)).otherwise(0.0).alias("confidence"),
    )


def propose(mentions: DataFrame, co: DataFrame, participated_in: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions (mention_id, dsid, channel, token) to the entity near them whose name the token shortens, if there is
    only one: same initial, letters in order, and not already a word of the name. entities: entity, name. A document's or channel's
    token is weighed once for all mentions that have it, and hands on its least and greatest fit: a sole one is both."""
    known = entities.groupBy("entity", "name").agg(F.count("*").alias("rows"))
    known = known.withColumns({"initial": F.substring(casefold(F.col("name")), 1, 1), "parts": short_form_parts(F.col("name")), "own": name_tokens(F.col("name"))})
    folded = casefold(F.col("token"))
    asked = mentions.where(F.length("token") >= SHORT_FORM_MIN).select("mention_id", "dsid", "channel", "token")
    fits = F.exists("parts", lambda p: F.rlike(p, F.col("pattern"))) & ~F.array_contains("own", F.col("folded"))

    def near(place: str, members: DataFrame) -> DataFrame:
        named = members.select(place, "entity").distinct().join(known, "entity")
        tokens = asked.select(place, "token").distinct().withColumns({"folded": folded, "initial": F.substring(folded, 1, 1), "pattern": short_form_pattern(F.col("token"))})
        met = tokens.join(named, [place, "initial"]).where(fits)
        fit = F.struct("token", "entity", "name")
        ends = met.groupBy(place, "token").agg(F.min(fit).alias("low"), F.max(fit).alias("high"), F.max("rows").alias("rows"))
        return asked.select("mention_id", place, "token").join(ends, [place, "token"]).select("mention_id", "low", "high", "rows")

    found = near("dsid", co).unionByName(near("channel", participated_in)).groupBy("mention_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("rows").alias("rows"))
    sole = found.where("low = high and rows = 1").select("mention_id", F.col("low.entity").alias("entity"))
    return sole.select("mention_id", "entity", F.lit("graph_proposed").alias("method"), F.lit(CONFIDENCE["graph_proposed"]).alias("confidence"))


def subgraph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of evidence() rows: documents, claims, spans."""
    def node(kind: str, key: str, label: str):
        return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("label"))

    def edge(kind: str, a: str, b: str):
        return rows.select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"))

    nodes = node("document", "dsid", "dsid").unionByName(node("claim", "claim_id", "object")).unionByName(node("span", "span_id", "quote"))
    links = edge("ASSERTS", "dsid", "claim_id").unionByName(edge("SUPPORTED_BY", "claim_id", "span_id"))
    return nodes.distinct(), links.distinct()


def shortest_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, budget: int = 4) -> DataFrame:
    """start, goal, hops: the fewest edges (src, dst; either way) from each start to each goal within the budget. One
    join a step; a node that was reached with fewer steps is not visited again, and the last steps go only where a goal is near
    enough. What is reached meets the edges as they are read, so these may repeat; they are read in each step and should be stored."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def across(front: DataFrame, rows: int) -> DataFrame:
        if rows <= BROADCAST_ROWS:
            return both.join(F.broadcast(front), both["src"] == front["node"])
        n = both.count()
        return parted(both, n, "src").join(parted(front, n, "node"), F.col("src") == F.col("node"))

    near = [stored(goals.select(F.col("id").alias("node")).distinct())]  # by the steps that are left
    while len(near) < (budget + 1) // 2 and (n := near[-1].count()) <= BROADCAST_ROWS:
        near.append(stored(near[-1].unionByName(across(near[-1], n).select(F.col("dst").alias("node"))).distinct()))
    seen = front = stored(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")))
    for step in range(1, budget + 1):
        if not (n := front.count()):
            break
        reached = across(front.select("start", "node"), n).select("start", F.col("dst").alias("node"))
        if (left := budget - step) < len(near):
            reached = reached.join(counted(near[left]), "node", "left_semi")
        front = reached.distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = stored(front.select("start", "node", F.lit(step).alias("hops")))
        seen = seen.unionByName(front)
    return seen.join(goals.select(F.col("id").alias("node")), "node").select("start", F.col("node").alias("goal"), "hops")
