"""Entity resolution in tiers: people from addresses, same-person merges, strong keys, unique names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.scoring import CONFIDENCE
from attestor.functions.text import email_domain, email_local_part, name_tokens, normalise_address, organisation_root, ROOT_PREFIX_MIN

MENTION_CAP, CANDIDATES_KEPT = 400, 8
#: Rows of one address that meet those of another block.
PAIR_BLOCK = 1024


def people(mentions: DataFrame) -> DataFrame:
    """mentions (dsid, start, surface, kind, email, channel) to a person an address: key, name, emails, domains, channels,
    documents. The name is the first surface that is not an address, else the first; bots and bare handles are nobody."""
    rows = mentions.where("kind <> 'bot' and email is not null").withColumn("email", normalise_address(F.col("email"))).where("email <> ''")
    named = F.struct(F.contains("surface", F.lit("@")).alias("address"), "dsid", "start", F.trim("surface").alias("surface"))
    return rows.groupBy(F.concat(F.lit("email:"), F.col("email")).alias("key")).agg(
        F.min(named)["surface"].alias("name"),
        F.array_sort(F.collect_set("email")).alias("emails"),
        F.array_sort(F.collect_set(email_domain(F.col("email")))).alias("domains"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.array_sort(F.collect_set("dsid")).alias("documents"),
    )


def _own_tokens(name):
    return F.array_sort(name_tokens(F.when(F.contains(name, F.lit("@")), email_local_part(name)).otherwise(name)))


def person_tokens(persons: DataFrame) -> DataFrame:
    """persons with tokens: words of the name and of every address' local part."""
    local = F.flatten(F.transform("emails", lambda e: name_tokens(email_local_part(e))))
    return persons.withColumn("tokens", F.array_sort(F.array_distinct(F.concat(_own_tokens(F.col("name")), local))))


def same_person(persons: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """key, survivor: people of one name, of two words or more, whose organisations agree. Within a name, keys are taken
    in order, and each joins the first group that has a matching organisation. A group with one protected key folds into
    it, a group with several is left alone."""
    rows = persons.withColumn("signature", _own_tokens(F.col("name"))).where("size(signature) >= 2")
    roots = F.array_distinct(F.filter(F.transform("domains", organisation_root), lambda r: r != ""))
    rows = rows.select("key", F.array_join("signature", " ").alias("signature"), roots.alias("roots"))
    safe = protected.select("key", F.lit(True).alias("protected")) if protected is not None else None
    rows = rows.join(safe, "key", "left").fillna(False, ["protected"]) if safe is not None else rows.withColumn("protected", F.lit(False))
    # the greedy order matters, so a name's people are folded in one row; only names that come twice get there
    person = F.struct("key", "roots", "protected")
    named = rows.groupBy("signature").agg(F.array_sort(F.collect_list(person)).alias("p")).where("size(p) > 1")
    kind = "array<struct<roots: array<string>, members: array<struct<key: string, protected: boolean>>>>"

    def agrees(a, b):
        short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
        return (a == b) | ((F.length(short) >= ROOT_PREFIX_MIN) & F.startswith(long, short))

    def add(groups, x):
        fits = lambda g: F.exists(x.roots, lambda a: F.exists(g.roots, lambda b: agrees(a, b)))
        at = F.array_position(F.transform(groups, fits), F.lit(True))
        member = F.array(F.struct(x.key.alias("key"), x.protected.alias("protected")))
        grown = F.transform(
            groups,
            lambda g, i: F.when(i + 1 == at, F.struct(F.array_union(g.roots, x.roots).alias("roots"), F.concat(g.members, member).alias("members"))).otherwise(g),
        )
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(F.struct(x.roots.alias("roots"), member.alias("members")))))

    groups = F.aggregate("p", F.array().cast(kind), add)
    found = named.select(F.explode(groups).alias("g")).select("g.members").where("size(members) > 1")
    anchors = F.filter("members", lambda m: m.protected)
    survivor = F.when(F.size(anchors) == 1, anchors[0]["key"]).otherwise(F.col("members")[0]["key"])
    merged = found.where(F.size(anchors) <= 1).select(survivor.alias("survivor"), F.explode("members.key").alias("key"))
    return merged.where("key <> survivor").select("key", "survivor")


def merged(persons: DataFrame, same: DataFrame) -> DataFrame:
    """persons after same_person: a survivor has what all its members had."""
    rows = persons.join(same, "key", "left").withColumn("into", F.coalesce("survivor", "key"))
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("emails", "domains", "channels", "documents")]
    name = F.max(F.when(F.col("key") == F.col("into"), F.col("name"))).alias("name")
    return rows.groupBy(F.col("into").alias("key")).agg(name, *sets).select(*persons.columns)


def candidates(surfaces: DataFrame, persons: DataFrame) -> DataFrame:
    """surface, key, exact: people whose tokens hold all of the surface's. An equi-join on each surface's rarest token
    only, then a test of the others: a first name that thousands share meets nobody by itself if a rarer word stands by it."""
    mine = surfaces.select("surface").distinct().withColumn("own", F.array_sort(name_tokens(F.col("surface")))).where("size(own) > 0")
    known = person_tokens(persons).select("key", "tokens")
    frequency = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    words = mine.select("surface", "own", F.explode("own").alias("token")).join(frequency, "token", "left")
    # a word that nobody has rules all people out, and sorts first
    rare = words.groupBy("surface", "own").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).where("r.n > 0")
    met = rare.select("surface", "own", F.col("r.token").alias("token")).join(known.select("key", "tokens", F.explode("tokens").alias("token")), "token")
    return met.where(F.size(F.array_except("own", "tokens")) == 0).select("surface", "key", (F.col("own") == F.col("tokens")).alias("exact"))


def tiers(mentions: DataFrame, persons: DataFrame) -> DataFrame:
    """mentions (mention_id, surface, kind, email) to mention_id, key, method, confidence, candidates (their number)."""
    address = persons.select("key", F.explode("emails").alias("email"))
    rows = mentions.withColumn("email", normalise_address(F.col("email")))
    strong = rows.where("kind <> 'bot'").join(address.groupBy("email").agg(F.min("key").alias("strong")), "email", "left")
    strong = rows.where("kind = 'bot'").withColumn("strong", F.lit(None).cast("string")).select("mention_id", "surface", "kind", "strong").unionByName(strong.select("mention_id", "surface", "kind", "strong"))
    found = candidates(rows.where("kind <> 'bot'"), persons).groupBy("surface").agg(F.count("*").alias("n"), F.min("key").alias("one"), F.max("exact").alias("exact"))
    out = strong.join(found, "surface", "left")
    usable = (F.col("kind") != "bot") & (F.coalesce("n", F.lit(0)) == 1)
    method = F.when(F.col("strong").isNotNull(), "strong_key").when(usable & F.col("exact"), "token_set_exact").when(usable, "token_subset_unique").otherwise("unresolved")
    out = out.withColumn("method", method)
    confidence = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[F.col("method")]
    key = F.when(F.col("method") == "strong_key", F.col("strong")).when(F.col("method") != "unresolved", F.col("one"))
    n = F.when(F.col("kind") == "bot", 0).when(F.col("method") == "strong_key", 1).otherwise(F.coalesce("n", F.lit(0)))
    return out.select("mention_id", "surface", key.alias("key"), "method", confidence.alias("confidence"), n.cast("long").alias("candidates"))


def capped(mentions: DataFrame, cap: int = MENTION_CAP) -> DataFrame:
    """The first mentions of each document, in parse order."""
    w = Window.partitionBy("dsid").orderBy("start", "end", "surface")
    return mentions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def ambiguous(resolved: DataFrame) -> DataFrame:
    """surface, occurrences, candidates of unresolved mentions with several candidates."""
    return resolved.where("method = 'unresolved' and candidates > 1").groupBy("surface").agg(F.count("*").alias("occurrences"), F.max("candidates").alias("candidates"))


def surfaces_of(resolved: DataFrame) -> DataFrame:
    """Entities under two or more surfaces."""
    return resolved.where("key is not null").groupBy("key").agg(F.array_sort(F.collect_set("surface")).alias("surfaces")).where("size(surfaces) >= 2")


def repointed(resolves_to: DataFrame, merged_into: DataFrame) -> DataFrame:
    """Resolutions after merges: what pointed at a superseded entity points at the one it went into."""
    moved = merged_into.select(F.col("src").alias("entity"), F.col("dst").alias("into"))
    return resolves_to.join(moved, "entity", "left").withColumn("entity", F.coalesce("into", "entity")).drop("into").select(*resolves_to.columns)


def stranded(entities: DataFrame, merged_into: DataFrame) -> DataFrame:
    """key, email, owner: addresses of an entity that was merged away whose own entity is still alive elsewhere. All pairs are asked for,
    so an address that many have is dealt out in blocks of both sides, and no task has to write more than one block's pairs."""
    over = merged_into.select(F.col("src").alias("id"))
    gone = entities.join(over, "id", "left_semi").select("key", F.explode("emails").alias("email"))
    alive = entities.join(over, "id", "left_anti").select(F.col("key").alias("owner"), F.explode("emails").alias("email"))

    def blocks(side: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        count = side.groupBy("email").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias(f"n_{name}"))
        return side.join(count, "email").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"n_{name}")).cast("int")).drop(f"n_{name}"), count

    (gone, n_gone), (alive, n_alive) = blocks(gone, "key", "a"), blocks(alive, "owner", "b")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    gone = gone.join(n_alive, "email").select("key", "email", "a", every("n_b").alias("b"))
    alive = alive.join(n_gone, "email").select("owner", "email", "b", every("n_a").alias("a"))
    # partitions by hash, as many as Spark is told to have and not fewer by their bytes: few bytes make many pairs here
    n = int(gone.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone, alive = gone.repartition(n, "email", "a", "b"), alive.repartition(n, "email", "a", "b")
    return gone.hint("merge").join(alive, ["email", "a", "b"]).select("key", "email", "owner")
