"""The catalogue of relations and the alignment of raw predicates with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.text import normalise_predicate, quoted, sql_normalise_predicate

#: Relation, whether it has one value, whether it may change, its systems of record (best first), synonyms.
CATALOGUE = [
    ("holds_title", True, True, "gmail fireflies confluence", "has title, job title, has job title, title, has role, role, works as, serves as, is title, holds title, position"),
    ("employed_by", True, True, "gmail fireflies hubspot", "works at, works for, employed by, employed at, is employed by, member of, belongs to organisation"),
    ("owned_by", True, True, "jira linear github confluence", "owner, owns, assigned to, is assigned to, has owner, responsible for, is owned by, led by, leads"),
    ("has_status", True, True, "jira linear github", "has status, status, is status, state, has state, current status"),
    ("due_on", True, True, "jira linear confluence", "due, due date, due on, eta, action due date, target date, scheduled for, deadline, target signature, expected by"),
    ("has_email", False, False, "gmail", "has email, email, email address, contactable at"),
    ("includes", False, False, "", "includes, contains, comprises, consists of, has component"),
    ("requires", False, False, "", "requires, depends on, needs, blocked on, is blocked on, requires engineer-days"),
    ("proposed_action", False, False, "", "proposed action, proposes, recommends, suggested, action item, next step"),
    ("operates_in", False, False, "hubspot", "operates in, located in, based in, present in"),
    ("references", False, False, "github linear jira", "references, relates to, linked to, related work, mentions"),
]
#: Words of a predicate that carry no meaning.
STOP = "is are was were the a an of to has have".split()


def _rows() -> list[tuple]:
    """place, relation, synonym, content words; a synonym that comes twice belongs to the later relation, at its first place."""
    names: dict[str, str] = {}
    for name, *_, synonyms in CATALOGUE:
        for s in [name.replace("_", " "), *synonyms.split(", ")]:
            names[s] = name
    return [(i, name, s, [w for w in dict.fromkeys(s.split()) if w not in STOP]) for i, (s, name) in enumerate(names.items())]


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_rows(), "place int, relation string, synonym string, words array<string>")


def relations(spark: SparkSession) -> DataFrame:
    rows = [(n, single, mutable, a.split()) for n, single, mutable, a, _ in CATALOGUE]
    return spark.createDataFrame(rows, "relation string, single boolean, mutable boolean, authority array<string>")


def align(predicates: DataFrame) -> DataFrame:
    """predicates (predicate) to predicate, relation, method, confidence, one row for each distinct one: a synonym word
    for word, or the synonym whose content words contain or are contained in the predicate's with the best overlap of
    at least a half. The catalogue has fewer than a hundred rows."""
    spark = predicates.sparkSession
    known = F.broadcast(synonyms(spark))
    raw = predicates.select("predicate").distinct().withColumn("text", normalise_predicate(F.col("predicate")))
    raw = raw.withColumn("own", F.filter(F.array_distinct(F.split("text", " ")), lambda w: (w != "") & ~w.isin(STOP)))
    exact = raw.join(known.select(F.col("synonym").alias("text"), F.col("relation").alias("exact")), "text", "left")
    # overlaps by an equi-join on words: n common words, and one side must be all common
    mine = raw.where("size(own) > 0").select("predicate", F.size("own").alias("n_own"), F.explode("own").alias("word"))
    theirs = known.select("place", "relation", F.size("words").alias("n_words"), F.explode("words").alias("word"))
    common = mine.join(F.broadcast(theirs), "word").groupBy("predicate", "place", "relation", "n_own", "n_words").agg(F.count("*").alias("n"))
    overlap = F.col("n") / (F.col("n_own") + F.col("n_words") - F.col("n"))
    fits = common.where((F.col("n") == F.col("n_own")) | (F.col("n") == F.col("n_words"))).withColumn("overlap", overlap).where("overlap >= 0.5")
    best = fits.groupBy("predicate").agg(F.max(F.struct("overlap", (-F.col("place")).alias("early"), F.col("relation").alias("name"))).alias("best"))
    rows = exact.join(best, "predicate", "left")
    method = (
        F.when(F.col("text") == "", "empty").when(F.col("exact").isNotNull(), "exact").when(F.size("own") == 0, "stopwords_only")
        .when(F.col("best").isNotNull(), "token_subset").otherwise("unmapped")
    )
    rows = rows.withColumn("method", method)
    relation = F.when(F.col("method") == "exact", F.col("exact")).when(F.col("method") == "token_subset", F.col("best.name"))
    confidence = F.when(F.col("method") == "exact", 1.0).when(F.col("method") == "token_subset", 0.6 + 0.3 * F.col("best.overlap")).otherwise(0.0)
    return rows.select("predicate", relation.alias("relation"), "method", confidence.alias("confidence"))


def sql_synonyms() -> str:
    """The catalogue's synonyms as a DuckDB values list: place, relation, synonym, words."""
    rows = ", ".join(f"({i}, '{n}', '{s}', [{quoted(w)}]::varchar[])" for i, n, s, w in _rows())
    return f"(values {rows}) as s(place, relation, synonym, words)"


def sql_relations() -> str:
    rows = ", ".join(f"('{n}', {single}, {mutable}, [{quoted(a.split())}]::varchar[])" for n, single, mutable, a, _ in CATALOGUE)
    return f"(values {rows}) as r(relation, single, mutable, authority)"


def sql_align(predicates: str) -> str:
    """DuckDB SQL of align over a query that returns `predicate`."""
    return f"""
  (select predicate, case method when 'exact' then exact when 'token_subset' then best.name end as relation, method,
     case method when 'exact' then 1.0::double when 'token_subset' then 0.6::double + 0.3::double * best.overlap else 0.0::double end as confidence
   from (select *, case when text = '' then 'empty' when exact is not null then 'exact' when len(own) = 0 then 'stopwords_only'
       when best is not null then 'token_subset' else 'unmapped' end as method
     from (select p.predicate, p.text, p.own, max(e.relation) as exact,
         max({{'overlap': f.overlap, 'early': -f.place, 'name': f.relation}}) filter (f.place is not null) as best
       from (select predicate, text, list_filter(list_distinct(string_split(text, ' ')), lambda w: w <> '' and w not in ({quoted(STOP)})) as own
         from (select distinct predicate, {sql_normalise_predicate('predicate')} as text from ({predicates}))) p
       left join (select * from {sql_synonyms()}) e on e.synonym = p.text
       left join (select place, relation, words, own2, n::double / (len(own2) + len(words) - n) as overlap
         from (select place, relation, words, own2, len(list_intersect(words, own2)) as n
           from (select * from {sql_synonyms()}), (select distinct list_filter(list_distinct(string_split({sql_normalise_predicate('predicate')}, ' ')), lambda w: w <> '' and w not in ({quoted(STOP)})) as own2 from ({predicates})))
         where n > 0 and (n = len(own2) or n = len(words)) and n::double / (len(own2) + len(words) - n) >= 0.5) f on f.own2 = p.own
       group by p.predicate, p.text, p.own)))"""
