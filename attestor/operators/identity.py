"""Identity keys for evaluation: observed entities against a directory of people.

Keys are an address, a set of name words, and a name's letters run together; one shared key matches, but a key of two
people is nobody's, and an entity that reaches two people is no one's either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import casefold, email_domain, email_local_part, organisation_root

#: Words before a name.
HONORIFICS = "mr mrs ms miss dr prof sir madam".split()
#: Letters with marks and what remains without them, in the same places.
MARKED = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįłñńňòóôõöøōőřśšşťùúûüūůűųýÿžźż"
PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorssstuuuuuuuuyyzzz"
COMPANY = "redwood"


def folded(c):
    """Case and accents away, whether accents are marks of their own or not."""
    return F.regexp_replace(F.translate(casefold(c), MARKED, PLAIN), r"\p{M}", "")


def words_of(c):
    return F.array_sort(F.array_distinct(F.filter(F.split(folded(c), "[^a-z]+"), lambda t: (F.length(t) > 1) & ~t.isin(HONORIFICS))))


def name_keys(c):
    """Two words at least: `sam` alone is no key."""
    words = words_of(c)
    keys = F.array(F.concat(F.lit("words:"), F.array_join(words, " ")), F.concat(F.lit("letters:"), F.regexp_replace(folded(c), "[^a-z]", "")))
    return F.when(F.size(words) >= 2, keys).otherwise(F.array().cast("array<string>"))


def person_keys(directory: DataFrame) -> DataFrame:
    """directory (name, email) to email, key; keys of several people are left out."""
    address = casefold(F.col("email"))
    keys = F.concat(F.array(F.concat(F.lit("email:"), address)), name_keys(F.col("name")), name_keys(email_local_part(F.col("email"))))
    rows = directory.select(address.alias("person"), F.explode(F.array_distinct(keys)).alias("key")).distinct()
    own = rows.groupBy("key").agg(F.countDistinct("person").alias("n"), F.min("person").alias("person"))
    return own.where("n = 1").select("key", "person")


def entity_keys(entities: DataFrame) -> DataFrame:
    """entities (entity, name, emails) to entity, key: addresses as they are; names only with an address of the company."""
    internal = F.filter("emails", lambda e: F.startswith(organisation_root(email_domain(e)), F.lit(COMPANY)))
    own = F.transform("emails", lambda e: F.concat(F.lit("email:"), casefold(e)))
    local = F.flatten(F.transform(internal, lambda e: name_keys(email_local_part(e))))
    name = F.when(F.size(internal) > 0, name_keys(F.col("name"))).otherwise(F.array().cast("array<string>"))
    return entities.select("entity", F.explode(F.array_distinct(F.concat(own, local, name))).alias("key"))


def matched(entities: DataFrame, directory: DataFrame) -> DataFrame:
    """entity, person, hits: the one person an entity is, or null if it reaches none or several."""
    hits = entity_keys(entities).join(person_keys(directory), "key").groupBy("entity").agg(F.countDistinct("person").alias("hits"), F.min("person").alias("person"))
    rows = entities.select("entity").join(hits, "entity", "left")
    return rows.select("entity", F.when(F.col("hits") == 1, F.col("person")).alias("person"), F.coalesce("hits", F.lit(0)).alias("hits"))


def clusters(resolved: DataFrame) -> DataFrame:
    """mention_id, system: the entity of a resolved mention; an abstention is a cluster of its own."""
    alone = F.concat(F.lit("alone:"), F.col("mention_id").cast("string"))
    return resolved.select("mention_id", F.when(F.col("key").isNotNull(), F.col("key").cast("string")).otherwise(alone).alias("system"))


def disagreements(entities: DataFrame) -> DataFrame:
    """Entities two of whose addresses spell names neither of which contains the other: a merge to look at."""
    named = F.array_distinct(F.filter(F.transform("emails", lambda e: words_of(email_local_part(e))), lambda w: F.size(w) >= 2))
    apart = lambda a, b: (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)
    rows = entities.withColumn("named", named)
    return rows.where(F.exists("named", lambda a: F.exists("named", lambda b: apart(a, b)))).select("entity", F.size("named").alias("spellings"))
