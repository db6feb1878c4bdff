"""The engine's queries over the derived tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import ids, scoring
from attestor.functions import text as tx
from attestor.operators import answer as an
from attestor.operators import conflicts as cf
from attestor.operators import evaluate as ev
from attestor.operators import graph, lexical, neardup, parsing, resolve, spans
from attestor.operators import identity as idn
from attestor.operators import ontology as on
from attestor.operators import recording as rec
from attestor.plans.views import duck, table, view
from attestor.sources import corpus, reports, tables
from attestor.sources.shared import shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ---- identities -------------------------------------------------------------------------------------------------

@query(f"select p_partkey, {ids.sql_node_id('Entity', ids.sql_canonical_key('Entity', 'p_name'))} as node_id from part")
def node_id_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Node ids of part names."""
    return table(spark, d, "part").select("p_partkey", ids.node_id("Entity", ids.canonical_key("Entity", F.col("p_name"))).alias("node_id"))


@query(f"select dsid, ticket, {ids.sql_edge_id('REFERENCES', 'dsid', 'ticket')} as eid from {duck('v_reference')}")
def edge_id_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Edge ids of document references."""
    return view(spark, d, "v_reference").select("dsid", "ticket", ids.edge_id("REFERENCES", F.col("dsid"), F.col("ticket")).alias("eid"))


@query(f"""select id, count(distinct key) as identities from (
  select {ids.sql_node_id('Person', 'p_brand')} & 15 as id, p_brand as key from part) group by id having count(distinct key) > 1""")
def id_collision_check(spark: SparkSession, d: str) -> DataFrame:
    """Collisions of ids that were cut to four bits on purpose: the check must find them."""
    key = F.col("p_brand")
    rows = table(spark, d, "part").select(ids.node_id("Person", key).bitwiseAND(F.lit(15)).alias("id"), F.lit("node").alias("kind"), F.lit("Person").alias("node_type"), key.alias("natural_key"), key.alias("full_hash"))
    return tables.collisions(rows)


@query(f"select distinct p_name, {ids.sql_canonical_key('Channel', 'p_name')} as channel_key, {ids.sql_canonical_key('Ticket', 'p_name')} as ticket_key from part")
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that ignore case and keys that keep it."""
    name = F.col("p_name")
    return table(spark, d, "part").select("p_name", ids.canonical_key("Channel", name).alias("channel_key"), ids.canonical_key("Ticket", name).alias("ticket_key")).distinct()


# ---- text -------------------------------------------------------------------------------------------------------

@query(f"select person_id, {tx.sql_organisation_root(tx.sql_email_domain('email'))} as root from {duck('v_person')}")
def org_root(spark: SparkSession, d: str) -> DataFrame:
    """The organisation behind each person's address."""
    return view(spark, d, "v_person").select("person_id", tx.organisation_root(tx.email_domain(F.col("email"))).alias("root"))


@query(f"select id, array_to_string({tx.sql_name_tokens('body')}, ' ') as tokens from {duck('v_doc')}")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Name tokens of whole documents, sorted."""
    return view(spark, d, "v_doc").select("id", F.array_join(F.array_sort(tx.name_tokens(F.col("body"))), " ").alias("tokens"))


@query(f"select distinct predicate, {tx.sql_normalise_predicate('predicate')} as normalised from (select concat('  ', predicate, ' (', event_type, ')!') as predicate from {duck('v_claim')}, (select distinct event_type from events))")
def normalise_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Predicates in odd spellings."""
    odd = table(spark, d, "events").select("event_type").distinct()
    raw = view(spark, d, "v_claim").select("predicate").distinct().join(F.broadcast(odd))
    raw = raw.select(F.concat(F.lit("  "), "predicate", F.lit(" ("), "event_type", F.lit(")!")).alias("predicate")).distinct()
    return raw.select("predicate", tx.normalise_predicate(F.col("predicate")).alias("normalised"))


@query(f"select p_partkey, {tx.sql_normalise_object('said')} as value from (select p_partkey, concat(p_name, case p_partkey % 4 when 0 then ', Inc.' when 1 then ' Systems LLC' when 2 then ' INFERENCE' else '' end) as said from part)")
def normalise_object(spark: SparkSession, d: str) -> DataFrame:
    """Objects with and without an organisation's suffix."""
    k = F.col("p_partkey") % 4
    said = F.concat("p_name", F.when(k == 0, ", Inc.").when(k == 1, " Systems LLC").when(k == 2, " INFERENCE").otherwise(""))
    return table(spark, d, "part").select("p_partkey", tx.normalise_object(said).alias("value"))


@query(f"select person_id, {tx.sql_normalise_address('raw')} as address from (select person_id, case when person_id % 3 = 0 then concat(' ', upper(split_part(email, '@', 1)), '@', email) else email end as raw from {duck('v_person')})")
def normalise_address(spark: SparkSession, d: str) -> DataFrame:
    """Addresses whose local part a header repeated."""
    raw = F.when(F.col("person_id") % 3 == 0, F.concat(F.lit(" "), F.upper(F.substring_index("email", "@", 1)), F.lit("@"), "email")).otherwise(F.col("email"))
    return view(spark, d, "v_person").select("person_id", tx.normalise_address(raw).alias("address"))


@query("""with recursive v as (select p_brand, list_sort(list(distinct p_type)) as l from part group by p_brand),
walk as (select p_brand, l, 1 as i, '' as packed, false as stop from v
  union all select p_brand, l, i + 1, case when length(packed) + length(l[i]) + (case when i > 1 then 1 else 0 end) > 40 then packed when i > 1 then packed || ';' || l[i] else l[i] end,
    length(packed) + length(l[i]) + (case when i > 1 then 1 else 0 end) > 40 from walk where i <= len(l) and not stop)
select p_brand, max_by(packed, length(packed)) as packed from walk group by p_brand""")
def pack_values(spark: SparkSession, d: str) -> DataFrame:
    """Types of each brand in forty characters, cut at a separator."""
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    return rows.select("p_brand", tx.pack(F.col("types"), 40).alias("packed"))


@query(f"""select a.person_id, t.token, {tx.sql_is_short_form('t.token', 'a.name')} as fits
from {duck('v_person')} a, (values ('red'), ('bu'), ('wgt'), ('gro'), ('zz')) as t(token)""")
def short_form_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether short forms fit the names of people."""
    tokens = F.explode(F.array(*(F.lit(t) for t in ("red", "bu", "wgt", "gro", "zz"))))
    rows = view(spark, d, "v_person").select("person_id", "name", tokens.alias("token"))
    return rows.select("person_id", "token", tx.is_short_form(F.col("token"), F.col("name")).alias("fits"))


@query(f"select qid, array_to_string(list_sort(list_distinct(case when len(kept) > 0 then kept else t end)), ' ') as terms from (select qid, t, list_filter(t, lambda x: length(x) >= 2 and x not in ({tx.quoted(tx.STOPWORDS)})) as kept from (select qid, {tx.sql_terms('text')} as t from {duck('v_question')}))")
def sanitise_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms that questions are searched by."""
    return view(spark, d, "v_question").select("qid", F.array_join(F.array_sort(tx.question_terms(F.translate("text", '"“”', " "))), " ").alias("terms"))


@query(f"select a.root as a, b.root as b, {tx.sql_same_organisation('a.root', 'b.root')} as same from (values ('redwood'), ('redwoodinference'), ('acme'), ('acmeworks'), (''), ('mediloop')) as a(root), (values ('redwood'), ('acme'), ('procure'), ('')) as b(root)")
def same_organisation(spark: SparkSession, d: str) -> DataFrame:
    """Which organisation roots are one."""
    rows = spark.createDataFrame([(a, b) for a in ("redwood", "redwoodinference", "acme", "acmeworks", "", "mediloop") for b in ("redwood", "acme", "procure", "")], "a string, b string")
    return rows.select("a", "b", tx.same_organisation(F.col("a"), F.col("b")).alias("same"))


# ---- scans ------------------------------------------------------------------------------------------------------

@query("select user_id, min(event_id) as event_id, count(*) as n from events group by user_id")
def dedup_first_row(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user, and how many there are."""
    events = table(spark, d, "events")
    first = corpus.first_rows(events, "user_id", ["event_id"]).select("user_id", "event_id")
    return first.join(events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("select doc_id, lang, source, n_chars from documents where doc_id = 42")
def doc_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One document by its id."""
    return corpus.fetch(table(spark, d, "documents"), "doc_id", 42, ["doc_id", "lang", "source", "n_chars"])


@query("select doc_id, length(text) as chars from documents where doc_id in (select doc_id from labels where toxic = 1)")
def semi_join_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of a set of documents."""
    wanted = table(spark, d, "labels").where("toxic = 1")
    return corpus.bodies(table(spark, d, "documents"), wanted, "doc_id").select("doc_id", F.length("text").cast("long").alias("chars"))


@query("select doc_id, source, length(substr(text, 1, 8000)) as chars from (select *, row_number() over (partition by source order by doc_id) as n from documents where length(text) >= 400) where n <= 3")
def quota_sample_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Three longer documents of each source."""
    return corpus.quota_sample(table(spark, d, "documents"), "source", 3, ["doc_id"], 400, "text", 8000).select("doc_id", "source", F.length("text").cast("long").alias("chars"))


@query("(select event_id, event_type from events where event_type = 'error' order by event_id limit 50) union all (select event_id, event_type from events where event_type = 'signup' order by event_id limit 20)")
def slice_selection(spark: SparkSession, d: str) -> DataFrame:
    """The first events of two kinds."""
    parts = [(F.col("event_type") == "error", 50), (F.col("event_type") == "signup", 20)]
    return corpus.slice_of(table(spark, d, "events").select("event_id", "event_type"), parts, ["event_id"])


@query("select item_id as question_id, text as question from benchmark")
def question_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Questions without the columns that tell the answer."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit("sealed").alias("gold_answer"))
    return corpus.open_columns(rows)


# ---- lexical ----------------------------------------------------------------------------------------------------

_TOKENS = f"""docs as (select id, {tx.sql_terms('title')} as t, {tx.sql_terms('body')} as b from {duck('v_doc')}),
hits as (select id, unnest(t) as term, 4.0::double as w from docs union all select id, unnest(b), 1.0::double from docs),
tf as (select term, id, sum(w) as tf from hits group by term, id),
sizes as (select id, len(t) + len(b) as dl from docs),
stats as (select count(*) as n, avg(dl::double) as avgdl from sizes),
df as (select term, count(*) as df, sum(tf) as cf from tf group by term)"""
_ASKED = f"asked as (select qid, list_distinct({tx.sql_terms('text')}) as terms from {duck('v_question')})"
_BM25 = f"""with {_TOKENS}, {_ASKED},
q as (select qid, unnest(terms) as term from asked),
scored as (select qid, tf.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))) as score
  from q join tf on tf.term = q.term join df on df.term = q.term join sizes on sizes.id = tf.id, stats group by qid, tf.id),
ranked as (select qid, id, score, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from scored)"""


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = view(spark, d, "v_doc")
    asked = view(spark, d, "v_question").select("qid", F.array_distinct(tx.terms(F.col("text"))).alias("terms"))
    index, stats = lexical.indexed(docs, asked)
    return docs, index, stats, asked


@query(f"with {_TOKENS} select term, df, cf from df")
def term_postings(spark: SparkSession, d: str) -> DataFrame:
    """Document and weighted collection frequency of every term."""
    return lexical.term_stats(lexical.postings(view(spark, d, "v_doc")))


@query(f"{_BM25} select qid, id, rank, floor(score * 1e4 + 0.5)::bigint as score_e4 from ranked where rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of every question."""
    _, index, stats, asked = _index(spark, d)
    best = lexical.bm25(index, stats, asked, 10)
    return best.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.floor(F.col("score") * 1e4 + 0.5).cast("long").alias("score_e4"))


@query(f"""with phrases as (select qid as pid, ' ' || array_to_string({tx.sql_terms('text')}, ' ') || ' ' as said from {duck('v_question')}),
docs as (select id, ' ' || array_to_string({tx.sql_terms('body')}, ' ') || ' ' as b from {duck('v_doc')})
select pid, id, len(string_split(b, said)) - 1 as n from phrases join docs on contains(b, said) where said <> '  '""")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a question's words in a row, and how often."""
    phrases = view(spark, d, "v_question").select(F.col("qid").alias("pid"), tx.terms(F.col("text")).alias("terms")).where("size(terms) > 0")
    return lexical.phrase_matches(view(spark, d, "v_doc"), phrases)


_KEY = f"""key as (select qid, id from {duck('v_question')}, {duck('v_doc')} where contains(body, text))"""
_RECALL = f"""{_BM25}, {_KEY}, budgets as (select unnest([4, 8, 20]) as budget),
judged as (select k.qid, budget, count(case when rank <= budget then 1 end) as found, count(*) as expected, min(case when rank <= budget then rank end) as first_rank
  from key k left join ranked r on r.qid = k.qid and r.id = k.id, budgets group by k.qid, budget)"""


def _recall(spark: SparkSession, d: str) -> DataFrame:
    docs, index, stats, asked = _index(spark, d)
    # a stated set of questions against all documents; a question meets the documents that hold its rarest term
    key = lexical.holding(docs, view(spark, d, "v_question"), index).groupBy("qid").agg(F.collect_set("id").alias("expected"))
    return lexical.recall(lexical.bm25(index, stats, asked, 20), key, [4, 8, 20])


@query(f"{_RECALL} select qid, budget, found, expected, first_rank from judged")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Documents found of those that hold a question, at three budgets."""
    return _recall(spark, d).select("qid", "budget", "found", "expected", F.col("first_rank").cast("long").alias("first_rank"))


@query(f"""{_RECALL} select budget, count(*) as questions, floor(avg(found::double / expected) * 10000 + 0.5 + 1e-9)::bigint as recall_e4, count(case when found > 0 then 1 end) as any_hit,
  count(case when found = expected then 1 end) as all_hit, list_sort(list(first_rank) filter (first_rank is not null))[(count(first_rank) // 2) + 1] as median_first_rank from judged group by budget""")
def median_first_rank(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall, hits and the upper median of first ranks, at three budgets."""
    rows = lexical.recall_summary(_recall(spark, d))
    return rows.select("budget", "questions", scoring.ten_thousandths(F.col("recall")).alias("recall_e4"), F.col("any_hit").cast("long").alias("any_hit"), F.col("all_hit").cast("long").alias("all_hit"), F.col("median_first_rank").cast("long").alias("median_first_rank"))


# ---- near-duplicates --------------------------------------------------------------------------------------------

_GRAMS = f"""w as (select id, list_filter(regexp_split_to_array({tx.sql_casefold('body')}, '[^a-z0-9]+'), lambda x: x <> '') as w from {duck('v_doc')}),
sets as (select id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
classes as (select id, min(id) over (partition by md5(array_to_string(list_sort(s), chr(31)))) as rep from sets where len(s) > 0),
items as (select id, unnest(s) as g from sets where id in (select rep from classes)),
pairs as (select a.id as l, b.id as r, count(*) as n from items a join items b on a.g = b.g and a.id < b.id group by all),
near as (select l, r, n::double / (len(x.s) + len(y.s) - n) as j from pairs join sets x on x.id = l join sets y on y.id = r where n::double / (len(x.s) + len(y.s) - n) >= 0.6)"""


@query(f"with {_GRAMS} select l, r, floor(j * 10000 + 0.5 + 1e-9)::bigint as similarity_e4 from near")
def exact_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Representatives of equal documents whose shingles agree by six tenths or more."""
    return neardup.similar_pairs(view(spark, d, "v_doc").select("id", "body")).select("l", "r", scoring.ten_thousandths(F.col("similarity")).alias("similarity_e4"))


@query(f"with {_GRAMS} select id, rep as representative from classes where id <> rep")
def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the shingles of another, and the smallest id of those."""
    return neardup.classes(view(spark, d, "v_doc").select("id", "body")).where("id <> representative")


@query()
def minhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same by signatures: candidates from bands, similarity estimated."""
    return neardup.estimated_pairs(view(spark, d, "v_doc").select("id", "body"))


@query(f"""with recursive {_GRAMS}, both_kinds as (select l, r from near union all select rep, id from classes where id <> rep), links as (select l, r from both_kinds union all select r, l from both_kinds),
reach as (select l as id, l as least from links union select links.r, least from reach join links on links.l = reach.id)
select id, min(least) as representative from reach group by id""")
def neardup_components(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of similar documents by their smallest id."""
    return neardup.clusters(view(spark, d, "v_doc").select("id", "body"))


# ---- ontology and conflicts -------------------------------------------------------------------------------------

_SAID = ["has job title", "Works As", "the owner", "current status of", "status update", "is", "", "!!", "due", "date due", "requires engineer-days", "engineer days", "mentions of", "responsible", "frobnicates", "e-mail address", "is located in the"]
_SAID_SQL = "select * from (values " + ", ".join(f"('{p}')" for p in _SAID) + ") as p(predicate) union select predicate from " + duck("v_claim")


@query(f"select predicate, relation, method, {scoring.sql_ten_thousandths('confidence')} as confidence_e4 from {on.sql_align(_SAID_SQL)}")
def predicate_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Raw predicates and the relations that they stand for."""
    said = spark.createDataFrame([(p,) for p in _SAID], "predicate string").unionByName(view(spark, d, "v_claim").select("predicate").distinct())
    return on.align(said).select("predicate", "relation", "method", scoring.ten_thousandths(F.col("confidence")).alias("confidence_e4"))


_AUTHORITY = "case when len(authority) = 0 then 0.5::double when list_position(authority, source_type) > 0 then 1.0::double - 0.15::double * (list_position(authority, source_type) - 1) else 0.25::double end"


@query(f"select relation, source_type, {scoring.sql_ten_thousandths(_AUTHORITY)} as authority_e4 from {on.sql_relations()}, (select distinct source_type from {duck('v_doc')})")
def source_authority(spark: SparkSession, d: str) -> DataFrame:
    """How authoritative each kind of source is for each relation."""
    kinds = view(spark, d, "v_doc").select("source_type").distinct().withColumn("one", F.lit(1))
    rows = on.relations(spark).withColumn("one", F.lit(1)).join(F.broadcast(kinds), "one")
    return rows.select("relation", "source_type", scoring.ten_thousandths(scoring.source_authority(F.col("authority"), F.col("source_type"))).alias("authority_e4"))


@query(f"select claim_id, {scoring.sql_ten_thousandths(scoring.sql_directness('quote', 'source_type'))} as directness_e4 from {duck('v_claim')}")
def directness(spark: SparkSession, d: str) -> DataFrame:
    """First-hand, ordinary or hearsay."""
    return view(spark, d, "v_claim").select("claim_id", scoring.ten_thousandths(scoring.directness(F.col("quote"), F.col("source_type"))).alias("directness_e4"))


_POSITION = f"""position as (select dsid, case when count(*) over () > 1 then (row_number() over (order by t, dsid) - 1)::double / (count(*) over () - 1) else 0.5 end as position
  from (select dsid, min(timestamp) as t from {duck('v_claim')} where timestamp is not null group by dsid))"""


@query(f"with {_POSITION} select dsid, {scoring.sql_ten_thousandths('position')} as position_e4 from position")
def recency_rank(spark: SparkSession, d: str) -> DataFrame:
    """Where each dated document stands in time."""
    return cf.recency(view(spark, d, "v_claim")).select("dsid", scoring.ten_thousandths(F.col("position")).alias("position_e4"))


_FACTS = f"""aligned as (select a.predicate, a.relation, mutable, authority from {on.sql_align('select predicate from ' + duck('v_claim'))} a join {on.sql_relations()} on r.relation = a.relation where single),
facts as (select c.*, relation, mutable, authority, 'name:' || {tx.sql_casefold('trim(subject)')} as who, {tx.sql_normalise_object('object')} as value
  from {duck('v_claim')} c join aligned using (predicate) where trim(subject) <> '')"""
_VERSIONS = f"""{_POSITION}, {_FACTS},
told as (select f.*, p.position, {_AUTHORITY} as auth, {scoring.sql_directness('quote', 'source_type')} as direct, list_contains(authority, source_type) as rec,
  {tx.sql_casefold('trim(quote)')} as q from facts f left join position p using (dsid) where value <> ''),
totals as (select who, relation, count(distinct dsid) as total, count(distinct value) as n_versions, count(distinct case when position is not null then value end) as dated from told group by who, relation),
grouped as (select who, relation, value, any_value(mutable) as mutable, min(claim_id) as claim_id, arg_min(object, claim_id) as display, arg_min(subject, claim_id) as subject,
  max(auth) as authority, max(direct) as directness, max(position) as position, count(distinct dsid) as documents, count(distinct case when q <> '' then q end) as quotes,
  bool_or(rec) as of_record, count(*) as claims from told group by who, relation, value),
weighed as (select g.*, n_versions, least(1.0::double, (case when quotes > 0 and quotes < documents then quotes else documents end)::double / greatest(total, 2)) as corroboration,
  case when mutable and dated >= 2 and position is not null then position else 0.5::double end as recency from grouped g join totals t using (who, relation) where n_versions >= 2),
scored as (select *, case when mutable then authority * 0.45::double + corroboration * 0.13::double + directness * 0.12::double + recency * 0.30::double
  else authority * 0.45::double + corroboration * 0.25::double + directness * 0.20::double + recency * 0.10::double end as score from weighed),
versions as (select *, row_number() over (partition by who, relation order by score desc, claim_id) as place from scored)"""
_DECISIONS = f"""{_VERSIONS},
ranked as (select *, count(case when of_record then 1 end) over w as records, row_number() over (partition by who, relation order by of_record desc, place) as by_record from versions window w as (partition by who, relation)),
best as (select * from ranked where case when records = 1 then by_record = 1 else place = 1 end),
rival as (select r.*, row_number() over (partition by r.who, r.relation order by r.place) as n from ranked r join best b on b.who = r.who and b.relation = r.relation and b.value <> r.value),
deltas as (select b.who, b.relation, b.n_versions, b.records = 1 as single, b.mutable, b.value, b.display, b.score - r.score as margin, b.recency > r.recency as later,
  (b.authority - r.authority) * 0.45::double as d1, (b.corroboration - r.corroboration) * (case when b.mutable then 0.13::double else 0.25::double end) as d2,
  (b.directness - r.directness) * (case when b.mutable then 0.12::double else 0.20::double end) as d3, (b.recency - r.recency) * (case when b.mutable then 0.30::double else 0.10::double end) as d4
  from best b join rival r on r.who = b.who and r.relation = b.relation and r.n = 1),
decisions as (select *, single or margin >= 0.15 - 1e-9 as decided, case when single then 'authority' when margin < 0.15 - 1e-9 then '' when mutable and later then 'recency'
  when greatest(d1, d2, d3, d4) <= 0 then 'a combination of components' when d1 >= greatest(d2, d3, d4) then 'source authority' when d2 >= greatest(d3, d4) then 'corroboration'
  when d3 >= d4 then 'directness' else 'recency' end as basis from deltas)"""


@query(f"with {_VERSIONS} select who, relation, value, {scoring.sql_ten_thousandths('corroboration')} as corroboration_e4, documents from versions")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Independent documents behind each version."""
    rows = cf.facts(view(spark, d, "v_claim")).where("value <> ''").select("who", "relation", "value", "dsid", "quote")
    found = cf.support(stored(rows))
    return found.select("who", "relation", "value", scoring.ten_thousandths(F.col("corroboration")).alias("corroboration_e4"), "documents")


@query(f"with {_VERSIONS} select who, relation, value, display, claims, place, {scoring.sql_ten_thousandths('score')} as score_e4 from versions")
def conflict_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions of each contested fact, by trust."""
    found = cf.detect(view(spark, d, "v_claim"))[0]
    return found.select("who", "relation", "value", "display", "claims", F.col("place").cast("long").alias("place"), scoring.ten_thousandths(F.col("score")).alias("score_e4"))


@query(f"with {_DECISIONS} select who, relation, n_versions, decided, basis, {scoring.sql_ten_thousandths('margin')} as margin_e4, case when decided then value end as best_value, case when decided then display end as best_display from decisions")
def conflict_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What each contested fact comes to."""
    found = cf.detect(view(spark, d, "v_claim"))[1]
    return found.select("who", "relation", "n_versions", "decided", "basis", scoring.ten_thousandths(F.col("margin")).alias("margin_e4"), "best_value", "best_display")


_EDGES = f"""{_DECISIONS}, edges as (select {ids.sql_edge_id('CONFLICTS_WITH', 'a.claim_id', 'b.claim_id', 'a.relation')} as eid, a.claim_id as src, b.claim_id as dst, a.relation as predicate, d.decided
  from facts a join facts b on a.who = b.who and a.relation = b.relation and a.claim_id < b.claim_id and a.value <> b.value join decisions d on d.who = a.who and d.relation = a.relation
  where a.value <> '' and b.value <> '')"""


@query(f"with {_EDGES} select eid, src, dst, predicate, decided from edges")
def conflict_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between claims that contradict each other."""
    return cf.edges(view(spark, d, "v_claim")).select("eid", "src", "dst", "predicate", "decided")


@query(f"with {_VERSIONS} select a.who, a.relation, a.value as a, b.value as b, a.claims * b.claims as edges from versions a join versions b on a.who = b.who and a.relation = b.relation and a.place < b.place")
def conflict_version_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Contradicting versions, and how many edges between claims each pair stands for."""
    return cf.version_pairs(cf.detect(view(spark, d, "v_claim"))[0])


@query(f"with {_POSITION}, {_FACTS}, keys as (select distinct who, relation from facts where dsid % 11 = 0) select claim_id, dsid from facts join keys using (who, relation)")
def conflict_touched_facts(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the facts that some documents speak of."""
    claims = view(spark, d, "v_claim")
    return cf.touched(claims, claims.where("dsid % 11 = 0")).select("claim_id", "dsid")


@query(f"select {tx.sql_casefold('trim(predicate)')} as predicate, count(*) as n from {duck('v_claim')} where predicate in (select predicate from {on.sql_align('select predicate from ' + duck('v_claim'))} where relation is null) group by 1 order by n desc, 1 limit 8")
def unmapped_predicates(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent predicates outside the catalogue."""
    return cf.unmapped(view(spark, d, "v_claim"))


# ---- graph ------------------------------------------------------------------------------------------------------

_CO = f"co as (select entity, dsid, count(*) as n from {duck('v_mention')} group by entity, dsid), joined as (select entity, channel, count(*) as n from (select distinct entity, channel, dsid from {duck('v_mention')}) group by entity, channel)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = stored(view(spark, d, "v_mention"))  # read several times
    co = graph.co_occurrence(m.select("mention_id", "entity"), m.select("mention_id", "dsid"))
    return m, co, graph.participation(m.select("entity", "channel", "dsid").distinct())


@query(f"with {_CO} select entity, dsid, n from co")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each entity in each document."""
    return _graph(spark, d)[1]


@query(f"with {_CO} select entity, channel, n from joined")
def participation(spark: SparkSession, d: str) -> DataFrame:
    """Participations of each entity in each channel."""
    return _graph(spark, d)[2]


#: Ambiguous mentions: their candidates are the entity itself and the two with the next numbers.
_CANDIDATES = f"candidates as (select mention_id, dsid, channel, unnest([entity, entity + 1, entity + 2]) as entity from {duck('v_mention')})"
_SCORES = f"with {_CO}, {_CANDIDATES}, scores as (select c.mention_id, c.entity, 3 * coalesce(co.n, 0) + coalesce(joined.n, 0) as score from candidates c left join co on co.entity = c.entity and co.dsid = c.dsid left join joined on joined.entity = c.entity and joined.channel = c.channel)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    m, co, part = _graph(spark, d)
    e = F.col("entity")
    asked = m.select("mention_id", "dsid", "channel", F.explode(F.array(e, e + 1, e + 2)).alias("entity"))
    return graph.candidate_scores(asked, co, part)


@query(f"{_SCORES} select mention_id, entity, score from scores")
def graph_candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """What the graph says for each candidate."""
    return _scored(spark, d).select("mention_id", "entity", "score")


@query(f"""{_SCORES}, named as (select s.*, s_name as name from scores s join supplier on s_suppkey = entity),
ranked as (select *, row_number() over w as place, lead(score) over w as next from named window w as (partition by mention_id order by score desc, name, entity))
select mention_id, case when score > 0 and score > coalesce(next, 0) then entity end as entity, case when score > 0 and score > coalesce(next, 0) then 'graph_evidence' else 'unresolved' end as method,
  case when score > 0 and score > coalesce(next, 0) then {scoring.sql_ten_thousandths('0.5::double + 0.45::double * ((score - coalesce(next, 0))::double / score)')} else 0 end as confidence_e4 from ranked where place = 1""")
def tier3_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The entity that the graph prefers, or none."""
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))
    return graph.graph_tier(_scored(spark, d), names).select("mention_id", "entity", "method", scoring.ten_thousandths(F.col("confidence")).alias("confidence_e4"))


_PROPOSE_NAMES = "select s_suppkey as entity, p_name as name from supplier join part on p_partkey = s_suppkey"
_ASKING = f"asking as (select mention_id, dsid, channel, substr(p_name, 1, 1) || substr(p_name, 3, 2) as token from {duck('v_mention')} join part on p_partkey = channel)"


@query(f"""with {_CO}, {_ASKING}, near as (select mention_id, token, co.entity from asking a join co on co.dsid = a.dsid union select mention_id, token, joined.entity from asking a join joined on joined.channel = a.channel),
fits as (select mention_id, n.entity from near n join ({_PROPOSE_NAMES}) e on e.entity = n.entity where length(token) >= 3 and starts_with({tx.sql_casefold('name')}, substr({tx.sql_casefold('token')}, 1, 1))
  and {tx.sql_is_short_form('token', 'name')} and not list_contains({tx.sql_name_tokens('name')}, {tx.sql_casefold('token')}))
select mention_id, min(entity) as entity, 'graph_proposed' as method, 7000 as confidence_e4 from fits group by mention_id having count(*) = 1""")
def propose_structure(spark: SparkSession, d: str) -> DataFrame:
    """Short forms that the structure around them explains."""
    m, co, part = _graph(spark, d)
    parts = table(spark, d, "part")
    name = F.col("p_name")
    asking = m.join(parts, F.col("channel") == F.col("p_partkey")).select("mention_id", "dsid", "channel", F.concat(F.substring(name, 1, 1), F.substring(name, 3, 2)).alias("token"))
    entities = table(spark, d, "supplier").join(parts, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("entity"), name.alias("name"))
    out = graph.propose(asking, co, part, entities)
    return out.select("mention_id", "entity", "method", scoring.ten_thousandths(F.col("confidence")).cast("int").alias("confidence_e4"))


@query(f"""with r as (select * from {duck('v_reference')}), first as (select a.dsid as anchor, b.dsid, min(a.ticket) as ticket from r a join r b on a.ticket = b.ticket and a.dsid <> b.dsid group by a.dsid, b.dsid)
select anchor, dsid, ticket, place from (select *, row_number() over (partition by anchor order by ticket, dsid) as place from first) where place <= 6""")
def ticket_related(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a ticket with some documents, the first six of each."""
    refs = view(spark, d, "v_reference")
    out = graph.related_by_ticket(refs.select("dsid"), refs)
    return out.select("anchor", "dsid", "ticket", F.col("place").cast("long").alias("place"))


@query(f"select ticket, count(distinct dsid) as documents from {duck('v_reference')} group by ticket having count(distinct dsid) >= 2")
def shared_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets that join documents."""
    return graph.shared_tickets(view(spark, d, "v_reference"))


@query(f"""with {_EDGES}, both_ways as (select src as claim_id, dst as other, predicate, decided from edges union all select dst, src, predicate, decided from edges)
select distinct e.claim_id, e.other, e.predicate, e.decided, c.object as other_object, c.dsid as other_dsid from both_ways e join {duck('v_claim')} c on c.claim_id = e.other""")
def contested_claims(spark: SparkSession, d: str) -> DataFrame:
    """The rivals of used claims, whichever way the edge points."""
    claims = view(spark, d, "v_claim")
    return graph.contested(claims, cf.edges(claims), claims).select("claim_id", "other", "predicate", "decided", "other_object", "other_dsid")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    claims = view(spark, d, "v_claim")
    spans_ = claims.select((F.col("claim_id") * 2).alias("span_id"), "quote")
    return graph.evidence(claims.select("dsid"), claims.select("dsid", "claim_id"), claims.select("claim_id", "subject", "object"), claims.select("claim_id", (F.col("claim_id") * 2).alias("span_id")), spans_)


@query(f"select dsid, claim_id, claim_id * 2 as span_id, subject, object, quote from {duck('v_claim')}")
def evidence_path(spark: SparkSession, d: str) -> DataFrame:
    """Documents, their claims and the spans behind them."""
    return _evidence(spark, d).select("dsid", "claim_id", "span_id", "subject", "object", "quote")


_E = f"e as (select cast(dsid as varchar) as d, cast(claim_id as varchar) as c, cast(claim_id * 2 as varchar) as s, object, quote from {duck('v_claim')})"


@query(f"""with {_E} select 'document' as kind, d as id, d as label, null as src, null as dst from e union select 'claim', c, object, null, null from e union select 'span', s, quote, null, null from e
union select 'ASSERTS', null, null, d, c from e union select 'SUPPORTED_BY', null, null, c, s from e""")
def evidence_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of that evidence."""
    nodes, edges = graph.subgraph(_evidence(spark, d))
    return nodes.unionByName(edges, allowMissingColumns=True)


@query(f"""with m as (select distinct entity, channel from {duck('v_mention')}),
one as (select distinct entity, channel, 1 as hops from m where entity <= 3),
three as (select distinct a.entity, c.channel, 3 as hops from m a join m b on a.channel = b.channel join m c on c.entity = b.entity where a.entity <= 3)
select entity, channel, min(hops) as hops from (select * from one union all select * from three) where channel <= 50 group by entity, channel""")
def bounded_paths(spark: SparkSession, d: str) -> DataFrame:
    """Fewest steps between some entities and some channels, at most four."""
    m = stored(view(spark, d, "v_mention").select("entity", "channel"))  # read in each step
    edges = m.select(F.concat(F.lit("e"), F.col("entity").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("channel").cast("string")).alias("dst"))
    starts = m.where("entity <= 3").select(F.concat(F.lit("e"), F.col("entity").cast("string")).alias("id")).distinct()
    goals = m.where("channel <= 50").select(F.concat(F.lit("c"), F.col("channel").cast("string")).alias("id")).distinct()
    out = graph.shortest_paths(edges, starts, goals)
    return out.select(F.expr("cast(substring(start, 2) as bigint)").alias("entity"), F.expr("cast(substring(goal, 2) as bigint)").alias("channel"), "hops")


# ---- tables -----------------------------------------------------------------------------------------------------

@query(f"select s_suppkey as id, case when s_suppkey % 2 = 0 then upper(s_name) else s_name end as name, s_nationkey as nation from supplier union all select s_suppkey + 1000000, upper(s_name), null from supplier where s_suppkey % 4 = 0")
def vertex_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vertices after a merge that sets one property of some and adds others."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    new = s.where("id % 2 = 0").select("id", F.upper("name").alias("name")).unionByName(s.where("id % 4 = 0").select((F.col("id") + 1000000).alias("id"), F.upper("name").alias("name")))
    return tables.merge(s, new, "id", ["name"])


@query(f"select {ids.sql_edge_id('REFERENCES', 'dsid', 'ticket')} as eid, dsid as src, ticket as dst from {duck('v_reference')} where dsid % 3 = 0 and ticket in (select p_partkey from part where p_size < 25) or dsid % 3 = 1 and ticket % 2 = 0")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Edges after a merge that leaves out those without both ends."""
    refs = view(spark, d, "v_reference").select(ids.edge_id("REFERENCES", F.col("dsid"), F.col("ticket")).alias("eid"), F.col("dsid").alias("src"), F.col("ticket").alias("dst"))
    old = refs.where("src % 3 = 1 and dst % 2 = 0")
    sources = refs.where("src % 3 = 0").select(F.col("src").alias("id")).distinct()
    targets = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"))
    return tables.merge_edges(old, refs, sources, targets, [])


@query(f"with {_EDGES} select eid from edges where src % 2 = 0")
def edge_prune(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a narrower set of claims no longer supports."""
    current = cf.edges(view(spark, d, "v_claim")).select("eid", "src")
    return cf.stale(current, current.where("src % 2 <> 0")).select("eid")


@query("select s_suppkey as id from supplier where s_suppkey % 6 <> 0")
def superseded_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Entities that no merge has superseded."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return tables.live(s, s.where("id % 6 = 0").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst")))


@query(f"select mention_id, case when entity % 6 = 0 then entity - 1 else entity end as entity from {duck('v_mention')}")
def repointed_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Resolutions after merges."""
    moved = table(spark, d, "supplier").where("s_suppkey % 6 = 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") - 1).alias("dst"))
    return resolve.repointed(view(spark, d, "v_mention").select("mention_id", "entity"), moved)


# ---- resolution -------------------------------------------------------------------------------------------------

def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """A named mention with an address for each person, of whom several share one."""
    p = view(spark, d, "v_person")
    return p.select(F.col("person_id").alias("mention_id"), F.col("person_id").alias("dsid"), F.lit(0).alias("start"), F.col("name").alias("surface"), F.lit("person").alias("kind"), "email", F.concat(F.lit("c"), (F.col("person_id") % 10).cast("string")).alias("channel"))


_PEOPLE = f"people as (select 'email:' || email as key, arg_min(name, person_id) as name, email, count(*) as documents from {duck('v_person')} group by email)"


@query(f"with {_PEOPLE} select key, name, email, documents from people")
def person_assembly(spark: SparkSession, d: str) -> DataFrame:
    """People from the addresses that documents mention."""
    return resolve.people(_mentions(spark, d)).select("key", "name", F.element_at("emails", 1).alias("email"), F.size("documents").cast("long").alias("documents"))


@query()
def person_merge(spark: SparkSession, d: str) -> DataFrame:
    """People of one name and organisation, and the key that they go under."""
    return resolve.same_person(resolve.people(_mentions(spark, d)))


_TOK = lambda x: tx.sql_name_tokens(x)
_TIERS = f"""{_PEOPLE}, known as (select key, list_sort(list_distinct(list_concat({_TOK('name')}, {_TOK("split_part(email, '@', 1)")}))) as tokens, email from people),
asked as (select person_id as mention_id, case when person_id % 3 = 1 then split_part(name, ' ', 1) else name end as surface, case when person_id % 3 = 0 then email end as email from {duck('v_person')}),
met as (select surface, key, {_TOK('surface')} = tokens as exact from (select distinct surface from asked), known where len({_TOK('surface')}) > 0 and list_has_all(tokens, {_TOK('surface')})),
found as (select surface, count(*) as n, min(key) as one, bool_or(exact) as exact from met group by surface),
tiers as (select mention_id, a.surface, case when k.key is not null then k.key when n = 1 then one end as key,
  case when k.key is not null then 'strong_key' when n = 1 and exact then 'token_set_exact' when n = 1 then 'token_subset_unique' else 'unresolved' end as method,
  case when k.key is not null then 10000 when n = 1 and exact then 9500 when n = 1 then 8500 else 0 end as confidence_e4, case when k.key is not null then 1 else coalesce(n, 0) end as candidates
  from asked a left join known k on k.email = a.email left join found f on f.surface = a.surface)"""


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    persons = resolve.people(_mentions(spark, d))
    k = F.col("person_id") % 3
    asked = view(spark, d, "v_person").select(F.col("person_id").alias("mention_id"), F.when(k == 1, F.substring_index("name", " ", 1)).otherwise(F.col("name")).alias("surface"), F.lit("person").alias("kind"), F.when(k == 0, F.col("email")).alias("email"))
    return resolve.tiers(asked, persons)


@query(f"with {_TIERS} select mention_id, key, method, confidence_e4, candidates from tiers")
def tier12_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that an address or a unique name resolves."""
    return _tiers(spark, d).select("mention_id", "key", "method", scoring.ten_thousandths(F.col("confidence")).cast("int").alias("confidence_e4"), "candidates")


@query(f"with {_TIERS} select surface, count(*) as occurrences, max(candidates) as candidates from tiers where method = 'unresolved' and candidates > 1 group by surface")
def ambiguous_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces that several people could be."""
    return resolve.ambiguous(_tiers(spark, d))


@query(f"with {_TIERS} select method, count(*) as n from tiers group by method")
def method_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How mentions were resolved."""
    return _tiers(spark, d).groupBy("method").agg(F.count("*").alias("n"))


# ---- parsing ----------------------------------------------------------------------------------------------------

#: Texts of four kinds: mails over whole documents, chats of all conversations, meetings of suppliers, structured documents.
_WRITTEN = """select doc_id * 4 as doc_id, 'gmail' as source_type, 'mail' as title, concat('From: "Ann ', lang, '" <Ann.', cast(doc_id as string), '@Redwood.com>\\nTo: x', cast(doc_id as string), '@acme.io, Bo Li <bo@x.io>\\nDate: 2025-03-27\\nSubject: PROJ-', cast(doc_id as string), '\\n\\n', coalesce(text, ''), ' see https://x.io/', cast(doc_id as string), ',') as body from {documents}
union all select conv_id * 4000 + turn * 4 + 1, 'slack', concat(' c', cast(conv_id as string), ' '), concat(role, ': ', coalesce(text, ''), '\\n```\\nzed: no @zed\\n```\\ndeploy-bot: done @sam') from {conversations}
union all select s_suppkey * 4 + 2, 'fireflies', 'meeting', concat('Date: 2025-01-02\\nDuration: 6 minutes\\nAttendees: ', s_name, ' (Redwood Sales Lead); Bare Name; Cut Of...; Eve (N', cast(s_nationkey as string), ')') from {supplier}
union all select doc_id * 4 + 3, 'jira', 'ticket', concat('description:\\nword ', lang, '\\nsummary: inline\\ntasks:\\n\\nnotes:\\n', lang, ' INC-7 http://a.b/(c) ', source) from {documents}"""
_WRITTEN_SQL = "select doc_id, source_type, title, replace(body, '\\n', chr(10)) as body from (" + re.sub(r"\{(\w+)\}", r"\1", _WRITTEN).replace("\\\\n", "\\n").replace("coalesce(text, '')", "replace(coalesce(text, ''), '\\n', ' ')") + ")"


def _written(spark: SparkSession, d: str) -> DataFrame:
    sql = _WRITTEN.replace("coalesce(text, '')", "replace(coalesce(text, ''), '\\\\n', ' ')")
    return spark.sql(sql, **{t: table(spark, d, t) for t in ("documents", "conversations", "supplier")})


_CHAT = "chat as (select doc_id, regexp_replace(body, '(?s)```.*?```', chr(1), 'g') as b from w where source_type = 'slack')"


@query(f"""with w as ({_WRITTEN_SQL}), {_CHAT},
said as (select doc_id as dsid, unnest(regexp_extract_all(b, '(?m)^([a-z0-9][a-z0-9._-]{{1,30}}):[ \\t]', 1)) as surface, 'speaker' as role from chat
  union all select doc_id, unnest(regexp_extract_all(b, '@([a-z0-9][a-z0-9._-]{{1,30}})', 1)), 'at_mention' from chat),
m as (select dsid, surface, case when surface like '%bot' or len(list_intersect(regexp_split_to_array(surface, '[^a-z]+'), [{tx.quoted(tx.BOT_TOKENS)}])) > 0 then 'bot' else 'person' end as kind, role, null as email from said
  union all select doc_id, regexp_extract(body, 'From: "([^"]*)"', 1), 'person', 'email_from', lower(regexp_extract(body, '<([^>]*)>', 1)) from w where source_type = 'gmail'
  union all select doc_id, regexp_extract(body, 'To: ([^,]*),', 1), 'person', 'email_to', regexp_extract(body, 'To: ([^,]*),', 1) from w where source_type = 'gmail'
  union all select doc_id, 'Bo Li', 'person', 'email_to', 'bo@x.io' from w where source_type = 'gmail'
  union all select doc_id, unnest([regexp_extract(body, 'Attendees: (.*) .Redwood', 1), 'Bare Name', 'Eve']), 'person', 'attendee', null from w where source_type = 'fireflies')
select dsid, surface, kind, role, email, count(*) as n from m group by all""")
def parse_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions in mails, chats and meetings, each verified at its place."""
    found = parsing.mentions_of(parsing.parse_documents(_written(spark, d)), cap=1 << 30)
    return found.groupBy("dsid", "surface", "kind", "role", "email").agg(F.count("*").alias("n"))


@query(f"""with w as ({_WRITTEN_SQL}) select doc_id, unnest(['date', 'subject']) as name, unnest(['2025-03-27', regexp_extract(body, 'Subject: (.*)', 1)]) as value from w where source_type = 'gmail'
union all select doc_id, 'channel', trim(title) from w where source_type = 'slack'
union all select doc_id, unnest(['date', 'duration', 'organisations']), unnest(['2025-01-02', '6 minutes', array_to_string(list_sort(['Redwood', regexp_extract(body, 'Eve .(N[0-9]+)', 1)]), ';')]) from w where source_type = 'fireflies'
union all select doc_id, unnest(['blocks', 'block_description_chars', 'block_notes_chars']), unnest(['description;tasks;notes', cast(length(regexp_extract(body, '^description:.(word [^' || chr(10) || ']*.summary: inline)', 1, 's')) as varchar), cast(length(split_part(body, 'notes:' || chr(10), 2)) as varchar)]) from w where source_type = 'jira'""")
def parse_attributes(spark: SparkSession, d: str) -> DataFrame:
    """What the parsers say of whole documents."""
    return parsing.parse_documents(_written(spark, d)).select("doc_id", F.explode("attributes").alias("name", "value"))


@query(f"""with w as ({_WRITTEN_SQL}), r as (select doc_id, unnest(regexp_extract_all(body, '\\b[A-Z]{{2,10}}-[0-9]{{1,6}}\\b')) as target, 'ticket' as kind from w
  union all select doc_id, rtrim(unnest(regexp_extract_all(body, 'https?://[^\\s<>()\\[\\]{{}}"'']+')), '.,);'), 'url' from w)
select doc_id, target, kind, count(*) as n from r group by all""")
def url_refs(spark: SparkSession, d: str) -> DataFrame:
    """Ticket keys and URLs that documents point at."""
    parsed = parsing.parse_documents(_written(spark, d))
    return parsed.select("doc_id", F.explode("references").alias("r")).groupBy("doc_id", "r.target", "r.kind").agg(F.count("*").alias("n"))


_KEYS = "select event_id, upper(concat(case event_id % 6 when 0 then 'PROJ' when 1 then 'AES' when 2 then 'inc' when 3 then 'Eng' when 4 then 'FY' else 'CVE' end, '-', cast(1980 + event_id % 150 as varchar))) as key from events"


@query(f"""select event_id, key from ({_KEYS}) where split_part(key, '-', 1) not in ({tx.quoted(tx.NOT_TICKETS)})
and not (split_part(key, '-', 1) in ({tx.quoted(tx.DATE_PREFIXES)}) and split_part(key, '-', 2)::int between 1990 and 2100)""")
def ticket_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are tickets and not look-alikes or dates."""
    k = F.col("event_id") % 6
    prefix = F.when(k == 0, "PROJ").when(k == 1, "AES").when(k == 2, "inc").when(k == 3, "Eng").when(k == 4, "FY").otherwise("CVE")
    key = F.concat(prefix, F.lit("-"), (F.lit(1980) + F.col("event_id") % 150).cast("string"))
    return table(spark, d, "events").select("event_id", F.explode(tx.ticket_keys(F.array(key))).alias("key"))


_EXTRACTED = """select o_orderkey as claim_id, case when o_orderkey % 11 = 0 then null else 'order' end as subject, 'has status' as predicate, o_orderstatus as object,
  case o_orderkey % 7 when 0 then '' when 1 then 'not there' else o_orderstatus || ' of' end as evidence_span,
  case o_orderkey % 5 when 0 then '0.8' when 1 then 'high' when 2 then '1.4' else '1' end as confidence, 'The state ' || o_orderstatus || ' of ' || o_orderpriority as text from orders"""


@query(f"""select claim_id, reason, case when reason is null then instr(text, evidence_span) - 1 end as span_start, case when reason is null then instr(text, evidence_span) - 1 + length(evidence_span) end as span_end from (
  select *, case when subject is null then 'missing_field' when trim(evidence_span) = '' then 'empty_span' when try_cast(confidence as double) is null then 'confidence_not_numeric'
    when try_cast(confidence as double) not between 0 and 1 then 'confidence_out_of_range' when instr(text, evidence_span) = 0 then 'span_not_verbatim' end as reason from ({_EXTRACTED}))""")
def span_validation(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose quote stands in the text, and why the others do not count."""
    rows = spark.sql(_EXTRACTED.replace("from orders", "from {orders}"), orders=table(spark, d, "orders"))
    return spans.validate(rows).select("claim_id", "reason", "span_start", "span_end")


# ---- answers and scores -----------------------------------------------------------------------------------------

def _answers(spark: SparkSession, d: str) -> DataFrame:
    claims = view(spark, d, "v_claim")
    used = claims.withColumn("qid", F.col("claim_id") % 100)
    w = Window.partitionBy("qid").orderBy("claim_id")
    rows = used.withColumn("place", F.row_number().over(w) - 1).withColumn("evidence_id", F.concat(F.lit("e"), F.col("place").cast("string")))
    rows = stored(rows.where(F.col("place") < an.EVIDENCE))
    questions = claims.select((F.col("claim_id") % 110).alias("qid")).distinct()
    said = an.first_evidence(rows)
    cited = said.select("qid", F.explode("used").alias("evidence_id")).join(rows, ["qid", "evidence_id"])
    # only facts that a cited claim is about can be disputed; recency still ranks all documents
    disputes = cf.edges(cf.touched(claims, cited.select("dsid")), ordering=cf.recency(claims))
    return an.judge(questions, rows, said, disputes, claims)


@query(f"""with {_EDGES}, both_ways as (select src as claim_id, dst as other from edges union all select dst, src from edges),
used as (select qid, claim_id, dsid, object, subject, predicate from (select *, claim_id % 100 as qid, row_number() over (partition by claim_id % 100 order by claim_id) as n from {duck('v_claim')}) where n <= 3),
fought as (select distinct u.qid from used u join both_ways b on b.claim_id = u.claim_id),
spoken as (select qid, count(*) as n_used, count(distinct dsid) as cited from used group by qid)
select q.qid, case when n_used is null then 'insufficient' when f.qid is not null then 'conflicting' else 'supported' end as answerability,
  case when n_used is null then 0 when f.qid is not null then {scoring.sql_ten_thousandths('least(0.6::double, least(0.95::double, 0.4::double + 0.1::double * cited + 0.05::double * least(n_used, 6)))')}
  else {scoring.sql_ten_thousandths('least(0.95::double, 0.4::double + 0.1::double * cited + 0.05::double * least(n_used, 6))')} end as confidence_e4
from (select distinct claim_id % 110 as qid from {duck('v_claim')}) q left join spoken t using (qid) left join fought f using (qid)""")
def answer_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Supported, conflicting or insufficient, and how sure."""
    return _answers(spark, d).select("qid", "answerability", scoring.ten_thousandths(F.col("confidence")).alias("confidence_e4"))


@query("select 'document' as label, count(*) as n from documents union all select 'entity', count(*) from supplier union all select 'mention', count(*) from lineitem union all select 'ticket', count(*) from part")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each label."""
    parts = [table(spark, d, t).agg(F.lit(n).alias("label"), F.count("*").alias("n")) for n, t in (("document", "documents"), ("entity", "supplier"), ("mention", "lineitem"), ("ticket", "part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


#: A clustering to judge: parts of one brand are one person, the system sees type and half of the brand.
_CLUSTERS = "select p_partkey as id, p_brand as gold, concat(substr(p_brand, 1, 7), p_size % 2) as system from part"
_CELLS = f"c as (select system, gold, count(*) as n from ({_CLUSTERS}) group by system, gold), s as (select system, sum(n) as ns from c group by system), g as (select gold, sum(n) as ng from c group by gold)"


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("gold"), F.concat(F.substring("p_brand", 1, 7), (F.col("p_size") % 2).cast("string")).alias("system"))


@query(f"""with {_CELLS}, one as (select (select sum(n * (n - 1) // 2) from c) as tp, (select sum(ns * (ns - 1) // 2) from s) as sp, (select sum(ng * (ng - 1) // 2) from g) as gp)
select tp::bigint as tp, (sp - tp)::bigint as fp, (gp - tp)::bigint as fn, floor(tp / sp * 10000 + 0.5 + 1e-9)::bigint as precision_e4, floor(tp / gp * 10000 + 0.5 + 1e-9)::bigint as recall_e4 from one""")
def pairwise_prf(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall over pairs of mentions."""
    r = ev.pairwise(_clusters(spark, d))
    e4 = scoring.ten_thousandths
    return r.select(F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), e4(F.col("precision")).alias("precision_e4"), e4(F.col("recall")).alias("recall_e4"))


@query(f"""with {_CELLS} select floor(sum(n::double * n / ns) / sum(n) * 10000 + 0.5 + 1e-9)::bigint as precision_e4, floor(sum(n::double * n / ng) / sum(n) * 10000 + 0.5 + 1e-9)::bigint as recall_e4 from c join s using (system) join g using (gold)""")
def bcubed_prf(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall averaged over mentions."""
    r = ev.bcubed(_clusters(spark, d))
    return r.select(scoring.ten_thousandths(F.col("precision")).alias("precision_e4"), scoring.ten_thousandths(F.col("recall")).alias("recall_e4"))


@query(f"select system, count(distinct gold) as people, count(*) as mentions from ({_CLUSTERS}) group by system having count(distinct gold) > 1")
def false_merge_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that hold several people."""
    return ev.false_merges(_clusters(spark, d))


@query(f"select gold, count(distinct system) as clusters, count(*) as mentions from ({_CLUSTERS}) group by gold having count(distinct system) > 1")
def split_identities(spark: SparkSession, d: str) -> DataFrame:
    """People who are in several clusters."""
    return ev.splits(_clusters(spark, d))


@query("""select count(*) as n, floor(avg(case when answerable then (case when abstained then 0.0 else 1.0 end) end) * 10000 + 0.5 + 1e-9)::bigint as answer_e4,
  floor(avg(case when not answerable then (case when abstained then 1.0 else 0.0 end) end) * 10000 + 0.5 + 1e-9)::bigint as abstain_e4 from (select o_orderstatus <> 'F' as answerable, o_orderkey % 4 = 0 as abstained from orders)""")
def abstention_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often answering and declining are right."""
    rows = table(spark, d, "orders").select((F.col("o_orderstatus") != "F").alias("answerable"), (F.col("o_orderkey") % 4 == 0).alias("abstained"))
    r = ev.abstention(rows)
    return r.select("n", scoring.ten_thousandths(F.col("answer_rate")).alias("answer_e4"), scoring.ten_thousandths(F.col("abstain_rate")).alias("abstain_e4"))


@query("""select event_type, value from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) where i = least(floor(0.95 * n)::bigint, n - 1)""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile of each kind of event, as the reports index it."""
    return ev.percentile_at(table(spark, d, "events").select("event_type", "value"), "event_type", "value", 0.95)


@query(f"with {_EDGES} select count(*) as edges, 0 as missing, 0 as surplus from edges")
def incremental_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Edges after two batches against edges of one: none is missing, none is surplus."""
    claims = view(spark, d, "v_claim")
    names = ["eid", "src", "dst", "predicate", "subject", "decided", "margin"]
    first = cf.edges(claims.where("dsid % 2 = 0")).select(*names)
    after = cf.reconcile(claims, claims.where("dsid % 2 <> 0").select("dsid"), first)
    whole = cf.edges(claims).select("eid", "decided")
    a, b = after.select("eid", "decided").withColumn("a", F.lit(1)), whole.withColumn("b", F.lit(1))
    both = a.join(b, ["eid", "decided"], "full_outer")
    none = lambda c: F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("int")
    return both.agg(F.count("b").alias("edges"), none("a").alias("missing"), none("b").alias("surplus"))


# ---- identities in evaluation, recorded decisions, reports ------------------------------------------------------

_WORDS = lambda x: f"list_sort(list_distinct(list_filter(regexp_split_to_array(translate({tx.sql_casefold(x)}, '{idn.MARKED}', '{idn.PLAIN}'), '[^a-z]+'), lambda t: length(t) > 1 and t not in ({tx.quoted(idn.HONORIFICS)}))))"
_LETTERS = lambda x: f"regexp_replace(translate({tx.sql_casefold(x)}, '{idn.MARKED}', '{idn.PLAIN}'), '[^a-z]', '', 'g')"


def _name_keys(key: str, name: str, source: str, where: str = "true") -> str:
    return f"select {key}, 'words:' || array_to_string({_WORDS(name)}, ' ') as k from {source} where len({_WORDS(name)}) >= 2 and {where} union select {key}, 'letters:' || {_LETTERS(name)} from {source} where len({_WORDS(name)}) >= 2 and {where}"


_MATCH = f"""with people as (select distinct lower(email) as email, name from {duck('v_person')}),
entities as (select person_id as entity, name, email from {duck('v_person')}),
pk as (select email as person, 'email:' || email as k from people union {_name_keys('email as person', 'name', 'people')} union {_name_keys('email as person', "split_part(email, '@', 1)", 'people')}),
own as (select k, min(person) as person from pk group by k having count(distinct person) = 1),
ek as (select entity, 'email:' || lower(email) as k from entities union {_name_keys('entity', 'name', 'entities', "email like '%@redwood%'")} union {_name_keys('entity', "split_part(email, '@', 1)", 'entities', "email like '%@redwood%'")}),
hits as (select entity, count(distinct person) as hits, min(person) as person from ek join own using (k) group by entity)"""


@query(f"{_MATCH} select entity, case when hits = 1 then person end as person, coalesce(hits, 0) as hits from (select entity from entities) left join hits using (entity)")
def identity_match(spark: SparkSession, d: str) -> DataFrame:
    """The person of a directory that each observed entity is, or none."""
    p = view(spark, d, "v_person")
    directory = p.select(F.lower("email").alias("email"), "name").distinct()
    entities = p.select(F.col("person_id").alias("entity"), "name", F.array("email").alias("emails"))
    return idn.matched(entities, directory)


@query(f"""with e as (select p_brand as entity, {_WORDS("replace(p_name, ' ', '.')")} as w from part),
apart as (select distinct a.entity from e a join e b on a.entity = b.entity and len(a.w) >= 2 and len(b.w) >= 2 and not list_has_all(a.w, b.w) and not list_has_all(b.w, a.w))
select entity, count(distinct w) filter (len(w) >= 2) as spellings from e where entity in (select entity from apart) group by entity""")
def disagreement_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose addresses spell different names."""
    emails = F.array_sort(F.collect_set(F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("@x.com")))).alias("emails")
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("entity")).agg(emails)
    return idn.disagreements(rows).select("entity", F.col("spellings").cast("long").alias("spellings"))


def _supplier_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))


@query(f"""{_SCORES}, named as (select s.*, s_name as name from scores s join supplier on s_suppkey = entity)
select {ids.sql_edge_id('CANDIDATE_FOR', 'mention_id', 'entity')} as eid, mention_id, entity, score, row_number() over (partition by mention_id order by score desc, name, entity) as place from named""")
def candidate_edges(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that the graph weighed, as edges."""
    rows = rec.candidate_edges(_scored(spark, d), _supplier_names(spark, d))
    return rows.select("eid", "mention_id", "entity", "score", F.col("place").cast("long").alias("place"))


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    scored, names = _scored(spark, d), _supplier_names(spark, d)
    n = F.count("*").alias("candidates")
    none = F.lit(None).cast("long").alias("entity")
    tiers = scored.groupBy("mention_id").agg(n).select("mention_id", none, F.lit("unresolved").alias("method"), F.lit(0.0).alias("confidence"), "candidates")
    proposed = scored.limit(0).select("mention_id", "entity", F.lit("graph_proposed").alias("method"), F.lit(0.7).alias("confidence"))
    return rec.record(tiers, graph.graph_tier(scored, names), proposed)


@query(f"""{_SCORES}, named as (select s.*, s_name as name from scores s join supplier on s_suppkey = entity),
ranked as (select *, row_number() over w as place, lead(score) over w as next from named window w as (partition by mention_id order by score desc, name, entity)),
won as (select mention_id, entity from ranked where place = 1 and score > 0 and score > coalesce(next, 0))
select case when w.entity is null then 'unresolved' else 'resolved' end as status, case when w.entity is null then 'unresolved' else 'graph_evidence' end as method, count(*) as n
from (select distinct mention_id from scores) m left join won w using (mention_id) group by 1, 2""")
def resolution_report(spark: SparkSession, d: str) -> DataFrame:
    """Recorded decisions by status and method."""
    return reports.resolution(_recorded(spark, d)).select("status", "method", "n")


@query(f"""with {_EDGES} select 'no_edge_missing' as "check", count(*) filter (src % 10 = 0) as n from edges union all select 'no_edge_surplus', count(*) from region
union all select c, 0 from (values ('resolution_explained'), ('nothing_pending'), ('entity_is_edge_target'), ('one_identity_per_organisation')) v(c)""")
def gate_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the store must keep, over edges of which some were lost and some are of no conflict."""
    recorded = stored(_recorded(spark, d))
    persons = resolve.people(_mentions(spark, d))
    merged = resolve.merged(persons, resolve.same_person(persons))
    entities = merged.select(F.col("key").alias("entity"), "name", "emails")
    found = stored(cf.edges(view(spark, d, "v_claim")).select("eid", "src"))
    kept = found.where("src % 10 <> 0").select("eid").unionByName(table(spark, d, "region").select((-F.col("r_regionkey") - 1).cast(found.schema["eid"].dataType).alias("eid")))
    return rec.violations(recorded, rec.resolves_to(recorded), entities, found.select("eid"), kept)


@query("select event_type as model, count(*) as calls, sum(user_id)::bigint as input_tokens, sum(event_id)::bigint as output_tokens from events group by event_type")
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and tokens of each model."""
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return reports.usage(calls)


@query("select event_id, row_number() over (partition by event_type order by event_id) as place from events qualify place <= 400")
def mention_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first mentions of each document, up to the cap."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("dsid"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), F.lit("s").alias("surface"), "event_id")
    kept = resolve.capped(rows)
    w = Window.partitionBy("dsid").orderBy("start")
    return kept.select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("""with v as (select o_custkey, count(*) filter (o_orderstatus = 'F') as f, count(*) as n from orders group by o_custkey)
select o_custkey as question, f::double / n >= 0.5 as passed from v""")
def verdict_tally(spark: SparkSession, d: str) -> DataFrame:
    """Whether enough runs of each question ended in an allowed verdict."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderstatus").alias("verdict"), F.array(F.lit("F")).alias("allowed"))
    return ev.verdict_shares(rows, 0.5).select("question", "passed")


@query("""with m as (select p_type as method, concat(substr(p_brand, 1, 7), p_size % 2) as system, p_brand as gold from part),
cells as (select system, gold, count(*) as n from m group by system, gold), main as (select system, gold as main from cells qualify row_number() over (partition by system order by n desc, gold desc) = 1)
select method, count(*) as n, count(*) filter (gold = main) as "right" from m join main using (system) group by method""")
def precision_by_method(spark: SparkSession, d: str) -> DataFrame:
    """How often each method is with its cluster's main person."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("method"), F.concat(F.substring("p_brand", 1, 7), (F.col("p_size") % 2).cast("string")).alias("system"), F.col("p_brand").alias("gold"))
    return ev.precision_by_method(rows).select("method", "n", F.col("right").cast("long").alias("right"))


# ---- runs, validation, written tables, reports ------------------------------------------------------------------

@query("select run_id, count(*) as n from (select o_orderstatus as run_id from orders) where run_id = (select max(o_orderstatus) from orders) group by run_id")
def latest_run_only(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the latest run, of a table stored by run."""
    path = f"{shared_dir(spark)}/attestor/{uuid.uuid4().hex}/orders"
    table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("run_id")).write.partitionBy("run_id").parquet(path)
    return tables.of_run(spark.read.parquet(path)).groupBy("run_id").agg(F.count("*").alias("n"))


@query(f"select claim_id, 'timestamp' as field, 'null' as problem from {duck('v_claim')} where timestamp is null union all select claim_id, 'names', 'nested' from {duck('v_claim')}")
def unstorable_rows(spark: SparkSession, d: str) -> DataFrame:
    """Properties that a store of scalars refuses."""
    return tables.unstorable(view(spark, d, "v_claim").withColumn("names", F.array("subject")), "claim_id")


@query(f"with {_TOKENS} select (select count(*) from tf) as postings, (select count(distinct term) from tf) as terms, (select count(distinct id) from tf) as documents, true as has_files")
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What a written index holds."""
    path = f"{shared_dir(spark)}/attestor/{uuid.uuid4().hex}/index"
    lexical.write_index(lexical.postings(view(spark, d, "v_doc")), path)
    return lexical.index_statistics(spark, path).select("postings", "terms", "documents", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("has_files"))


@query("select l_partkey as dsid, l_returnflag as handle, count(distinct l_suppkey) as entities from lineitem group by all having count(distinct l_suppkey) > 1")
def inconsistent_handles(spark: SparkSession, d: str) -> DataFrame:
    """Handles that stand for several entities in one document."""
    return ev.inconsistent_handles(table(spark, d, "lineitem").select(F.col("l_partkey").alias("dsid"), F.col("l_returnflag").alias("handle"), F.col("l_suppkey").alias("entity")))


@query("select doc_id, length(text) as chars from documents order by length(text) desc nulls last, doc_id limit 50")
def longest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that extraction takes first."""
    return corpus.longest_first(table(spark, d, "documents"), "text", "doc_id", 50).select("doc_id", F.length("text").cast("long").alias("chars"))


@query(f"""with {_DECISIONS}, spoken as (select who, relation, value, list_sort(list(distinct dsid)) as ds, list_sort(list(distinct source_type)) as ss from told group by all),
rows_ as (select v.who, v.relation, v.place, v.display || '|' || array_to_string(t.ds, ',') || '|' || array_to_string(t.ss, ',') || '|' || v.claims || '|' || (d.decided and d.value = v.value) as said, d.decided, d.basis, d.mutable
  from versions v join spoken t using (who, relation, value) join decisions d using (who, relation))
select who, relation, any_value(mutable) as mutable, any_value(decided) as decided, any_value(basis) as basis, any_value(basis) = 'recency' as supersession, string_agg(said, '/' order by place) as versions from rows_ group by who, relation""")
def conflict_contract(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts as reports hand them on, the nested versions spelled out."""
    rows = cf.contract(view(spark, d, "v_claim"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    said = F.transform("versions", lambda v: F.concat_ws("|", v.value, joined(v.documents), joined(v.sources), v.claims.cast("string"), v.best_supported.cast("string")))
    return rows.select("who", "relation", "mutable", "decided", "basis", "supersession", F.array_join(said, "/").alias("versions"))


# ---- the answer path --------------------------------------------------------------------------------------------

#: Documents that exist for answering are those in English; a claim says a document's first 40 characters, every third wrongly.
_ASK = f"{_BM25}, tops as (select qid, id, rank from ranked where rank <= 24), found as (select qid, id, place as rank from (select qid, id, row_number() over (partition by qid order by rank) as place from tops join documents on doc_id = id and lang = 'en') where place <= 8)"
_QUOTES = "said as (select doc_id * 10 as claim_id, doc_id as dsid, case when doc_id % 3 = 0 then concat('not ', substr(text, 1, 40)) else substr(text, 1, 40) end as quote from documents)"
_FOUND_EVIDENCE = "evidence as (select qid, claim_id, dsid, 'e' || (row_number() over (partition by qid order by rank, claim_id) - 1) as evidence_id from found join said on dsid = id join documents on doc_id = id where quote <> '' and contains(text, quote))"


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, index, stats, asked = _index(spark, d)
    docs = table(spark, d, "documents")
    claims = docs.select((F.col("doc_id") * 10).alias("claim_id"), F.col("doc_id").alias("dsid"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("not "), F.substring("text", 1, 40))).otherwise(F.substring("text", 1, 40)).alias("quote"))
    found = an.retrieve(index, stats, asked, docs.where("lang = 'en'").select(F.col("doc_id").alias("id")))
    return stored(found.select("qid", "id", "rank")), claims, docs.select(F.col("doc_id").alias("dsid"), F.col("text").alias("body"))


@query(f"{_ASK} select qid, id, rank from found")
def retrieved_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first eight documents that exist, of each question's hits."""
    return _asked(spark, d)[0].select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query(f"{_ASK}, {_QUOTES}, {_FOUND_EVIDENCE} select qid, claim_id, dsid, evidence_id from evidence")
def verified_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Claims of those documents whose quote still stands there."""
    found, claims, bodies = _asked(spark, d)
    return an.evidence(found, claims, bodies).select("qid", "claim_id", "dsid", "evidence_id")


@query(f"""{_ASK}, {_QUOTES}, {_FOUND_EVIDENCE}, n as (select qid, count(*) as e from evidence group by qid), f as (select qid, count(*) as r from found group by qid)
select asked.qid, unnest(['retrieve', 'evidence', 'cite', 'reject', 'dispute']) as operation, unnest([coalesce(r, 0), coalesce(e, 0), least(coalesce(e, 0), 3), case when e is null then 0 else 1 end, 0]) as results
from asked left join n on n.qid = asked.qid left join f on f.qid = asked.qid""")
def answer_trace(spark: SparkSession, d: str) -> DataFrame:
    """What each step of an answer came to; the synthesiser also cites a piece that there is not."""
    found, claims, bodies = _asked(spark, d)
    rows = stored(an.evidence(found, claims.withColumns({"subject": F.lit("s"), "predicate": F.lit("p"), "object": F.lit("o")}), bodies))
    said = an.first_evidence(rows).withColumn("used", F.array_append("used", F.lit("e999")))
    none = claims.limit(0).select(F.col("claim_id").alias("src"), F.col("claim_id").alias("dst"), F.lit("p").alias("predicate"), F.lit(False).alias("decided"))
    judged = an.judge(view(spark, d, "v_question").select("qid"), rows, said, none, claims.withColumn("object", F.lit("o")))
    return an.trace(found, rows, said, judged)


@query(f"""{_ASK}, refs as (select * from {duck('v_reference')}), pairs as (select a.dsid as anchor, b.dsid, min(a.ticket) as ticket from refs a join refs b on a.ticket = b.ticket and a.dsid <> b.dsid where a.dsid in (select id from found) group by all),
near as (select anchor, dsid from pairs qualify row_number() over (partition by anchor order by ticket, dsid) <= 6),
more as (select f.qid, n.dsid as id, min(f.rank) as r from found f join near n on n.anchor = f.id where (f.qid, n.dsid) not in (select qid, id from found) group by all)
select qid, id, rank from found union all select m.qid, m.id, l.last + row_number() over (partition by m.qid order by r, m.id) from more m join (select qid, max(rank) as last from found group by qid) l on l.qid = m.qid""")
def related_documents(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved documents and, after them, those that share a ticket with one."""
    found = _asked(spark, d)[0]
    return an.with_related(found, view(spark, d, "v_reference")).select("qid", "id", F.col("rank").cast("long").alias("rank"))


# ---- functions and sinks over whole tables ----------------------------------------------------------------------

@query("select o_orderkey, case when o_orderkey % 5 = 4 then null else epoch(date_trunc('day', o_orderdate))::bigint end as at from (select o_orderkey, o_orderdate::timestamp as o_orderdate from orders)")
def to_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Dates in several shapes, and in one that none reads."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" 00:00"))).when(k == 2, F.concat(day, F.lit(" 00:00:00"))).when(k == 3, F.concat(day, F.lit("T00:00:00"))).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(spark, d, "orders").select("o_orderkey", parsing.to_epoch(said).alias("at"))


_HANDLES = "select distinct handle from (select concat(event_type, case event_id % 4 when 0 then '-bot' when 1 then '.ci' when 2 then 'er' else '_alerts2' end) as handle from events)"


@query(f"select handle, handle like '%bot' or len(list_intersect(regexp_split_to_array(handle, '[^a-z]+'), [{tx.quoted(tx.BOT_TOKENS)}])) > 0 as bot from ({_HANDLES})")
def bot_handles(spark: SparkSession, d: str) -> DataFrame:
    """Handles that automated accounts have."""
    rows = spark.sql(_HANDLES.replace("from events", "from {events}"), events=table(spark, d, "events"))
    return rows.select("handle", tx.looks_like_bot(F.col("handle")).alias("bot"))


@query("select doc_id, lower(trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g'))) as name from documents where text is not null and not contains(text, 'ß')")
def normalised_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with runs of blanks and of any case."""
    rows = table(spark, d, "documents").where("text is not null and not contains(text, 'ß')")
    return rows.select("doc_id", tx.normalise_name(F.substring("text", 1, 60)).alias("name"))


_STATED = "select p_partkey, concat('It is ', p_name, ' of ', p_brand) as answer, case p_partkey % 3 when 0 then upper(p_name) when 1 then concat(p_brand, ' zebra ', p_name, ' x') else p_type end as value from part"


@query(f"""select p_partkey, contains(lower(answer), lower(value)) or (len(t) >= 2 and len(list_filter(t, lambda x: contains(lower(answer), x))) >= 0.75 * len(t)) as stated
from (select *, list_distinct(list_filter(regexp_split_to_array(lower(value), '[^a-z0-9]+'), lambda x: length(x) > 2)) as t from ({_STATED}))""")
def stated_values(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer says a value."""
    rows = spark.sql(_STATED.replace("from part", "from {part}"), part=table(spark, d, "part"))
    return rows.select("p_partkey", tx.states(F.col("answer"), F.col("value")).alias("stated"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    """A report written as JSON, read again."""
    path = f"{shared_dir(spark)}/attestor/{uuid.uuid4().hex}/report"
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reports.write_json(nation, path)
    return spark.read.schema(nation.schema).json(path)


@query("select doc_id, lang, n_chars from documents")
def repartition_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """The documents rewritten in key order with small row groups: the same rows, none missing."""
    path = f"{shared_dir(spark)}/attestor/{uuid.uuid4().hex}/documents"
    docs = table(spark, d, "documents")
    corpus.repartitioned(docs, path, "doc_id")
    return corpus.check_complete(corpus.read_documents(spark, path, ["doc_id", "lang", "n_chars", "doc_id"]), docs.count())


@query("select s_suppkey as id, case when s_suppkey % 2 = 0 then 'second' else 'first' end as told from supplier where s_suppkey % 5 <> 0")
def versioned_read(spark: SparkSession, d: str) -> DataFrame:
    """A table after two batches, one of which came twice, as of the version before a third."""
    store = tables.Versions(spark, f"{shared_dir(spark)}/attestor/{uuid.uuid4().hex}/store")
    s = table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.lit("first").alias("told"))
    store.commit("a", entity=s)
    for _ in range(2):
        at = store.commit("b", entity=tables.merge(store.read("entity"), s.where("id % 2 = 0").withColumn("told", F.lit("second")), "id", ["told"]))
    store.commit("c", entity=s.limit(0))
    return store.read("entity", at)


@query(f"with {_TIERS} select key, count(distinct surface) as surfaces from tiers where key is not null group by key having count(distinct surface) >= 2")
def entity_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """People under several surfaces."""
    return resolve.surfaces_of(_tiers(spark, d)).select("key", F.size("surfaces").cast("long").alias("surfaces"))


@query(f"""with e as (select s_suppkey as id, concat('k', s_suppkey) as key, concat('m', s_suppkey % 7, '@x.com') as email from supplier), g as (select id from e where id % 6 = 0)
select a.key, a.email, b.key as owner from e a join e b on a.email = b.email where a.id in (select id from g) and b.id not in (select id from g)""")
def stranded_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of entities that were merged away, and who has them now."""
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key"), F.array(F.concat(F.lit("m"), (F.col("s_suppkey") % 7).cast("string"), F.lit("@x.com"))).alias("emails"))
    return resolve.stranded(e, e.where("id % 6 = 0").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst")))
