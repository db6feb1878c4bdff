import pytest
from pyspark.sql import functions as F

from attestor.operators import answer, conflicts, evaluate, graph, lexical, neardup, parsing, resolve, spans
from attestor.operators.ontology import align
from attestor.sources import corpus, tables

CLAIM = "claim_id long, dsid string, source_type string, subject string, predicate string, object string, confidence double, quote string, timestamp long"


def claims(spark, *rows):
    """(subject, predicate, object, dsid, source, timestamp)"""
    return spark.createDataFrame([(i, d, s, sub, p, o, 0.9, f"quote {i}", t) for i, (sub, p, o, d, s, t) in enumerate(rows)], CLAIM)


def decided(spark, *rows):
    return conflicts.detect(claims(spark, *rows))[1].collect()


def test_values_of_a_relation_with_several_are_no_conflict(spark):
    assert decided(spark, ("rollback", "includes", "a", "d1", "slack", None), ("rollback", "includes", "b", "d2", "slack", None)) == []
    assert decided(spark, ("Al", "has email", "a@x", "d1", "gmail", None), ("Al", "has email", "b@x", "d2", "gmail", None)) == []


def test_spellings_of_a_predicate_are_one_fact(spark):
    [row] = decided(spark, ("Laura", "has title", "Engineer", "d1", "slack", None), ("Laura", "job title", "Director", "d2", "slack", None))
    assert row.n_versions == 2 and not row.decided


def test_later_statement_supersedes(spark):
    [row] = decided(spark, ("Ana", "has title", "Engineer", "d1", "slack", 10), ("Ana", "has title", "Staff Engineer", "d2", "slack", 20))
    assert (row.basis, row.best_value) == ("recency", "staff engineer")


def test_system_of_record_decides(spark):
    [row] = decided(spark, ("BILL-1", "status", "closed", "d1", "jira", 10), ("BILL-1", "status", "open", "d2", "slack", 20))
    assert (row.basis, row.best_value) == ("authority", "closed")


def test_one_dated_version_decides_nothing(spark):
    [row] = decided(spark, ("Y", "status", "open", "d1", "slack", 10), ("Y", "status", "blocked", "d2", "slack", None))
    assert not row.decided and row.basis == ""


def test_edges_only_between_values(spark):
    df = claims(spark, ("Y", "status", "open", "d1", "slack", None), ("Y", "status", "Open!", "d2", "slack", None), ("Y", "status", "closed", "d3", "slack", None))
    assert sorted((r.src, r.dst) for r in conflicts.edges(df).collect()) == [(0, 2), (1, 2)]


def test_same_name_two_people(spark):
    df = claims(spark, ("Anna", "works at", "a", "d1", "slack", None), ("Anna", "works at", "b", "d2", "slack", None))
    identity = spark.createDataFrame([("d1", "anna", 1), ("d2", "anna", 2)], "dsid string, surface string, entity long")
    assert conflicts.edges(df, identity).count() == 0
    assert conflicts.edges(df).count() == 1


def test_copies_are_one_source(spark):
    df = claims(spark, *[("Y", "status", "open", f"d{i}", "slack", None) for i in range(4)], ("Y", "status", "shut", "d9", "slack", None))
    plain = {r.value: r.corroboration for r in conflicts.detect(df)[0].collect()}
    copies = spark.createDataFrame([(f"d{i}", "d0") for i in range(4)], "id string, representative string")
    folded = {r.value: r.corroboration for r in conflicts.detect(df, canonical=copies)[0].collect()}
    assert plain["open"] == pytest.approx(0.8) and folded["open"] == pytest.approx(0.2)


def test_reconcile_equals_sweep(spark):
    df = claims(spark, *[(f"S{i % 5}", "status", "abc"[i % 3], f"d{i}", ["slack", "jira"][i % 2], i * 7 % 11 if i % 4 else None) for i in range(40)])
    first = conflicts.edges(df.where("claim_id < 20"))
    after = conflicts.reconcile(df, df.where("claim_id >= 20").select("dsid"), first)
    key = lambda e: sorted((r.eid, r.decided, round(r.margin, 9)) for r in e.collect())
    assert key(after) == key(conflicts.edges(df))


def test_partitions_do_not_matter(spark):
    df = claims(spark, *[(f"S{i % 7}", "status", "abcd"[i % 4], f"d{i % 13}", "slack", i % 5) for i in range(60)])
    one = conflicts.detect(df.coalesce(1))[1].orderBy("who").collect()
    many = conflicts.detect(df.repartition(7))[1].orderBy("who").collect()
    assert one == many


def test_alignment(spark):
    said = ["works as", "Has Job-Title", "current status of", "requires engineer-days", "frobnicates", "", "is the"]
    got = {r.predicate: (r.relation, r.method) for r in align(spark.createDataFrame([(s,) for s in said], "predicate string")).collect()}
    assert got["works as"] == ("holds_title", "exact") and got["Has Job-Title"] == ("holds_title", "exact")
    assert got["current status of"] == ("has_status", "token_subset")
    assert got["requires engineer-days"][1] == "unmapped" and got["frobnicates"] == (None, "unmapped")
    assert got[""] == (None, "empty") and got["is the"] == (None, "stopwords_only")


DOCS = [
    (1001, "Atlas migration rollback plan", "acme rollback plan for the Atlas migration platform team cutover window"),
    (1002, "Q3 revenue forecast", "acme revenue forecast third quarter finance"),
    (1003, "Onboarding checklist", "acme laptop accounts buddy assignment"),
    (2**63 - 1, "Incident 4417 postmortem", "acme search latency bad cache config"),
]


def test_bm25_ranks_and_phrases(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, body string")
    asked = spark.createDataFrame([("a", ["rollback", "plan"]), ("b", ["latency"]), ("c", ["nothing"]), ("d", [])], "qid string, terms array<string>")
    got = lexical.bm25(lexical.postings(docs), lexical.corpus_stats(docs), asked, 3).collect()
    assert {r.qid: r.id for r in got if r["rank"] == 1} == {"a": 1001, "b": 2**63 - 1}
    phrases = spark.createDataFrame([("p", ["atlas", "migration"]), ("q", ["migration", "atlas"])], "pid string, terms array<string>")
    assert [(r.pid, r.id, r.n) for r in lexical.phrase_matches(docs, phrases).collect()] == [("p", 1001, 1)]


def test_near_duplicates(spark):
    base = "the runbook says drain the node then wait for replicas to catch up before the upgrade starts and page the owner if lag grows " * 2
    docs = spark.createDataFrame([("a", base), ("b", base + "extra words here"), ("c", "something else entirely about quarterly finance and hiring plans"), ("d", ""), ("e", None), ("f", "hi"), ("g", "HI!")], "id string, body string")
    assert sorted((r.l, r.r) for r in neardup.similar_pairs(docs).collect()) == [("a", "b")]
    assert ("a", "b") in {(r.l, r.r) for r in neardup.estimated_pairs(docs).collect()}
    assert {(r.id, r.representative) for r in neardup.classes(docs).where("id <> representative").collect()} == {("g", "f")}
    assert dict(neardup.clusters(docs).collect()) == {"a": "a", "b": "a", "f": "f", "g": "f"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(50, 60)], "l long, r long")
    got = dict(neardup.canonical(chain).collect())
    assert set(got.values()) == {1, 50} and 60 in got and 99 not in got


def test_mail_chat_meeting(spark):
    docs = spark.createDataFrame([
        ("m", "gmail", "t", "From: Alyssa Chen <alyssa.chen@cascadefg.com>\nTo: m.k@redwood.com\nDate: 2025-06-03\nSubject: Escalation\n\nFrom: Not Me <no@x.com>"),
        ("s", "slack", " eng-runtime ", "sasha: hi @kevin\ndeploy-bot: done\n```\nnote: log\n```\nmaria: see ENG-4129"),
        ("f", "fireflies", "t", "Date: 2025-03-27\nDuration: 62 minutes\nAttendees: Maya Patel (Redwood AE); Sofia Alv... (Tethys CTO)"),
        ("g", "github", "t", "Related work: Linear ENG-4129, I-5 https://x.io/a)."),
        ("n", "slack", None, None),
    ], "doc_id string, source_type string, title string, body string")
    parsed = parsing.parse_documents(docs)
    got = {(r.dsid, r.surface, r.kind, r.role) for r in parsing.mentions_of(parsed).collect()}
    assert got == {("m", "Alyssa Chen", "person", "email_from"), ("m", "m.k@redwood.com", "person", "email_to"), ("s", "sasha", "person", "speaker"), ("s", "deploy-bot", "bot", "speaker"),
                   ("s", "maria", "person", "speaker"), ("s", "kevin", "person", "at_mention"), ("f", "Maya Patel", "person", "attendee")}
    refs = {(r.doc_id, r.target, r.kind) for r in parsed.select("doc_id", F.explode("references").alias("r")).select("doc_id", "r.*").collect()}
    assert refs == {("s", "ENG-4129", "ticket"), ("g", "ENG-4129", "ticket"), ("g", "https://x.io/a", "url")}


MENTION = "dsid string, start int, surface string, kind string, email string, channel string"


def people(spark, *pairs):
    rows = [(f"d{i}", 0, s, "person", e, None) for i, (s, e) in enumerate(pairs)]
    return resolve.people(spark.createDataFrame(rows, MENTION))


def test_one_person_under_several_domains(spark):
    p = people(spark, ("Grace O'Connor", "grace@redwood.com"), ("Grace O'Connor", "grace@redwood.ai"), ("Grace O'Connor", "g@redwood-inference.com"),
               ("Priya Sharma", "p@mediloop.com"), ("Priya Sharma", "p@procureco.com"), ("Dana Reid", "d@arc.com"), ("Dana Reid", "d@arcadia-health.com"), ("sam", "sam@x.com"), ("sam", "sam@x.ai"))
    same = resolve.same_person(p)
    assert {(r.key, r.survivor) for r in same.collect()} == {("email:grace@redwood.ai", "email:g@redwood-inference.com"), ("email:grace@redwood.com", "email:g@redwood-inference.com")}
    survivor = resolve.merged(p, same).where("key = 'email:g@redwood-inference.com'").first()
    assert survivor.emails == ["g@redwood-inference.com", "grace@redwood.ai", "grace@redwood.com"]
    protected = spark.createDataFrame([("email:grace@redwood.com",)], "key string")
    assert {r.survivor for r in resolve.same_person(p, protected).collect()} == {"email:grace@redwood.com"}
    both = spark.createDataFrame([("email:grace@redwood.com",), ("email:grace@redwood.ai",)], "key string")
    assert resolve.same_person(p, both).count() == 0


def test_tiers(spark):
    p = people(spark, ("Alex Chen", "alex.chen@x.com"), ("Sam Lee", "sam.lee@x.com"), ("Sam Roe", "sam.roe@x.com"))
    asked = spark.createDataFrame([(1, "whoever", "person", "ALEX.CHEN@x.com"), (2, "Alex Chen", "person", None), (3, "chen", "person", None), (4, "sam", "person", None), (5, "ci-bot", "bot", None), (6, "zed", "person", None)], "mention_id long, surface string, kind string, email string")
    got = {r.mention_id: (r.method, r.candidates) for r in resolve.tiers(asked, p).collect()}
    assert got == {1: ("strong_key", 1), 2: ("token_set_exact", 1), 3: ("token_subset_unique", 1), 4: ("unresolved", 2), 5: ("unresolved", 0), 6: ("unresolved", 0)}


def test_proposals_need_a_sole_candidate(spark):
    mentions = spark.createDataFrame([(1, "d1", "c", "sam"), (2, "d2", "c", "hi"), (3, "d3", "c2", "ben")], "mention_id long, dsid string, channel string, token string")
    co = spark.createDataFrame([("d1", 7), ("d2", 7)], "dsid string, entity long")
    part = spark.createDataFrame([("c2", 8)], "channel string, entity long")
    names = spark.createDataFrame([(7, "Soham Ratnaparkhi"), (8, "Barbara")], "entity long, name string")
    assert [(r.mention_id, r.entity) for r in graph.propose(mentions, co, part, names).collect()] == [(1, 7)]


def test_span_reasons(spark):
    base = ("s", "p", "o", "quick fox", "0.9", "the quick fox and the quick fox")
    rows = [base, (None, *base[1:]), (*base[:3], "", *base[4:]), (*base[:4], "high", base[5]), (*base[:4], "1.1", base[5]), (*base[:3], "Quick fox", *base[4:]), (*base[:5], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "claim_id int, subject string, predicate string, object string, evidence_span string, confidence string, text string")
    got = {r.claim_id: (r.reason, r.span_start, r.span_end) for r in spans.validate(df).collect()}
    assert got[0] == (None, 4, 13)
    assert [got[i][0] for i in range(1, 7)] == ["missing_field", "empty_span", "confidence_not_numeric", "confidence_out_of_range", "span_not_verbatim", "span_not_verbatim"]


def test_sealed_columns(spark):
    df = spark.createDataFrame([("q1", "who?", "SECRET", ["d1"])], "question_id string, question string, gold_answer string, expected_doc_ids array<string>")
    assert corpus.open_columns(df).columns == ["question_id", "question"]
    with pytest.raises(corpus.SealedColumnError):
        corpus.open_columns(df, ["gold_answer"])
    with pytest.raises(ValueError):
        corpus.project(df, ["nope"])


def test_merges_and_collisions(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n int")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, name string")
    merged = tables.merge(old, new, "id", ["name"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 5), (2, "B", 6), (3, "c", None)]
    assert sorted(map(tuple, tables.merge(merged, new, "id", ["name"]).collect())) == [(1, "a", 5), (2, "B", 6), (3, "c", None)]
    kind = "id long, kind string, node_type string, natural_key string, full_hash string"
    a, b = spark.createDataFrame([(1, "node", "T", "x", "h1")], kind), spark.createDataFrame([(1, "node", "T", "y", "h2")], kind)
    with pytest.raises(tables.CollisionError):
        tables.register(a, b)
    assert tables.register(a, a).count() == 1


def test_scores(spark):
    rows = spark.createDataFrame([(1, "s1", "g1"), (2, "s1", "g1"), (3, "s1", "g2"), (4, "s2", "g2")], "id int, system string, gold string")
    p = evaluate.pairwise(rows).first()
    assert (p.tp, p.fp, p.fn) == (1, 2, 1)
    b = evaluate.bcubed(rows).first()
    assert b.precision == pytest.approx((2 / 3 * 2 + 1 / 3 + 1) / 4) and b.recall == pytest.approx((1 + 1 + 0.5 + 0.5) / 4)


def test_answers_fail_closed(spark):
    df = claims(spark, ("Y", "status", "open", "d1", "slack", None), ("Y", "status", "shut", "d2", "slack", None), ("Z", "status", "new", "d3", "slack", None))
    rows = df.withColumn("qid", F.when(F.col("dsid") == "d3", 2).otherwise(1)).withColumn("place", F.lit(0)).withColumn("evidence_id", F.concat(F.lit("e"), F.col("claim_id").cast("string")))
    questions = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    answers = spark.createDataFrame([(1, "it is open", ["e0"]), (2, "new", ["e2", "e99"]), (3, "made up", ["e77"])], "qid int, answer string, used array<string>")
    got = {r.qid: r for r in answer.judge(questions, rows, answers, conflicts.edges(df), df).collect()}
    assert got[1].answerability == "conflicting" and got[1].alternatives == ["shut"] and got[1].document_ids == ["d1", "d2"] and got[1].confidence <= 0.6
    assert got[2].answerability == "supported" and got[2].document_ids == ["d3"]
    assert got[3].answerability == "insufficient" and got[3].answer == "" and not got[3].document_ids


def test_stream_equals_batch(spark, tmp_path):
    from attestor.sources.tables import Versions
    from attestor.streaming import incremental

    df = claims(spark, *[(f"S{i % 4}", "status", "abc"[i % 3], f"d{i}", "slack", i if i % 2 else None) for i in range(24)])
    for i in range(3):
        df.where(f"claim_id % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    store = Versions(spark, str(tmp_path / "store"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    incremental.start(source, store, str(tmp_path / "check")).awaitTermination()
    version = store.version()
    assert version == 3 and store.read("claim").count() == 24
    key = lambda e: sorted((r.eid, r.decided) for r in e.collect())
    assert key(store.read("conflicts_with")) == key(conflicts.edges(df))
    assert incremental.apply_batch(store, df, "stream-0") == version
