from pyspark.sql import functions as F

from attestor.operators import identity, recording
from attestor.sources import corpus, reports


def test_directory_matches(spark):
    directory = spark.createDataFrame([("Tomáš Novák", "tomas.novak@redwood.com"), ("Grace O'Connor", "grace@redwood.com"), ("Priya Sharma", "ps1@redwood.com"), ("Priya Sharma", "ps2@redwood.com")], "name string, email string")
    entities = spark.createDataFrame([
        (1, "Tomas Novak", ["tn@redwood.ai"]),
        (2, "grace_oconnor@redwood.ai", ["grace_oconnor@redwood.ai"]),
        (3, "Priya Sharma", ["p@redwood.ai"]),
        (4, "Tomas Novak", ["t@mediloop.com"]),
        (5, "sam", ["sam@redwood.ai"]),
        (6, "x", ["ps1@redwood.com", "grace@redwood.com"]),
    ], "entity int, name string, emails array<string>")
    got = {r.entity: (r.person, r.hits) for r in identity.matched(entities, directory).collect()}
    assert got == {1: ("tomas.novak@redwood.com", 1), 2: ("grace@redwood.com", 1), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: (None, 2)}


def test_every_mention_ends_with_a_decision(spark):
    kind = "mention_id long, entity long, method string, confidence double"
    tiers = spark.createDataFrame([(1, 9, "strong_key", 1.0, 1), (2, None, "unresolved", 0.0, 2), (3, None, "unresolved", 0.0, 0), (4, None, "unresolved", 0.0, 3), (5, None, "unresolved", 0.0, 0)], kind + ", candidates int")
    graph = spark.createDataFrame([(2, 8, "graph_evidence", 0.7), (4, None, "unresolved", 0.0)], kind)
    proposed = spark.createDataFrame([(3, 7, "graph_proposed", 0.7), (4, 6, "graph_proposed", 0.7)], kind)
    done = recording.record(tiers, graph, proposed)
    got = {r.mention_id: (r.status, r.method, r.entity) for r in done.collect()}
    assert got == {1: ("resolved", "strong_key", 9), 2: ("resolved", "graph_evidence", 8), 3: ("resolved", "graph_proposed", 7), 4: ("unresolved", "unresolved", None), 5: ("unresolved", "unresolved", None)}
    edges = recording.resolves_to(done)
    add, drop, stay = recording.rebuilt(edges.where("src <> 2").unionByName(edges.limit(1).withColumn("eid", F.lit(5).cast("long"))), done)
    assert (add.count(), drop.count(), stay.count()) == (1, 1, 2)
    people = spark.createDataFrame([(1, "Grace Lee", ["g@redwood.com"]), (2, "Grace Lee", ["g@redwood.ai"]), (3, "Grace Lee", ["g@acme.io"])], "entity long, name string, emails array<string>")
    none = spark.createDataFrame([(1,)], "eid long")
    broken = {r.check: r.n for r in recording.violations(done, edges.where("src <> 1"), people, none, none.limit(0)).collect()}
    assert broken == {"resolution_explained": 0, "nothing_pending": 0, "entity_is_edge_target": 1, "one_identity_per_organisation": 1, "no_edge_missing": 1, "no_edge_surplus": 0}


def test_bookmarks_and_reports(spark):
    a, b = reports.parse_bookmark("sgk:1:ab:cd:ef:7"), reports.parse_bookmark("sgk:1:ab:cd:ef:9")
    assert reports.later(a, b) == b and reports.later(None, a) == a
    assert reports.parse_bookmark("sgk:1:ab:cd:7") is None and reports.parse_bookmark(None) is None
    df = spark.createDataFrame([("r2",), ("r10",)], "run_id string")
    assert reports.latest_run(df) == "r2"
    assert {r.label: r.n for r in reports.status(a=df, b=df.limit(0)).collect()} == {"a": 2, "b": 0}


def test_directory_and_fingerprint(spark, tmp_path):
    text = "# people\nGrace O'Connor:\n  email: grace@redwood.com\n  title: 'Lead'\nSam Lee:\n  email: sam@redwood.com\n"
    got = corpus.read_directory(spark, text).collect()
    assert [(r.name, r.email, r.title) for r in got] == [("Grace O'Connor", "grace@redwood.com", "Lead"), ("Sam Lee", "sam@redwood.com", None)]
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert corpus.fingerprint(df) == corpus.fingerprint(df.repartition(7)) != corpus.fingerprint(df.where("id > 0"))
    corpus.repartitioned(df, str(tmp_path / "t"), "id", 4096)
    again = spark.read.parquet(str(tmp_path / "t"))
    assert again.count() == 50 and corpus.fetch(again, "id", 7, ["x"]).first().x == 14
    assert corpus.located(again).where("file is null").count() == 0
