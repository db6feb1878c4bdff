"""What queries move and hold does not grow with the square of a group; results against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import conflicts, graph, lexical, neardup, resolve
from attestor.plans.queries import ORACLE_SQL, QUERIES
from attestor.plans.views import view
from attestor.sources import shared
from tests import oracle


def moved(spark, action):
    """Records that the stages of an action write to shuffles, and what it returns."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    out = action()
    return total() - before, out


def test_a_ticket_of_many_documents_makes_few_pairs(spark):
    refs = [(i, 5) for i in range(3000)] + [(i, 5 + i % 3) for i in range(100)] + [(7, 1), (2999, 1), (7, 2), (8, 2), (9, 9)]
    df = spark.createDataFrame(refs, "dsid long, ticket long")
    n, got = moved(spark, lambda: graph.related_by_ticket(df.select("dsid"), df).collect())
    by = {}
    for d, t in set(refs):
        by.setdefault(t, []).append(d)
    want = set()
    for a in {d for d, _ in refs}:
        least = {}
        for t in sorted({t for d, t in refs if d == a}):
            for d in by[t]:
                if d != a:
                    least.setdefault(d, t)
        want |= {(a, t, d, i + 1) for i, (t, d) in enumerate(sorted((t, d) for d, t in least.items())[:6])}
    assert {(r.anchor, r.ticket, r.dsid, r.place) for r in got} == want and len(got) == len(want)
    assert n < 100_000  # nine million pairs before


def test_occurrences_of_a_phrase_share_no_blank(spark):
    texts = {1: "x x x", 2: "a a a a", 3: "a b a b, a b", 4: "a-a-a-a-a b", 5: "", 6: None, 7: "y"}
    docs = spark.createDataFrame(list(texts.items()), "id long, body string")
    phrases = spark.createDataFrame([("x", ["x"]), ("aa", ["a", "a"]), ("ab", ["a", "b"])], "pid string, terms array<string>")
    got = {(r.pid, r.id): r.n for r in lexical.phrase_matches(docs, phrases).collect()}
    assert got == {("x", 1): 2, ("aa", 2): 1, ("aa", 4): 2, ("ab", 3): 2, ("ab", 4): 1}


def test_an_index_holds_the_terms_asked_for(spark):
    docs = spark.createDataFrame([(1, "Ünï Two", "two two three ünï"), (2, None, "four"), (3, "", None)], "id long, title string, body string")
    index, stats = lexical.indexed(docs, spark.createDataFrame([(["two", "ünï"],)], "terms array<string>"))
    assert {(r.term, r.id, r.tf, r.dl) for r in index.collect()} == {("two", 1, 6.0, 6), ("ünï", 1, 5.0, 6)}
    assert tuple(stats.first()) == tuple(lexical.corpus_stats(docs).first())


def test_shingles_move_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(204))) for i in range(300)] + [(900, "ẞ İstanbul Kelvin a b c"), (901, "ss i stanbul kelvin A b, c")], "id long, body string")
    n, got = moved(spark, lambda: neardup.similar_pairs(docs).collect())
    assert got == [] and n < 300 * 200 * 1.5  # twice and more before
    assert {(r.id, r.representative) for r in neardup.classes(docs).where("id >= 900").collect()} == {(900, 900), (901, 900)}


def test_a_channel_of_many_mentions_makes_few_pairs(spark):
    mentions = spark.createDataFrame([(i, f"d{i}", "c", "sam") for i in range(400)], "mention_id long, dsid string, channel string, token string")
    part = spark.createDataFrame([("c", i) for i in range(400)], "channel string, entity long")
    names = spark.createDataFrame([(i, "Soham Roy" if i == 7 else "Barbara") for i in range(400)], "entity long, name string")
    co = spark.createDataFrame([("d1", 7), ("d2", 9)], "dsid string, entity long")
    n, got = moved(spark, lambda: graph.propose(mentions, co, part, names).collect())
    assert sorted((r.mention_id, r.entity) for r in got) == [(i, 7) for i in range(400)]
    assert n < 10_000  # 160,000 pairs before


def test_pairs_of_one_address_are_dealt_out(spark):
    e = spark.range(6000).select("id", F.concat(F.lit("k"), "id").alias("key"), F.array(F.lit("a@x.com")).alias("emails"))
    out = resolve.stranded(e, e.where("id % 6 = 0").select(F.col("id").alias("src")))
    parts = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("key", "owner").alias("d")).collect()
    assert sum(r.n for r in parts) == sum(r.d for r in parts) == 1000 * 5000 and len(parts) > 1


def test_far_edges_of_a_path_stay_where_they_are(spark):
    far = [(f"x{i}", f"y{i % 997}") for i in range(20_000)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), ("c", "d"), ("d", "e"), ("a", "e"), ("e", "f"), *far], "src string, dst string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    n, got = moved(spark, lambda: graph.shortest_paths(edges, ids("a", "z"), ids("a", "d", "f", "q")).collect())
    assert sorted(map(tuple, got)) == [("a", "a", 0), ("a", "d", 2), ("a", "f", 2)]
    assert n < 5_000  # all edges, both ways, before


@pytest.mark.parametrize("broadcast, budget", [(200_000, 5), (3, 4), (0, 4)])
def test_paths_of_a_random_graph(spark, monkeypatch, broadcast, budget):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(shared, "PART_ROWS", 20)
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(None, 1), (2, None), (7, 7)]
    df, ids = spark.createDataFrame(edges, "src long, dst long"), lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    want = set()
    for start in range(8):
        hops = {start: 0}
        for step in range(1, budget + 1):
            for a, b in edges + [(b, a) for a, b in edges]:
                if a is not None and b is not None and hops.get(a) == step - 1 and b not in hops:
                    hops[b] = step
        want |= {(start, g, hops[g]) for g in range(5, 30) if g in hops}
    got = [tuple(x) for x in graph.shortest_paths(df, ids(range(8)), ids(range(5, 30)), budget).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")
def test_mentions_of_a_large_table_have_parts_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 300)
    assert view(spark, oracle.DATA, "v_mention").rdd.getNumPartitions() >= 20  # no more than cores before
    for name in ("bounded_paths", "cooccurrence"):
        oracle.agree(spark, QUERIES[name], ORACLE_SQL[name])


def test_claims_of_few_predicates_stay_where_they_are(spark):
    claims = spark.range(8000).selectExpr("id dsid", "concat('s', id % 50) subject", "if(id % 3 = 0, 'status', 'has status') predicate", "'o' object").repartition(4)
    claims = spark.createDataFrame(claims.rdd, claims.schema)
    n, got = moved(spark, lambda: conflicts.facts(claims).agg(F.count("*"), F.min("relation"), F.max("who")).first())
    assert tuple(got) == (8000, "has_status", "name:s9")
    assert n < 1000  # all claims, by their two predicates, before


@pytest.mark.parametrize("folded", [False, True])
def test_support_of_versions_in_many_parts(spark, monkeypatch, folded):
    monkeypatch.setattr(shared, "PART_ROWS", 40)
    r = random.Random(3)
    quotes = [None, "", " ", "It is", "it IS ", "no", "yes", "ẞ", "ss"]
    data = [(f"w{r.randrange(9)}", r.choice("pq"), r.choice("abc"), r.choice([None, *range(25)]), r.choice(quotes)) for _ in range(400)] + [("alone", "p", "a", 1, "x")]
    same = {d: d // 2 for d in range(0, 20)} if folded else {}
    rows = spark.createDataFrame(data, "who string, relation string, value string, dsid int, quote string")
    canonical = spark.createDataFrame(list(same.items()), "id int, representative int") if folded else None
    want = set()
    for w, p, v in {x[:3] for x in data}:
        fact, mine = [x for x in data if x[:2] == (w, p)], [x for x in data if x[:3] == (w, p, v)]
        documents = len({same.get(x[3], x[3]) for x in mine} - {None})
        told = len({x[4].strip(" ").lower().replace("ß", "ss") for x in mine if x[4] is not None} - {""})
        if (n := len({x[2] for x in fact})) > 1:
            share = min(1.0, (told if 0 < told < documents else documents) / max(2, len({x[3] for x in fact} - {None})))
            want.add((w, p, v, documents, n, round(share, 9)))
    got = [(*x[:5], round(x.corroboration, 9)) for x in conflicts.support(rows, canonical).collect()]
    assert len(got) == len(want) and set(got) == want
