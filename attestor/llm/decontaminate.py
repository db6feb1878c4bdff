"""Operator 7, benchmark decontamination by a distributed positional inverted index; DataFrame functions only.

Index: the postings (term, document, position) of the training texts for every term of the test set, written
as shards beside one another: a task indexes the documents that it reads, so building moves no row between machines. A
document's number of words is a posting of its own (of the empty term), so one pass over the texts tells both.
Search: a window is eight consecutive words of a test item. By the index' own counts its terms are ranked; the list of
its rarest term, shifted by the term's offset, gives (document, start) pairs, and the shifted list of the second rarest is
intersected with them. The few starts left are completed from the words of the documents that have any, term by term.
(Intersecting all eight lists would return the same: over the test data the lists of the rarest terms of all windows hold
0.03 postings for each word of the corpus, the second ones 0.2, the third 0.75, the last 110.)

Texts do not move: those of documents with a start are looked up by a broadcast of their keys, if a count shows that
there are at most BROADCAST_IDS; beyond that Spark shuffles. Windows, their terms and the terms' counts are broadcast
only if counted within the bound too.

Defined cases: null or wordless texts have no words and no hits; items without words have no windows; an item of fewer than
eight words is one window; repeated items with one id count once; rows are told apart by id and text, so rows that share a
doc_id, or have none, are judged each by their own words; other columns are ignored; an empty table gives an empty result,
an empty test set clean documents. All this holds for `proximity` too, which finds nothing there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import BROADCAST_IDS, BROADCAST_ROWS, ascii_lower, in_shards, maybe_broadcast, save, table

WINDOW = 8
#: What separates words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """w (the window's number), item_id, terms: one row for each item and distinct window of it."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.greatest(F.size("words") - size, F.lit(0))
    rows = rows.select("item_id", "words", F.explode(F.sequence(F.lit(0), n)).alias("at"))
    return rows.select("item_id", F.slice("words", F.col("at") + 1, F.lit(size)).alias("terms")).distinct()


#: The term whose posting says how many words a document has.
SIZE = "xxhash64('')"


def numbered(terms: Column) -> Column:
    """Term numbers. Terms that share one only add starts, which the documents' words then refuse."""
    return F.transform(terms, lambda x: F.xxhash64(x))


def index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The positional index: term number t, document key k, position p, for the column `term` given and for SIZE, whose
    p is the number of words; there doc_id stands too. A document comes as often as its row does."""
    words = words_of(F.col("text"))
    rows = in_shards(docs).select("k", "doc_id", F.posexplode(F.array_append(words, F.lit(""))).alias("p", "term"))
    wanted = terms.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    rows = rows.join(maybe_broadcast(wanted, n_terms), "term", "left_semi")
    return save(rows.select(F.xxhash64("term").alias("t"), "k", "p", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id")), "postings")


def keyed(docs: DataFrame) -> DataFrame:
    """k: a hash of id and text. Documents that share one are still told apart by their id, and their words are read."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))


def of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents with one of the keys, each row once."""
    keys = keys.select("k").distinct()
    return docs.join(maybe_broadcast(keys, keys.count(), BROADCAST_IDS), "k", "left_semi").distinct()


def starts(postings: DataFrame, windows: DataFrame, n_windows: int) -> DataFrame:
    """k, start, w: where the shifted lists of each window's two rarest terms meet. windows: w, ts (term numbers)."""
    counts = save(postings.where(f"t <> {SIZE}").groupBy("t").agg(F.count("*").alias("n")), "counts", WINDOW * n_windows)
    slots = windows.select("w", F.posexplode("ts").alias("o", "t")).join(maybe_broadcast(counts, WINDOW * n_windows), "t", "left")
    ranked = slots.groupBy("w").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "t"))).alias("by"))
    # a window with a term that the corpus lacks occurs nowhere
    ranked = ranked.where("by[0].n > 0").select("w", F.col("by")[0]["t"].alias("t"), F.col("by")[0]["o"].alias("o"), F.get("by", F.lit(1))["t"].alias("t2"), F.get("by", F.lit(1))["o"].alias("o2"))
    ranked = save(ranked, "lists", n_windows)
    first = postings.join(maybe_broadcast(ranked, n_windows), "t").where("p >= o").select("k", (F.col("p") - F.col("o")).alias("start"), "w", "t2", "o2")
    alone = first.where("t2 is null").select("k", "start", "w")
    pairs = first.where("t2 is not null").select("k", "start", "w", F.col("t2").alias("t"), (F.col("start") + F.col("o2")).alias("p"))
    seconds = ranked.where("t2 is not null").select(F.col("t2").alias("t")).distinct()
    second = postings.select("t", "k", "p").join(maybe_broadcast(seconds, n_windows), "t", "left_semi")
    return second.join(pairs.hint("shuffle_hash"), ["k", "t", "p"]).select("k", "start", "w").unionByName(alone)


def search(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_hit, items (sorted ids of the items that occur)."""
    docs = keyed(docs)
    found = test_windows(items, size)
    # windows of equal terms are one window with several items
    windows = found.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    windows = save(windows.withColumn("w", F.xxhash64("terms")), "windows", 100 * items.count())
    n_windows = windows.count()
    postings = index(docs, windows.select(F.explode("terms").alias("term")), n_windows * size)
    near = starts(postings, windows.select("w", numbered(F.col("terms")).alias("ts")), n_windows)
    near = near.join(maybe_broadcast(windows, n_windows, BROADCAST_ROWS // 10), "w")
    # a document has at most as many starts as words, and each is verified against its words
    near = save(near.groupBy("k").agg(F.collect_list(F.struct("start", "terms", "item_ids")).alias("near")), "starts", n_windows)
    # the explode of one value keeps the optimizer from splitting the text again for every start
    rows = of(docs, near).join(near, "k").select("k", "doc_id", "near", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    exact = F.filter("near", lambda x: F.slice(F.col("words"), x.start + 1, F.size(x.terms)) == x.terms)
    rows = rows.select("k", "doc_id", exact.alias("hits"))
    # words that hits cover: sorted by start, each adds what lies beyond the furthest end so far
    spans = F.array_sort(F.transform("hits", lambda x: F.struct(x.start.alias("s"), (x.start + F.size(x.terms)).alias("e"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a.end, x.e).alias("end"), (a.n + F.greatest(x.e - F.greatest(x.s, a.end), F.lit(0))).alias("n")),
        lambda a: a.n,
    )
    ids = F.array_sort(F.array_distinct(F.flatten(F.col("hits.item_ids"))))
    hit = save(rows.where(F.size("hits") > 0).select("k", F.col("doc_id").alias("_id"), covered.cast("long").alias("n_hit"), ids.alias("items")), "hits", n_windows)
    sizes = postings.where(f"t = {SIZE}").select("k", "doc_id", F.col("p").cast("long").alias("n_words"))
    told = sizes.join(maybe_broadcast(hit.withColumnRenamed("k", "_k"), hit.count()), (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return told.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def proximity(docs: DataFrame, items: DataFrame, slop: int = 4) -> DataFrame:
    """doc_id, item_id, start, stop: places where the words of a window of the item stand in order with at most `slop`
    other words in between. From the rarest term's list on, each step keeps, for each place of the first
    term found, the nearest fitting place of the next; the places found are compared with the documents' words."""
    docs = keyed(docs)
    windows = test_windows(items).groupBy("terms").agg(F.collect_set("item_id").alias("item_ids"))
    windows = save(windows.withColumn("w", F.xxhash64("terms")), "queries", 100 * items.count())
    n_windows = windows.count()
    slots = windows.select("w", F.size("terms").alias("size"), F.posexplode("terms").alias("o", "term")).withColumn("t", F.xxhash64("term"))
    postings = index(docs, slots.select("term"), n_windows * WINDOW)
    counts = save(postings.where(f"t <> {SIZE}").groupBy("t").agg(F.count("*").alias("n")), "counts", WINDOW * n_windows)
    rare = slots.join(maybe_broadcast(counts, WINDOW * n_windows), "t").withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy("n", "o")))
    rare = save(rare.select("w", "size", "o", "t", "rank"), "ranks", WINDOW * n_windows)
    anchor = rare.where("rank = 1").select("w", "size", "t", F.col("o").alias("anchor"))
    near = postings.join(maybe_broadcast(anchor, n_windows), "t").select("k", "w", "size", "anchor", F.col("p").alias("a")).distinct()
    # the second rarest must stand near the rarest, which few do; then all terms, and only in those documents
    second = rare.where("rank = 2").select("w", F.col("o").alias("o2"), F.col("t").alias("t2"))
    asked = near.join(maybe_broadcast(second, n_windows), "w", "left")
    offset = F.col("o2") - F.col("anchor")
    beside = postings.select(F.col("k").alias("_k"), F.col("t").alias("_t"), "p")
    fits = (F.col("p") - F.col("a")).between(offset - F.when(offset < 0, slop).otherwise(0), offset + F.when(offset > 0, slop).otherwise(0))
    kept = asked.where("t2 is not null").join(beside, (F.col("k") == F.col("_k")) & (F.col("t2") == F.col("_t")) & fits, "left_semi")
    near = save(kept.unionByName(asked.where("t2 is null")).select("k", "w", "size", "anchor", "a"), "near", n_windows)
    keys = near.select("k").distinct()
    inside_these = postings.join(maybe_broadcast(keys, keys.count(), BROADCAST_IDS), "k", "left_semi").select("k", "t", "p")
    # all terms near an anchor: the span around it bounds what this join returns
    wanted = near.join(maybe_broadcast(slots.select("w", "o", "t"), n_windows * WINDOW), "w")
    inside = (F.col("p") >= F.col("a") - F.col("anchor") - slop) & (F.col("p") < F.col("a") + F.col("size") - F.col("anchor") + slop)
    both = wanted.join(inside_these, ["k", "t"]).where(inside)
    rows = both.groupBy("k", "w", "size", "anchor", "a").agg(F.array_sort(F.collect_set(F.struct("o", "p"))).alias("ps"))
    # in order: the latest place before the anchor for each term before it, the earliest after it for each after
    def step(by: int):
        def go(acc, x):
            fits = (x.o == acc.o + by) & ((x.p - acc.p) * by > 0)
            grown = F.struct(x.o.alias("o"), x.p.alias("p"), F.concat(acc.at, F.array(x.p)).alias("at"))
            return F.when(fits, grown).otherwise(acc)

        return go

    begin = F.struct(F.col("anchor").alias("o"), F.col("a").alias("p"), F.array("a").alias("at"))
    rows = rows.withColumn("last", F.aggregate("ps", begin, step(1))).withColumn("first", F.aggregate(F.reverse("ps"), begin, step(-1)))
    rows = rows.where((F.col("first.o") == 0) & (F.col("last.o") == F.col("size") - 1) & (F.col("last.p") - F.col("first.p") + 1 - F.col("size") <= slop))
    places = F.concat(F.reverse("first.at"), F.slice("last.at", 2, F.col("size")))
    rows = rows.select("k", "w", F.col("first.p").alias("start"), (F.col("last.p") + 1).alias("stop"), places.alias("places")).join(maybe_broadcast(windows, n_windows, BROADCAST_ROWS // 10), "w")
    rows = save(rows.select("k", "start", "stop", "places", "terms", "item_ids"), "places", n_windows)
    told = of(docs, rows).select("k", "doc_id", F.explode(F.array(words_of(F.col("text")))).alias("words")).join(rows, "k")
    told = told.where(F.transform("places", lambda p: F.get("words", p)) == F.col("terms"))
    return told.select("doc_id", F.explode("item_ids").alias("item_id"), "start", "stop").distinct()


def op7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where windows of items stand with other words in between; op7_decontaminate has the exact ones."""
    return proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


OP7_SQL = r"""
with docs as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
items as (
  select item_id::varchar as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 8) as size, array_to_string(w[i:i+7], ' ') as g
  from items, lateral (select unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i) where len(w) > 0),
sizes as (select distinct size from windows),
grams as (
  select doc_id, size, i, array_to_string(w[i:i+size-1], ' ') as g
  from docs, sizes, lateral (select unnest(range(1, len(w) - size + 2)) as i) where len(w) >= size),
hits as (select doc_id, i, grams.size, item_id from grams join windows on grams.g = windows.g and grams.size = windows.size),
places as (select distinct doc_id, i + o as p from hits, lateral (select unnest(range(0, size)) as o)),
n_hits as (select doc_id, count(*) as n_hit from places group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id)), ',') as ids from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from docs left join n_hits using (doc_id) left join found using (doc_id)
"""
