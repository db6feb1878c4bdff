"""Operator 4, URL filters: rules first, then a ratio of two character language models.

Rules decide the URLs that they fit. From those, two smoothed variable-order Markov models are trained, one of accepted
and one of rejected URLs: contexts of 0 to `ORDER` characters, each blended with the next shorter one by Witten-Bell
weights. A URL that no rule fits is scored by the difference of its log-likelihoods for each of its characters; a
logistic curve fitted to a part of the decided URLs that no count has seen turns that into a probability.

Counts cover all decided URLs and all their contexts, in a table. If a count shows that the table has at most
`2 * CONTEXTS` rows, the models go to every worker; else the distinct pieces of the URLs (a character and the `ORDER` before
it) are joined with the table, order by order, and the URLs with the pieces. Both ways score alike.

Defined cases: null or without `://`: host and path are empty and no rule fits; the models score the text as
it is, an empty one has ratio 0; where either class has no URL there is no model and the rest is allowed; repeated
rows count and are judged each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attestor.llm.common import ascii_lower, maybe_broadcast, save, table, tuned

#: Rule (host and path) and its verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
ORDER, CONTEXTS, HELD_OUT, BINS = 5, 60_000, 5, 400
START = "\x02"
FLOOR = 1.0 / 1024
#: A piece with more than this share of all pieces' rows is sent to the URLs; there are at most 1 / HOT of those.
HOT = 1e-4


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the longest is tested first, as it comes last
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        found = F.when(fits, rule).otherwise(found)
    return found


class Markov:
    """P(character | up to ORDER before it), Witten-Bell: (n + kinds * P(shorter)) / (total + kinds)."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.table = {c: (sum(n.values()), len(n), n) for c, n in counts.items()}
        self.floor = FLOOR

    def log_likelihood(self, url: str) -> float:
        text, total, table = START * ORDER + url, 0.0, self.table
        for i in range(ORDER, len(text)):
            p, ch = self.floor, text[i]
            for order in range(ORDER + 1):
                if (seen := table.get(text[i - order : i])) is None:
                    break
                n, kinds, by = seen
                p = (by.get(ch, 0) + kinds * p) / (n + kinds)
            total += math.log(p)
        return total


def _count(batches):
    """label, context, character, n: partial counts, sent whenever a worker holds many."""
    seen: Counter = Counter()

    def out():
        cols = list(zip(*((k[0], k[1:-1], k[-1], n) for k, n in seen.items()))) or [[]] * 4
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["label", "context", "ch", "n"])

    for b in batches:
        for url, verdict in zip(b.column("url").to_pylist(), b.column("verdict").to_pylist()):
            text = START * ORDER + (url or "")
            for order in range(ORDER + 1):
                seen.update(verdict[0] + text[i - order : i + 1] for i in range(ORDER, len(text)))
        if len(seen) > 500_000:
            yield out()
    yield out()


def contexts_of(decided: DataFrame) -> DataFrame:
    """label, context, total, by: the counts of all rows (url, verdict) given."""
    counts = decided.mapInArrow(_count, "label string, context string, ch string, n long")
    # one row a context, at most as many characters as there are; map-side sums come first
    summed = counts.groupBy("label", "context", "ch").agg(F.sum("n").alias("n"))
    held = summed.groupBy("label", "context").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("ch", "n"))).alias("by"))
    return save(held, "contexts")


def models_of(held: DataFrame) -> dict[str, Markov]:
    """The two models, of a table of counts that is within the bound."""
    rows = held.collect()
    return {label: Markov({r.context: r.by for r in rows if r.label == label}) for label in "ab"}


def ratios(rows: DataFrame, models) -> DataFrame:
    """rows with `ratio`: the difference of log-likelihoods for each character; higher is more like accepted URLs."""
    def run(batches):
        pair = models.value
        for b in batches:
            told = [(pair["a"].log_likelihood(u) - pair["b"].log_likelihood(u)) / len(u) if u else 0.0 for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.float64())], [*b.schema.names, "ratio"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("ratio", DoubleType())]))


def _pieces(batches):
    """k, g, n: how often each piece occurs in each URL."""
    for b in batches:
        rows = []
        for k, url in zip(b.column("k").to_pylist(), b.column("url").to_pylist()):
            text = START * ORDER + url
            rows += [(k, g, n) for g, n in Counter(text[i : i + ORDER + 1] for i in range(len(url))).items()]
        cols = [*zip(*rows)] or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["k", "g", "n"])


def joined_ratios(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The same as `ratios`, by joins with the counts."""
    urls = rows.where("url <> ''").select("url").distinct().select(F.md5("url").alias("k"), "url")
    pieces = save(urls.mapInArrow(_pieces, "k string, g string, n long"), "pieces")
    seen = save(pieces.groupBy("g").agg(F.count("*").alias("c")), "seen")
    told = seen.select("g", "c", F.lit(FLOOR).alias("pa"), F.lit(FLOOR).alias("pb"))
    for order in range(ORDER + 1):
        of = lambda label, c: F.first(F.when(F.col("label") == label, F.col(c)), ignorenulls=True)
        model = held.where(F.char_length("context") == order).groupBy("context").agg(*(of(x, c).alias(f"{c}_{x}") for x in "ab" for c in ("total", "by")))
        model = save(model, "order")
        told = told.withColumn("context", F.substring("g", ORDER + 1 - order, order)).join(maybe_broadcast(model, model.count()), "context", "left")
        ch = F.substring("g", ORDER + 1, 1)
        for x in "ab":
            kinds, p = F.size(f"by_{x}"), F.col(f"p{x}")
            new = (F.coalesce(F.try_element_at(f"by_{x}", ch), F.lit(0)) + kinds * p) / (F.col(f"total_{x}") + kinds)
            told = told.withColumn(f"p{x}", F.when(F.col(f"total_{x}").isNull(), p).otherwise(new))
        told = told.select("g", "c", "pa", "pb")
    told = save(told.select("g", "c", (F.log("pa") - F.log("pb")).alias("d")), "told")
    # a piece like "https:" is in every URL
    hot = told.where(F.col("c") > pieces.count() * HOT).select("g", "d")
    often = pieces.join(F.broadcast(hot), "g")
    rare = pieces.join(F.broadcast(hot), "g", "left_anti").join(told.select("g", "d"), "g")
    sums = often.unionByName(rare).groupBy("k").agg(F.sum(F.col("n") * F.col("d")).alias("_sum"))
    out = rows.withColumn("k", F.md5("url")).join(sums, "k", "left")
    return out.select(*rows.columns, F.coalesce(F.col("_sum") / F.char_length("url"), F.lit(0.0)).alias("ratio"))


def calibrate(held_out: DataFrame) -> tuple[float, float]:
    """Slope and offset of P(allow) = 1 / (1 + exp(-(slope * ratio + offset))), classes weighted alike, from a histogram."""
    low, width = -4.0, 8.0 / BINS
    bin_of = F.least(F.greatest(F.floor((F.col("ratio") - low) / width), F.lit(0)), F.lit(BINS - 1))
    rows = held_out.groupBy(bin_of.cast("int").alias("b"), (F.col("verdict") == "allow").alias("y")).count().collect()
    x = np.array([low + (r.b + 0.5) * width for r in rows])
    y = np.array([float(r.y) for r in rows])
    n = np.array([float(r["count"]) for r in rows])
    if len(set(y)) < 2:
        return 1.0, 0.0
    for label in (0.0, 1.0):
        n[y == label] /= n[y == label].sum()
    slope, offset = 1.0, 0.0
    for _ in range(60):  # Newton steps, with a small pull to 0 that keeps a separable fit finite
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -40, 40)))
        w, g = n * p * (1 - p), n * (p - y)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * x).sum() + 1e-3 * slope, g.sum() + 1e-3 * offset])
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """pages (page_id, url) to page_id, host, path, rule, verdict, score: P(allow) by the models, null under a rule."""
    spark = tuned(pages.sparkSession)
    pages = pages.select("page_id", "url")
    host, path = parts(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("rule")]
    decided = rows.where("rule is not null").select("url", by_rule.alias("verdict"), (F.crc32(F.col("url").cast("binary")) % HELD_OUT == 0).alias("held"))
    held = contexts_of(decided.where("not held").select("url", "verdict"))
    if held.select("label").distinct().count() < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    tested = decided.where("held").select("url", "verdict")
    if held.count() <= 2 * CONTEXTS:
        sent = spark.sparkContext.broadcast(models_of(held))
        slope, offset = calibrate(ratios(tested, sent))
        scored = ratios(rows, sent)
    else:
        slope, offset = calibrate(joined_ratios(tested, held))
        free = joined_ratios(rows.where("rule is null"), held)
        scored = free.unionByName(rows.where("rule is not null").withColumn("ratio", F.lit(0.0)))
    p = F.when(F.col("rule").isNull(), 1 / (1 + F.exp(-(F.lit(slope) * F.col("ratio") + F.lit(offset)))))
    scored = scored.withColumn("score", p)
    return scored.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
