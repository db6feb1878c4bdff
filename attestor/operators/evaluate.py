"""Scores: clusterings against a key, abstention, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame) -> DataFrame:
    """rows (id, system, gold) to system, gold, n."""
    return rows.groupBy("system", "gold").agg(F.count("*").alias("n"))


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def pairwise(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over pairs of mentions, from the cells' sizes alone."""
    def pairs(df: DataFrame, name: str) -> DataFrame:
        n = F.col("n").cast("long")
        return df.agg(F.coalesce(F.sum(F.floor(n * (n - 1) / 2)), F.lit(0)).alias(name))

    cells = contingency(rows)
    tp = pairs(cells, "tp")
    system = pairs(rows.groupBy("system").agg(F.count("*").alias("n")), "s")
    gold = pairs(rows.groupBy("gold").agg(F.count("*").alias("n")), "g")
    one = tp.join(F.broadcast(system)).join(F.broadcast(gold))  # three rows
    p = F.when(F.col("s") > 0, F.col("tp") / F.col("s")).otherwise(1.0)
    r = F.when(F.col("g") > 0, F.col("tp") / F.col("g")).otherwise(1.0)
    out = one.select("tp", (F.col("s") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def bcubed(rows: DataFrame) -> DataFrame:
    """precision, recall, f1 averaged over mentions."""
    cells = contingency(rows)
    sizes = cells.join(cells.groupBy("system").agg(F.sum("n").alias("ns")), "system").join(cells.groupBy("gold").agg(F.sum("n").alias("ng")), "gold")
    n = F.col("n").cast("double")
    out = sizes.agg((F.sum(n * n / F.col("ns")) / F.sum(n)).alias("precision"), (F.sum(n * n / F.col("ng")) / F.sum(n)).alias("recall"))
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def false_merges(rows: DataFrame) -> DataFrame:
    """Clusters of the system that hold several people."""
    return rows.groupBy("system").agg(F.countDistinct("gold").alias("people"), F.count("*").alias("mentions")).where("people > 1")


def splits(rows: DataFrame) -> DataFrame:
    """People who are in several clusters."""
    return rows.groupBy("gold").agg(F.countDistinct("system").alias("clusters"), F.count("*").alias("mentions")).where("clusters > 1")


def precision_by_method(rows: DataFrame) -> DataFrame:
    """rows (method, system, gold): the share of each method's mentions that are with their cluster's main person."""
    cells = rows.groupBy("system", "gold").agg(F.count("*").alias("n"))
    main = cells.groupBy("system").agg(F.max(F.struct("n", "gold"))["gold"].alias("main"))
    judged = rows.join(main, "system")
    return judged.groupBy("method").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gold") == F.col("main"), 1).otherwise(0)).alias("right"))


def inconsistent_handles(rows: DataFrame) -> DataFrame:
    """rows (dsid, handle, entity): handles that stand for several entities inside one document, where one can only mean one."""
    return rows.groupBy("dsid", "handle").agg(F.countDistinct("entity").alias("entities")).where("entities > 1")


def abstention(rows: DataFrame) -> DataFrame:
    """rows (answerable, abstained): how often each is right, and their mean."""
    answered = F.avg(F.when(F.col("answerable"), F.when(F.col("abstained"), 0.0).otherwise(1.0)))
    declined = F.avg(F.when(~F.col("answerable"), F.when(F.col("abstained"), 1.0).otherwise(0.0)))
    out = rows.agg(F.count("*").alias("n"), answered.alias("answer_rate"), declined.alias("abstain_rate"))
    return out.withColumn("balanced", (F.coalesce("answer_rate", F.lit(0.0)) + F.coalesce("abstain_rate", F.lit(0.0))) / 2)


def percentile_at(df: DataFrame, group: str, value: str, share: float, shift: int = 0) -> DataFrame:
    """The value at index int(share * n) + shift of each group's sorted values: both conventions of the reports."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.least(F.greatest(F.floor(F.lit(share) * F.col("_n")) + shift, F.lit(0)), F.col("_n") - 1)
    return rows.where(F.col("_i") == at).select(group, F.col(value).alias("value"))


def verdict_shares(rows: DataFrame, floor: float = 0.9) -> DataFrame:
    """rows (question, verdict, allowed array): the share within the allowed verdicts, and whether it reaches the floor."""
    share = F.avg(F.array_contains("allowed", F.col("verdict")).cast("double"))
    return rows.groupBy("question").agg(share.alias("share")).withColumn("passed", F.col("share") >= floor)
