"""Graph tables as DataFrames: keyed merges, edges with endpoints, removals, identities, versions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class CollisionError(ValueError):
    """Two identities share an id."""


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a table, type or property name: {name!r}")
    return name


def merge(table: DataFrame, rows: DataFrame, key: str, properties: Sequence[str]) -> DataFrame:
    """table with rows merged in by key: listed properties are set, other columns of known keys stay, new keys are
    added. Rows that share a key must agree; the greatest wins otherwise, so that the order of rows does not matter."""
    for p in properties:
        check_name(p)
    new = rows.groupBy(key).agg(F.max(F.struct(*properties)).alias("_new"))
    joined = table.join(new, key, "full_outer")

    def value(c: str):
        kept = F.col(c)
        if c not in properties:
            return kept
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}").cast(table.schema[c].dataType)).otherwise(kept).alias(c)

    return joined.select(*(F.col(c) if c == key else value(c) for c in table.columns))


class RowValueError(ValueError):
    """A property that a store of scalars cannot hold."""


def unstorable(rows: DataFrame, key: str) -> DataFrame:
    """key, field, problem: properties that are null or nested, which a property of a vertex or an edge must not be."""
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    problem = lambda c: F.lit("nested") if c in nested else F.when(F.col(c).isNull(), "null")
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), problem(c).cast("string").alias("problem")) for c in rows.columns if c != key)))
    return rows.select(key, told.alias("x")).where("x.problem is not null").select(key, "x.field", "x.problem")


def require_scalars(rows: DataFrame, key: str) -> DataFrame:
    """The rows, if every property can be stored."""
    if (bad := unstorable(rows, key).first()) is not None:
        raise RowValueError(f"{key} {bad[0]}: property {bad.field!r} is {bad.problem}")
    return rows


def of_run(table: DataFrame, run_id: str | None = None) -> DataFrame:
    """The rows of one run, or of the latest: reads never mix runs. run_id is the partition column of a stored table, so
    only that run's files are read."""
    if run_id is not None:
        return table.where(F.col("run_id") == run_id)
    latest = table.agg(F.max("run_id").alias("run_id"))  # one row
    return table.join(F.broadcast(latest), "run_id", "left_semi")


def with_endpoints(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    a, b = sources.select(F.col("id").alias("src")), targets.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def merge_edges(table: DataFrame, edges: DataFrame, sources: DataFrame, targets: DataFrame, properties: Sequence[str]) -> DataFrame:
    return merge(table, with_endpoints(edges, sources, targets), "eid", ["src", "dst", *properties])


def remove(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def live(entities: DataFrame, merged_into: DataFrame) -> DataFrame:
    """Entities that no merge has superseded."""
    return entities.join(merged_into.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def collisions(identities: DataFrame) -> DataFrame:
    """Ids that stand for more than one identity (id, kind, node_type, natural_key, full_hash)."""
    named = F.struct("kind", "node_type", "natural_key", "full_hash")
    return identities.groupBy("id").agg(F.countDistinct(named).alias("identities")).where("identities > 1")


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """All identities; nothing is registered if any id collides."""
    both = known.unionByName(new).distinct()
    if not (bad := collisions(both)).isEmpty():
        raise CollisionError(f"ids of several identities, for example {bad.first().id}")
    return both


class Versions:
    """Tables by name under a folder; each commit is a new version, and readers name the one they read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self) -> DataFrame:
        return self.spark.read.schema("version long, name string, batch string").json(f"{self.folder}/_log")

    def version(self) -> int:
        try:
            return self._log().agg(F.max("version")).first()[0] or 0
        except Exception as e:  # an empty store has no log yet
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def done(self, batch: str) -> bool:
        return self.version() > 0 and not self._log().where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, **tables: DataFrame) -> int:
        """Writes all tables, then the log line that makes them visible. A batch that is in the log is left alone."""
        if self.done(batch):
            return self.version()
        n = self.version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{check_name(name)}/v{n}")
        log = self.spark.createDataFrame([(n, name, batch) for name in tables], "version long, name string, batch string")
        log.coalesce(1).write.mode("append").json(f"{self.folder}/_log")
        return n

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        if not (at := version or self.version()):
            return None
        found = self._log().where((F.col("name") == name) & (F.col("version") <= at)).agg(F.max("version")).first()[0]
        return self.spark.read.parquet(f"{self.folder}/{name}/v{found}") if found else None
