"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, Token

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts of 100,000 characters then take 50 MB, not 1 GB.
ARROW_ROWS = 512
#: A table is broadcast only if a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000
#: Ids, as long integers, that a broadcast may hold: 16 MB.
BROADCAST_IDS = 1_000_000
#: Rows for which a written table gets another file.
ROWS_PER_FILE = 4_000
#: Bytes of stored input that one task of a text pass takes, at least, when it writes something.
SHARD_BYTES = 16 << 20
#: Keys with more than this share of a join's rows are split; there are fewer than SPREAD of them.
SPREAD = 200
#: Bytes of text that one vectorised step takes at once (one longer text is taken alone).
CHUNK_BYTES = 1 << 19

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stated_bytes(df: DataFrame) -> int:
    """The size that the plan's statistics state: of the files that a scan reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that would be fewer tasks than there are cores, by the least that a scan takes for one, is dealt out (a
    file of one row group is one task)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and stated_bytes(df) < cores * (4 << 20) else df


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of a bounded size for the Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one, but only for a
    session whose executors are on this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="attestor-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/attestor/{uuid.uuid4().hex}/{name}"
    if (made := _scratch.get()) is not None:
        made.append(path)
    return path


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, by Arrow: file, hdfs, s3, gs."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of fresh_path, if it is there."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


#: The folders made since the innermost `scratch` began.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the folders made inside on leaving it, but for tables that went through the function it gives: for callers
    who store what they get before they leave."""
    made: list[str] = []
    kept: set[str] = set()
    before = _scratch.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.saved_at)
        return df

    try:
        yield keep
    finally:
        _scratch.reset(before)
        for path in made:
            if path not in kept:
                delete(spark, path)
            elif before.old_value not in (None, Token.MISSING):
                before.old_value.append(path)


def save(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and returns it as read from there: later steps neither
    repeat the work nor depend on the executors that did it. rows: a bound or estimate of its rows; a small table then
    goes to a few files, whatever the number of shuffle partitions, and a large one to as many files as it has partitions."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of `save` that nothing reads any more: all that was made of it is saved itself."""
    delete(df.sparkSession, df.saved_at)


def in_shards(docs: DataFrame) -> DataFrame:
    """docs in tasks of SHARD_BYTES or more, by the size that the scan states, if that still keeps all cores busy: what
    each task writes is then a file worth reading. No row moves."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(2 * cores, min(stated_bytes(docs) // SHARD_BYTES, 1 << 20)))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right on equal columns, where one key may hold a large part of left's rows. Keys with more than
    1 / SPREAD of the rows are split: left's rows get one of several numbers, right's rows each of them. Fewer than SPREAD
    keys can be that large, so their list is small whatever the tables' size. left is read twice: a stored table, unless
    counts (on, _n) has its keys' numbers of rows, or of those keys that come more than once."""
    spark = left.sparkSession
    counts = left.groupBy(*on).agg(F.count("*").alias("_n")) if counts is None else counts
    limit = max(50, (counts.agg(F.sum("_n")).first()[0] or 0) // SPREAD)
    hot = counts.where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_k"))
    found = hot.collect()
    if not found:
        return left.join(right, on, how)
    hot = F.broadcast(spark.createDataFrame(found, hot.schema).coalesce(1))
    place = F.when(F.col("_k").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), "_k").cast("int"))
    a = left.join(hot, on, "left").withColumn("_place", place).drop("_k")
    b = right.join(hot, on, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    return a.join(b, [*on, "_place"], how).drop("_place")


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows are within the bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= bound else df


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def fold_of(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins (one more at the end). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most limit bytes each, or of one row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))
