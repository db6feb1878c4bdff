"""Corpus tables: projections that are checked, questions behind a firewall, lookups, samples."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Question columns that answering may read, and those that only evaluation may.
OPEN_COLUMNS = ("question_id", "question", "question_type", "source_types")
KEY_COLUMNS = ("question_id", "expected_doc_ids")
SEALED_COLUMNS = ("gold_answer", "answer_facts", "expected_doc_ids")
ROW_GROUP_BYTES = 8 << 20


class SealedColumnError(PermissionError):
    """A column that holds answers was asked for outside evaluation."""


class IncompleteError(ValueError):
    """A table does not hold what it is said to hold."""


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The columns in the order asked for, each once; an unknown one is an error before any plan runs."""
    if columns is None:
        return df
    wanted = list(dict.fromkeys(columns))
    if unknown := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"unknown columns: {unknown}; there are {df.columns}")
    return df.select(*wanted)


def schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def read_documents(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return project(spark.read.parquet(path), columns)


def located(df: DataFrame) -> DataFrame:
    """Rows with the file, the block and the place in it that they came from."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.row_index").alias("row_index"))


def read_questions(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Questions without anything that tells the answer."""
    return open_columns(spark.read.parquet(path), columns)


def open_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    if sealed := [c for c in columns or () if c in SEALED_COLUMNS]:
        raise SealedColumnError(f"sealed columns: {sealed}")
    chosen = [c for c in (columns or OPEN_COLUMNS) if c in OPEN_COLUMNS and c in df.columns]
    if not chosen:
        raise ValueError("no open column is left to read")
    return df.select(*dict.fromkeys(chosen))


def read_answer_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*KEY_COLUMNS)


def fetch(df: DataFrame, key: str, value, columns: Sequence[str] | None = None) -> DataFrame:
    """The row of one key: an equality that the scan prunes row groups by."""
    return project(df.where(F.col(key) == F.lit(value)), columns).limit(1)


def first_rows(df: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """One row a key: the first by the order given (for files: file, block, row_index)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def check_complete(df: DataFrame, expected: int) -> DataFrame:
    if (n := df.count()) != expected:
        raise IncompleteError(f"{n} rows instead of {expected}")
    return df


def fingerprint(df: DataFrame) -> str:
    """A short hash of all rows in any order."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    totals = df.agg(F.count("*").alias("n"), *parts)
    return totals.select(F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 16)).first()[0]


def repartitioned(df: DataFrame, path: str, key: str, block_bytes: int = ROW_GROUP_BYTES) -> None:
    """The same rows in key order with small row groups, so that a lookup reads one of them."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.size", block_bytes).parquet(path)


def quota_sample(df: DataFrame, group: str, quota: int, order: Sequence[str | Column], least_chars: int = 0, text: str | None = None, truncate: int | None = None) -> DataFrame:
    """At most `quota` rows of each group, by the order given; `truncate` keeps so many characters of the text, as a sample
    that goes to a model is bounded."""
    rows = df if text is None else df.where(F.length(text) >= least_chars)
    w = Window.partitionBy(group).orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")
    return rows if truncate is None else rows.withColumn(text, F.substring(text, 1, truncate))


def longest_first(df: DataFrame, text: str, key: str, limit: int) -> DataFrame:
    """The longest documents, which extraction takes first."""
    return df.orderBy(F.length(text).desc_nulls_last(), key).limit(limit)


def bodies(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return docs.join(ids.select(key).distinct(), key, "left_semi")


def slice_of(df: DataFrame, parts: Sequence[tuple[Column, int]], order: Sequence[str]) -> DataFrame:
    """The first rows of each condition, together."""
    out = None
    for where, limit in parts:
        rows = df.where(where).orderBy(*order).limit(limit)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_directory(spark: SparkSession, text: str) -> DataFrame:
    """A directory of people from two-level YAML: a name, then indented `field: value` lines."""
    people, current = [], None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = line.strip().partition(":")
        value = re.sub(r"^(['\"])(.*)\1$", r"\2", value.strip())
        if line[0] not in " \t-":
            current = {"name": re.sub(r"^(['\"])(.*)\1$", r"\2", key)}
            people.append(current)
        elif current is not None:
            current[key.lstrip("- ")] = value
    rows = [tuple(p.get(k) for k in ("name", "email", "title", "department")) for p in people]
    return spark.createDataFrame(rows, "name string, email string, title string, department string")
