"""Reports: JSON files, status tables, read positions. What endpoints return, as DataFrames and dictionaries."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BOOKMARK = re.compile(r"sgk:(\w+):([0-9a-f]+):([0-9a-f]+):([0-9a-f]+):(\d+)")


@dataclass(frozen=True)
class Bookmark:
    """A read position: version, namespace, graph and cell in hexadecimal, sequence number."""

    version: str
    namespace: str
    graph: str
    cell: str
    sequence: int


def parse_bookmark(text: str | None) -> Bookmark | None:
    m = _BOOKMARK.fullmatch(text or "")
    return Bookmark(*m.groups()[:4], int(m[5])) if m else None


def later(a: Bookmark | None, b: Bookmark | None) -> Bookmark | None:
    """The bookmark that both reads are covered by; positions of different cells do not compare, so the second counts."""
    if a is None or b is None:
        return a or b
    same = (a.version, a.namespace, a.graph, a.cell) == (b.version, b.namespace, b.graph, b.cell)
    return max(a, b, key=lambda x: x.sequence) if same else b


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(rows: DataFrame, limit: int) -> str:
    """A bounded report as one JSON text, for artifacts that people read."""
    return json.dumps([json.loads(r) for r in rows.limit(limit).select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0]], ensure_ascii=False, indent=1)


def status(**tables: DataFrame) -> DataFrame:
    """label, n: rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("label"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def resolution(recorded: DataFrame) -> DataFrame:
    """Mentions by status and method, with mean confidence."""
    return recorded.groupBy("status", "method").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


def usage(calls: DataFrame) -> DataFrame:
    """calls (model, input_tokens, output_tokens) by model."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def latest_run(df: DataFrame) -> str | None:
    """The greatest run id, as text."""
    return df.agg(F.max("run_id")).first()[0]


def seeded_order(seed: int, *columns: str):
    """An order that looks random and is the same every time."""
    return F.xxhash64(F.lit(seed), *columns)
