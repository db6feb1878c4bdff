"""Stable 63-bit identities: the first eight bytes of a SHA-256 over type and key, without the sign bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import casefold, collapse, sql_casefold

SEPARATOR = "\x1f"
#: The types whose keys ignore case.
FOLDED = "person alias email handle team channel company product project topic meeting predicate rawpredicate".split()


def canonical_key(node_type: str, raw: Column) -> Column:
    """Runs of white space are one blank; case goes for the types in FOLDED. Null for an empty key or one that holds the separator."""
    key = collapse(raw)
    key = casefold(key) if node_type.casefold().replace("_", "") in FOLDED else key
    return F.when((key != "") & ~F.contains(raw, F.lit(SEPARATOR)), key)


def _fold(payload: Column) -> tuple[Column, Column]:
    digest = F.sha2(payload, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    return F.shiftleft(high, 32) + F.conv(F.substring(digest, 9, 8), 16, 10).cast("long"), digest


def node_id(node_type: str, key: Column) -> Column:
    return _fold(F.concat(F.lit(node_type + SEPARATOR), key))[0]


def node_hash(node_type: str, key: Column) -> Column:
    return _fold(F.concat(F.lit(node_type + SEPARATOR), key))[1]


def edge_id(edge_type: str, source: Column, target: Column, scope: Column | str = "") -> Column:
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return _fold(F.concat_ws(SEPARATOR, F.lit(edge_type), source.cast("string"), target.cast("string"), scope))[0]


def sql_id(payload: str) -> str:
    """DuckDB SQL for the id of a payload."""
    return f"(((('0x' || substr(sha256({payload}), 1, 8))::bigint & 2147483647) << 32) + ('0x' || substr(sha256({payload}), 9, 8))::bigint)"


def sql_node_id(node_type: str, key: str) -> str:
    return sql_id(f"('{node_type}' || chr(31) || {key})")


def sql_edge_id(edge_type: str, source: str, target: str, scope: str = "''") -> str:
    return sql_id(f"('{edge_type}' || chr(31) || {source}::varchar || chr(31) || {target}::varchar || chr(31) || {scope})")


def sql_canonical_key(node_type: str, x: str) -> str:
    key = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return sql_casefold(key) if node_type.casefold().replace("_", "") in FOLDED else key
