"""Operator 8, near-duplicates by MinHash with tensored banding.

Two collections of half keys, `SIDE` each of `HALF` minhashes, are computed for a document; a table's key is a pair of one
half key from either collection. So `SIDE * SIDE` tables of `2 * HALF` minhashes cost only `2 * SIDE * HALF`. Two sets of
similarity s share a table with probability (1 - (1 - s^HALF)^SIDE)^2: 0.9999 at the threshold of 0.75,
0.99999 at 0.8. A half key that one document alone holds is in no shared table, so such keys go before pairs are formed.

Equal sets are one node (copies are never paired): the sha-256 of the sorted full set tells them. Within a table, a group
is verified as a star round its smallest id, which is linear in the group, on the full shingle sets; connected components
join the links. Groups that then still hold more than one component go through a second step, in which members of
different components meet, in the first table that they share, unless sizes or bounds from 1024-bit bitmaps (each
differing bit is a shingle that one set lacks) exclude a link. So a candidate is verified, excluded exactly, or already
connected. Joins on keys that may hold a large part of all rows (a fingerprint, a table, a hub) are split by `spread_join`.

Defined cases: null or wordless texts have no shingles, no links, and are kept; rows that share a doc_id count as
one document; a null doc_id takes no part, has a null component and is kept; a text of fewer than five words is one
shingle; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import BROADCAST_IDS, chunks, in_shards, maybe_broadcast, mix, save, spread_join, table, tuned, utf8
from attestor.llm.components import components

WIDTH, SIDE, HALF = 5, 12, 2
BITS, WORDS = 1024, 16
#: Members of a table that one task compares with one another at most, and pairs that it holds at once.
BLOCK, PAIRS_AT_ONCE = 4096, 1 << 17
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_SLOT = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_XOR = _rng.integers(0, 1 << 63, 2 * SIDE * HALF, dtype=np.uint64) * U(2)
_MUL = _rng.integers(0, 1 << 63, 2 * SIDE * HALF, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, and where each text's begin (one more at the end)."""
    rows = len(at) - 1
    solid = np.flatnonzero(~_WHITE[data])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    first = np.empty(len(solid), bool)
    first[0] = True
    np.not_equal(np.diff(solid), 1, out=first[1:])
    first[np.searchsorted(solid, at[:-1][(at[:-1] < at[1:]) & ~_WHITE[data[np.minimum(at[:-1], len(data) - 1)]]])] = True
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, len(solid)))
    # a word's hash: its bytes as a polynomial, then spread
    depth = np.arange(len(solid)) - np.repeat(begin, sizes)
    powers = np.multiply.accumulate(np.append(U(1), np.full(int(sizes.max()), _BASE)))
    word = np.add.reduceat((_LOWER[data[solid]].astype(np.uint64) + U(1)) * powers[depth], begin)
    word = mix(word + sizes.astype(np.uint64))
    doc = np.searchsorted(at, solid[begin], "right") - 1
    count = np.bincount(doc, minlength=rows)
    start = np.append(0, np.cumsum(count))
    n = len(word)
    full = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if n >= WIDTH:
        inside = doc[WIDTH - 1 :] == doc[: n - WIDTH + 1]
        total = np.zeros(n - WIDTH + 1, np.uint64)
        for i in range(WIDTH):
            total += word[i : n - WIDTH + 1 + i] * _SLOT[i]
        full, owner = mix(total)[inside], doc[: n - WIDTH + 1][inside]
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):
        whole = [mix((word[start[d] : start[d + 1]] * _SLOT[: count[d]]).sum(keepdims=True, dtype=np.uint64) + U(count[d]))[0] for d in short]
        full, owner = np.append(full, np.asarray(whole, np.uint64)), np.append(owner, short)
    order = np.lexsort((full, owner))
    full, owner = full[order], owner[order]
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
    full, owner = full[new], owner[new]
    return full, np.append(0, np.cumsum(np.bincount(owner, minlength=rows)))


def signatures(sets: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of each set that is not empty: size, fingerprint of the whole set, half keys of both sides, bitmap."""
    rows = np.flatnonzero(at[:-1] < at[1:])
    begin = at[:-1][rows]
    least = np.empty((len(rows), 2 * SIDE * HALF), np.uint64)
    for i in range(2 * SIDE * HALF):
        least[:, i] = np.minimum.reduceat((sets ^ _XOR[i]) * _MUL[i], begin)
    keys = np.zeros((len(rows), 2 * SIDE), np.uint64)
    for j in range(HALF):
        keys = mix(keys + least[:, j::HALF] + U(j + 1))
    keys = mix(keys + np.arange(2 * SIDE, dtype=np.uint64))  # a key holds its side and place
    bits = np.zeros((len(rows), BITS), bool)
    sizes = np.diff(at)[rows]
    bits[np.repeat(np.arange(len(rows)), sizes), (sets >> U(54)).astype(np.int64)] = True
    return {
        "rows": rows,
        "n": sizes,
        "f": [hashlib.sha256(sets[i:j]).digest() for i, j in zip(begin.tolist(), at[1:][rows].tolist())],
        "keys": keys.view(np.int64),
        "bits": np.packbits(bits, axis=1).view(np.int64),
    }


_BITS = [f"b{i}" for i in range(WORDS)]


def _sign(batches):
    """Rows (doc_id, text) to signatures; a row without shingles has n = 0 and nulls."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for lo, hi in chunks(at):
            sets, inner = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            n = np.diff(inner)
            cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64())]
            empty = n == 0
            if empty.all():
                cols += [pa.nulls(hi - lo, pa.binary()), pa.nulls(hi - lo, pa.list_(pa.int64()))] + [pa.nulls(hi - lo, pa.int64())] * WORDS
            else:
                s = signatures(sets, inner)
                take = np.zeros(hi - lo, np.int64)
                take[s["rows"]] = np.arange(len(s["rows"]))
                cols.append(pa.array([None if none else s["f"][i] for i, none in zip(take, empty)], pa.binary()))
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(empty, 0, 2 * SIDE))), pa.int32()), pa.array(s["keys"].ravel()))
                cols += [keys] + [pa.array(s["bits"][take, i], pa.int64(), mask=empty) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "f", "keys", *_BITS])


def _sets(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for lo, hi in chunks(at):
            sets, inner = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), lists], ["id", "s"])


def shared_keys(nodes: DataFrame, rows: int) -> DataFrame:
    """(t, i, j, id): the table keys that at least two nodes may hold, and the places of their half keys on both sides.
    Half keys that one node alone holds go first. rows: a bound of the nodes."""
    half = nodes.select("id", F.posexplode("keys").alias("place", "key"))
    twice = save(half.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"), "half_keys", SIDE * rows)
    half = spread_join(half, twice.select("key"), ["key"], "left_semi", twice)
    sides = half.groupBy("id").agg(
        F.collect_list(F.when(F.col("place") < SIDE, F.struct("place", "key"))).alias("a"),
        F.collect_list(F.when(F.col("place") >= SIDE, F.struct("place", "key"))).alias("b"),
    )
    pairs = sides.select("id", "b", F.explode("a").alias("a")).select("id", "a", F.explode("b").alias("b"))
    return pairs.select(F.xxhash64("a.key", "b.key").alias("t"), F.col("a.place").alias("i"), F.col("b.place").alias("j"), "id")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (l, r) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("l"), F.col("s").alias("sl"))
    right = sets.select(F.col("id").alias("r"), F.col("s").alias("sr"))
    by_r = pairs.groupBy("r").agg(F.count("*").alias("_n"))
    both = spread_join(spread_join(pairs, left, ["l"]), right, ["r"], counts=by_r).withColumn("both", F.size(F.array_intersect("sl", "sr")))
    return both.where(100 * F.col("both") >= percent * (F.size("sl") + F.size("sr") - F.col("both"))).select("l", "r")


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and bitmaps do not exclude."""
    def end(side: str) -> DataFrame:
        return nodes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), *(F.col(b).alias(f"{b}{side}") for b in _BITS))

    by_r = pairs.groupBy("r").agg(F.count("*").alias("_n"))
    return spread_join(spread_join(pairs, end("l"), ["l"]), end("r"), ["r"], counts=by_r).where(_bound(percent)).select("l", "r")


def _bound(percent: int):
    """differ: at least so many shingles are in one set only; the intersection is at most (nl + nr - differ) / 2."""
    differ = sum((F.bit_count(F.col(f"{b}l").bitwiseXOR(F.col(f"{b}r"))) for b in _BITS), F.lit(0))
    common, total = F.col("nl") + F.col("nr") - differ, F.col("nl") + F.col("nr") + differ
    sizes = (100 * F.least("nl", "nr") >= percent * F.greatest("nl", "nr"))
    return sizes & (100 * common >= percent * total)


def _pairs_in(table: pa.Table, percent: int):
    """Index pairs (i, j) of rows in one group (t, x, y) that may be linked: in different components, in their first
    common table, and not excluded by sizes and bitmaps. Rows come sorted by group and component."""
    col = {k: table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in ("t", "x", "y", "block", "c", "n", "i", "j")}
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(table), 2 * SIDE)
    bits = np.column_stack([table.column(b).combine_chunks().to_numpy() for b in _BITS]).view(np.uint64)
    new = np.ones(len(table), bool)
    new[1:] = (col["t"][1:] != col["t"][:-1]) | (col["x"][1:] != col["x"][:-1]) | (col["y"][1:] != col["y"][:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(table)))
    places = np.arange(SIDE)

    def chosen(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = col["n"][i], col["n"][j]
        ok = (col["c"][i] != col["c"][j]) & ((col["x"][i] == col["y"][i]) | (col["block"][i] != col["block"][j]))
        ok &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        i, j, n, m = i[ok], j[ok], n[ok], m[ok]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(1).astype(np.int64)
        ok = 100 * (n + m - differ) >= percent * (n + m + differ)
        i, j = i[ok], j[ok]
        same = keys[i] == keys[j]
        ok = ~(same[:, :SIDE] & (places < col["i"][i][:, None])).any(1) & ~(same[:, SIDE:] & (places + SIDE < col["j"][i][:, None])).any(1)
        return i[ok], j[ok]

    for m in np.unique(size):  # groups of one size together, a bounded number of pairs at a time
        left, right = np.triu_indices(m, 1) if m <= 64 else (None, None)
        starts = begin[size == m]
        if left is not None:
            step = max(1, PAIRS_AT_ONCE // max(1, len(left)))
            for k in range(0, len(starts), step):
                yield chosen((starts[k : k + step, None] + left).ravel(), (starts[k : k + step, None] + right).ravel())
        else:
            for s in starts:  # a component's rows stand together, and meet those of the components after it only
                c = col["c"][s : s + m]
                ends = np.append(np.flatnonzero(c[1:] != c[:-1]) + 1, m)
                lo = 0
                for hi in ends[:-1]:
                    after = np.arange(hi, m)
                    step = max(1, PAIRS_AT_ONCE // len(after))
                    for k in range(lo, hi, step):
                        i, j = np.meshgrid(np.arange(k, min(k + step, hi)), after, indexing="ij")
                        yield chosen(s + i.ravel(), s + j.ravel())
                    lo = hi


def _unsettled(percent: int):
    """Rows sorted by group to pairs (l, r); a group that goes on in the next batch waits for it."""
    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not len(rows):
                continue
            last = tuple(rows.column(k)[-1].as_py() for k in ("t", "x", "y"))
            same = np.logical_and.reduce([rows.column(k).to_numpy() == v for k, v in zip(("t", "x", "y"), last)])
            cut = int(np.flatnonzero(same)[0])
            rest = rows.slice(cut)
            yield from emit(rows.slice(0, cut))
        if rest is not None:
            yield from emit(rest)

    def emit(rows: pa.Table):
        if len(rows):
            ids = rows.column("id").combine_chunks()
            for i, j in _pairs_in(rows, percent):
                if len(i):
                    a, b = ids.take(pa.array(i)), ids.take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b)], ["l", "r"])

    return run


def unsettled_pairs(rest: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """rest: t, i, j, id, c, n, keys, bitmap. Pairs of members of one table in different components that may be linked.
    A table with more than `block` members is split into blocks, and each pair of blocks is a group of its own: no task
    holds more than two blocks, however large the table."""
    count = rest.groupBy("t").agg(F.count("*").alias("_n"))
    blocks = count.select("t", F.ceil(F.col("_n") / block).cast("int").alias("blocks"))
    rows = spread_join(rest, blocks, ["t"], counts=count).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("blocks", "other")
    kind = rest.schema["id"].dataType.simpleString()
    sorted_rows = rows.repartition("t", "x", "y").sortWithinPartitions("t", "x", "y", "c")
    return sorted_rows.mapInArrow(_unsettled(percent), f"l {kind}, r {kind}")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id, kept."""
    tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, f binary, keys array<long>, " + ", ".join(f"{b} long" for b in _BITS)
    signed = save(in_shards(docs).mapInArrow(_sign, schema), "signatures")
    rows = signed.count()
    real = signed.where("n > 0 and doc_id is not null")
    # one node for each set, with the signature of its smallest id; a group's rows are combined before they move
    group = real.groupBy("f").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n"), F.min_by(F.struct("n", "keys", *_BITS), "doc_id").alias("s"))
    group = save(group, "classes", rows)
    nodes = group.select(F.col("rep").alias("id"), "s.*")
    tables = shared_keys(nodes, rows)
    sizes = tables.groupBy("t").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("_n")).where("hub < top")
    sizes = save(sizes.select("t", "hub", "_n"), "tables", SIDE * rows)
    tables = save(spread_join(tables, sizes.select("t", "hub"), ["t"], counts=sizes), "members", SIDE * rows)

    ids = tables.select("id").distinct()
    lean = save(nodes.join(ids, "id", "left_semi"), "candidates", rows)
    n_ids = lean.count()
    members = docs.withColumnRenamed("doc_id", "id").join(maybe_broadcast(lean.select("id"), n_ids, BROADCAST_IDS), "id", "left_semi")
    sets = save(members.mapInArrow(_sets, f"id {kind}, s array<long>"), "sets", rows)

    stars = save(tables.where("id <> hub").select(F.col("hub").alias("l"), F.col("id").alias("r")).distinct(), "spokes", rows)
    stars = save(possible(stars, lean, percent), "stars", rows)
    # rows of one doc_id with different texts are linked through that id
    several = real.groupBy("doc_id").agg(F.min("f").alias("a"), F.max("f").alias("b")).where("a <> b").select("doc_id")
    links = verified(stars, sets, percent)
    if not several.isEmpty():
        texts = save(spread_join(real.select("doc_id", "f"), several, ["doc_id"], "left_semi").distinct(), "several", rows)
        same_id = spread_join(texts, group.select("f", "rep"), ["f"]).where("doc_id <> rep")
        links = links.unionByName(same_id.select(F.col("rep").alias("l"), F.col("doc_id").alias("r")))
    found = components(save(links.distinct(), "links", rows), rows)

    # members of one table in different components: what no star has tested
    rest = save(tables.join(found, "id", "left").select("t", "i", "j", "id", F.coalesce("component", "id").alias("c")), "placed", SIDE * rows)
    mixed = rest.groupBy("t").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("t")
    rest = save(spread_join(rest, mixed, ["t"], "left_semi", sizes).join(lean, "id"), "mixed", rows)
    pairs = unsettled_pairs(rest, percent).distinct().join(stars, ["l", "r"], "left_anti")
    more = save(verified(save(pairs, "pairs", rows), sets, percent).distinct(), "links", rows)
    if not more.isEmpty():
        # the links so far enter as what they have led to
        known = found.select(F.col("id").alias("l"), F.col("component").alias("r"))
        found = components(known.unionByName(more), rows)

    root = group.join(found.withColumnRenamed("id", "rep"), "rep", "left").where("_n > 1 or component is not null")
    root = root.select("f", F.coalesce("component", "rep").alias("component"))
    out = spread_join(signed.select("doc_id", "n", "f"), root, ["f"], "left", group.where("_n > 1").select("f", "_n"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from words),
items as (select doc_id, unnest(s) as g from sets),
common as (
  select a.doc_id as l, b.doc_id as r, count(*) as n from items a join items b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select l, r from common join sets x on x.doc_id = l join sets y on y.doc_id = r
  where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
both_ways as (select l, r from links union all select r, l from links),
reach as (
  select doc_id as id, doc_id as least from sets
  union select b.r, reach.least from reach join both_ways b on b.l = reach.id),
roots as (select id, min(least) as component_id from reach group by id)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept
from sets join roots on id = doc_id
"""
