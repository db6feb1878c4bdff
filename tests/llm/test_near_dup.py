import random

import numpy as np
import pytest

from attestor.llm import near_dup
from attestor.llm.components import components
from tests.llm import brute

DOC = "doc_id long, text string"


def run(spark, rows):
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}


def family(seed, n, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_agrees_with_all_pairs(spark):
    texts = family(1, 25, 9) + family(2, 25, 14) + family(3, 10, 2) + ["unrelated words only here now"] + [" ".join(f"x{j}_{i}" for j in range(60)) for i in range(20)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute.near_duplicates(rows)


def test_second_step_alone_finds_the_links(spark, monkeypatch):
    # tiny blocks: one table's members meet block by block
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    real = near_dup.unsettled_pairs
    monkeypatch.setattr(near_dup, "unsettled_pairs", lambda rest, percent, block=4: real(rest, percent, 4))
    rows = list(enumerate(family(4, 30, 12) + family(5, 12, 20)))
    assert run(spark, rows) == brute.near_duplicates(rows)


@pytest.mark.parametrize("texts", [
    [],
    [None, "", "   \n\t"],
    ["one two", "ONE two", "one two three", "one", None],
    ["a b c d e f"] * 5,
    ["x" * 200_000, "x" * 200_000, "word " * 30_000],
])
def test_edge_cases(spark, texts):
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute.near_duplicates(rows)


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], DOC + ", n string, component_id int")
    got = sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, None, True), (2, 3, 1, False), (3, 0, 3, True)], key=repr)


def test_one_id_with_two_texts_links_them(spark):
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "p q r s t u v"), (9, "p q r s t u v")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert {r.component_id for r in got} == {1}


def test_hashes_stand_for_sets():
    rng = random.Random(7)
    texts = ["".join(rng.choice("aAbß \n\tc") for _ in range(rng.randrange(80))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    sets, inner = near_dup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), at)
    seen = {}
    for i, t in enumerate(texts):
        mine = sets[inner[i] : inner[i + 1]].tolist()
        assert len(mine) == len(brute.shingles(t))
        seen.setdefault(frozenset(mine), set()).add(brute.shingles(t))
    assert all(len(v) == 1 for v in seen.values())


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(200, 199), (5, 5)]
    got = dict(components(spark.createDataFrame(links, "l long, r long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, 199: 199, 200: 199}
