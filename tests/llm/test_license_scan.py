import random
import re

import pytest

from attestor.llm import license_scan as ls
from tests.llm import brute

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def base_by_hand(text):
    w = brute.words(text, WORD)
    found = [(i, label) for phrase, label in ls.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def texts():
    rng = random.Random(4)
    parts = ["gnu", "General", "public", "LICENSE", "license", "apache", "Apache", "cc", "by", "mit", "é", "ß1", "x"]
    seps = [" ", "\n", "-", " * ", "/", "  "]
    made = ["".join(rng.choice(parts) + rng.choice(seps) for _ in range(rng.randrange(40))) for _ in range(200)]
    return made + [None, "", "the MIT License " * 3000, "Licensed under the Apache License, Version 2.0.", "mit licenses", "cc byé", "écc by"]


def test_base_columns():
    for t in texts():
        got = ls.scan(t)
        assert got[:5] == base_by_hand(t), t
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(","))
        assert 0 <= got[6] <= 1 and (got[6] > 0) == bool(got[5])


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated documentation", "mit"),
    ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"),
    ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    ("no rights mentioned", ""),
])
def test_labels(text, labels):
    assert ls.scan(text)[5] == labels


def test_gate_drops_no_match():
    """Every rule's own text passes the keyword gate: rules found by it are those that match without it."""
    rules = ls.rules()
    assert len(rules.rules) >= 200
    samples = [line.split(" | ")[2] for _, _, lines in ls.GROUPS for line in lines.strip().splitlines()]
    for s in samples:
        low = re.sub(r"\(\?[:!=][^)]*\)|[\\?()]", "", s).lower()
        free = [i for i, (_, _, _, p) in enumerate(rules.rules) if p.search(low)]
        assert set(free) <= set(rules.candidates(low)), s


def test_suppression_leaves_disjoint_places_of_highest_rank():
    rules = ls.Rules((("high", 0.9, "a | big | the big licence text"), ("low", 0.5, "b | licence | licence\nc | big | really the big licence text and more\nd | more | more words")))
    got = rules.detections("really the big licence text and more words. licence")
    assert [(s[2], s[3]) for s in got] == [("a", 0.9), ("d", 0.5), ("b", 0.5)]


def test_over_a_table(spark):
    rows = list(enumerate(texts())) + [(None, "MIT License"), (3, "MIT License")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    got = ls.license_scan(df)
    assert got.count() == len(rows)
    key = lambda r: repr((r[0], r[1:6]))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=key) == sorted(((i, *base_by_hand(t)) for i, t in rows), key=key)
    assert ls.license_scan(df.limit(0)).count() == 0


def test_deep_indentation():
    text = "Permission is hereby granted, free of charge, to any person obtaining\n" + " " * 40 + "* a copy of this software and associated documentation"
    assert ls.scan(text)[5] == "mit"
    assert ls.scan("permission is hereby" + " " * 1_000_000)[5] == ""


@pytest.mark.parametrize("text, label", [
    ("Neither the name of{0}the{0}University{0}of{0}Somewhere nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("As long as you retain this notice you can do whatever you want with this stuff.{0}If{0}we meet buy me a beer", "beerware"),
    ("governed by the CeCILL license{0}under French law,{0}version 2.1", "cecill-2.1"),
])
def test_gaps_are_counted_in_words(text, label):
    for separator in (" ", "\n" + " " * 400 + "// "):
        assert label in ls.scan(text.format(separator))[5].split(",")
    assert label not in ls.scan(text.format(" word" * 100 + " "))[5].split(",")


def plain_scan(text):
    """All rules without the gate, all matches, the strongest first."""
    low = (text or "").translate(brute.LOWER)
    found = sorted((rank, m.start() - m.end(), m.start(), r, m.end(), label, weight) for r, (rank, weight, label, p) in enumerate(ls.rules().rules) for m in p.finditer(low))
    kept = []
    for _, _, start, _, end, label, weight in found:
        if all(end <= s or e <= start for s, e, _, _ in kept):
            kept.append((start, end, label, weight))
    weights = {}
    for _, _, label, weight in kept:
        weights[label] = max(weight, weights.get(label, 0))
    for label in filter(None, base_by_hand(text)[4].split(",")):
        weights[label] = max(ls.BASE_WEIGHT, weights.get(label, 0))
    left = 1.0
    for w in weights.values():
        left *= 1 - w
    return ",".join(sorted(weights)), 1 - left


def test_the_query_against_a_plain_version(spark):
    from attestor.llm.queries import QUERIES
    from tests import oracle

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    rows = QUERIES["op6_license_scan"](spark, oracle.DATA).collect()
    assert len(rows) == len(texts) and any(r.labels for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(texts[r.doc_id])
        labels, score = plain_scan(texts[r.doc_id])
        assert r.labels == labels and r.score == pytest.approx(score)


def test_equal_rank_and_length_go_by_place():
    rules = ls.Rules((("one", 0.5, "a | alpha | alpha beta\nb | beta | beta gamm"),))
    assert [s[2] for s in rules.detections("alpha beta gamm")] == ["a"]
    rules = ls.Rules((("one", 0.5, "b | alpha | alpha beta\na | beta | alpha beta"),))
    assert [s[2] for s in rules.detections("alpha beta")] == ["b"]
