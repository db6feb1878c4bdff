import random

import pytest

import corpus_pipeline as cp
from attestor.llm import pii
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = random.Random(9)

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n)]

    def prose(w):
        return ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9))

    items = [(i, " ".join(words(20))) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        w, good = words(rng.randrange(30, 120)), rng.random() < 0.75
        text = prose(w) if good else " ".join(x.upper() + "!!" for x in w)
        if good and i % 10 == 3:
            text += " " + items[i % 5][1]
        if good and i % 10 == 4:
            text += f" Mail p{i}@mail.example.com or +1 (499) 555-{1000 + i}."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
        if good and i % 7 == 0:
            rows.append((1000 + i, text + " once more", "en", "s", len(text) + 10))
            rows.append((2000 + i, text, "en", "s", len(text)))
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, dict((i, q) for i, q, _ in labels), items


def test_stages_against_plain_versions(spark, tmp_path):
    rows, labels, items = corpus(spark, tmp_path)
    d, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    out = {}
    for name, stage in cp.STAGES:
        docs = cp.save(stage(spark, docs, d), name)
        out[name] = docs
        assert name == "bpe" or docs.columns == names
    good = {r.doc_id: r.text for r in out["quality"].collect()}
    assert sum(labels.get(i, labels.get(i % 1000)) != 1 for i in good) <= 2
    assert len(good) >= 0.98 * sum(labels[i % 1000] for i, *_ in rows)
    kept = {i for i, (_, _, k) in brute.near_duplicates(sorted(good.items())).items() if k}
    assert {r.doc_id for r in out["near_dup"].collect()} == kept
    clean = {i for i in kept if not brute.hits(good[i], items)[2]}
    assert {r.doc_id for r in out["decontaminate"].collect()} == clean and len(clean) < len(kept)
    for r in out["pii"].collect():
        found = pii.find(good[r.doc_id])
        assert (r.text != good[r.doc_id]) == bool(found) and r.n_chars == len(r.text)
        assert not any(m.said in r.text for m in found)
    assert {r.doc_id for r in out["bpe"].collect()} == clean
    assert {tuple(r) for r in cp.run(spark, d).collect()} == {tuple(r) for r in out["bpe"].collect()}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "a b", "en", "s", 3), (None, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0)]])
def test_odd_rows(spark, tmp_path, rows):
    d = str(tmp_path)
    spark.createDataFrame([(*r, 1) for r in rows], DOC + ", kept int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = cp.run(spark, d).collect()
    assert sorted([r.doc_id for r in got], key=repr) == sorted([None, None, 1, 2] if rows else [], key=repr)


def test_rows_without_ids_are_judged_each(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows = [(None, "clean words", "en", "s", 1), (None, "has one two three in it", "en", "s", 1), (None, "bad words", "en", "s", 1), (4, "bad and one two three", "en", "s", 1), (5, "fine", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOC)
    assert sorted(r.text for r in cp.clean(spark, docs, d).collect()) == ["bad words", "clean words", "fine"]
    # a stand-in for the classifier: how rows are chosen by their scores is what is tested
    monkeypatch.setattr(cp.quality, "accepted", lambda docs, labels: docs.where("text not like 'bad%'"))
    assert sorted(r.text for r in cp.good(spark, docs, d).collect()) == ["clean words", "fine", "has one two three in it"]


def test_what_stages_write_besides_is_deleted(spark, tmp_path):
    from pathlib import Path

    from attestor.llm.common import shared_dir

    corpus(spark, tmp_path)
    folder = Path(shared_dir(spark).removeprefix("file:")) / "attestor"
    before = set(folder.iterdir()) if folder.is_dir() else set()
    out = cp.run(spark, str(tmp_path))
    left = {x.name for f in set(folder.iterdir()) - before for x in f.iterdir()}
    assert {"quality", "near_dup", "decontaminate", "pii"} <= left and not left & {"signatures", "sets", "postings", "mentions"}
    assert out.count() > 0
