import random
import zlib

import numpy as np
import pytest

from attestor.llm import quality

DOC, LABEL = "doc_id long, text string", "doc_id long, quality int"


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))]
        good = rng.random() < 0.7
        text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy_and_no_leak(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOC)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    # labels of held-out rows are wrong on purpose: reading them would spoil the scores
    labels = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows if i % 2], LABEL)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i in held]
    assert np.mean(right) > 0.97


def test_edge_cases(spark):
    empty = quality.quality_scores(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL))
    assert empty.count() == 0
    docs = spark.createDataFrame([(1, None, 0.5, "f"), (1, "", 1.0, "y"), (None, "a " * 60_000, 1.0, "raw")], DOC + ", score double, f string")
    assert {r.score for r in quality.quality_scores(docs, spark.createDataFrame([], LABEL)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)] + [(3, None)], LABEL)
    assert {r.score for r in quality.quality_scores(docs, one).collect()} == {1.0}


def test_normal_equations_add_up(spark):
    rows = [(quality.statistics(t, np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)), float(y)) for _, t, y in corpus(300, 3)]
    df = spark.createDataFrame([([float(v) for v in f], y) for f, y in rows], "f array<float>, y double")
    one, many = quality.fit_ridge(df.coalesce(1)), quality.fit_ridge(df.repartition(40))
    x = np.array([f for f, _ in rows])
    assert np.allclose(one[0](x) @ one[1], many[0](x) @ many[1], atol=1e-6)


@pytest.mark.parametrize("y, expected", [([0, 1], [0, 1]), ([1, 0], [0.5]), ([0.1, 0.5, 0.3, 0.9], [0.1, 0.4, 0.9])])
def test_isotonic(y, expected):
    assert quality.isotonic(np.arange(len(y), dtype=float), np.array(y, float), np.ones(len(y)))[1].tolist() == pytest.approx(expected)


ODD = [(9001, None), (9002, ""), (9003, "Good words here. " * 20_000), (9004, "BAD!! " * 50_000), (9001, "Plain text again."), (None, "Plain text again."), (9005, "Plain text again.")]


def test_odd_rows_through_a_fitted_model(spark):
    rows = corpus(600, 5)
    docs = spark.createDataFrame([(*r, 0.5, "f") for r in [*((i, t) for i, t, _ in rows), *ODD]], DOC + ", score double, f string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(None, 1), (5, None), (9001, 1), (9002, 0), (9002, 1)], LABEL)
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert len(by[9001]) == 2 and by[None] == by[9005] and by[9005][0] in by[9001]
    # an empty text has one score, whether null or not
    assert by[9002][0] in by[9001] and max(by[9003]) > 0.5 > max(by[9004])
    kept = quality.accepted(docs, labels).collect()
    assert sorted(r.doc_id or -1 for r in kept) == sorted(r.doc_id or -1 for r in got if r.score >= 0.5) and kept[0].f == "f"


def test_scores_by_a_plain_version(spark):
    """The query's scores from the whole learning in numpy, in one piece."""
    rows = corpus(500, 6)
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], DOC), spark.createDataFrame([(i, y) for i, _, y in rows], LABEL)
    x = {i: np.array(quality.statistics(t, np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)), np.float32).astype(float) for i, t, _ in rows}
    part = {i: zlib.crc32(str(i).encode()) % 3 for i, *_ in rows}
    fx, fy = np.array([x[i] for i, *_ in rows if part[i] == 0]), np.array([float(y) for i, _, y in rows if part[i] == 0])
    fourier = quality.Fourier(fx.mean(0), fx.std(0))
    z, w = fourier(fx), np.where(fy == 1, len(fy) / (2 * (fy == 1).sum()), len(fy) / (2 * (fy == 0).sum()))
    beta = np.linalg.solve((z * w[:, None]).T @ z + quality.RIDGE * len(fy) * np.eye(z.shape[1]), (z * w[:, None]).T @ fy)
    held = [(float((fourier(x[i][None]) @ beta)[0]), y) for i, _, y in rows if part[i] == 2]
    bins = {}
    for raw, y in held:
        bins.setdefault(int(np.floor(np.clip(raw, -0.5, 1.5) * (quality.BINS // 2))), []).append((raw, y))
    n = np.array([len(v) for _, v in sorted(bins.items())], float)
    mx = np.array([np.mean([a for a, _ in v]) for _, v in sorted(bins.items())])
    my = np.array([np.mean([b for _, b in v]) for _, v in sorted(bins.items())])
    knots = quality.isotonic(mx, (my * n + 0.5 / len(n)) / (n + 1 / len(n)), n)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    want = {i: float(np.interp((fourier(x[i][None]) @ beta)[0], *knots)) for i, *_ in rows}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3


def test_learning_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEARN_ROWS", 100)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, y int")
    n = quality.sample(labels, lambda c: quality.folds(c)[0]).count()
    assert 50 < n < 160


def test_scores_at_knots_and_between(monkeypatch):
    model = quality.Model(((lambda x: x[:, :1]), np.ones(1)), (np.array([0.0, 1.0]), np.array([0.25, 0.75])), 0.0)
    monkeypatch.setattr(quality, "described", lambda texts: np.array([[float(t)] for t in texts.to_pylist()]))
    import pyarrow as pa

    assert model.scores(pa.array(["-5", "0", "0.5", "1", "7"])).tolist() == [0.25, 0.25, 0.5, 0.75, 0.75]
