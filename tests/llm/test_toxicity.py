import random
import zlib

import numpy as np

from attestor.llm import toxicity as tox

DOC, LABEL = "doc_id long, text string", "doc_id long, toxic int"


def test_gradients():
    rng = np.random.default_rng(0)
    net = tox.Network(3, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((6, 3, tox.WORD_DIM + tox.CHAR_DIM))
    mask, y, w = np.arange(6)[:, None] < np.array([6, 4, 1]), np.array([1.0, 0, 1]), np.ones(3)
    _, grads, dx = net.gradients(x, mask, y, w)
    for name in ("wf", "uf", "bf", "wb", "ub", "bb", "attend", "out", "bias"):
        at = tuple(n // 2 for n in net.p[name].shape)
        values = []
        for step in (1e-3, -1e-3):
            net.p[name][at] += step
            values.append(net.gradients(x, mask, y, w)[0])
            net.p[name][at] -= step
        assert abs((values[0] - values[1]) / 2e-3 - grads[name][at]) < 1e-3, name
    values = []
    for step in (1e-3, -1e-3):
        x[2, 1, 5] += step
        values.append(net.gradients(x, mask, y, w)[0])
        x[2, 1, 5] -= step
    assert abs((values[0] - values[1]) / 2e-3 - dx[2, 1, 5]) < 1e-3


def test_windows_cover_all_words():
    for n in (0, 1, tox.WINDOW, tox.WINDOW + 1, 100, 1001):
        starts = tox.window_starts(n)
        assert set(range(n)) <= {p for s in starts for p in range(s, s + tox.WINDOW)}
        assert starts[0] == 0 and (n <= tox.WINDOW or starts[-1] == n - tox.WINDOW)


def corpus(n, seed=1):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("abcdefghiklmno") for _ in range(rng.randrange(2, 8))) for _ in range(1500)]
    bad = ["zounds", "varlet", "knavery"] + [f"quisling{x}" for x in clean[:40]]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 400))]
        toxic = rng.random() < 0.25
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", ",", "!!"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_documents(spark):
    rows = corpus(1400)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    labels = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], LABEL)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOC)
    got = {r.doc_id: r.score for r in tox.toxicity_scores(docs, labels).collect()}
    judged = [(got[i] >= 0.3, bool(y)) for i, _, y in rows if i in held]
    assert np.mean([a for a, b in judged if b]) > 0.9
    assert np.mean([a for a, b in judged if not b]) < 0.05


def test_edge_cases(spark):
    assert tox.toxicity_scores(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)).count() == 0
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "word " * 40_000, "z")], DOC + ", score string")
    assert {r.score for r in tox.toxicity_scores(docs, spark.createDataFrame([], LABEL)).collect()} == {0.0}


def test_scores_of_odd_texts():
    scorer = tox.Scorer(tox.Network(2, np.random.default_rng(3)), {"word": 1})
    texts = [None, "", "!!!", "word", "word " * 33, "ß " * 5000]
    whole = scorer.scores(texts)
    assert np.allclose(whole, [scorer.scores([t])[0] for t in texts], atol=1e-5)
    assert whole[0] == whole[1] == whole[2]


def test_odd_rows_through_a_fitted_model(spark):
    rows = corpus(700, 4)
    odd = [(9001, None), (9002, ""), (9003, "word " * 60_000), (9004, "word " * 60_000 + "zounds varlet knavery"), (9001, "plain words"), (None, "plain words"), (9005, "plain words")]
    docs = spark.createDataFrame([(*r, "x") for r in [*((i, t) for i, t, _ in rows), *odd]], DOC + ", score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(None, 1), (5, None), (9001, 0), (9002, 0)], LABEL)
    by = {}
    for r in tox.toxicity_scores(docs, labels).collect():
        assert 0 <= r.score <= 1
        by.setdefault(r.doc_id, []).append(r.score)
    assert sum(map(len, by.values())) == len(rows) + len(odd)
    assert len(by[9001]) == 2 and by[9005] == by[None] and min(abs(by[9005][0] - s) for s in by[9001]) < 1e-6
    assert min(abs(by[9002][0] - s) for s in by[9001]) < 1e-6
    assert by[9004][0] > 0.3 > by[9003][0]


def test_windows_by_a_plain_version():
    """All overlapping windows, one by one and step by step."""
    rng = np.random.default_rng(8)
    scorer = tox.Scorer(tox.Network(4, rng), {"a": 1, "b": 2, "c": 3}, 1.3, -0.2)
    scorer.net.p["word"][:] = rng.standard_normal(scorer.net.p["word"].shape)
    scorer.net.p["gram"][:] = rng.standard_normal(scorer.net.p["gram"].shape) * 0.3
    scorer.reset()
    p, sig = scorer.net.p, lambda x: 1 / (1 + np.exp(-x))
    h = tox.HIDDEN

    def states(xs, d):
        s, out = np.zeros(h), []
        for x in xs:
            i, r = x @ p["w" + d] + p["b" + d], s @ p["u" + d]
            z, g = sig(i[:h] + r[:h]), sig(i[h : 2 * h] + r[h : 2 * h])
            s = (1 - z) * np.tanh(i[2 * h :] + g * r[2 * h :]) + z * s
            out.append(s)
        return out

    def logit(words):
        xs = [np.hstack([p["word"][scorer.vocabulary.get(w, 0)], np.mean([p["gram"][g] for g in tox.grams_of(w)], 0)]) for w in words or [""]]
        hs = [np.hstack(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
        e = np.exp([x @ p["attend"] for x in hs])
        return (e / e.sum()) @ np.array(hs) @ p["out"] + p["bias"][0]

    texts = ["", "a b unknown", "c " * 40 + "b a", " ".join(rng.choice(["a", "b", "c", "dd"], 100))]
    for t, got in zip(texts, scorer.scores(texts)):
        w = t.split()
        best = max(logit(w[s : s + tox.WINDOW]) for s in tox.window_starts(len(w)))
        assert abs(got - sig(1.3 * best - 0.2)) < 1e-4
