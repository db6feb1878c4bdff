"""Operator 5, toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Input of a word: a vector of the word (of the training vocabulary) beside the mean vector of its character pieces, so an
unknown word still has a spelling. A forward and a backward gated recurrent layer read a window of `WINDOW` words; attention
weighs their states, and a linear layer gives the window's logit. A document's windows overlap by half and cover all its
words; its score is the calibrated highest logit.

Training is on a bounded sample: at most `TOXIC_DOCS` and `CLEAN_DOCS` labelled documents, by the hash of their id. Labels
are for documents, so the windows that stand for a toxic document are chosen anew after each round (multiple-instance
learning), and those of clean documents that score highest are added as hard cases. Calibration is on labelled
documents that training has not seen, of the same bound.

Defined cases: null and empty texts are one window without words; texts are scored whole; without labels of both classes
all scores are the share of toxic ones (0 without labels); repeated rows and null ids are scored each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import fold_of, table, tuned

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, GRAMS = 8, 8, 8, 1 << 16
TOXIC_DOCS, CLEAN_DOCS = 1200, 2400
#: Documents of the sample that hold a word which gets a vector of its own; rarer ones have their pieces.
SEEN = 3
ROUNDS, STEPS, BATCH, RATE = 2, 260, 192, 0.01
#: Weight of a toxic document without a window that stands out.
DOUBT = 0.05
#: Times that a round sees its windows at most.
EPOCHS = 30
#: Pull of word and piece vectors back to where they began, at each step, and the statistic that chance reaches.
DECAY, CHANCE = 0.05, 15.0
#: Windows computed side by side, and words whose input a worker keeps.
SIDE_BY_SIDE, CACHE_WORDS = 4096, 250_000

_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def window_starts(n: int) -> np.ndarray:
    """Where the windows of n words begin: every STRIDE words, and one that ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def grams_of(word: str) -> list[int]:
    """Hash buckets of a word's beginnings of 3 to 8 characters (in bytes) and of all its three-character pieces."""
    raw = b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03"
    n = len(raw)
    return [crc32(raw[:k]) % GRAMS for k in range(4, min(10, n + 1))] + [crc32(raw[i : i + 3], 1) % GRAMS for i in range(max(1, n - 2))]


# ---- the network ------------------------------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, n_words: int, rng: np.random.Generator):
        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        inputs = WORD_DIM + CHAR_DIM
        self.p = {
            "word": np.zeros((n_words, WORD_DIM), np.float32), "gram": np.zeros((GRAMS, CHAR_DIM), np.float32),
            **{f"w{d}": normal(inputs, 3 * HIDDEN, scale=0.3) for d in "fb"},
            **{f"u{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3) for d in "fb"},
            **{f"b{d}": np.zeros(3 * HIDDEN, np.float32) for d in "fb"},
            "attend": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32),
        }

    def layer(self, x: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, batch, HIDDEN) for projected inputs x (time, batch, 3 * HIDDEN), in the order given."""
        u, h = self.p["u" + d], np.zeros((x.shape[1], HIDDEN), np.float32)
        states = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            hu = h @ u
            gates = _sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = new if mask is None else np.where(mask[t][:, None], new, h)
            states[t] = h
        return states

    def pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention weights and pooled states."""
        e = states @ self.p["attend"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return pooled @ self.p["out"] + self.p["bias"][0], a, pooled

    def logits(self, f: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """f, b: projected inputs (time, batch, 3 * HIDDEN) of both directions, in reading order."""
        back = self.layer(b[::-1], None if mask is None else mask[::-1], "b")[::-1]
        return self.pool(np.concatenate([self.layer(f, mask, "f"), back], 2), mask)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients of all but the input vectors, and the gradient of x (time, batch, inputs)."""
        p, g = self.p, {}
        kept: dict[str, list] = {"f": [], "b": []}
        forward = self.layer(x @ p["wf"] + p["bf"], mask, "f", kept["f"])
        back = self.layer((x @ p["wb"] + p["bb"])[::-1], mask[::-1], "b", kept["b"])[::-1]
        states = np.concatenate([forward, back], 2)
        logit, a, pooled = self.pool(states, mask)
        prob = _sigmoid(logit)
        loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
        dl = (weight * (prob - y) / len(y)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpooled = dl[:, None] * p["out"]
        dstates = a[:, :, None] * dpooled
        da = np.einsum("tbh,bh->tb", states, dpooled)
        de = a * (da - (a * da).sum(0))
        g["attend"] = np.einsum("tb,tbh->h", de, states)
        dstates = dstates + de[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for d, ds, order in (("f", dstates[:, :, :HIDDEN], slice(None)), ("b", dstates[:, :, HIDDEN:], slice(None, None, -1))):
            ds, m, xs = ds[order], mask[order], x[order]
            dproj = np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            g["u" + d] = np.zeros_like(p["u" + d])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, z, r, n, hn = kept[d][t]
                dh = dh + ds[t]
                live = m[t][:, None]
                dnew = np.where(live, dh, 0)
                dz, dn = dnew * (h - n) * z * (1 - z), dnew * (1 - z) * (1 - n * n)
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                dproj[t] = np.concatenate([dz, dr, dn], 1)
                g["u" + d] += h.T @ dhu
                dh = np.where(live, dnew * z, dh) + dhu @ p["u" + d].T
            flat = dproj.reshape(-1, 3 * HIDDEN)
            g["w" + d], g["b" + d] = xs.reshape(len(flat), -1).T @ flat, flat.sum(0)
            dx[order] += (flat @ p["w" + d].T).reshape(x.shape)
        return loss, g, dx


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads.values())) + 1e-9))
        for k, g in grads.items():
            self.m[k] += 0.1 * (g * size - self.m[k])
            self.v[k] += 0.01 * ((g * size) ** 2 - self.v[k])
            params[k] -= (self.rate * self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores whole texts; words' projected inputs are kept up to a bound."""

    def __init__(self, net: Network, vocabulary: dict[str, int], slope: float = 1.0, offset: float = 0.0):
        self.net, self.vocabulary, self.slope, self.offset = net, vocabulary, slope, offset
        self.reset()

    def reset(self) -> None:
        p = self.net.p
        self.rows: dict[str, int] = {}
        self.w, self.b = np.hstack([p["wf"], p["wb"]]), np.concatenate([p["bf"], p["bb"]])
        self.table = np.empty((0, 6 * HIDDEN), np.float32)

    def vectors(self, words: list[str]) -> np.ndarray:
        """The input vectors of words."""
        grams = [grams_of(w) for w in words]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        sums = np.add.reduceat(self.net.p["gram"][np.concatenate(grams)], np.cumsum(sizes) - sizes)
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        return np.hstack([self.net.p["word"][ids], sums / sizes[:, None]]).astype(np.float32)

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """The highest window logit of each list of words."""
        if len(self.rows) > CACHE_WORDS:
            self.reset()
        new = [w for w in set().union(*texts, [""]) if w not in self.rows]
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = np.vstack([self.table, self.vectors(new) @ self.w + self.b])
        return np.array([x.max() for x in self.windows(texts)])

    def windows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """All window logits of each list of words, whose inputs are in the table."""
        find, blank = self.rows.__getitem__, self.rows[""]
        sizes = np.array([len(t) for t in texts])
        flat = np.fromiter((find(w) for t in texts for w in t), np.int64, int(sizes.sum()))
        begin = np.append(0, np.cumsum(sizes))
        starts = [window_starts(n) for n in sizes]
        counts = np.array([len(s) for s in starts])
        at = np.concatenate([s + b for s, b in zip(starts, begin)])
        left = np.repeat(begin[1:], counts) - at  # words from a window's start to its text's end
        out = np.empty(len(at), np.float32)
        for whole in (True, False):
            chosen = np.flatnonzero((left >= WINDOW) == whole)
            for i in range(0, len(chosen), SIDE_BY_SIDE):
                c = chosen[i : i + SIDE_BY_SIDE]
                place = at[c] + np.arange(WINDOW)[:, None]
                mask = None if whole else np.arange(WINDOW)[:, None] < np.maximum(left[c], 1)
                ids = flat[place] if whole else np.where(place < begin[-1], flat[np.minimum(place, max(len(flat) - 1, 0))] if len(flat) else blank, blank)
                if not whole:
                    ids = np.where(np.arange(WINDOW)[:, None] < left[c], ids, blank)
                x = self.table[ids]
                out[c] = self.net.logits(x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask)
        return np.split(out, np.cumsum(counts)[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        logit = self.logits([words_of(t) for t in texts]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -40, 40)))


# ---- training ---------------------------------------------------------------------------------------------------

def _evidence(docs: Iterable[set], y: np.ndarray) -> tuple[dict, dict]:
    """Of each feature (word or piece): how far the share of toxic documents among its documents is from the share in all,
    as the signed root of the likelihood ratio statistic beyond CHANCE; and the number of its documents."""
    by: dict = {}
    for found, toxic in zip(docs, y):
        for w in found:
            by.setdefault(w, [0, 0])[int(toxic)] += 1
    share, out = float(y.mean()), {}
    for w, (clean, toxic) in by.items():
        n = clean + toxic
        g = 2 * sum(c * np.log(c / (n * q)) for c, q in ((toxic, share), (clean, 1 - share)) if c)
        out[w] = float(np.sign(toxic - n * share) * np.sqrt(max(0.0, g - CHANCE)))
    return out, {w: sum(c) for w, c in by.items()}


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Scorer:
    """Fits the network to documents. Word vectors start from the words' evidence in the sample."""
    rng = np.random.default_rng(seed)
    one: dict[str, str] = {}  # equal words, and equal numbers below, are kept once
    docs = [[one.setdefault(w, w) for w in words_of(t)] or [""] for t in texts]
    numbers = list(range(GRAMS))
    spelt = {w: tuple({numbers[g] for g in grams_of(w)}) for w in set().union(*docs)}
    evidence, count = _evidence(map(set, docs), y)
    pieces, _ = _evidence((set().union(*(spelt[w] for w in set(d))) for d in docs), y)
    common = sorted((w for w, n in count.items() if n >= SEEN), key=lambda w: (-abs(evidence[w]), -count[w], w))
    vocabulary = {w: i + 1 for i, w in enumerate(common)}
    net = Network(len(vocabulary) + 1, rng)
    for w, i in vocabulary.items():
        net.p["word"][i, 0] = np.clip(evidence[w] / 6, -1.5, 1.5)
    for g, e in pieces.items():
        net.p["gram"][g, 0] = np.clip(e / 6, -1.5, 1.5)
    origin = {k: net.p[k].copy() for k in ("word", "gram")}
    hint = {w: max(0.0, e, max(pieces[g] for g in spelt[w])) for w, e in evidence.items()}
    scorer, adam = Scorer(net, vocabulary), Adam(net.p, RATE)
    starts = [window_starts(len(d)) for d in docs]
    ranks = [np.array([max(hint[w] for w in d[s : s + WINDOW]) for s in at]) for d, at in zip(docs, starts)]
    for _ in range(ROUNDS):
        chosen = []  # (document, start, label, weight)
        for i, (at, rank) in enumerate(zip(starts, ranks)):
            best = int(np.argmax(rank))
            # a toxic document none of whose windows stands out says little about the one that was taken
            chosen.append((i, int(at[best]), float(y[i]), DOUBT if y[i] and rank[best] <= 0 else 1.0))
            if not y[i]:
                chosen += [(i, int(at[rng.integers(len(at))]), 0.0, 1.0) for _ in range(2)]
        label = np.array([c[2] for c in chosen])
        weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
        weight *= np.array([c[3] for c in chosen])
        types = {w: i for i, w in enumerate(sorted({w for i, s, _, _ in chosen for w in docs[i][s : s + WINDOW]} | {""}))}
        ids = np.full((len(chosen), WINDOW), types[""])
        sizes = np.empty(len(chosen), np.int64)
        for k, (i, s, _, _) in enumerate(chosen):
            part = docs[i][s : s + WINDOW]
            sizes[k] = len(part)
            ids[k, : len(part)] = [types[w] for w in part]
        names = list(types)
        own = np.array([vocabulary.get(w, 0) for w in names])
        grams = [np.array(grams_of(w)) for w in names]
        steps = min(STEPS, max(60, EPOCHS * len(chosen) // BATCH))
        for step in range(steps):
            adam.rate = RATE * min(1.0, 2.0 * (1 - step / steps) + 0.05)
            some = rng.integers(len(chosen), size=BATCH)
            part = ids[some].T
            used, where = np.unique(part, return_inverse=True)
            where = where.reshape(part.shape)
            flat = [grams[t] for t in used]
            n = np.fromiter(map(len, flat), np.int64, len(flat))
            flat = np.concatenate(flat)
            char = np.add.reduceat(net.p["gram"][flat], np.cumsum(n) - n) / n[:, None]
            known = np.where(rng.random(part.shape) < 0.1, 0, own[part])  # some words pass as unknown
            x = np.concatenate([net.p["word"][known], char[where]], 2).astype(np.float32)
            mask = np.arange(WINDOW)[:, None] < sizes[some]
            _, g, dx = net.gradients(x, mask, label[some], weight[some])
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], known.ravel(), dx[:, :, :WORD_DIM].reshape(-1, WORD_DIM))
            g["word"][0] = 0
            dchar = np.zeros((len(used), CHAR_DIM), np.float32)
            np.add.at(dchar, where.ravel(), dx[:, :, WORD_DIM:].reshape(-1, CHAR_DIM))
            np.add.at(g["gram"], flat, np.repeat(dchar / n[:, None], n, axis=0))
            adam.step(net.p, g)
            for k, before in origin.items():
                net.p[k] += DECAY * (before - net.p[k])
        scorer.reset()
        ranks = []
        for i in range(0, len(docs), 256):  # the windows that stand for each document are chosen anew
            scorer.logits(docs[i : i + 256])
            ranks += scorer.windows(docs[i : i + 256])
    scorer.reset()
    return scorer


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic map from logit to P(toxic), by Newton steps with a small pull towards (1, 0)."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * logit + offset, -40, 40)))
        w, g = p * (1 - p), p - y
        h = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, [(g * logit).sum() + 0.1 * (slope - 1), g.sum() + 0.1 * offset])
        step *= min(1.0, 2.0 / (abs(step).max() + 1e-12))
        slope, offset = max(0.05, slope - step[0]), offset - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


# ---- over DataFrames --------------------------------------------------------------------------------------------

def _sample(docs: DataFrame, labels: DataFrame, where: Column) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a bounded number of documents of each class, by the hash of their id."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("y").cast("int").alias("_y")).where("_y is not null and _id is not null").where(where).distinct()
    order = F.xxhash64("_id")
    some = known.where("_y = 1").orderBy(order).limit(TOXIC_DOCS).unionByName(known.where("_y = 0").orderBy(order).limit(CLEAN_DOCS))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("_y", "text", "doc_id")
    rows = sorted(rows.toLocalIterator(), key=lambda r: (r.doc_id, r._y, r.text or ""))
    return [r.text or "" for r in rows], np.array([float(r._y) for r in rows])


def score_documents(docs: DataFrame, labels: DataFrame, learn_from, fit_with) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, y) to doc_id, score. learn_from, fit_with: conditions on an id column's name,
    for the labels that may be read and for those that train the network; the others calibrate it."""
    spark = tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    texts, y = _sample(docs, labels, learn_from("_id") & fit_with("_id"))
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return docs.select("doc_id", F.lit(share).alias("score"))
    scorer = train(texts, y)
    held, truth = _sample(docs, labels, learn_from("_id") & ~fit_with("_id"))
    if len(set(truth)) == 2:
        logit = np.concatenate([scorer.logits([words_of(t) for t in held[i : i + 256]]) for i in range(0, len(held), 256)])
        scorer.slope, scorer.offset = platt(logit.astype(np.float64), truth)
    scorer.reset()
    sent = spark.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.scores(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, labels.select("doc_id", F.col("toxic").alias("y")), lambda c: fold_of(c, 4) != 2, lambda c: fold_of(c, 4) != 3)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
