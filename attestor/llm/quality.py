"""Operator 1, quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each whole text becomes a vector of document statistics (shares of character kinds, word and line shapes, repetition).
`FEATURES` random cosines approximate a Gaussian kernel over the standardised vector. Every partition of the labelled
rows sums its part of the normal equations; the sums add up in a tree, so neither rows nor partitions meet in one
task, and the driver solves one system of fixed size. Scores of rows that the fit has not seen are binned, and
pooling adjacent violators turns the bins into a monotone map from raw score to probability.

Learning is on a bounded sample: the documents of about `LEARN_ROWS` labels, by the hash of their id (all labels, where
there are no more). Half of them (by crc32(doc_id), see `folds`) fit the ridge, half the calibration. Scoring is then one pass
over all whole texts in which no row moves.

Defined cases: null and empty texts have the statistics of an empty text and are scored; labels or ids that are null are not
learnt from; repeated rows are scored each, a repeated label counts once; with one class or none all scores are that
class' share (0.5 without labels); a score at a knot is the knot's; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attestor.llm.common import fold_of, save, table, tuned, utf8

FEATURES, RIDGE, BINS, SEED = 256, 1e-3, 512, 11
#: Labels that are learnt from, about, at most.
LEARN_ROWS = 100_000
#: Kernel width, in units of the square root of the number of statistics.
WIDTH = 0.7
#: Tasks that add up the partial sums; as many vectors reach the driver.
FAN_IN = 16

_PUNCTUATION = ".,;:!?\"'()-"
_SYMBOLS = "#$%&*|<>=+/\\^~@_[]{}`"
NAMES = [
    "log_bytes", "upper", "lower", "digit", "space", "newline", "wide", "punctuation", "symbol", *(f"char_{c}" for c in "!#$%&*|.,"),
    "word_size", "word_spread", "longest_word", "distinct_words", "top_word", "upper_words", "symbol_words",
    "lines", "distinct_lines", "line_words", "short_lines", "sentence_words",
]


def statistics(text: str, counts: np.ndarray) -> list[float]:
    """The numbers in NAMES. counts: how often each byte occurs in the text's UTF-8."""
    n = max(1, int(counts.sum()))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    ends = sum(int(counts[ord(c)]) for c in ".!?")
    of = lambda chars: sum(int(counts[ord(c)]) for c in chars) / n
    return [
        math.log1p(n), int(counts[65:91].sum()) / n, int(counts[97:123].sum()) / n, int(counts[48:58].sum()) / n, of(" \t"), of("\n"),
        int(counts[128:].sum()) / n, of(_PUNCTUATION), of(_SYMBOLS), *(of(c) for c in "!#$%&*|.,"),
        math.log1p(sizes.mean()), math.log1p(sizes.std()), math.log1p(int(sizes.max())), len(seen) / k, max(seen.values(), default=0) / k,
        sum(map(str.isupper, words)) / k, 1.0 - sum(map(str.isalpha, words)) / k,
        math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(k / max(1, len(lines))),
        sum(1 for x in lines if len(x) < 30) / max(1, len(lines)), math.log1p(k / max(1, ends)),
    ]


def described(texts: pa.Array) -> np.ndarray:
    """The statistics of each text, a row each."""
    data, at = utf8(texts)
    rows = [statistics(t or "", np.bincount(data[at[i] : at[i + 1]], minlength=256)) for i, t in enumerate(texts.to_pylist())]
    return np.asarray(rows, np.float32).reshape(len(rows), len(NAMES))


def _describe(batches):
    """doc_id, y, text to doc_id, y, f."""
    for b in batches:
        flat = described(b.column("text")).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(NAMES), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), lists], ["doc_id", "y", "f"])


def matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


class Fourier:
    """cos(w x + b) for Gaussian w: their inner products approximate exp(-|x - y|^2 / (2 width^2))."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), FEATURES)) / (WIDTH * math.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([math.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), z * 0.1, np.ones((len(x), 1))])


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the vectors in column `s`: FAN_IN tasks add up what reaches them one by one, the driver adds theirs."""
    def add(batches):
        total = None
        for b in batches:
            for x in b.column("s").to_pylist():
                v = np.frombuffer(x)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]})

    rows = [np.frombuffer(r.s) for r in parts.repartition(FAN_IN).mapInArrow(add, "s binary").collect()]
    return np.sum(rows, axis=0) if rows else np.zeros(0)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic."""
    k = len(NAMES)
    got = rows.agg(*(f(F.col("f")[i].cast("double")) for f in (F.avg, F.stddev_pop) for i in range(k))).first()
    values = np.array([x or 0.0 for x in got])
    return values[:k], values[k:]


def fit_ridge(rows: DataFrame) -> tuple[Fourier, np.ndarray] | None:
    """rows: f, y. The weights that solve the summed normal equations; classes weigh alike."""
    shares = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(shares) < 2:
        return None
    weight = {y: sum(shares.values()) / (2 * n) for y, n in shares.items()}
    fourier = Fourier(*_moments(rows))
    sent = rows.sparkSession.sparkContext.broadcast(fourier)

    def partial(batches):
        a = None
        for b in batches:
            if not b.num_rows:
                continue
            z = sent.value(matrix(b.column("f")))
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            zw = z * np.array([weight[v] for v in y])[:, None]
            part = np.hstack([zw.T @ z, (zw.T @ y)[:, None]])
            a = part if a is None else a + part
        if a is not None:
            yield pa.RecordBatch.from_pydict({"s": [a.tobytes()]})

    total = _added(rows.select("f", "y").mapInArrow(partial, "s binary"))
    d = math.isqrt(len(total))
    while d * (d + 1) > len(total):
        d -= 1
    total = total.reshape(d, d + 1)
    n = sum(shares.values())
    return fourier, np.linalg.solve(total[:, :d] + RIDGE * n * np.eye(d), total[:, d])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: knots (x ascending) of the monotone map that is nearest to the shares y."""
    blocks: list[list[float]] = []  # sum of y, of n, of x
    for a, b, c in sorted(zip(x, y, n)):
        blocks.append([b * c, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def score_raw(rows: DataFrame, model) -> DataFrame:
    """rows with `raw`, the ridge score."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "f"]

    def run(batches):
        fourier, w = sent.value
        for b in batches:
            raw = fourier(matrix(b.column("f"))) @ w if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(raw, pa.float64())], [*names, "raw"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, schema + ", raw double")


def calibration(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Knots from rows (raw, y): a histogram first, so that the driver gets BINS rows at most."""
    bin_of = F.floor(F.greatest(F.least(F.col("raw"), F.lit(1.5)), F.lit(-0.5)) * (BINS // 2))
    # the counts get one row of either class added over the whole range, so that no knot is exactly 0 or 1
    got = rows.groupBy(bin_of.alias("b")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("b").collect()
    x, y, n = (np.array([float(r[k]) for r in got]) for k in ("x", "y", "n"))
    return isotonic(x, (y * n + 0.5 / len(n)) / (n + 1.0 / len(n)), n)


def folds(doc_id: str) -> tuple[Column, Column]:
    """Whether a row is held out, and whether it is one of those that fit the ridge."""
    return fold_of(doc_id, 3) == 1, fold_of(doc_id, 3) == 0


def sample(labels: DataFrame, learn_from: Callable[[str], Column]) -> DataFrame:
    """_id, y: the labels that are learnt from, at most about LEARN_ROWS, each once."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("y").cast("double").alias("y")).where("y is not null and _id is not null")
    known = save(known.where(learn_from("_id")).distinct(), "labels", labels.count())
    share = min(1.0, LEARN_ROWS / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


class Model:
    """Texts to calibrated scores; without a ridge they are all the same."""

    def __init__(self, ridge, knots: tuple[np.ndarray, np.ndarray], share: float):
        self.ridge, self.knots, self.share = ridge, knots, share

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.ridge is None or not len(texts):
            return np.full(len(texts), self.share)
        fourier, w = self.ridge
        return np.clip(np.interp(fourier(described(texts).astype(np.float64)) @ w, *self.knots), 0.0, 1.0)


def learnt(docs: DataFrame, labels: DataFrame, learn_from: Callable[[str], Column], fit_with: Callable[[str], Column]) -> Model:
    """docs (doc_id, text), labels (doc_id, y); learn_from, fit_with: conditions on an id column's name, for the labels that
    are read and for those that go into the ridge; the others calibrate it."""
    tuned(docs.sparkSession)
    chosen = sample(labels, learn_from)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "y", "text")
    train = save(rows.mapInArrow(_describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y double, f array<float>"), "training", LEARN_ROWS)
    fit = train.withColumn("fit", fit_with("doc_id"))
    ridge = fit_ridge(fit.where("fit").select("f", "y"))
    share = train.agg(F.avg("y")).first()[0]
    if ridge is None:
        return Model(None, (np.zeros(0), np.zeros(0)), 0.5 if share is None else float(share))
    knots = calibration(score_raw(fit.where("not fit").select("f", "y"), ridge))
    return Model(ridge, knots if len(knots[0]) else (np.array([0.0, 1.0]), np.array([0.0, 1.0])), 0.0)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Callable[[str], Column], fit_with: Callable[[str], Column]) -> DataFrame:
    """doc_id, score of each row."""
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, learn_from, fit_with))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.scores(b.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, StructType([docs.schema["doc_id"], StructField("score", DoubleType())]))


def _quality(labels: DataFrame) -> tuple:
    return labels.select("doc_id", F.col("quality").alias("y")), lambda c: ~folds(c)[0], lambda c: folds(c)[1]


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, *_quality(labels))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`; each is judged by its own text."""
    sent = docs.sparkSession.sparkContext.broadcast(learnt(docs, *_quality(labels)))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.scores(b.column("text")) >= least))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", F.coalesce(folds("doc_id")[0], F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
