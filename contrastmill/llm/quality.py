"""Quality of documents: random-indexing word vectors, pooled, and a two-layer network.

Every token (run of letters, digits or punctuation; words in capitals are tokens of their own) has
one of ``BUCKETS`` hashed entries, and an entry a sparse random index vector. The vector of an
entry is the sum of the index vectors of its neighbours over the whole corpus; these sums are
whole numbers, so they do not depend on the order of tasks, and their number is fixed whatever the
corpus. A document is the mean of its tokens' vectors and index vectors, with how far the tokens
agree among themselves (repetition). A network with one hidden layer is fitted in numpy to a
sample of at most ``sample`` labelled documents, and a temperature, fitted to documents that the
network has not seen, turns its outputs into probabilities.

Null and empty texts have a score as any other. Repeated rows keep their own result rows. Without
labels of both kinds all documents score the share of label 1 among them, 1 without any label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastmill.llm.arrow_text import LOWER, SPACES, Runs, row_sums, slices, utf8
from contrastmill.llm.labelled import TRAINING, held_out, scored_schema, training_labels, training_rows, with_features, with_score
from contrastmill.runtime import materialize

BUCKETS = 1 << 14
DIM = 24
WINDOW = 2
LAGS = 4
SAMPLE = 20_000
THRESHOLD = 0.7

KIND = np.full(256, 3, np.uint8)
KIND[list(SPACES)] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each entry two components (in different halves) and their signs."""
    rng = np.random.default_rng(11)
    where = np.stack([rng.integers(0, DIM // 2, BUCKETS), rng.integers(DIM // 2, DIM, BUCKETS)])
    return where, rng.choice(np.array([-1, 1]), (2, BUCKETS))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each token, and where the tokens of each row begin."""
    runs = Runs(data, at, KIND, LOWER)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    count = lambda c: c[runs.end] - c[runs.begin]
    capitals = (count(upper) >= 2) & (count(lower) == 0)
    code = runs.hash ^ (capitals.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
    return (code >> np.uint64(64 - 14)).astype(np.int64), runs.rows


def _neighbours(batches):
    where, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for first, last in slices(at):
            w, rows = tokens(data[at[first] : at[last]], at[first : last + 1] - at[first])
            row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            for k in range(1, WINDOW + 1):
                same = row[k:] == row[:-k]
                a, b = w[:-k][same], w[k:][same]
                for one, other in ((a, b), (b, a)):
                    for h in (0, 1):
                        total += np.bincount(one * DIM + where[h][other], sign[h][other], BUCKETS * DIM)
    sums = total.reshape(BUCKETS, DIM).astype(np.int64)
    seen = np.flatnonzero(sums.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen, pa.int64()), *(pa.array(sums[seen, d]) for d in range(DIM))], ["entry", *(f"v{d}" for d in range(DIM))]
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A unit vector for each entry (zero if not seen), from all of ``docs``."""
    parts = docs.select("text").mapInArrow(_neighbours, "entry long, " + ", ".join(f"v{d} long" for d in range(DIM)))
    table = parts.groupBy("entry").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM))).toArrow()
    out = np.zeros((BUCKETS, DIM))
    out[table.column("entry").to_numpy()] = np.stack([table.column(f"v{d}").to_numpy() for d in range(DIM)], axis=1)
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def pooled(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each row; ``vectors`` holds the vectors and the index vectors of the entries."""
    w, rows = tokens(data, at)
    n_rows = len(rows) - 1
    n = np.diff(rows).astype(np.float64)
    some = np.maximum(n, 1)
    row = np.repeat(np.arange(n_rows), np.diff(rows))
    pair, count = np.unique(row * BUCKETS + w, return_counts=True)
    of = pair // BUCKETS
    begin = np.searchsorted(of, np.arange(n_rows + 1))
    means = row_sums(vectors[pair % BUCKETS] * count[:, None].astype(np.float32), begin) / some[:, None]
    agreement = row_sums(count.astype(np.float64) ** 2, begin) / some**2
    parts = [means, np.diff(begin) / some, np.sqrt(agreement), np.log1p(n)]
    for k in range(1, LAGS + 1):
        repeated = np.zeros(len(w))
        repeated[k:] = (w[k:] == w[:-k]) & (row[k:] == row[:-k])
        parts.append(row_sums(repeated, rows) / some)
    return np.column_stack(parts).astype(np.float32)


def feature_rows(column, both: np.ndarray) -> np.ndarray:
    data, at = utf8(column)
    found = [np.zeros((0, 2 * DIM + 3 + LAGS), np.float32)]
    for first, last in slices(at):
        found.append(pooled(data[at[first] : at[last]], at[first : last + 1] - at[first], both))
    return np.concatenate(found).astype(np.float64)


def with_index_vectors(vectors: np.ndarray) -> np.ndarray:
    where, sign = index_vectors()
    index = np.zeros((BUCKETS, DIM), np.float32)
    for h in (0, 1):
        index[np.arange(BUCKETS), where[h]] = sign[h]
    return np.concatenate([vectors, index], axis=1)


def _training_features(vectors: np.ndarray):
    def run(batches):
        both = with_index_vectors(vectors)
        for batch in batches:
            x = feature_rows(batch.column("text"), both)
            yield with_features(batch, x)

    return run


class Network:
    """Standardised inputs, one hidden layer of tanh, one output; fitted by Adam with weight decay."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, decay: float = 1e-4):
        rng = np.random.default_rng(5)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = self._scaled(x)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        epochs = max(epochs, min(600, 60_000 // max(1, len(x))))
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(x))
            for first in range(0, len(x), batch):
                rows = order[first : first + batch]
                a = np.tanh(x[rows] @ p[0] + p[1])
                slope = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
                back = slope[:, None] * p[2] * (1 - a * a)
                step += 1
                for i, g in enumerate((x[rows].T @ back, back.sum(0), a.T @ slope, slope.sum(keepdims=True))):
                    g = g + decay * p[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature under which the labels of these rows are likeliest, on a fixed grid."""
        if not len(y):
            return
        z = self.logits(x)
        loss = [np.logaddexp(0, np.where(y > 0, -z, z) / t).mean() for t in TEMPERATURES]
        self.temperature = float(TEMPERATURES[int(np.argmin(loss))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


TEMPERATURES = np.exp(np.linspace(np.log(0.5), np.log(10), 61))


class Constant:
    def __init__(self, score: float):
        self.score = score

    def scores(self, x):
        return np.full(len(x), self.score)


def fit(x: np.ndarray, y: np.ndarray, part: np.ndarray):
    """A network of parts 0 to 7, calibrated on parts 8 and 9."""
    own = part < 8
    if len(np.unique(y[own])) < 2:
        return Constant(float(y.mean()) if len(y) else 1.0)
    model = Network(x[own], y[own])
    model.calibrate(x[~own], y[~own])
    return model


def _score(model, vectors: np.ndarray, name):
    def run(batches):
        both = with_index_vectors(vectors)
        for batch in batches:
            yield with_score(batch, model.scores(feature_rows(batch.column("text"), both)), name)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """All columns of ``docs`` (``doc_id``, ``text``) with the score as ``name``, which must be a new one.

    ``labels`` (``doc_id``, ``quality``) of held-out documents are not read.
    """
    chosen = materialize(training_labels(labels, "quality", sample))
    vectors = word_vectors(docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_training_features(vectors), TRAINING)
    model = fit(*training_rows(rows, sample))
    return docs.mapInArrow(_score(model, vectors, name), scored_schema(docs, name))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    scored = score_quality(docs.select("doc_id", "text"), labels, sample)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
