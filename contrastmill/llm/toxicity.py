"""Toxicity of documents: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: density of a given and of a learned lexicon, how near their words stand
to a second person, shares of capitals and of kinds of punctuation, and rates of obfuscation
(letters mixed with look-alikes, lexicon words that appear once those are undone, spelled-out
words, stretched letters). The learned lexicon has the words whose document frequency among
labelled documents differs most between toxic and other ones (likelihood ratio against the number
of words tried). Trees and calibration must not be fooled by words that were picked from the very
documents they are fitted to: for them, documents of either half of the labelled sample meet the
lexicon of the other half. Parts 0 to 7 grow the trees, 8 and 9 give the calibration; documents to
be scored meet the lexicon of the whole sample.

Null and empty texts have a score as any other. Repeated rows keep their own result rows. Without
labels of both kinds all documents score the share of label 1 among them, 0 without any label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastmill.llm.arrow_text import LOWER, Runs, hash_words, row_sums, slices, utf8
from contrastmill.llm.labelled import TRAINING, held_out, scored_schema, training_labels, training_rows, with_features, with_score
from contrastmill.runtime import materialize

SAMPLE = 30_000
LEXICON_SIZE = 5_000
THRESHOLD = 0.3

# Insults of everyday English, and words for the person spoken to.
INSULTS = tuple("idiot moron stupid trash scum loser clown pathetic worthless disgusting dumb imbecile jerk filth vermin bastard".split())
SECOND_PERSON = tuple(
    "you your yours yourself yourselves u ur youre thou thy tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "euch euer sie ihr ti tus tuyo usted ustedes vosotros su".split()
)
NEAR = 5

LETTER = np.zeros(256, np.uint8)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
# look-alikes of letters
ALIKE = dict(zip(b"0134578@$!|", b"oleastbasil"))
DISGUISED = LETTER.copy()
DISGUISED[list(ALIKE)] = 1
UNDISGUISE = LOWER.copy()
for _a, _b in ALIKE.items():
    UNDISGUISE[_a] = _b


def words_of(data: np.ndarray, at: np.ndarray) -> Runs:
    return Runs(data, at, LETTER, LOWER)


def spread(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def nearness(hits: np.ndarray, second: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hit (positions of words): 1 / (1 + distance) to the next second person of its row, and whether it is near."""
    score, near = np.zeros(len(hits)), np.zeros(len(hits))
    if len(second) and len(hits):
        after = np.searchsorted(second, hits)
        for neighbour in (np.clip(after - 1, 0, len(second) - 1), np.clip(after, 0, len(second) - 1)):
            at = second[neighbour]
            distance = np.abs(at - hits)
            one = np.where(row[at] == row[hits], 1 / (1 + distance), 0)
            score = np.maximum(score, one)
            near = np.maximum(near, (row[at] == row[hits]) & (distance <= NEAR))
    return score, near


def dense(data: np.ndarray, at: np.ndarray, given: np.ndarray, learned: np.ndarray, second_person: np.ndarray) -> np.ndarray:
    words = words_of(data, at)
    rows = words.rows
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    n = np.maximum(np.diff(rows), 1).astype(np.float64)
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    per_row = lambda flags: row_sums(flags.astype(np.float64), rows)
    in_given, in_learned = np.isin(words.hash, given), np.isin(words.hash, learned)
    second = np.isin(words.hash, second_person)
    hit = in_given | in_learned
    hits = np.flatnonzero(hit)
    near_score, near_count = nearness(hits, np.flatnonzero(second), row)
    by_hit = lambda v: np.bincount(row[hits], v, len(rows) - 1)

    upper, lower = spread((data >= 65) & (data <= 90)), spread((data >= 97) & (data <= 122))
    length = words.end - words.begin
    capitals = ((upper[words.end] - upper[words.begin]) >= 2) & ((lower[words.end] - lower[words.begin]) == 0)
    letters = np.maximum((upper[at[1:]] - upper[at[:-1]]) + (lower[at[1:]] - lower[at[:-1]]), 1)

    full = Runs(data, at, DISGUISED, UNDISGUISE)
    plain = spread(LETTER[data])
    kept = plain[full.end] - plain[full.begin]
    mixed = (kept > 0) & (kept < full.end - full.begin)
    undone = mixed & np.isin(full.hash, np.concatenate([given, learned]))
    per_full = lambda flags: row_sums(flags.astype(np.float64), full.rows)
    single = length == 1
    spelled = single.copy()
    spelled[1:] &= single[:-1] & (row[1:] == row[:-1])
    stretched = np.zeros(len(data))
    stretched[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (LETTER[data[2:]] == 1)
    counts = {c: spread(data == c) for c in b"!?*"}
    other = spread((LETTER[data] == 0) & (data > 32) & ~((data >= 48) & (data <= 57)))
    per_byte = lambda c: (c[at[1:]] - c[at[:-1]]) / size

    return np.column_stack(
        [
            per_row(in_given) / n, np.log1p(per_row(in_given)), per_row(in_learned) / n, np.log1p(per_row(in_learned)),
            per_row(hit) / n, np.log1p(per_row(hit)), per_row(second) / n,
            by_hit(near_score) / np.maximum(per_row(hit), 1), np.log1p(by_hit(near_count)),
            (upper[at[1:]] - upper[at[:-1]]) / letters, per_row(capitals) / n,
            per_byte(counts[33]), per_byte(counts[63]), per_byte(counts[42]), per_byte(other),
            per_full(mixed) / n, np.log1p(per_full(undone)), per_row(spelled) / n,
            (spread(stretched)[at[1:]] - spread(stretched)[at[:-1]]) / size, np.log1p(np.diff(rows)),
        ]
    ).astype(np.float32)


WIDTH = 20
# nats by which a word must stand out: the logarithm of millions of words that are tried
CLEAR = 14.0


def _distinct_words(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        label, half = batch.column("label").to_numpy(), batch.column("half").to_numpy()
        for first, last in slices(at):
            words = words_of(data[at[first] : at[last]], at[first : last + 1] - at[first])
            row = np.repeat(np.arange(last - first), np.diff(words.rows)).astype(np.uint64)
            pair = np.unique(np.stack([row, words.hash]), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
            of = first + pair[0].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[1].view(np.int64)), pa.array(label[of], pa.int32()), pa.array(half[of], pa.int32())],
                ["word", "toxic", "half"],
            )


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    half = F.when(F.col("part") % 2 == 0, 0).otherwise(1).alias("half")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "code", "label", "part", half)


def learned_lexicons(docs: DataFrame, chosen: DataFrame, most: int = LEXICON_SIZE) -> list[np.ndarray]:
    """Hashes of the ``most`` clearest words of toxic documents, of those clear beyond chance.

    First from one half of the sample, then from the other, then from all of it.
    """
    words = labelled_texts(docs, chosen).select("text", "label", "half").mapInArrow(_distinct_words, "word long, toxic int, half int")
    even, toxic = F.col("half") == 0, F.col("toxic")
    sums = {"k0": F.when(even, toxic), "n0": F.when(even, 1), "k1": F.when(~even, toxic), "n1": F.when(~even, 1), "k2": toxic, "n2": F.lit(1)}
    counts = words.groupBy("word").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))
    base = chosen.agg(*(F.avg(F.when(c, F.col("label"))) for c in (F.col("part") % 2 == 0, F.col("part") % 2 == 1, F.lit(True)))).first()
    lexicons = []
    for i, share in enumerate(base):
        if not share or share >= 1:
            lexicons.append(np.zeros(0, np.uint64))
            continue
        k, n = F.col(f"k{i}"), F.col(f"n{i}")
        term = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)  # noqa: B023, E731
        counts = counts.withColumn(
            f"clear{i}", F.when((n >= 4) & (k >= 0.5 * n) & (k > n * share), term(k, F.lit(share)) + term(n - k, F.lit(1 - share)))
        )
        lexicons.append(None)
    if all(x is not None for x in lexicons):
        return lexicons
    counts = materialize(counts.where(F.greatest(F.lit(0.0), *(F.col(c) for c in counts.columns if c.startswith("clear"))) >= CLEAR))
    for i, known in enumerate(lexicons):
        if known is None:
            top = counts.where(F.col(f"clear{i}") >= CLEAR).orderBy(F.desc(f"clear{i}"), "word").limit(most).select("word").toArrow()
            lexicons[i] = np.sort(top.column("word").to_numpy().astype(np.int64).view(np.uint64))
    return lexicons


def feature_rows(column, given, learned, second) -> np.ndarray:
    data, at = utf8(column)
    found = [np.zeros((0, WIDTH), np.float32)]
    for first, last in slices(at):
        found.append(dense(data[at[first] : at[last]], at[first : last + 1] - at[first], given, learned, second))
    return np.concatenate(found).astype(np.float64)


def _training_features(given, learned, second):
    def run(batches):
        for batch in batches:
            half = batch.column("half").to_numpy()
            x = np.zeros((batch.num_rows, WIDTH))
            for h in (0, 1):
                own = half == h
                x[own] = feature_rows(batch.column("text").filter(pa.array(own)), given, learned[1 - h], second)
            yield with_features(batch, x)

    return run


class Trees:
    """Boosted trees of fixed depth for logistic loss, over features cut at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.bins, self.rate, self.depth = bins, rate, depth
        b = self._binned(x)
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.start = np.log(share / (1 - share))
        f, self.trees = np.full(len(y), self.start), []
        offset = np.arange(x.shape[1]) * bins
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(depth):
                cells = ((node * x.shape[1] * bins)[:, None] + offset + b).ravel()
                shape = (2**level, x.shape[1], bins)
                total = lambda v: np.bincount(cells, np.repeat(v, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(2)
                gl, hl = total(g), total(h)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                best = gain.reshape(2**level, -1).argmax(1)
                feature, cut = best // bins, best % bins
                cut = np.where(gain.reshape(2**level, -1).max(1) > 1e-9, cut, bins)
                tree.append((feature, cut))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
            f = f + rate * leaf[node]
            self.trees.append((tree, leaf))
        self.points = (np.array([0.0]), np.array([0.0]))

    def _binned(self, x):
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = 2 * node + (b[np.arange(len(x)), feature[node]] > cut[node])
            f += self.rate * leaf[node]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.points = isotonic(self.raw(x), y) if len(y) else (np.linspace(-8, 8, 65), 1 / (1 + np.exp(-np.linspace(-8, 8, 65))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.points)


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; gives each pool's mean output and its share of label 1, to interpolate between.

    Every pool counts one half of a label of each kind on top, so no share is quite 0 or 1.
    """
    order = np.argsort(f, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(f[order], y[order]):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a, b, n = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + n]
    t = np.array(pools)
    return t[:, 0] / t[:, 2], np.maximum.accumulate((t[:, 1] + 0.5 * (t[:, 1] > 0)) / (t[:, 2] + 1))


class Constant:
    def __init__(self, score: float):
        self.score = score

    def scores(self, x):
        return np.full(len(x), self.score)


def fit(x: np.ndarray, y: np.ndarray, part: np.ndarray):
    own = part < 8
    if len(np.unique(y[own])) < 2:
        return Constant(float(y.mean()) if len(y) else 0.0)
    model = Trees(x[own], y[own])
    model.calibrate(x[~own], y[~own])
    return model


def _score(model, given, learned, second, name):
    def run(batches):
        for batch in batches:
            yield with_score(batch, model.scores(feature_rows(batch.column("text"), given, learned, second)), name)

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, name: str = "score", insults: tuple[str, ...] = INSULTS
) -> DataFrame:
    """All columns of ``docs`` (``doc_id``, ``text``) with the score as ``name``, which must be a new one.

    ``labels`` (``doc_id``, ``toxic``) of held-out documents are not read.
    """
    chosen = materialize(training_labels(labels, "toxic", sample))
    given, second = np.sort(hash_words(list(insults))), np.sort(hash_words(list(SECOND_PERSON)))
    *halves, learned = learned_lexicons(docs, chosen)
    rows = labelled_texts(docs, chosen).mapInArrow(_training_features(given, halves, second), TRAINING)
    model = fit(*training_rows(rows, sample))
    return docs.mapInArrow(_score(model, given, learned, second, name), scored_schema(docs, name))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    scored = score_toxicity(docs.select("doc_id", "text"), labels, sample)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
