"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import slices, written

_WORD = re.compile(r"\w+")
#: Labelled documents that the model is fitted to, at most: those with the smallest hashes of their ids.
SAMPLE = 12_000
#: Features are kept that stand in at least so many of them, and of these the most telling, at most: both bound the model
#: that is fitted to the sample, and are parameters. Words that fewer sampled texts hold have no weight.
LEAST_DOCS, MOST_FEATURES = 8, 6000
#: Grades where labels are 0 and 1 only: 0 for clean texts; toxic ones from 1 by the number of telling words they hold.
CUTS = (3, 6)
#: Steps end at ``ROUNDS``, or where no weight moves by more than ``STILL``.
PENALTY, ROUNDS, STILL = 1e-4, 400, 1e-5
#: Words whose features a task remembers; the only effect is on memory.
REMEMBERED = 500_000


def features(text: str | None) -> Counter:
    """Lower-cased words, and beginnings of longer words, which stand for their inflected forms."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in (4, 5, 6):
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: np.ndarray  # in rising order; one set of weights for all

    def score(self, text: str | None) -> float:
        """Sum of the weights of all features, each times log(1 + count)."""
        return sum(self.weights.get(f, 0.0) * np.log1p(n) for f, n in features(text).items())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


class _Weighted(dict):
    """The weighted features of a word, by their numbers; most words have none."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = [self.numbers.get(f) for f in (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k))]
        self[word] = out = tuple(x for x in found if x is not None)
        return out


class Scorer:
    """``Model.score`` of many texts: a sparse matrix of counts of weighted features by text, times the weights."""

    def __init__(self, model: Model):
        self.numbers = {f: i for i, f in enumerate(model.weights)}
        self.weights = np.array(list(model.weights.values()))
        self.features = _Weighted(self.numbers)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.numbers:
            return np.zeros(len(texts))
        rows, cols = [], []
        for i, text in enumerate(texts):
            found = [f for hit in map(self.features.__getitem__, _WORD.findall((text or "").lower())) if hit for f in hit]
            cols += found
            rows += [i] * len(found)
            if len(self.features) > REMEMBERED:
                self.features.clear()
        cells, n = np.unique(np.array(rows, dtype=np.int64) * len(self.numbers) + np.array(cols, dtype=np.int64), return_counts=True)
        return np.bincount(cells // len(self.numbers), weights=self.weights[cells % len(self.numbers)] * np.log1p(n), minlength=len(texts))


def fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n_cols: int, y: np.ndarray, grades: int, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood less an L1 penalty, by accelerated proximal steps.

    P(grade <= k) = sigmoid(threshold[k] - weights . x). Rows are a sparse matrix by coordinates.
    """
    n = len(y)
    share = np.clip(np.array([(y < k).mean() for k in range(1, grades)]), 1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades - 1))
    w, look, speed = np.zeros(n_cols), np.zeros(n_cols), 1.0
    v = np.random.default_rng(0).standard_normal(n_cols)
    for _ in range(15):  # the largest eigenvalue bounds the curvature
        v = np.bincount(cols, vals * np.bincount(rows, vals * v[cols], n)[rows], n_cols)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / max(1e-9, 0.3 * top / n)
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for i in range(rounds):
        s = np.bincount(rows, vals * look[cols], n)
        low, high = sigmoid(edges[y] - s), sigmoid(edges[y + 1] - s)
        low[y == 0], high[y == grades - 1] = 0.0, 1.0
        grad = np.bincount(cols, vals * (1 - low - high)[rows], n_cols) / n
        after = look - step * grad
        after = np.sign(after) * np.maximum(0, np.abs(after) - step * penalty)
        quick = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        look = after + (speed - 1) / quick * (after - w)
        moved, w, speed = np.abs(after - w).max(initial=0.0), after, quick
        if i % 2 == 0:
            gap = np.maximum(high - low, 1e-9)
            slope = np.array([(np.where(y == k, high * (1 - high) / gap, 0) - np.where(y == k + 1, low * (1 - low) / gap, 0)).sum() for k in range(grades - 1)]) / n
            curve = np.array([(np.where((y == k), high * (1 - high), 0) + np.where(y == k + 1, low * (1 - low), 0)).sum() for k in range(grades - 1)]) / n + 1e-3
            theta = np.maximum.accumulate(theta + np.clip(0.5 * slope / curve, -0.5, 0.5))
            theta = theta + 1e-6 * np.arange(grades - 1)
            moved = max(moved, np.abs(theta - edges[1:-1]).max())
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            if moved < STILL:
                break
    return w, theta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, cuts: tuple[int, ...] = CUTS, least_docs: int = LEAST_DOCS, most_features: int = MOST_FEATURES) -> Model:
    """Fit a bounded sample of labelled documents.

    A label above 1 is a grade as it is. Where labels say no more than whether a text is toxic, a toxic text's grade
    follows from how many telling words it holds: words in toxic texts alone, or nearly so, at ``cuts``. Grades above 1
    are then a measure of how thick the toxic words stand, made of the same words that predict it, not a judgement of
    anybody. Repeated labels of a document: the highest counts. A labelled text without any of the features is a row of
    zeros: it counts for the thresholds.
    """
    grades = len(cuts) + 2
    none = Model({}, np.full(grades - 1, 10.0))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known.withColumnRenamed(id_col, "id")), "id")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 500_000):
                found = [features(t) for t in part.column(1).to_pylist()]
                n = [len(x) for x in found]
                ids, y = (np.repeat(part.column(k).to_numpy(zero_copy_only=False), n) for k in (0, 2))
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "feature": pa.array([f for x in found for f in x], pa.string()), "n": pa.array([c for x in found for c in x.values()], pa.int32()), "y": pa.array(y, pa.int32())})

    rows = rows.select(F.xxhash64("id", "text").alias("id"), "text", "y")
    sampled = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy("id").toPandas()  # with those that have no feature
    sparse = written(rows.mapInArrow(exploded, "id bigint, feature string, n int, y int"), "features")
    bad, good = int((sampled["y"] > 0).sum()), int((sampled["y"] <= 0).sum())
    if not bad or not good:
        return none
    df = sparse.groupBy("feature").agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") == 0).alias("q")).where(F.col("p") + F.col("q") >= least_docs)
    odds = F.ln((F.col("p") + 0.5) / (bad + 1)) - F.ln((F.col("q") + 0.5) / (good + 1))
    z = F.abs(odds) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    telling = (odds > 3) & (F.col("p") >= 9 * F.col("q")) & ~F.col("feature").endswith("*")
    best = df.select("feature", z.alias("z"), telling.alias("telling")).orderBy(F.desc("z"), "feature").limit(most_features).toPandas()
    place = {f: i for i, f in enumerate(best["feature"])}
    chosen = docs.sparkSession.createDataFrame([(f, i) for f, i in place.items()], "feature string, col int")
    kept = sparse.join(F.broadcast(chosen), "feature").select("id", "y", "col", "n")
    by_doc = kept.groupBy("id").agg(F.collect_list("col").alias("cols"), F.collect_list("n").alias("ns")).orderBy("id").toPandas()
    y = sampled["y"].to_numpy(dtype=int)
    lengths = np.array([len(x) for x in by_doc["cols"]], dtype=int)
    r = np.repeat(np.searchsorted(sampled["id"].to_numpy(), by_doc["id"].to_numpy()), lengths)
    c = np.concatenate([np.zeros(0), *by_doc["cols"]]).astype(int)
    counts = np.concatenate([np.zeros(0), *by_doc["ns"]]).astype(float)
    order = np.lexsort((c, r))
    r, c, counts = r[order], c[order], counts[order]
    if y.max() <= 1:
        held = np.bincount(r, counts * best["telling"].to_numpy()[c], len(y))
        y = np.where(y > 0, 1 + sum((held >= cut).astype(int) for cut in cuts), 0)
    y = np.minimum(y, grades - 1)
    w, theta = fit(r, c, np.log1p(counts), len(place), y, grades) if place else fit(np.zeros(1, int), np.zeros(1, int), np.zeros(1), 1, y, grades)
    return Model({f: float(w[i]) for f, i in place.items() if w[i]}, theta)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.4, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``expected_severity`` (sum of P(grade >= k)), ``p_toxic`` (P(grade >= 1)), ``grade``
    (the median grade), ``toxic`` (p_toxic >= threshold).

    Whole texts are scored. A null or empty text has no features and gets the prior. Without toxic and clean labels
    nothing is toxic. Ids may repeat or be null. See ``train`` for what grades mean where labels are 0 and 1.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for part in slices(batch, 1):
                tails = model.value.tails(scorer.scores(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "expected_severity": pa.array(tails.sum(axis=1)), "p_toxic": pa.array(tails[:, 0].copy()), "grade": pa.array((tails > 0.5).sum(axis=1).astype(np.int32)), "toxic": pa.array(tails[:, 0] >= threshold)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_severity double, p_toxic double, grade int, toxic boolean")
