"""Quality classifier with hierarchical empirical Bayes: text evidence, then host and path posteriors."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm._shared import discard, fresh, own_columns, sized_join, slices, written

#: Labelled documents that the text model is fitted to, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
RIDGE, ROUNDS = 1.0, 30
#: Bounds of the number of documents that a prior counts for, and distance of rates from 0 and 1: for the arithmetic only.
LEAST_PRIOR, MOST_PRIOR, EDGE = 1e-3, 1e12, 1e-9

FEATURES = ("length", "upper", "symbols", "exclaim", "bars", "digits", "word_length", "distinct", "repeats", "marks", "double_lines", "spaces")


def features(text: str | None) -> list[float]:
    """Shares that don't depend on the language, each between 0 and about 1. An empty text has zeros."""
    text = text or ""
    if not text.strip():
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    upper, lower, wide = int(count[65:91].sum()), int(count[97:123].sum()), int(count[192:].sum())
    digits, spaces = int(count[48:58].sum()), int(count[32] + count[9:14].sum())
    marks = int(count[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    n = max(1, len(text))
    symbols = max(0, int(count[33:127].sum()) - upper - lower - digits - marks - int(count[124]))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words)) / m
    return [
        math.log1p(m) / 10, upper / max(1, upper + lower + wide), math.sqrt(symbols / n), math.sqrt(int(count[33]) / n), math.sqrt(int(count[124]) / n), math.sqrt(digits / n),
        min(1.0, len(text) / m / 20), distinct, math.sqrt(sum(map(operator.eq, words, words[1:])) / m), min(1.0, marks / m), 1 - len(set(lines)) / max(1, len(lines)), spaces / n,
    ]


class TextModel(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    base: float  # log odds of the sample's share of good documents

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return z @ self.weights[:-1] + self.weights[-1]


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray) -> TextModel:
    """Logistic regression with a ridge, by Newton's method. Without rows it says nothing of a text, and all is good."""
    if not len(y):
        return TextModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.concatenate([np.zeros(len(FEATURES)), [_logit(0.99)]]), _logit(0.99))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    base = _logit((y.sum() + 1) / (len(y) + 2))
    w = np.zeros(z.shape[1])
    w[-1] = base
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-3
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * (w - np.eye(len(w))[-1] * base))
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return TextModel(mean, scale, w, base)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> TextModel:
    """Fit the text model to ``sample`` labelled documents at most, of repeated labels to the highest. Features are taken
    on the executors."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(known), id_col).select(text_col, "y", F.xxhash64(id_col, text_col).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.RecordBatch.from_pydict({"x": pa.array([features(t) for t in part.column(0).to_pylist()], pa.list_(pa.float64())), "y": part.column(1), "h": part.column(2)})

    # ids that repeat in docs: of their rows, those with the smallest hashes
    got = rows.mapInArrow(run, "x array<double>, y double, h bigint").orderBy("h", "x").limit(2 * sample).toPandas()
    return fit(np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES)), got["y"].to_numpy(dtype=float))


def evidence(docs: DataFrame, model: TextModel, text_col: str, name: str, store: bool = False) -> DataFrame:
    """``docs`` and ``name``: log odds of each whole text; stored, to be read more than once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any sign may be in the names
    schema = StructType([*plain.schema.fields, StructField("log_odds", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                x = np.array([features(t) for t in part.column(at).to_pylist()]).reshape(part.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.log_odds(x))], names=[*part.schema.names, "log_odds"])

    found = plain.mapInArrow(run, schema)
    return (written(found, "scored") if store else found).toDF(*docs.columns, name)


def _strength(groups: DataFrame, parent: Column) -> float:
    """How many documents a group's prior counts for, by the method of moments.

    Of groups (``n``, ``k``) with the prior means ``parent``: the spread of their rates beyond what chance gives.
    """
    gap = F.col("k") / F.col("n") - parent
    sums = groups.where("n > 1").agg(
        F.sum("n"), F.sum(F.col("n") * gap * gap), F.count("*"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * parent * (1 - parent))
    ).first()
    n, spread, count, squares, chance = (float(x or 0) for x in sums)
    if count < 2 or n <= 0:
        return MOST_PRIOR
    within = chance / n
    between = (spread - count * within) / max(1e-9, n - squares / n)
    return MOST_PRIOR if between <= 0 else min(MOST_PRIOR, max(LEAST_PRIOR, within / between - 1))


def sites(scored: DataFrame, host: str, path: str, log_odds: str) -> tuple[DataFrame, float, float, float]:
    """Sums of each path (``host_``, ``path_``, ``n``, ``k``, ``host_n``, ``host_k``), global mean, both prior strengths.

    Counts are grouped sums of probabilities over all documents; partial sums go first, so a host with a third of
    all rows costs its share only.
    """
    p = 1 / (1 + F.exp(-F.col(log_odds)))
    paths = scored.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path_")).agg(F.count("*").alias("n"), F.sum(p).alias("k"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host_").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_k")).first()
    mean = (total[1] or 0.0) / total[0] if total[0] else 0.5
    mean = min(1 - EDGE, max(EDGE, mean))
    m_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_k").alias("k")), F.lit(mean))
    both = written(sized_join(paths, hosts, ["host_"], "inner"), "sites")
    m_path = _strength(both, (F.col("host_k") + m_host * mean) / (F.col("host_n") + m_host))
    discard(paths)
    return both, mean, m_host, m_path


def combined(scored: DataFrame, both: DataFrame, mean: float, m_host: float, m_path: float, host: str, path: str, log_odds: str, names: tuple[str, str, str]) -> DataFrame:
    """Add the posteriors of host, path and document, each site without the document itself, as ``names``."""
    h, q, n, k, hn, hk = fresh(scored, "host", "path", "n", "k", "host_n", "host_k")
    both = both.select(F.col("host_").alias(h), F.col("path_").alias(q), F.col("n").alias(n), F.col("k").alias(k), F.col("host_n").alias(hn), F.col("host_k").alias(hk))
    rows = scored.withColumns({h: F.coalesce(F.col(host).cast("string"), F.lit("")), q: F.coalesce(F.col(path).cast("string"), F.lit(""))})
    rows = sized_join(rows, both, [h, q])
    own = 1 / (1 + F.exp(-F.col(log_odds)))
    within = lambda x: F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), x))
    host_mean = within((F.col(hk) - own + m_host * mean) / (F.col(hn) - 1 + m_host))
    path_mean = within((F.col(k) - own + m_path * host_mean) / (F.col(n) - 1 + m_path))
    shift = F.ln(path_mean / (1 - path_mean)) - math.log(mean / (1 - mean))
    return rows.withColumns({names[0]: host_mean, names[1]: path_mean, names[2]: 1 / (1 + F.exp(-(F.col(log_odds) + shift)))}).drop(h, q, n, k, hn, hk)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``text_quality`` (of the text alone), ``host_quality``, ``path_quality`` (posterior
    means of its site, the document left out), ``quality`` (all combined), ``keep`` (quality >= threshold).

    A path is a part of a host, named by ``path_col`` (of documents: their language). A sparse path shrinks to its
    host, a sparse host to the global mean. Null hosts and paths are one of their own. An empty or null text has
    the features of nothing and is scored like any other. Without labels every text is taken for good. Only labelled
    documents up to ``sample`` are fitted; all documents are scored and counted.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    scored = written(evidence(base, model, "text", "log_odds").drop("text"), "evidence")
    found = combined(scored, *sites(scored, "host", "path", "log_odds"), "host", "path", "log_odds", ("host_quality", "path_quality", "quality"))
    return found.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-F.col("log_odds")))).alias("text_quality"), "host_quality", "path_quality", "quality", (F.col("quality") >= threshold).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with ``scores``' ``keep``, with their columns. Texts are stored with their evidence rather than
    scored twice or shuffled."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    odds, host_name, path_name, quality = fresh(docs, "odds", "host_quality", "path_quality", "quality")
    scored = evidence(docs, model, text_col, odds, store=True)
    found = sites(scored, host_col, path_col, odds)
    rows = combined(scored, *found, host_col, path_col, odds, (host_name, path_name, quality))
    return rows.where(F.col(quality) >= threshold).select(*own_columns(docs))
