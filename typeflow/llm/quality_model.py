"""Quality classifier: a generalised additive model with pairwise interactions.

Features are numbers that Spark expressions measure on whole texts.  Each feature is cut into
quantile bins; boosting goes round the features, fitting a shallow tree on one feature's bins at
a time and adding its leaves to that feature's lookup table.  Then the pairs whose joint bins
explain most of what is left get tables of their own in the same way.  A document's score is the
sigmoid of the entries its bins pick, added up.

The model is fitted in numpy on the features of about ``sample`` labelled rows.

Defined cases: a null or empty text has no words and gets the features of an empty text; a very long
text is measured whole; a null doc_id counts as held out; null labels and labels of unknown
documents teach nothing; of rows that share a sampled doc_id the one with the least features is
learned from; with nothing to learn from every score is 0.5; repeated rows are scored each; an empty
table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, settle, table
from .labelled import labelled_sample
from .quality_rules import measurements

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 4
RATE = 0.15
DAMPING = 5.0
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "symbol_rate", "duplicate_lines", "repeat_rate", "upper_rate", "line_words", "bang_rate")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features, a row for each row of ``docs``."""
    m = F.col("m")
    words = F.greatest(m["n_words"], F.lit(1))
    lines = F.greatest(m["n_lines"], F.lit(1))
    made: list[Column] = [
        F.log1p(m["n_words"].cast("double")),
        m["word_chars"] / words,
        m["n_symbols"] / words,
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words,
        m["n_upper"] / F.greatest(m["word_chars"], F.lit(1)),
        F.log1p(m["n_words"] / lines),
        F.col("n_bangs") / words,
    ]
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        measurements(F.col("text")).alias("m"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("!")).alias("n_bangs"),
    )
    return measured.select("doc_id", *[c.cast("double").alias(name) for c, name in zip(made, FEATURES)])


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)  # by feature: inner bin edges
    tables: list[np.ndarray] = field(default_factory=list)  # by feature: an entry a bin
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1) if edges else np.zeros(x.shape, int)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best gain and cut of a histogram of gradients and weights; the cut is the first bin on the right."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + DAMPING) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + DAMPING) - g.sum() ** 2 / (h.sum() + DAMPING)
    cut = int(np.argmax(gain))
    return float(gain[cut]), cut + 1


def _line_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over one feature's bins, as the value it gives each bin."""
    gain, cut = _split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + DAMPING))
    return np.concatenate([_line_tree(g[:cut], h[:cut], depth - 1), _line_tree(g[cut:], h[cut:], depth - 1)])


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that cuts one axis, then the other on each side, as the value it gives each cell, and its gain."""
    best, found = -1.0, np.zeros(g.shape)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        _, cut = _split(a.sum(axis=1), b.sum(axis=1))
        value, total = np.zeros(a.shape), 0.0
        for part in (slice(0, cut), slice(cut, None)):
            gs, hs = a[part].sum(axis=0), b[part].sum(axis=0)
            _, second = _split(gs, hs)
            for side in (slice(0, second), slice(second, None)):
                leaf = gs[side].sum() / (hs[side].sum() + DAMPING)
                value[part, side] = leaf
                total += leaf * gs[side].sum()
        if total > best:
            best, found = total, value if axis == 0 else value.T
    return found, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of labels ``y`` (0 or 1) by features ``x``."""
    if not len(y):
        return Model()
    quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) for f in range(x.shape[1])]
    model = Model(quantiles(BINS), [], quantiles(PAIR_BINS), [], float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins, coarse = _bins(x, model.edges), _bins(x, model.pair_edges)
    score = np.full(len(y), model.intercept)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-score))), p * (1 - p))
    for _ in range(ROUNDS):
        for f, tab in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _line_tree(np.bincount(bins[:, f], g, len(tab)), np.bincount(bins[:, f], h, len(tab)))
            tab += step
            score += step[bins[:, f]]

    shape = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int) -> tuple[np.ndarray, float]:
        g, h = slopes()
        cell, n = coarse[:, a] * shape[b] + coarse[:, b], shape[a] * shape[b]
        return _grid_tree(np.bincount(cell, g, n).reshape(shape[a], shape[b]), np.bincount(cell, h, n).reshape(shape[a], shape[b]))

    gains = sorted(((grid(a, b)[1], a, b) for a, b in combinations(range(x.shape[1]), 2) if shape[a] > 1 and shape[b] > 1), reverse=True)
    model.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, tab in model.pairs:
            step = RATE * grid(a, b)[0]
            tab += step
            score += step[coarse[:, a], coarse[:, b]]
    return model


def predict(x: np.ndarray, model: Model) -> np.ndarray:
    """Scores by adding the table entries that the bins pick."""
    total = np.full(len(x), model.intercept)
    bins, coarse = _bins(x, model.edges), _bins(x, model.pair_edges)
    for f, tab in enumerate(model.tables):
        total += tab[bins[:, f]]
    for a, b, tab in model.pairs:
        total += tab[coarse[:, a], coarse[:, b]]
    return 1 / (1 + np.exp(-total))


def learn(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model fitted on the features of about ``sample`` labelled documents that are not held out."""
    chosen = labelled_sample(labels, ["quality"], sample)  # at most about ``sample`` rows
    joined = measured.join(F.broadcast(chosen), "doc_id")
    # one row a sampled doc_id, however often the documents repeat it
    rows = joined.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("m"), F.max("quality").alias("quality")).select("doc_id", "m.*", "quality").toArrow()
    x = np.column_stack([rows[f].to_numpy() for f in FEATURES])
    order = np.lexsort([*x.T, rows["doc_id"].to_numpy()])  # so that fits don't depend on the partitions
    return fit(x[order], rows["quality"].to_numpy()[order].astype(float))


def score(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with its score."""
    shared = measured.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    @F.pandas_udf("double")
    def of(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(predict(rows[list(FEATURES)].to_numpy(dtype=float), shared.value))

    return measured.withColumn("score", of(F.struct(*FEATURES)))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = settle(features(table(spark, sf_dir, "documents")))
    scored = score(measured, learn(measured, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
