"""Toxicity by a classifier chain.

The labelled categories are predicted in a fixed order.  Each link is a linear (logistic) model
over hashed words and the log-odds of the earlier links; in training those come from out-of-fold
predictions, so a later link learns from errors as large as it will meet.  Models are fitted in
numpy on a bounded sample of labelled rows (``sample``, whole texts each, as sparse word buckets);
all documents are scored on the executors with the broadcast weights.

A text's features are the distinct buckets of its words.  Texts are split many at a time; scoring
looks up the distinct words of all of them once, drops those whose buckets weigh nothing in any
link, and adds up what is left by text.

The tables label two categories, so the chain is low quality, then toxic.

Defined cases: a null or empty text has no words and is scored by the intercepts; a very long text
is read whole; a null doc_id counts as held out; a category's null label, or labels of unknown
documents, teach nothing; of rows that share a sampled doc_id the one whose text has the least hash
is learned from; with nothing to learn from every score is 0; repeated rows are scored each; an
empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, portions, table, trimmed
from .labelled import labelled_sample

BUCKETS = 1 << 18
SAMPLE = 6_000
FOLDS = 3
STEPS = 150
#: Features that a link may use: those whose labels differ most from the rest's.
KEPT = 2_000
L1 = 3e-4
THRESHOLD = 0.5
#: The categories in chain order, as conditions on the label columns quality and toxic.
CHAIN: tuple[tuple[str, str], ...] = (("low_quality", "1 - quality"), ("toxic", "toxic"))
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\\n"


#: Lengths of word beginnings that are features too, since insults are inflected and compounded.
STEMS = (4, 5, 6)


class _Buckets(dict):
    """The buckets of each word as it is written; starts afresh beyond a bounded number of words.

    With ``weighing`` (a flag by bucket) only buckets that weigh something are listed.
    """

    def __init__(self, weighing: np.ndarray | None = None):
        self.weighing = weighing

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        bare = word.strip(_EDGES) or word[:1]
        parts = [bare, *(f"{n} {bare[:n]}" for n in STEMS if len(bare) > n)]
        found = (zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)
        value = self[word] = tuple(b for b in found if self.weighing is None or self.weighing[b])
        return value


def word_buckets(texts: list[str], known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct buckets of each text's words and of their beginnings, in ascending order."""
    cut = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.fill_null(pc.list_value_length(cut), 0)))
    coded = cut.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    found = [known[w] if w else () for w in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int64)
    some = sizes[codes] > 0 if len(codes) else np.zeros(0, dtype=bool)
    row, codes = row[some], codes[some]
    n = sizes[codes]
    place = np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    both = np.unique(np.repeat(row, n) * BUCKETS + flat[place])
    return both // BUCKETS, both % BUCKETS


@dataclass(frozen=True)
class Link:
    weights: np.ndarray  # by bucket
    earlier: np.ndarray  # by earlier link
    intercept: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _screened(rows: np.ndarray, cols: np.ndarray, width: int, y: np.ndarray) -> np.ndarray:
    """True for the (at most KEPT) features whose share of positive rows is farthest from the rest's, in deviations."""
    p = y.mean()
    seen, hits = np.bincount(cols, minlength=width), np.bincount(cols, weights=y[rows], minlength=width)
    z = np.abs(hits - seen * p) / np.sqrt(seen * p * (1 - p) + 1)
    kept = np.zeros(width, dtype=bool)
    kept[np.argsort(-z, kind="stable")[:KEPT]] = True
    return kept


def _fit(rows: np.ndarray, cols: np.ndarray, width: int, extra: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """L1-regularised logistic regression by accelerated proximal gradient; features are 0 or 1 at (rows, cols), rows ascending.

    Each weight has a step of its own: a quarter of the feature's mean row sum bounds the curvature.
    """
    n, k = len(y), extra.shape[1]
    if not n:
        return np.zeros(width), np.zeros(k), 0.0
    kept = _screened(rows, cols, width, y)
    names, number, inside = np.flatnonzero(kept), np.cumsum(kept) - 1, kept[cols]
    rows, cols = rows[inside], number[cols[inside]]
    m = len(names)
    by_row, by_col = _summing(rows, n), _summing(cols, m)
    rows_by_col = rows[np.argsort(cols, kind="stable")]
    sums = by_row(np.ones(len(rows))) + np.abs(extra).sum(axis=1) + 1.0
    curve = np.concatenate([by_col(sums[rows_by_col]), np.abs(extra).T @ sums, [sums.sum()]]) / (4 * n)
    step = 1 / np.maximum(curve, 1e-3)
    w = np.zeros(m + k + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    z, t = w.copy(), 1.0
    for _ in range(STEPS):
        margin = by_row(z[cols]) + extra @ z[m:-1] + z[-1]
        error = (_sigmoid(margin) - y) / n
        grad = np.concatenate([by_col(error[rows_by_col]), extra.T @ error, [error.sum()]])
        new = z - step * grad
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step[:m] * L1, 0)
        if ((z - new) / step) @ (new - w) > 0:  # momentum points uphill: start it afresh
            t, z = 1.0, new.copy()
        else:
            following = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z = new + (t - 1) / following * (new - w)
            t = following
        w = new
    weights = np.zeros(width)
    weights[names] = w[:m]
    return weights, w[m:-1], float(w[-1])


def _summing(keys: np.ndarray, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that sums values given in ascending order of their keys, by key."""
    counts = np.bincount(keys, minlength=width)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]

    def total(values: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        if len(values):
            out[some] = np.add.reduceat(values, starts)
        return out

    return total


def fit_chain(buckets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Link]:
    """The links of the chain; ``labels`` is documents x categories, ``folds`` each document's fold."""
    used, inverse = np.unique(np.concatenate(buckets) if buckets else np.zeros(0, np.int32), return_inverse=True)
    rows = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    links: list[Link] = []
    earlier = np.zeros((len(buckets), 0))
    for k in range(labels.shape[1]):
        labelled, y = ~np.isnan(labels[:, k]), np.nan_to_num(labels[:, k])

        def fitted(train: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            number, inside = np.cumsum(train) - 1, train[rows]
            return _fit(number[rows[inside]], inverse[inside], len(used), earlier[train], y[train])

        out_of_fold = np.zeros(len(y))
        for fold in range(FOLDS):
            w, e, b = fitted(labelled & (folds != fold))
            margin = np.bincount(rows, weights=w[inverse], minlength=len(y)) + earlier @ e + b
            out_of_fold[folds == fold] = margin[folds == fold]
        w, e, b = fitted(labelled)
        weights = np.zeros(BUCKETS)
        weights[used] = w
        links.append(Link(weights, e, b))
        earlier = np.column_stack([earlier, np.clip(out_of_fold, -6, 6)])
    return links


def score_texts(texts: list[str], links: list[Link], known: _Buckets) -> np.ndarray:
    """The probability of each category, texts x categories in chain order; ``known`` lists what weighs in the links."""
    row, bucket = word_buckets(texts, known)
    logits = np.zeros((len(texts), 0))
    for link in links:
        own = np.bincount(row, weights=link.weights[bucket], minlength=len(texts)) + np.clip(logits, -6, 6) @ link.earlier + link.intercept
        logits = np.column_stack([logits, own])
    return _sigmoid(logits)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Link]:
    """The chain fitted on about ``sample`` labelled documents that are not held out, one row each."""
    targets: list[Column] = [F.expr(rule).cast("double").alias(name) for name, rule in CHAIN]
    chosen = labelled_sample(labels, ["quality", "toxic"], sample).select("doc_id", F.array(*targets).alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for batch in batches:
            for i in range(batch.num_rows):
                found = word_buckets([batch.column(1)[i].as_py() or ""], known)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found], pa.list_(pa.int64())), batch.column(2).slice(i, 1)], names=["doc_id", "buckets", "y"])

    # the labels of the sample are bounded by it, and so are the rows once each doc_id has one
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    rows = found.mapInArrow(of, "doc_id long, buckets array<long>, y array<double>").toArrow()
    if not rows.num_rows:
        return []
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")  # so that fits don't depend on the partitions
    doc_ids = rows["doc_id"].to_numpy()[order]
    buckets = [np.array(rows["buckets"][int(i)].as_py(), dtype=np.int64) for i in order]
    y = np.array([rows["y"][int(i)].as_py() for i in order], dtype=float)
    folds = np.array([zlib.crc32(str(d).encode()) // 5 % FOLDS for d in doc_ids])
    return fit_chain(buckets, y, folds)


def score(docs: DataFrame, links: list[Link]) -> DataFrame:
    """doc_id and the probability of each category for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(links)  # BUCKETS numbers a link, whatever the corpus's size
    names = [name for name, _ in CHAIN]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = shared.value
        known = _Buckets(reduce(np.logical_or, [link.weights != 0 for link in links], np.zeros(BUCKETS, dtype=bool)))
        for batch in batches:
            at = 0
            for run in portions(t.as_py() or "" for t in batch.column(1)):
                got = score_texts(run, links, known) if links else np.zeros((len(run), len(names)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), *map(pa.array, got.T)], names=["doc_id", *names])
                at += len(run)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(trimmed(of), "doc_id long, " + ", ".join(f"{n} double" for n in names))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic").alias("score"),
        (F.col("toxic") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("low_quality").alias("low_quality_score"),
    )
