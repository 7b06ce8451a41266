"""Hard negatives by bounds along spanning trees of anchors.

Anchors of one label are cut into runs of at most ``RUN``, and each run is joined to a minimum spanning tree.  A
task walks the trees with blocks of candidates: from a score at a parent anchor, a child's score is known
within the edge's length times the candidate's norm, and only pairs whose bounds overlap the window that is
searched are scored anew.  The first pass finds each anchor's positives, with the window above its
k-th best score so far (to begin with, among the run's own anchors); their scores give the windows of the second pass.  Bounds
only rule pairs out: every score that counts is an exact integer.

All candidates meet all anchors, in blocks; nothing is sampled or capped.  Trees reach the tasks as
broadcasts of at most ``BATCH_BYTES`` each, checked, in as many rounds over the candidates as the anchors
need.  A task keeps the first few candidates of each anchor of a round, and Spark ranks what the tasks found.

Scores are exact: the products are formed in 32- or 64-bit floats where all sums fit their integers, else in 64-bit integers.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
shorter vectors count as padded with zeros, so an empty one scores 0; repeated rows count once, and so do candidates of one anchor with
the same id and score; rows with the anchor's own id are never its positives; ties go to the smaller id; an
empty table gives no rows; other columns are ignored.  Scores that do not fit 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, trim

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least and at most so many hundredths of the positive's.
LEAST, MOST = 50, 95
#: Anchors of a tree at most.
RUN = 1024
#: Candidates that a task holds against a tree at a time.
BLOCK = 2048
#: Bytes of trees that are broadcast at a time.
BATCH_BYTES = 64 << 20
#: Where more of a level's pairs than this share need a score, all get one by a matrix product.
DENSE = 0.25

#: Below and above all scores.
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

TREES = "tree long, label long, size int, width int, ids binary, vectors binary, parents binary, edges binary, floor binary"
FOUND = "anchor long, anchor_id long, id long, score long"


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each component as floor(scale * x)."""
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    quantised = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised.alias("v"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of integers as rows, padded with zeros to the longest."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which products of rows of ``a`` and ``b`` are exact."""
    most = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    bound = most(a) * most(b) * max(a.shape[1], 1)
    if bound >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


# trees


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parents, edges) of a minimum spanning tree, shallow nodes first: the row of each node, its parent node (the root: -1), the edge's length."""
    points = vectors.astype(np.float64)
    n = len(points)
    near, from_, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    depth, edge = np.zeros(n, np.int64), np.zeros(n)
    at = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    near[at] = 0
    for _ in range(n):
        at = int(np.argmin(np.where(left, near, np.inf)))
        left[at] = False
        if from_[at] >= 0:
            depth[at], edge[at] = depth[from_[at]] + 1, np.sqrt(near[at])
        away = ((points - points[at]) ** 2).sum(1)
        closer = left & (away < near)
        near[closer], from_[closer] = away[closer], at
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    parents = np.where(from_[order] >= 0, place[from_[order]], -1)
    return order, parents, edge[order]


def own_floor(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each anchor's k-th best score: that among the run's anchors of other ids."""
    _, once = np.unique(ids, return_index=True)
    scores = vectors.astype(kind := exact_kind(vectors, vectors)) @ vectors[once].astype(kind).T
    scores = np.where(ids[:, None] == ids[once], LOWEST, np.rint(scores).astype(np.int64) if kind is not np.int64 else scores)
    return np.full(len(ids), LOWEST) if len(once) <= k else np.ascontiguousarray(np.partition(scores, -k, axis=1)[:, -k])


def build_trees(anchors: DataFrame, k: int) -> DataFrame:
    """TREES over (vec_id, label, v): runs of one label, each at most RUN anchors."""
    parts = max(1, -(-anchors.count() // RUN))
    dealt = anchors.repartitionByRange(parts, "label", "vec_id").sortWithinPartitions("label", "vec_id", "v")

    def tree(number: int, label: int, rows: list[tuple]) -> tuple:
        ids = np.array([r[0] for r in rows])
        vectors = matrix(pa.array([r[2] for r in rows], pa.list_(pa.int64())))
        order, parents, edges = spanning_tree(vectors)
        ids, vectors = ids[order], vectors[order]
        arrays = (ids, vectors, parents, edges, own_floor(ids, vectors, k))
        return (number, label, len(ids), vectors.shape[1], *(a.tobytes() for a in arrays))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        number = TaskContext.get().partitionId() << 32
        for label, run in groupby(rows, lambda r: r[1]):
            held = []
            for r in run:
                held.append(r)
                if len(held) == RUN:
                    yield _batch([tree(number, label, held)], TREES)
                    number, held = number + 1, []
            if held:
                yield _batch([tree(number, label, held)], TREES)
                number += 1

    return settle(dealt.mapInArrow(of, TREES))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple] | list[np.ndarray], fields: str, columns: bool = False) -> pa.RecordBatch:
    named = [f.split() for f in fields.split(", ")]
    arrays = [pa.array(c, _KINDS[k]) for c, (_, k) in zip(rows if columns else zip(*rows), named)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in named])


class Tree:
    """A run's anchors, parents before children, level by level."""

    def __init__(self, row):
        read = lambda b, kind=np.int64: np.frombuffer(bytes(b), kind)
        self.number, self.label = row.tree, row.label
        self.ids, self.vectors = read(row.ids), read(row.vectors).reshape(row.size, row.width)
        self.parents, self.edges, self.floor = read(row.parents), read(row.edges, np.float64), read(row.floor)
        depth = np.zeros(row.size, np.int64)
        for i, p in enumerate(self.parents):
            depth[i] = 0 if p < 0 else depth[p] + 1
        self.levels = np.flatnonzero(np.diff(depth, prepend=-1, append=depth[-1] + 1))
        self.windows = None  # of the second pass: least, most, positive scores for each anchor and window
        self.anchors = np.arange(row.size) + row.tree * RUN

    def scan(self, block: Block, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(anchor, candidate, score) of the pairs whose score is in the anchor's window, and how many pairs were scored."""
        width = max(self.vectors.shape[1], block.vectors.shape[1])
        own, other = widened(self.vectors, width), widened(block.vectors, width)
        kind = exact_kind(own, other)
        own, other = own.astype(kind), other.astype(kind)
        norms = block.norms
        # rounding of the bounds, far above what sums of 64-bit floats of this size can lose
        slack = 1 + 1e-9 * float(norms.max(initial=0)) * float(np.sqrt((own.astype(np.float64) ** 2).sum(1)).max())
        low, high = np.empty((2, len(own), len(norms)))
        found, scored = [], 0
        for start, end in zip(self.levels[:-1], self.levels[1:]):
            at = slice(start, end)
            below, above = least[at, None], most[at, None]
            if start == 0:
                n = need = None
            else:
                reach = self.edges[at, None] * norms
                np.subtract(low[self.parents[at]], reach, out=low[at])
                np.add(high[self.parents[at]], reach, out=high[at])
                need = (high[at] >= below - slack) & (low[at] <= above + slack)
                n = np.count_nonzero(need)
            if n is None or n > DENSE * need.size:
                low[at] = high[at] = scores = own[at] @ other.T
                scored += scores.size
                i, j = np.nonzero((scores >= below) & (scores <= above))
                found.append((i + start, j, scores[i, j]))
            elif n:
                i, j = np.nonzero(need)
                scores = np.concatenate([np.einsum("ij,ij->i", own[i[k : k + BLOCK * 8] + start], other[j[k : k + BLOCK * 8]]) for k in range(0, n, BLOCK * 8)])
                scored += n
                low[i + start, j] = high[i + start, j] = scores
                inside = (scores >= least[i + start]) & (scores <= most[i + start])
                found.append((i[inside] + start, j[inside], scores[inside]))
        i, j, s = (np.concatenate(x) for x in zip(*found))
        return i, j, np.rint(s).astype(np.int64) if kind is not np.int64 else s, scored


class Block:
    """Candidates in order of labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))

    def part(self, at) -> Block:
        out = object.__new__(Block)
        out.ids, out.labels, out.vectors, out.norms = self.ids[at], self.labels[at], self.vectors[at], self.norms[at]
        return out

    def of_label(self, label: int, same: bool) -> Block:
        start, end = np.searchsorted(self.labels, [label, label + 1])
        return self.part(slice(start, end) if same else np.r_[0:start, end : len(self.labels)])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            ids, labels, lists = (batch.column(n).slice(start, BLOCK) for n in ("vec_id", "label", "v"))
            yield Block(ids.to_numpy(), labels.to_numpy(), matrix(lists))


class Best:
    """The first ``k`` distinct (score, id) of each key: higher scores first, then smaller ids.  ``floor``: no lower score can be among them."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        kept = score >= self.floor[key]
        if not kept.any():
            return
        key, score, id = (np.concatenate(x) for x in ((self.key, key[kept]), (self.score, score[kept]), (self.id, id[kept])))
        order = np.lexsort((id, -score, key))
        key, score, id = key[order], score[order], id[order]
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(score) != 0) | (np.diff(id) != 0)
        key, score, id = key[new], score[new], id[new]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(starts, append=len(key)))
        last = rank == self.k - 1
        self.floor[key[last]] = np.maximum(self.floor[key[last]], score[last])
        kept = rank < self.k
        self.key, self.score, self.id = key[kept], score[kept], id[kept]


# the two passes


def _positives(trees: Callable[[], list[Tree]], k: int) -> Callable[[Iterator], Iterator]:
    """``mapInArrow`` function: each anchor's first k of its label among the task's candidates, FOUND."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(t, Best(t.floor, k), np.full(len(t.ids), HIGHEST)) for t in trees()]
        for block in blocks(batches):
            for tree, best, top in held:
                part = block.of_label(tree.label, same=True)
                if len(part.ids):
                    i, j, scores, _ = tree.scan(part, best.floor, top)
                    others = tree.ids[i] != part.ids[j]
                    best.add(i[others], scores[others], part.ids[j][others])
        for tree, best, _ in held:
            yield _batch([tree.anchors[best.key], tree.ids[best.key], best.id, best.score], FOUND, columns=True)
        trim()

    return of


def _negatives(trees: Callable[[], list[Tree]], k: int) -> Callable[[Iterator], Iterator]:
    """``mapInArrow`` function: for each anchor and positive score the first k of other labels in its window, (anchor, positive_score, id, score)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(t, *t.windows, Best(t.windows[0].ravel(), k)) for t in trees()]
        for block in blocks(batches):
            for tree, least, most, _, best in held:
                part = block.of_label(tree.label, same=False)
                if not len(part.ids):
                    continue
                floor = best.floor.reshape(least.shape)
                i, j, scores, _ = tree.scan(part, floor.min(1), most.max(1))
                for w in range(least.shape[1]):
                    inside = (scores >= floor[i, w]) & (scores <= most[i, w])
                    best.add(i[inside] * least.shape[1] + w, scores[inside], part.ids[j[inside]])
        for tree, least, _, positive, best in held:
            anchor = tree.anchors[best.key // least.shape[1]]
            yield _batch([anchor, positive.ravel()[best.key], best.id, best.score], NEGATIVE, columns=True)
        trim()

    return of


NEGATIVE = "anchor long, positive_score long, id long, score long"


def with_windows(tree: Tree, scores: list[tuple[int, int]] | None) -> Tree:
    """The tree with the windows of its anchors' positive scores (anchor, score); unused ones hold no score."""
    least, most = np.full((len(tree.ids), POSITIVES), HIGHEST), np.full((len(tree.ids), POSITIVES), LOWEST)
    positive, used = np.zeros(least.shape, np.int64), np.zeros(len(tree.ids), np.int64)
    for anchor, score in scores or ():
        i = anchor - tree.number * RUN
        low, high = -(-LEAST * score // 100), MOST * score // 100
        if low <= high:
            w = used[i]
            least[i, w], most[i, w], positive[i, w] = low, high, score
            used[i] += 1
    tree.windows = least, most, positive
    return tree


def in_rounds(rows: DataFrame, trees: DataFrame, make: Callable, k: int, fields: str) -> DataFrame:
    """``make``'s function over all ``rows`` with all ``trees`` (settled), of which at most BATCH_BYTES are broadcast at a time."""
    spark = rows.sparkSession
    size = F.octet_length("vectors") + 40 * F.col("size")
    total = trees.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    rounds = max(1, -(-total // BATCH_BYTES))
    while True:
        number = F.pmod(F.xxhash64("tree"), F.lit(rounds))
        if (trees.groupBy(number).agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] or 0) <= max(BATCH_BYTES, RUN * 4096):
            break
        rounds *= 2
    out = None
    for n in range(rounds):
        some = [with_windows(Tree(r), getattr(r, "scores", None)) for r in trees.where(number == n).collect()]
        shared = spark.sparkContext.broadcast(some)
        found = rows.mapInArrow(make(lambda shared=shared: shared.value, k), fields)
        out = found if out is None else out.unionByName(found)
    return out


def _first(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The first k distinct (score, id) of each key, with their rank."""
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates([*key, "score", "id"])


def hard_negatives(rows: DataFrame, every: int, scale: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``rows`` (vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by ``every``; components are taken as floor(scale * x).
    """
    found = usable(rows, scale)
    trees = build_trees(settle(found.where(F.col("vec_id") % every == 0).distinct()), POSITIVES)
    positives = settle(_first(in_rounds(found, trees, _positives, POSITIVES, FOUND), ["anchor", "anchor_id"], POSITIVES))
    # at most RUN * POSITIVES scores a tree
    scores = positives.groupBy(F.expr(f"anchor div {RUN}").alias("tree")).agg(F.collect_set(F.struct("anchor", "score")).alias("scores"))
    windowed = settle(trees.join(scores, "tree"))
    negatives = _first(in_rounds(found, windowed, _negatives, NEGATIVES, NEGATIVE), ["anchor", "positive_score"], NEGATIVES)
    named = positives.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(negatives, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: Every so many ids an anchor, and the factor of the components, of the query.
EVERY, SCALE = 50, 256


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), EVERY, SCALE)


ORACLE_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT *, row_number() OVER () AS n FROM v WHERE vec_id % {EVERY} = 0),
s AS MATERIALIZED (
  SELECT DISTINCT a.n, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CASE WHEN len(a.e) = 0 THEN 0 ELSE list_inner_product(a.e, b.e) END::BIGINT AS score
  FROM a CROSS JOIN v b),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS k FROM s WHERE same AND id <> anchor_id) WHERE k <= {POSITIVES}),
m AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.n, p.id, p.score ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.n = s.n AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= {NEGATIVES}
"""
