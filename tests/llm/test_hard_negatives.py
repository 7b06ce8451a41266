"""Hard negatives against plain Python over all pairs, and against DuckDB."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from typeflow.llm import hard_negatives as hn

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, scale):
    """Rows (vec_id, label, vector) to sorted result tuples."""
    sound = {
        (i, label, tuple(math.floor(float(x) * scale) for x in v))
        for i, label, v in rows
        if None not in (i, label) and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a, label, av in sound:
        if math.fmod(a, every):
            continue
        score = lambda v: sum(x * y for x, y in zip(av, v))
        near = sorted({(-score(v), i) for i, other, v in sound if other == label and i != a})[:5]
        far = sorted({(-score(v), i) for i, other, v in sound if other != label})
        for p, pid in near:
            fit = [(n, i) for n, i in far if 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, pid, k, i, -p, -n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def made(spark, rows):
    kinds = "vec_id long, label int, embedding array<float>, anchor long, score int, tree string"
    return spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "t") for i, label, v in rows], kinds).repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def clusters(seed, n, width, labels, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + spread * rng.normal(size=width)
        rows.append((i, int(rng.integers(labels)), [float(np.float32(x)) for x in v / 4]))
    return rows


@pytest.mark.parametrize("seed,run,block,batch", [(1, 1024, 2048, 64 << 20), (2, 4, 16, 64 << 20), (3, 4, 7, 1000), (4, 1, 5, 64 << 20)])
def test_rows_against_plain_python(spark, monkeypatch, seed, run, block, batch):
    monkeypatch.setattr(hn, "RUN", run)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "BATCH_BYTES", batch)
    rows = clusters(seed, 260, 6, 3, 0.3)
    odd = [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (505, 1, None), (510, 1, [1.0, None, 0, 0, 0, 0]), (515, 1, [math.nan] + [1.0] * 5), (520, 1, [math.inf] + [1.0] * 5)]
    ties = [(i, 1, [0.25] * 6) for i in (600, 601, 602, 605, 605)] + [(i, 2, [0.2] * 6) for i in (610, 611, 612, 613, 613)] + rows[:40:5]
    other = [(620, 0, []), (621, 0, [0.5]), (625, 1, [1.0] * 9), (625, 2, [0.5] * 6), (625, 1, [0.75] * 6), (630, 77, [1.0] * 6), (-5, 1, [-1.0] * 6), (-7, 1, [-0.5] * 6)]
    everything = rows + odd + ties + other
    assert found(hn.hard_negatives(made(spark, everything), 5, 256)) == brute(everything, 5, 256)


def test_empty_tables(spark):
    assert found(hn.hard_negatives(made(spark, []), 50, 256)) == []
    assert found(hn.hard_negatives(made(spark, [(50, None, [1.0])]), 50, 256)) == []
    assert found(hn.hard_negatives(made(spark, [(1, 1, [1.0])]), 50, 256)) == []


def test_one_label_with_a_third_of_the_rows_and_labels_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(hn, "RUN", 8)
    rows = [(i, 0 if i % 3 == 0 else i, v) for i, _, v in clusters(9, 240, 5, 1, 0.2)]
    rows += [(240 + i, 0, rows[0][2]) for i in range(60)]
    assert found(hn.hard_negatives(made(spark, rows), 10, 256)) == brute(rows, 10, 256)


def test_scores_of_all_sizes(spark):
    for scale in (1, 256, 1 << 22, 1 << 29):
        rows = clusters(5, 120, 4, 2, 0.3)
        assert found(hn.hard_negatives(made(spark, rows), 6, scale)) == brute(rows, 6, scale)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        found(hn.hard_negatives(made(spark, rows), 6, 1 << 40))


def tree_of(vectors, ids=None):
    order, parents, edges = hn.spanning_tree(vectors)
    ids = np.arange(len(vectors))[order] if ids is None else ids[order]
    arrays = {"ids": ids, "vectors": vectors[order], "parents": parents, "edges": edges, "floor": hn.own_floor(ids, vectors[order], 5)}
    row = type("Row", (), {"tree": 0, "label": 0, "size": len(ids), "width": vectors.shape[1], **{k: a.tobytes() for k, a in arrays.items()}})
    return hn.Tree(row)


def test_tree_is_a_least_spanning_tree():
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (40, 3))
    order, parents, edges = hn.spanning_tree(v)
    v = v[order]
    assert parents[0] == -1 and all(p < i for i, p in enumerate(parents[1:], 1))
    assert np.allclose(edges[1:], np.sqrt(((v[1:] - v[parents[1:]]) ** 2).sum(1)))
    # Kruskal
    pairs = sorted((((v[i] - v[j]) ** 2).sum() ** 0.5, i, j) for i in range(40) for j in range(i))
    group, total = list(range(40)), 0.0
    for d, i, j in pairs:
        if group[i] != group[j]:
            total += d
            group = [group[i] if g == group[j] else g for g in group]
    assert math.isclose(total, edges.sum())


def test_bounds_rule_pairs_out_and_lose_none():
    rng = np.random.default_rng(7)
    centres = rng.integers(-200, 200, (6, 16))
    anchors = centres[rng.integers(0, 6, 300)] + rng.integers(-6, 7, (300, 16))
    others = centres[rng.integers(0, 6, 900)] + rng.integers(-6, 7, (900, 16))
    scores = anchors @ others.T
    tree = tree_of(anchors)
    block = hn.Block(np.arange(900), np.zeros(900, np.int64), others)
    least = np.sort(scores, 1)[:, -5][tree.ids]
    i, j, s, scored = tree.scan(block, least, np.full(300, hn.HIGHEST))
    want = {(a, b) for a, b in zip(*np.nonzero(scores >= np.sort(scores, 1)[:, -5:-4]))}
    assert {(tree.ids[a], block.ids[b]) for a, b in zip(i, j)} == want
    assert (s == scores[tree.ids[i], block.ids[j]]).all()
    assert scored < 0.6 * scores.size


def test_padding():
    lists = pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))
    assert hn.matrix(lists).tolist() == [[1, 2], [0, 0], [3, 0]]
    assert hn.matrix(lists.slice(1, 2)).tolist() == [[0], [3]]
    assert hn.matrix(pa.array([], pa.list_(pa.int64()))).shape == (0, 0)


def test_rows_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in con.sql("SELECT vec_id, label, embedding FROM embeddings").fetchall()]
    want = sorted(con.sql(hn.ORACLE_SQL).select(", ".join(COLUMNS)).fetchall())
    assert want == brute(rows, 50, 256) and len(want) > 50
    assert found(hn.op13_hard_negatives(spark, sf_dir)) == want
