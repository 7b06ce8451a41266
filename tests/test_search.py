"""Searches on graphs held as rows, against a heap and against the planner."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from typeflow import queries
from typeflow.operators import search
from typeflow.plans.planner import NoPath, shortest_path
from typeflow.plans.registry import Edge


def brute(edges, source):
    out, best, queue = {}, {}, [(0, 0, str(source), source)]
    for src, dst, weight in edges:
        out.setdefault(src, []).append((dst, weight))
    while queue:
        cost, hops, path, node = heapq.heappop(queue)
        if node not in best:
            best[node] = (cost, hops, path)
            for dst, weight in out.get(node, ()):
                heapq.heappush(queue, (cost + weight, hops + 1, f"{path}>{dst}", dst))
    return best


def random_edges(seed, nodes, n, weights):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes), rng.choice(weights)) for _ in range(n)]


@pytest.mark.parametrize("seed,nodes,n,weights,delta", [(1, 40, 160, [0, 1, 1, 2], None), (2, 60, 150, [1, 5, 40], 4), (3, 30, 60, [3], 1)])
def test_shortest_paths(spark, seed, nodes, n, weights, delta):
    """Nodes whose numbers begin alike, ties, weights of 0, parallel edges, loops; with and without heavy edges."""
    edges = random_edges(seed, nodes, n, weights)
    df = spark.createDataFrame(edges, "src long, dst long, weight int").repartition(3)
    got = search.shortest_paths(df, F.lit(1).cast("long"), delta=delta).collect()
    assert {r.node: (r.cost, r.hops, r.path) for r in got} == brute(edges, 1)


def test_a_long_chain_and_a_graph_without_choices(spark):
    edges = [(k, k + 1, 1) for k in range(12)]
    df = spark.createDataFrame(edges, "src long, dst long, weight int")
    got = search.shortest_paths(df, F.lit(0).cast("long"), delta=4).collect()
    assert {r.node: (r.cost, r.hops, r.path) for r in got} == brute(edges, 0)
    alone = search.shortest_paths(df.where("false"), F.lit(0).cast("long")).collect()
    assert [tuple(r) for r in alone] == [(0, 0, 0, "0")]
    with pytest.raises(ValueError, match="did not end"):
        search.shortest_paths(df, F.lit(0).cast("long"), rounds=3)


def planned(edges, source, caller):
    built = [Edge(s, d, w, scope, seq, None) for s, d, w, scope, seq in edges]
    out = {}
    for node in {e.src for e in built} | {e.dst for e in built}:
        try:
            chain = shortest_path(built, source, node, caller=caller)
        except NoPath:
            continue
        out[node] = (sum(e.weight for e in chain), [e.seq for e in chain])
    return out


SCOPES = ["app", "app.tool", "app.tool.x", "lib", "lib.deep", "lib.deep.er", "application"]


@pytest.mark.parametrize("seed,weights", [(1, [0]), (2, [0, 0, 0, 1]), (4, [0, 0, 2, 7])])
def test_planned_paths_equal_the_planner(spark, seed, weights):
    """Foreign and local edges, mostly without weight, parallel ones in several scopes."""
    rng = random.Random(seed)
    edges = [(f"t{rng.randrange(25)}", f"t{rng.randrange(25)}", rng.choice(weights), rng.choice(SCOPES), k) for k in range(110)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src string, dst string, weight int, scope string, seq long").repartition(3)
    for caller in ("app", "lib.deep.<module>")[: 1 + (seed == 2)]:
        got = search.planned_paths(df, F.lit("t1"), caller).collect()
        assert {r.node: (r.cost, list(r.chain)) for r in got} == planned(edges, "t1", caller)


def test_the_rule_of_places_in_plain_python():
    """The falling sequences of ranks give the planner's chains: many graphs, without Spark."""
    for seed in range(300):
        rng = random.Random(seed)
        edges = [(rng.randrange(9), rng.randrange(9), rng.choice([0, 0, 0, 1]), rng.choice(SCOPES), k) for k in range(30)]
        rank = {k: (not (s == "app" or s.startswith("app.")), -s.count("."), k) for _, _, _, s, k in edges}
        label, chain = {0: (0, [])}, {0: []}
        changed = True
        while changed:
            changed = False
            for s, d, w, _, k in edges:
                if s in label and s != d:
                    cost, place = label[s]
                    new = (cost + w, [*(r for r in place if r > rank[k] and not w), rank[k]])
                    if d not in label or new < label[d]:
                        label[d], chain[d], changed = new, [*chain[s], k], True
        # a chain may have been made before the label of a node on it was improved
        last = {d: label[d][1][-1][2] for d in label if d}
        source = {k: s for s, _, _, _, k in edges}
        whole = lambda d: [] if d == 0 else [*whole(source[last[d]]), last[d]]
        want = planned(edges, 0, "app")
        assert {d: (label[d][0], whole(d)) for d in label} == (want or {0: (0, [])})


def test_planned_supply(spark, sf_dir):
    rows = queries._scoped_edges(spark, sf_dir).collect()
    edges = [(r.src, r.dst, r.weight, r.scope, r.seq) for r in rows]
    got = {r.node: (r.cost, r.steps, r.chain) for r in queries.QUERIES["graph_planned_supply"](spark, sf_dir).collect()}
    assert len(got) > 200
    built = [Edge(*e[:4], e[4], None) for e in edges]
    for node in random.Random(1).sample(sorted(got), 60):
        chain = shortest_path(built, "p1", node, caller="app")
        assert got[node] == (sum(e.weight for e in chain), len(chain), ">".join(str(e.seq) for e in chain))


def dense(seed, weights):
    """A dense graph, nodes that heavy edges alone lead to, a chain of such edges behind them, and nodes that nothing leads to."""
    edges = random_edges(seed, 60, 2500, weights)
    edges += [(60, 61, 3), (3, 62, 70), (5, 62, 71), (62, 63, 90), (63, 64, 3), (62, 7, 60), (62, 7, 9)]
    return edges + [(80 + a, 80 + b, w) for a, b, w in random_edges(seed + 1, 20, 600, weights)]


def test_a_dense_graph_is_searched_over_few_edges(spark, monkeypatch):
    monkeypatch.setattr(search, "FEW", 20)  # so that nodes are joined in both ways
    edges = dense(7, range(1, 41))
    df = spark.createDataFrame(edges, "src long, dst long, weight int").repartition(3)
    want = brute(edges, 1)
    assert 60 not in want and {62, 64} <= set(want)
    got = search.shortest_paths(df, F.lit(1).cast("long")).collect()
    assert {r.node: (r.cost, r.hops, r.path) for r in got} == want
    # without the ways that are heavy alone, one pass over the heavier edges is enough, and opens few
    plain = search.Graph(df.where("weight < 60"))
    label = lambda cost: F.struct(cost.alias("cost"))
    found, kept = plain.search(F.lit(1).cast("long"), label(F.lit(0).cast("long")), lambda old, edge: label(old["cost"] + edge("weight")))
    assert {r.node: r.label.cost for r in found.collect()} == {n: c for n, (c, *_) in brute([e for e in edges if e[2] < 60], 1).items()}
    assert kept.count() < 0.4 * plain.edges.count()


def test_planned_paths_on_a_dense_graph(spark):
    """Some edges without weight, ties, and nodes behind heavy edges alone."""
    rng = random.Random(3)
    edges = [(f"t{s}", f"t{d}", w, rng.choice(SCOPES), k) for k, (s, d, w) in enumerate(dense(5, range(40)))]
    df = spark.createDataFrame(edges, "src string, dst string, weight int, scope string, seq long").repartition(3)
    got = search.planned_paths(df, F.lit("t1"), "app").collect()
    assert {r.node: (r.cost, list(r.chain)) for r in got} == planned(edges, "t1", "app")


def test_a_search_to_one_node_and_from_a_node_with_heavy_edges_alone(spark):
    """Bounds begin behind the source's own edges, so few others are opened; with a target nothing dearer than it is found."""
    edges = [e for e in random_edges(7, 60, 2500, range(1, 41)) if e[0] != 1] + [(1, k, 35) for k in (2, 5, 9)]
    want = {n: c for n, (c, *_) in brute(edges, 1).items()}
    graph = search.Graph(spark.createDataFrame(edges, "src long, dst long, weight int").repartition(3))
    label = lambda cost: F.struct(cost.alias("cost"))
    source, zero, extend = F.lit(1).cast("long"), F.lit(0).cast("long"), lambda old, edge: label(old["cost"] + edge("weight"))
    found, kept = graph.search(source, label(zero), extend)
    assert {r.node: r.label.cost for r in found.collect()} == want
    assert kept.count() < 0.4 * graph.edges.count()
    target = sorted(want, key=want.get)[20]
    found, _ = graph.search(source, label(zero), extend, target=F.lit(target).cast("long"))
    assert {r.node: r.label.cost for r in found.collect()} == {n: c for n, c in want.items() if c <= want[target]}


def test_long_ways_without_weight_take_few_rounds(spark, monkeypatch):
    """A chain both ways that is entered in its middle and at one end, with twigs; places are taken by one task, and in rounds beyond TAKEN edges."""
    rng = random.Random(11)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(41), 50 + k) for k in range(12)]
    ways = [(s, d, 0) for a, b in pairs for s, d in ((a, b), (b, a))] + [(99, 17, 2), (99, 40, 2), (99, 60, 1), (50, 99, 0), (55, 70, 3), (70, 71, 0), (20, 71, 3)]
    edges = [(f"t{s}", f"t{d}", w, rng.choice(SCOPES), k) for k, (s, d, w) in enumerate(ways)]
    df = spark.createDataFrame(edges, "src string, dst string, weight int, scope string, seq long").repartition(3)
    rounds, relaxed = [], search.Spread._relaxed
    monkeypatch.setattr(search.Spread, "_relaxed", lambda self, *args: rounds.append(1) or relaxed(self, *args))
    got = search.planned_paths(df, F.lit("t99"), "app").collect()
    assert {r.node: (r.cost, list(r.chain)) for r in got} == planned(edges, "t99", "app")
    assert len(rounds) <= 12  # and more than 40 by edges alone

    few = [e for e in edges if all(int(n[1:]) < 8 or int(n[1:]) > 40 for n in e[:2])] + [("t99", "t3", 2, "lib", 900), ("t99", "t7", 2, "app.tool", 901)]
    monkeypatch.setattr(search, "TAKEN", 6)
    got = search.planned_paths(spark.createDataFrame(few, df.schema).repartition(3), F.lit("t99"), "app").collect()
    assert {r.node: (r.cost, list(r.chain)) for r in got} == planned(few, "t99", "app")
