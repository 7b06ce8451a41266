import heapq

import pytest

from typeflow import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_resolve_nested_all_converts_every_element(spark, sf_dir):
    whole = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = {r.vec_id: r.t for r in queries.QUERIES["resolve_nested_all"](spark, sf_dir).collect()}
    assert got == {k: "_".join(str(int(x * 1000) * 2) for x in v) for k, v in whole.items()}
    assert all(len(t.split("_")) == 64 for t in got.values())


@pytest.mark.parametrize("name", ["resolve_nested", "resolve_nested_all"])
def test_resolve_nested_rounds_products_as_its_sql_does(name, spark, duck, tmp_path):
    """Elements whose product with 1000 is whole as a float only; nulls inside and in place of a vector."""
    rows = [(1, [-0.196, 0.053, -0.159, 0.053]), (2, [0.25, None, -0.0005]), (3, []), (4, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.t for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    sql = queries.ORACLE_SQL[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == dict(duck.sql(sql).fetchall())
    assert got[1].startswith("-392_106_-318")


def brute_paths(edges, source):
    best, queue = {}, [(0, 0, source, source)]
    while queue:
        cost, hops, path, node = heapq.heappop(queue)
        if node not in best:
            best[node] = (cost, hops, path)
            for dst, weight in edges.get(node, {}).items():
                heapq.heappush(queue, (cost + weight, hops + 1, f"{path}>{dst}", dst))
    return best


def test_paths_over_all_line_items(spark, sf_dir, duck):
    edges = {}
    for part, supplier, weight in duck.sql("SELECT 'p' || l_partkey, 's' || l_suppkey, min(l_quantity)::BIGINT FROM lineitem GROUP BY ALL").fetchall():
        edges.setdefault(part, {})[supplier] = weight
        edges.setdefault(supplier, {})[part] = weight
    want = brute_paths(edges, "p1")
    assert len(want) == len(edges) > 200
    got = queries.QUERIES["graph_sssp_supply"](spark, sf_dir).collect()
    assert {r.node: (r.cost, r.hops, r.path) for r in got} == want
    cost, _, path = want["s1"]
    via = {node: (cost + c, path + p[len("s1") :]) for node, (c, _, p) in brute_paths(edges, "s1").items()}
    got = queries.QUERIES["graph_waypoint_supply"](spark, sf_dir).collect()
    assert {r.node: (r.cost, r.path) for r in got} == via


def test_exec_status(spark, sf_dir, duck):
    got = {r.s_suppkey: r.exit_code for r in queries.QUERIES["exec_status"](spark, sf_dir).collect()}
    assert got == {k: 0 if n < 20 else 1 for k, n in duck.sql("SELECT s_suppkey, s_nationkey FROM supplier").fetchall()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["p_partkey", "cmd"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
