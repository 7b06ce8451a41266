"""Registered queries of the core library, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import gzip as _gzip
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import convert
from .operators import assets, bricks, command, execute, graph, search, volumes, workflow
from .operators.proxified import ProxyCommand
from .operators.storage import checkpointed, new_folder
from .plans.defaults import default_registry, join
from .plans.dispatch import distinct_tags, resolve_tagged as by_tag, resolve_variant as by_variant
from .plans.planner import Context
from .sources import metadata, volume_files
from .streaming import managed

QUERIES = {}
ORACLE_SQL = {}


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# commands


@_query("""
SELECT p_partkey, concat_ws(' ', 'resize', '-i', p_name, '--size', p_size::VARCHAR, CASE WHEN p_type = 'LARGE' THEN '--large' END) AS cmd FROM part
""")
def render_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = command.Command("resize", [command.Param("name", label="i"), command.Param("size", "keyword"), command.Param("large", "flag", default=False)])
    part = _t(spark, sf_dir, "part")
    return part.select("p_partkey", spec.text({"name": F.col("p_name"), "size": F.col("p_size"), "large": F.col("p_type") == "LARGE"}).alias("cmd"))


@_query("""
SELECT p_partkey, concat_ws(' ', 'transform_threshold', '-i', p_partkey::VARCHAR || '.vol', '-o', 'out/' || p_partkey::VARCHAR || '.vol',
       '--select', 'below ' || p_size::VARCHAR, '--substitute', 'binarize') AS threshold_cmd,
       concat_ws(' ', 'volume_align', '--i1', p_name, '--i2', p_brand, CASE WHEN p_size > 25 THEN '--local' END, '--apply', p_partkey::VARCHAR || '.vol') AS align_cmd,
       concat_ws(' ', 'volume_from_pdb', '-i', p_name, '-o', p_brand, '--centerPDB', 'yes', '--sampling', p_size::VARCHAR, '--size', '64') AS pdb_cmd
FROM part
""")
def render_bound_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = command.bound_programs()
    key = F.col("p_partkey").cast("string")
    volume = assets.retype(key, ".vol")
    text = F.col("p_size").cast("string")
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        programs["transform_threshold"]
        .text({"inputs": volume, "outputs": F.concat(F.lit("out/"), volume), "select": F.concat(F.lit("below "), text), "substitute": F.lit("binarize")})
        .alias("threshold_cmd"),
        programs["volume_align"].text({"reference_map": F.col("p_name"), "volume": F.col("p_brand"), "local": F.col("p_size") > 25, "apply": volume}).alias("align_cmd"),
        programs["volume_from_pdb"]
        .text({"inputs": F.col("p_name"), "outputs": F.col("p_brand"), "center_pdb": F.lit("yes"), "sampling": text, "size": F.lit(64)})
        .alias("pdb_cmd"),
    )


@_query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-4]') AS ok FROM part")
def validate_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = command.Command("check", [command.Param("brand", pattern="Brand#[0-4]")])
    return _t(spark, sf_dir, "part").select("p_partkey", (F.size(spec.invalid({"brand": F.col("p_brand")})) == 0).alias("ok"))


@_query("SELECT p_partkey, list_concat((['-i', p_name, p_brand])[2:3], (['-i', p_name, p_brand])[1:1]) AS a FROM part")
def postprocess_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values, then the first argument's label: an order that only the program's own rule gives."""
    values_first = lambda groups: F.array(F.transform(groups, lambda g: g[1]), F.array(groups[0][0]))
    spec = command.Command("program", [command.Param("name", label="i"), command.Param("brand")], postprocess=values_first)
    return _t(spark, sf_dir, "part").select("p_partkey", spec.arguments({"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("a"))


@_query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def bind_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    params = [command.Param("quality", "keyword", default=-1), command.Param("toxic", "keyword", default=0)]
    bound = command.bind_defaults(params, {"quality": F.col("quality"), "toxic": F.col("toxic")})
    return rows.select("doc_id", *[value.alias(name) for name, value in bound.items()])


@_query("SELECT event_id, coalesce(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'buy' END, event_type) AS n FROM events")
def rename_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", command.rename(F.col("event_type"), {"view": "v", "click": "c", "purchase": "buy"}).alias("n"))


@_query("""
SELECT d.doc_id, list_concat(CASE WHEN quality = 1 THEN ['--quality'] ELSE []::VARCHAR[] END, CASE WHEN toxic = 1 THEN ['--toxic'] ELSE []::VARCHAR[] END) AS f
FROM documents d LEFT JOIN labels USING (doc_id)
""")
def bool_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    flags = F.array(command.flag("--quality", F.col("quality") == 1), command.flag("--toxic", F.col("toxic") == 1))
    return rows.select("doc_id", F.flatten(flags).alias("f"))


@_query("SELECT event_id, list_filter([event_type, CASE WHEN value > 50 THEN 'hi' END], lambda v: v IS NOT NULL) AS a FROM events")
def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", command.drop_nulls(F.array("event_type", F.when(F.col("value") > 50, F.lit("hi")))).alias("a"))


@_query()
def exec_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's command compares its nation with 20 by a harmless program."""
    rows = _t(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array(F.lit("test"), F.col("s_nationkey").cast("string"), F.lit("-lt"), F.lit("20")).alias("argv")
    )
    return execute.run_commands(rows, "s_suppkey", "argv").select("s_suppkey", "exit_code")


def _command_graph(spark: SparkSession, sf_dir: str):
    """A command for each document: it reads its source's file and what the commands of half and a third of its number write."""
    docs = _t(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("command"), "source")
    name = lambda number: F.concat(F.lit("out-"), F.expr(number).cast("string"))
    later = docs.where("command > 0")
    reads = later.select("command", name("command div 2").alias("asset")).unionByName(later.select("command", name("command div 3").alias("asset")))
    reads = reads.unionByName(docs.select("command", F.concat(F.lit("source-"), "source").alias("asset")))
    return docs.select("command"), reads, docs.select("command", name("command").alias("asset")).distinct()


_COMMAND_GRAPH = """
c AS (SELECT DISTINCT doc_id AS command FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT command, command // 2 AS needed FROM c WHERE command > 0 UNION SELECT command, command // 3 FROM c WHERE command > 0),
l AS (SELECT command, 0 AS level FROM c UNION SELECT n.command, level + 1 FROM l JOIN n ON n.needed = l.command),
v AS (SELECT command, max(level) AS level FROM l GROUP BY command),
r AS (SELECT command, 'out-' || needed::VARCHAR AS asset FROM n UNION SELECT doc_id, 'source-' || source FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT asset, max((level, command)) AS last, count(*) AS readers FROM r JOIN v USING (command) GROUP BY asset)
"""


@_query(f"""
WITH RECURSIVE {_COMMAND_GRAPH}
SELECT coalesce('out-' || v.command::VARCHAR, u.asset) AS asset, v.command AS writer, v.level::INTEGER AS level, coalesce(readers, 0)::BIGINT AS readers,
       last[2] AS last_reader, last[1]::INTEGER AS last_level, CASE WHEN v.command IS NOT NULL THEN greatest(v.level, last[1]) END::INTEGER AS free_after
FROM v FULL JOIN u ON u.asset = 'out-' || v.command::VARCHAR
""")
def command_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and last reader of every file of a graph of commands, and when it may go."""
    commands, reads, writes = _command_graph(spark, sf_dir)
    levels = workflow.command_levels(commands, workflow.dependencies(reads, writes))
    return workflow.asset_uses(levels, reads, writes)


@_query(f"""
WITH RECURSIVE {_COMMAND_GRAPH},
f AS (SELECT v.level, greatest(v.level, last[1]) AS free FROM v LEFT JOIN u ON u.asset = 'out-' || v.command::VARCHAR),
k AS (SELECT DISTINCT level FROM (SELECT level FROM f UNION SELECT free FROM f))
SELECT k.level::INTEGER AS level, count(*) FILTER (f.level = k.level) AS made, count(*) FILTER (f.free = k.level) AS freed, count(*) FILTER (f.level <= k.level AND f.free >= k.level) AS held
FROM k CROSS JOIN f GROUP BY k.level
""")
def command_files_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files are written, freed and held on each level."""
    commands, reads, writes = _command_graph(spark, sf_dir)
    levels = workflow.command_levels(commands, workflow.dependencies(reads, writes))
    return workflow.held_files(workflow.asset_uses(levels, reads, writes))


# text forms and parameters


@_query("SELECT conv_id, array_to_string(list_sort(list(turn)), '_') AS t FROM conversations GROUP BY conv_id")
def tuple_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    registry = default_registry()
    registry.add("tuple", "str", lambda v, context: join(v, context, "_"), "app", nested=True)
    return turns.select("conv_id", Context(registry).inside("app").resolve(F.col("turns"), "tuple[int]", "str").alias("t"))


@_query("SELECT o_orderkey, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS s, CASE WHEN o_totalprice > 1000 THEN 'True' ELSE 'False' END AS b FROM orders")
def to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", convert.to_string(F.col("o_totalprice").cast("long")).alias("s"), convert.bool_to_string(F.col("o_totalprice") > 1000).alias("b")
    )


@_query("SELECT p_partkey, p_name AS str_rep, 'path' AS dtype, p_size > 25 AS managed FROM part")
def param_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    param = convert.param_struct(F.col("p_name"), "path", F.col("p_size") > 25)
    return _t(spark, sf_dir, "part").select("p_partkey", param.alias("p")).select("p_partkey", "p.*")


# conversion graph


@_query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1
""")
def registry_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return graph.dedupe_edges(edges, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@_query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem)
  WHERE n = 1) WHERE m = 1
""")
def registry_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First in a scope, last among scopes."""
    edges = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return graph.dedupe_edges(edges, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"], "l_returnflag").drop("l_returnflag")


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    customer = _t(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("sub"), name("n", "c_nationkey").alias("sup"))
    nation = _t(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("sub"), name("r", "n_regionkey").alias("sup"))
    region = _t(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("sub"), F.lit("object").alias("sup"))
    return customer.unionByName(nation).unionByName(region)


@_query("""
WITH RECURSIVE p AS (
  SELECT 'c' || c_custkey::VARCHAR AS sub, 'n' || c_nationkey::VARCHAR AS sup FROM customer
  UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR FROM nation
  UNION ALL SELECT 'r' || r_regionkey::VARCHAR, 'object' FROM region),
a AS (SELECT sub, sup, 1 AS weight FROM p UNION ALL SELECT a.sub, p.sup, weight + 1 FROM a JOIN p ON a.sup = p.sub WHERE weight < 6)
SELECT sub, sup, min(weight)::INTEGER AS weight FROM a GROUP BY sub, sup
""")
def downcast_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors_closure(_parents(spark, sf_dir))


@_query("""
WITH RECURSIVE p AS (
  SELECT 'c' || c_custkey::VARCHAR AS sub, 'n' || c_nationkey::VARCHAR AS sup FROM customer
  UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR FROM nation
  UNION ALL SELECT 'r' || r_regionkey::VARCHAR, 'object' FROM region),
a AS (SELECT sub, sup, 1 AS weight FROM p UNION ALL SELECT a.sub, p.sup, weight + 1 FROM a JOIN p ON a.sup = p.sub WHERE weight < 6)
SELECT sub, sup, min(weight)::INTEGER AS weight FROM a GROUP BY sub, sup
""")
def downcast_closure_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure when the nations of one region get their parent later, and only they and their customers are ordered anew."""
    parents = _parents(spark, sf_dir)
    late = _t(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("sub"))
    before = graph.ancestors_closure(parents.join(late, "sub", "left_anti"))
    return graph.update_closure(before, parents, late)


@_query("""
WITH c AS (
  SELECT 'c' || c_custkey::VARCHAR AS sub, 'n' || n_nationkey::VARCHAR AS n, 'r' || n_regionkey::VARCHAR AS r, coalesce(c_mktsegment, '') AS s
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT sub, n AS sup, 1 AS weight FROM c
UNION ALL SELECT sub, r, 2 FROM c
UNION ALL SELECT sub, s, 3 FROM c
UNION ALL SELECT sub, 'object', 4 FROM c
UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR, 1 FROM nation
UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'object', 2 FROM nation
UNION ALL SELECT 'r' || r_regionkey::VARCHAR, 'object', 1 FROM region
UNION ALL SELECT DISTINCT s, 'object', 1 FROM c
""")
def downcast_closure_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two parents each, their nation and then their market segment."""
    customer = _t(spark, sf_dir, "customer").select("c_custkey", F.coalesce("c_mktsegment", F.lit("")).alias("segment"))
    second = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("sub"), F.col("segment").alias("sup"), F.lit(1).alias("at"))
    segments = customer.select(F.col("segment").alias("sub"), F.lit("object").alias("sup")).distinct()
    parents = _parents(spark, sf_dir).unionByName(segments).withColumn("at", F.lit(0)).unionByName(second)
    return graph.ancestors_closure(parents, "at")


_NATION_EDGES = """
e AS (
  SELECT src, dst, min(weight) AS weight FROM (
    SELECT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst, n_regionkey AS weight FROM nation
    UNION ALL SELECT n_nationkey, (3 * n_nationkey + 1) % 25, n_nationkey % 4 FROM nation) WHERE src <> dst GROUP BY src, dst)
"""


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("src"), ((7 * F.col("n_nationkey") + 3) % 25).alias("dst"), F.col("n_regionkey").cast("long").alias("weight"))
    b = n.select(F.col("n_nationkey").alias("src"), ((3 * F.col("n_nationkey") + 1) % 25).alias("dst"), (F.col("n_nationkey") % 4).cast("long").alias("weight"))
    return a.unionByName(b)


def _walks(name: str, start: int, hops: int) -> str:
    return f"""{name} AS (
  SELECT {start} AS node, 0 AS cost, 0 AS hops, '{start}' AS path
  UNION ALL SELECT e.dst, cost + e.weight, hops + 1, path || '>' || e.dst::VARCHAR FROM {name} JOIN e ON node = e.src WHERE hops < {hops}),
best_{name} AS (SELECT node, cost, hops, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, hops, path) AS k FROM {name}) WHERE k = 1)"""


@_query(f"WITH RECURSIVE {_NATION_EDGES}, {_walks('w', 0, 12)} SELECT node::INTEGER AS node, cost::BIGINT AS cost, hops::BIGINT AS hops, path FROM best_w")
def graph_sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shortest_paths(_nation_edges(spark, sf_dir), F.lit(0))


@_query(f"""
WITH RECURSIVE {_NATION_EDGES}, {_walks('w', 0, 12)}, {_walks('x', 3, 12)}
SELECT x.node::INTEGER AS node, (w.cost + x.cost)::BIGINT AS cost, w.path || CASE WHEN x.hops = 0 THEN '' ELSE substr(x.path, 2) END AS path
FROM best_x x, best_w w WHERE w.node = 3
""")
def graph_waypoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.paths_via(_nation_edges(spark, sf_dir), F.lit(0), F.lit(3))


def _supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that a line item joins, both ways, weighted by its quantity; grows with the data."""
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    weight = F.col("l_quantity").cast("long").alias("weight")
    lines = _t(spark, sf_dir, "lineitem")
    return lines.select(part.alias("src"), supplier.alias("dst"), weight).unionByName(lines.select(supplier.alias("src"), part.alias("dst"), weight))


@_query()
def graph_sssp_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shortest_paths(_supply_edges(spark, sf_dir), F.lit("p1"))


@_query()
def graph_waypoint_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.paths_via(_supply_edges(spark, sf_dir), F.lit("p1"), F.lit("s1"))


def _scoped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as converters between parts and suppliers, some without weight, in scopes of three depths."""
    edges = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    scope = F.when(F.col("l_returnflag") == "A", "app.tool").when(F.col("l_returnflag") == "N", "lib").otherwise("lib.deep.er")
    weight = F.col("l_quantity").cast("long") - 1 + F.col("l_linenumber") % 2
    number = lambda way: F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(way)).alias("seq")
    there = edges.select(part.alias("src"), supplier.alias("dst"), weight.alias("weight"), scope.alias("scope"), number(0))
    return there.unionByName(edges.select(supplier.alias("src"), part.alias("dst"), weight.alias("weight"), scope.alias("scope"), number(1)))


@_query()
def graph_planned_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's own chain to every part and supplier, on a graph that is held as rows."""
    found = search.planned_paths(_scoped_edges(spark, sf_dir), F.lit("p1"), "app")
    return found.select("node", "cost", F.size("chain").cast("long").alias("steps"), F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))


@_query("""
SELECT l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 2, l_returnflag <> 'N', l_suppkey % 5 DESC, l_orderkey, l_linenumber, l_suppkey) AS n
  FROM lineitem) WHERE n = 1
""")
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = graph.rank_candidates(
        _t(spark, sf_dir, "lineitem"),
        ["l_partkey"],
        F.col("l_linenumber") % 2,
        F.col("l_returnflag") != "N",
        F.col("l_suppkey") % 5,
        ["l_orderkey", "l_linenumber", "l_suppkey"],
    )
    return ranked.select("l_partkey", "l_suppkey")


_HOST = "regexp_extract(url, '^[a-z]+://([^/:]+)', 1)"


@_query(f"""
SELECT DISTINCT array_to_string(p[1:i], '.') AS ns FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split({_HOST}, '.') AS p FROM pages))
""")
def scope_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select(F.explode(graph.expand_scopes(F.expr(_HOST))).alias("ns")).distinct()


@_query(f"""
SELECT string_split({_HOST}, '.')[1] AS ns FROM pages WHERE page_id % 2 = 0 INTERSECT SELECT string_split({_HOST}, '.')[1] FROM pages WHERE page_id % 2 = 1
""")
def scope_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", F.substring_index(F.expr(_HOST), ".", 1).alias("ns"))
    side = lambda k: pages.where(F.col("page_id") % 2 == k).select("ns")
    return graph.visible_scopes(side(0), side(1))


@_query(f"""
WITH h AS (SELECT page_id, string_split({_HOST}, '.') AS p FROM pages),
e AS (SELECT page_id, array_to_string(p[1:i], '.') AS ns FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM h))
SELECT DISTINCT page_id % 10 AS caller, ns FROM e WHERE ns IN (SELECT ns FROM e WHERE page_id % 3 = 0)
""")
def scope_visible_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of ten callers sees of the scopes that a third of the pages register."""
    pages = _t(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("caller"), "page_id", F.expr(_HOST).alias("ns"))
    return graph.visible_to_callers(pages, pages.where("page_id % 3 = 0"), "caller", "ns")


@_query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def scope_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible = _t(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return graph.edges_in_scope(_t(spark, sf_dir, "documents").select("doc_id", "source"), visible, "doc_id")


@_query(f"SELECT page_id, array_to_string(p[1:len(p) - 1], '.') AS parent FROM (SELECT page_id, string_split({_HOST}, '.') AS p FROM pages)")
def scope_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", graph.parent_scope(F.expr(_HOST)).alias("parent"))


@_query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'root' ELSE source END AS module FROM documents")
def scope_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", graph.lift_scope(F.col("source"), "src0", "root").alias("module"))


@_query("""
SELECT c_custkey, CASE WHEN n_regionkey % 2 = 0 THEN 'n' || n_nationkey::VARCHAR ELSE 'r' || n_regionkey::VARCHAR END AS sup
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def origin_upcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nearest ancestor among all regions and the nations of even regions."""
    nations = _t(spark, sf_dir, "nation")
    closure = graph.ancestors_closure(_parents(spark, sf_dir)).where(F.col("sub").startswith("c"))
    even = nations.where("n_regionkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("sup"))
    nodes = even.unionByName(nations.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("sup")).distinct())
    found = graph.nearest_ancestor(closure, nodes, "sub", "sup", "weight")
    return found.select(F.substring("sub", 2, 20).cast("long").alias("c_custkey"), "sup")


# conversions


@_query("SELECT p_partkey, 'p' || CAST(CAST(trunc(p_retailprice) AS INTEGER) AS VARCHAR) AS s FROM part")
def resolve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """double to int to text to a prefixed name, planned and compiled to one expression."""
    registry = default_registry()
    registry.declare("name")
    registry.add("float", "int", convert.to_int, "app")
    registry.add("str", "name", lambda v: F.concat(F.lit("p"), v), "app")
    context = Context(registry).inside("app")
    return _t(spark, sf_dir, "part").select("p_partkey", context.resolve(F.col("p_retailprice"), "float", "name", via="int").alias("s"))


@_query("SELECT n_nationkey, n_name FROM nation")
def resolve_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = Context(default_registry())
    return _t(spark, sf_dir, "nation").select("n_nationkey", context.resolve(F.col("n_name"), "str", "str", via="int").alias("n_name"))


@_query("SELECT c_custkey, c_name FROM customer")
def resolve_passthrough_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = Context(default_registry())
    return _t(spark, sf_dir, "customer").select("c_custkey", context.resolve(F.col("c_name"), "str", "str", via="int").alias("c_name"))


def _nested_context() -> Context:
    registry = default_registry()
    # the product is rounded in the element's own precision, as in the SQL: a double's 52.99999937 is a float's 53
    registry.add("float", "str", lambda v: convert.to_string(convert.to_int(v * F.lit(1000).cast("float")) * 2), "app")
    joined = lambda v, context: convert.join_elements(v, lambda x: context.resolve(x, "float", "str"), "_")
    registry.add("tuple", "str", lambda v, context: F.when(v.isNotNull(), joined(v, context)), "app", nested=True)
    return Context(registry).inside("app")


@_query("SELECT vec_id, array_to_string(list_transform(embedding[1:3], lambda v: CAST(CAST(trunc(v * 1000) AS INTEGER) * 2 AS VARCHAR)), '_') AS t FROM embeddings")
def resolve_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three elements of a tuple converted by the rules of the scope that the tuple is resolved in."""
    scaled = F.slice("embedding", 1, 3)
    return _t(spark, sf_dir, "embeddings").select("vec_id", _nested_context().resolve(scaled, "tuple", "str").alias("t"))


@_query("SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CAST(CAST(trunc(v * 1000) AS INTEGER) * 2 AS VARCHAR)), '_') AS t FROM embeddings")
def resolve_nested_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of a tuple converted by the rules of the scope that the tuple is resolved in."""
    return _t(spark, sf_dir, "embeddings").select("vec_id", _nested_context().resolve(F.col("embedding"), "tuple", "str").alias("t"))


@_query("""
SELECT event_id, CASE event_type WHEN 'view' THEN user_id::VARCHAR WHEN 'click' THEN value::VARCHAR WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'True' ELSE 'False' END
       WHEN 'signup' THEN user_id::VARCHAR || ' ' || event_id::VARCHAR END AS text,
       CASE WHEN event_type = 'error' THEN 'unknown type: blob' END AS error
FROM events
""")
def resolve_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of five types in one table, each converted from the type that its row names; one of them is not known."""
    registry = default_registry()
    registry.declare("price", "float")
    tags = F.create_map(*[F.lit(x) for pair in (("view", "int"), ("click", "price"), ("purchase", "bool"), ("signup", "tuple[int]"), ("error", "blob")) for x in pair])
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "value", tags[F.col("event_type")].alias("tag"))
    columns = {"int": F.col("user_id"), "price": F.col("value"), "bool": F.col("value") > 50, "tuple[int]": F.array("user_id", "event_id")}
    known = {t: columns[t] for t in distinct_tags(rows, F.col("tag")) if t in columns}
    made = by_tag(Context(registry), F.col("tag"), known, "str", "string")
    return rows.select("event_id", made.alias("m")).select("event_id", F.col("m.value").alias("text"), "m.error")


@_query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN n_chars::VARCHAR || '.5' WHEN 2 THEN lang WHEN 3 THEN CASE WHEN n_chars > 500 THEN 'True' ELSE 'False' END
       WHEN 4 THEN n_chars::VARCHAR || ' True ' || lang || ' 1 2.5' END AS text,
       CASE WHEN doc_id % 6 = 5 THEN 'unknown type: OBJECT<a: BIGINT>' END AS error
FROM documents
""")
def resolve_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values of any type, each converted by the type of what it holds, arrays element by element."""
    n, quoted = F.col("n_chars").cast("string"), F.concat(F.lit('"'), "lang", F.lit('"'))
    kinds = [n, F.concat(n, F.lit(".5")), quoted, F.when(F.col("n_chars") > 500, "true").otherwise("false"), F.concat(F.lit("["), n, F.lit(", true, "), quoted, F.lit(", null, [1, 2.5]]")), F.lit('{"a": 1}')]
    json = F.lit(None).cast("string")
    for k, kind in enumerate(kinds):
        json = F.when(F.col("doc_id") % 6 == k, kind).otherwise(json)
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.parse_json(json).alias("v"))
    made = by_variant(Context(default_registry()), F.col("v"), "str", "string")
    return rows.select("doc_id", made.alias("m")).select("doc_id", F.col("m.value").alias("text"), "m.error")


# assets and references


@_query(r"SELECT doc_id, regexp_extract(concat(source, '.', lang), '([.][^./]+)$', 1) AS ext, lang = 'en' AS is_en FROM documents")
def asset_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("."), "lang")
    return _t(spark, sf_dir, "documents").select("doc_id", convert.suffix_of(path).alias("ext"), assets.is_type(path, ".en").alias("is_en"))


@_query("SELECT doc_id, concat('/tmp/', source, '/', doc_id::VARCHAR, '.vol') AS path FROM documents")
def asset_retype(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("/tmp/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", assets.retype(base, ".vol").alias("path"))


@_query("""
SELECT doc_id, '/tmp/mask-' || doc_id::VARCHAR || '.vol' AS mask_path, 'Volume' AS mask_type, '/tmp/log-' || doc_id::VARCHAR || '.txt' AS log_path, true AS managed
FROM documents
""")
def proxify_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets.with_outputs(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"mask": ("Volume", ".vol"), "log": ("Text", ".txt")}, "/tmp")
    return rows.select("doc_id", F.col("mask.path").alias("mask_path"), F.col("mask.type").alias("mask_type"), F.col("log.path").alias("log_path"), "mask.managed")


@_query("""
SELECT p_partkey, concat_ws(' ', 'transform_threshold', '-i', 'in/' || p_partkey::VARCHAR || '.vol', '-o', 'out/outputs-' || p_partkey::VARCHAR || '.vol',
       '--select', CASE WHEN p_size > 5 THEN 'below ' || p_size::VARCHAR END, '--substitute', 'binarize') AS cmd,
       'out/outputs-' || p_partkey::VARCHAR || '.vol' AS out_path, 'Volume' AS out_type, true AS managed
FROM part WHERE p_size > 5
UNION ALL
SELECT p_partkey, concat_ws(' ', 'transform_threshold', '-i', 'in/' || p_partkey::VARCHAR || '.vol', '-o', 'out/outputs-' || p_partkey::VARCHAR || '.vol',
       '--substitute', 'binarize'),
       'out/outputs-' || p_partkey::VARCHAR || '.vol', 'Volume', true
FROM part WHERE p_size <= 5
""")
def proxified_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values to a command and its output asset: a path by way of its file type, a null left out, a new managed file."""
    registry = default_registry()
    registry.declare("Volume", "proxy", suffix=".vol")
    bound = command.bound_programs()["transform_threshold"]
    params = [replace(p, default=command.Output("Volume", ".vol")) if p.name == "outputs" else p for p in bound.params]
    program = ProxyCommand(replace(bound, params=params), {"inputs": "Volume", "outputs": "Volume"})
    path = F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), F.lit(".vol"))
    chosen = F.when(F.col("p_size") > 5, F.concat(F.lit("below "), F.col("p_size").cast("string")))
    given = {"inputs": (path, "path"), "select": (chosen, "str"), "substitute": (F.lit("binarize"), "str")}
    rows = program.apply(_t(spark, sf_dir, "part"), "p_partkey", given, Context(registry), "out")
    return rows.select("p_partkey", F.array_join("argv", " ").alias("cmd"), F.col("outputs.path").alias("out_path"), F.col("outputs.type").alias("out_type"), "outputs.managed")


@_query("""
SELECT doc_id, lang <> 'en' AS untyped, CASE WHEN lang <> 'en' THEN '/data/' || doc_id::VARCHAR || '.pos' END AS path, CASE WHEN lang <> 'en' THEN 'PosFile' END AS type
FROM (SELECT doc_id, coalesce(lang, '') AS lang FROM documents)
""")
def asset_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets without a type get one; the others (English texts here) have a type already and are told apart first."""
    english = F.coalesce(F.col("lang"), F.lit("")) == "en"
    parts = [F.concat(F.lit("/data/"), F.col("doc_id").cast("string")).alias("path"), F.when(english, F.lit(".txt")).alias("ext"), F.when(english, F.lit("Text")).alias("type"), F.lit(False).alias("managed")]
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.struct(*parts).alias("asset"))
    made = F.when(assets.untyped(F.col("asset")), assets.typed(F.col("asset"), assets.AssetType("PosFile", ".pos")))
    return rows.select("doc_id", assets.untyped(F.col("asset")).alias("untyped"), made["path"].alias("path"), made["type"].alias("type"))


@_query("SELECT vec_id // 64 AS volume, 16 + count(*) * 256 AS bytes, true AS same FROM embeddings GROUP BY volume")
def asset_typed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume files without a type get one, with their content; each copy is read back beside its source."""
    home = new_folder(spark, "typed")
    volume_files.write_volumes(_planes(spark, sf_dir), home, 8, 8)
    content = lambda pattern: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(home).select("path", F.sha2("content", 256).alias("digest"))
    stored = content("*.tfv")
    none = F.lit(None).cast("string")
    rows = stored.select(F.struct("path", none.alias("ext"), none.alias("type"), F.lit(True).alias("managed")).alias("asset"), "digest")
    copied = checkpointed(assets.typed_content(rows, "asset", assets.AssetType("PosFile", ".pos")).where("error IS NULL"))
    both = copied.join(stored.withColumnRenamed("path", "source"), "source").join(content("*.pos").select(F.col("path").alias("target"), F.col("digest").alias("copy")), "target")
    return both.select(F.regexp_extract("source", r"([0-9]+)[.]tfv$", 1).cast("long").alias("volume"), "bytes", (F.col("digest") == F.col("copy")).alias("same"))


def _delta():
    return F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type") == "error", -1).otherwise(0)


_DELTA = "CASE WHEN event_type IN ('signup', 'view') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END"


@_query(f"SELECT user_id, sum({_DELTA})::BIGINT AS refs FROM events GROUP BY user_id")
def ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.reference_counts(_t(spark, sf_dir, "events"), "user_id", _delta())


@_query(f"SELECT event_id, user_id, (sum({_DELTA}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM events")
def ref_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return assets.running_counts(ledger, "user_id", _delta(), ["ts", "event_id"]).select("event_id", "user_id", "running")


@_query(f"""
WITH s AS (SELECT event_id, user_id, ts, sum({_DELTA}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events),
m AS (SELECT *, min(running) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM s)
SELECT event_id, user_id FROM m WHERE running < least(coalesce(least, 0), 0)
""")
def ref_underflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that take a reference from a user who has none left."""
    ledger = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return assets.underflows(ledger, "user_id", _delta(), ["ts", "event_id"]).select("event_id", "user_id")


@_query(f"""
WITH s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, user_id, ts, {_DELTA} AS d FROM events)),
m AS (SELECT *, s - d - least(coalesce(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS before FROM s),
l AS (SELECT *, greatest(before + d, 0) AS refs, count(*) FILTER (d = 1 AND before = 0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM m)
SELECT user_id, life::BIGINT AS life, max(event_id) FILTER (before = 0) AS born, max(event_id) FILTER (refs = 0) AS died, max(refs)::BIGINT AS peak
FROM l WHERE before > 0 OR refs > 0 GROUP BY user_id, life
""")
def ref_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each life of a user's references: it ends when the last one goes, and a later addition begins another."""
    ledger = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return assets.reference_lives(ledger, "user_id", "event_id", _delta(), ["ts", "event_id"])


@_query(f"SELECT user_id, sum({_DELTA})::BIGINT AS refs FROM events GROUP BY user_id HAVING sum({_DELTA}) <= 0")
def ref_collectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.collectable(assets.reference_counts(_t(spark, sf_dir, "events"), "user_id", _delta()))


@_query(f"""
WITH s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, user_id, date_trunc('milliseconds', ts) AS ms, {_DELTA} AS d FROM events)),
m AS (SELECT *, s - least(min(s) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING), 0) AS refs FROM s)
SELECT user_id, arg_max(refs, (ms, event_id))::BIGINT AS refs FROM m GROUP BY user_id HAVING arg_max(refs, (ms, event_id)) > 0
""")
def ref_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events replayed as a stream of managed users: who has references at the end."""
    schema = _t(spark, sf_dir, "events").schema
    # a pattern, since a stream takes a plain path for a folder
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("at", F.date_trunc("millisecond", "ts"))
    home = new_folder(spark, "ref-stream")
    managed.start(managed.managed_references(events, "user_id", "at", "event_id", _delta()), f"{home}/out", f"{home}/state").awaitTermination()
    return managed.tracked(managed.changes(spark, f"{home}/out")).select(F.col("path").alias("user_id"), "refs")


# volumes


@_query("SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v < 0.02::FLOAT THEN 0 ELSE 1 END) AS m FROM embeddings")
def volume_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", volumes.threshold(F.col("embedding"), 0.02).alias("m"))


@_query("SELECT vec_id, len(list_filter(embedding, lambda v: v >= 0.02::FLOAT))::BIGINT AS n FROM embeddings")
def volume_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", volumes.count_at_least(F.col("embedding"), 0.02).alias("n"))


@_query("SELECT vec_id, embedding[17:32] AS z1 FROM embeddings")
def volume_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", volumes.plane(F.col("embedding"), (4, 4, 4), 1).alias("z1"))


@_query("""
SELECT vec_id, ((i - 1) // 16)::INTEGER AS z, (((i - 1) // 4) % 4)::INTEGER AS y, ((i - 1) % 4)::INTEGER AS x, embedding[i] AS v
FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)
""")
def volume_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.voxels(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4))


@_query("""
SELECT vec_id, count(*)::BIGINT AS n, round(sum(v::DOUBLE), 4) AS total
FROM (SELECT vec_id, (i - 1) // 16 - 2 AS z, ((i - 1) // 4) % 4 - 2 AS y, (i - 1) % 4 - 2 AS x, embedding[i] AS v
      FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))
WHERE z * z + y * y + x * x <= 4 GROUP BY vec_id
""")
def sphere_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels of each 4 x 4 x 4 volume inside a sphere of radius 2 round its centre voxel."""
    inside = volumes.sphere_values(F.col("embedding"), (4, 4, 4), (2, 2, 2), 2)
    total = F.aggregate(inside, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.size(inside).cast("long").alias("n"), F.round(total, 4).alias("total"))


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of 64 planes, each an embedding of 8 x 8 values."""
    return _t(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("volume"), (F.col("vec_id") % 64).cast("int").alias("z"), F.col("embedding").alias("plane"))


@_query("SELECT vec_id, embedding AS plane FROM embeddings WHERE vec_id % 64 BETWEEN 3 AND 5")
def volume_file_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All volumes written to files, and three planes of each read back."""
    home = new_folder(spark, "volumes")
    volume_files.write_volumes(_planes(spark, sf_dir), home, 8, 8)
    read = volume_files.read_volumes(spark, home, 3, 5)
    return read.select((F.col("volume").cast("long") * 64 + F.col("z")).alias("vec_id"), "plane")


@_query("""
SELECT volume, count(*)::BIGINT AS n, round(sum(v::DOUBLE), 4) AS total
FROM (SELECT vec_id // 64 AS volume, vec_id % 64 AS z, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))
WHERE (z - 30) * (z - 30) + (y - 4) * (y - 4) + (x - 3) * (x - 3) <= 36 GROUP BY volume
""")
def volume_brick_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels inside a sphere, out of bricks of 4 x 4 x 4 in Morton order; bricks outside it are not read."""
    home = new_folder(spark, "bricks")
    bricks.write_bricks(bricks.to_bricks(_planes(spark, sf_dir), 8, 8, 4), home)
    inside = bricks.sphere_voxels(spark.read.parquet(home), (30, 4, 3), 6, 4)
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return inside.groupBy("volume").agg(F.sum(F.size("values")).cast("long").alias("n"), F.round(F.sum(total), 4).alias("total")).where("n > 0")


@_query("SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings")
def array_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", volumes.to_float64(F.col("embedding")).alias("e"))


# sources


@_query("SELECT event_id, -CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, lower(json_extract_string(props, '$.a')) AS a FROM events")
def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = metadata.map_metadata(F.col("props"), {"k": ("$.k", "int"), "a": ("$.a", "string")}, negate=("k",), lower=("a",))
    return _t(spark, sf_dir, "events").select("event_id", fields.alias("m")).select("event_id", "m.*")


@_query("SELECT doc_id, printf('map_%d_half_%d.map', doc_id, 2) AS l FROM documents")
def locator_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", metadata.locator("map_%d_half_%d.map", F.col("doc_id"), F.lit(2)).alias("l"))


@_query("SELECT page_id, strlen(html)::BIGINT AS n_bytes, sha256(html) AS digest FROM pages")
def gunzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page packed and unpacked again."""
    pack = F.pandas_udf(lambda pages: pages.map(lambda h: None if h is None else _gzip.compress(h.encode())), "binary")
    packed = _t(spark, sf_dir, "pages").select("page_id", pack("html").alias("html"))
    opened = metadata.gunzip(packed, "page_id", "html")
    return opened.select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), F.sha2("html", 256).alias("digest"))
