import pytest
from pyspark.sql import functions as F

from typeflow.operators import graph
from typeflow.plans import scopes
from typeflow.plans.defaults import default_registry
from typeflow.plans.planner import Context, NoPath, NodeNotFound, Resolve, resolve_params, shortest_path
from typeflow.plans.registry import CORE, Edge, Registry


def edges(*rows):
    return [Edge(a, b, w, m, k, F.lower) for k, (a, b, w, m) in enumerate(rows)]


def way(found):
    return [found[0].src, *[e.dst for e in found]]


SMALL = edges(("A", "B", 0, "m"), ("B", "C", 0, "m"), ("A", "Base", 1, "m"), ("D", "Base", 0, "m"), ("Base", "C", 0, "m"))


def test_paths_and_errors():
    assert way(shortest_path(SMALL, "A", "C")) == ["A", "B", "C"]
    assert way(shortest_path(SMALL, "A", "C", via="Base")) == ["A", "Base", "C"]
    with pytest.raises(NoPath):
        shortest_path(SMALL, "A", "D")
    with pytest.raises(NodeNotFound):
        shortest_path(SMALL, "A", "F")


def test_ties_follow_the_queue():
    def graph_of(depth):
        far = ".".join(["x"] * depth)
        return edges(("S", "B", 0, "y.z"), ("S", "C", 0, far), ("C", "B", 0, "here"))

    assert way(shortest_path(graph_of(5), "S", "B", caller="here")) == ["S", "C", "B"]
    assert way(shortest_path(graph_of(1), "S", "B", caller="here")) == ["S", "B"]


def test_local_and_deeper_scopes_win():
    rows = edges(("A", "B", 0, "other"), ("A", "B", 0, "other.foo"), ("A", "B", 0, "main"), ("A", "B", 0, "main.bar"))
    pick = lambda es: shortest_path(es, "A", "B", caller="main")[0].scope
    assert pick(rows[:2]) == "other.foo"
    assert pick(rows) == "main.bar"
    assert pick(edges(("A", "B", 0, "main2.x.y"), ("A", "B", 0, "main"))) == "main"  # a dotted prefix, not a text prefix


def test_registry_rules():
    r = Registry()
    r.declare("Base")
    r.declare("Sub", "Base")
    r.add("Sub", "Base", F.upper, "app")
    with pytest.warns(UserWarning):
        r.add("Sub", "Base", F.lower, "app")
    (kept,) = [e for e in r.edges() if (e.src, e.dst, e.scope) == ("Sub", "Base", "app")]
    assert kept.build is F.upper
    assert [(e.dst, e.weight) for e in r.edges() if e.src == "Sub" and e.scope == CORE] == [("Base", 1), ("object", 2)]
    r.lift("app", "app")
    with pytest.raises(ValueError):
        r.lift("app", "ap")


def test_scopes():
    assert scopes.expand("a.b.c") == {"a", "a.b", "a.b.c"}
    assert scopes.parent("m.f.<locals>.g") == "m.f"
    assert scopes.within("m.f", "m.<module>") and not scopes.within("m.f2", "m.f")
    assert scopes.visible(["a.b"], ["a.c", "a.b.d"]) == {"a", "a.b"}


def test_resolve_compiles_to_a_column(spark):
    registry = default_registry()
    registry.add("float", "int", lambda v: v.cast("int"), "app")
    outer, inner = Context(registry), Context(registry).inside("app")
    df = spark.range(1).select(F.lit(2.7).alias("x"), F.array(F.lit(1.5), F.lit(2.0)).alias("t"), F.lit(True).alias("b"), F.lit(None).cast("double").alias("n"))
    row = df.select(
        inner.resolve(F.col("x"), "float", "str", via="int").alias("a"),
        outer.resolve(F.col("t"), "tuple", "str").alias("b"),
        outer.resolve(F.col("b"), "bool", "param").alias("c"),
        outer.resolve(F.col("n"), "float", "str").alias("d"),
        outer.resolve(F.col("x"), "float", "float", via="int").alias("e"),
    ).first()
    assert (row.a, row.b, row.c.str_rep, row.d, row.e) == ("2", "1.5 2.0", "True", None, 2.7)
    with pytest.raises(NoPath):
        outer.plan("float", "int", via="str") if not any(e.dst == "int" and e.scope == CORE for e in registry.edges()) else None
        outer.plan("str", "tuple")
    assert "float -> str" in outer.describe("float", "str")

    @resolve_params(outer)
    def greet(name: Resolve("str"), mark="!"):
        return F.concat(name, F.lit(mark))

    assert df.select(greet((F.col("x"), "float")).alias("g")).first().g == "2.7!"


def test_declared_types_check_suffixes(spark):
    registry = default_registry()
    registry.declare("volume", suffix=".vol")
    context = Context(registry)
    df = spark.createDataFrame([("/a/b.vol",)], "p string")
    assert df.select(context.resolve(F.col("p"), "str", "volume").alias("v")).first().v == "/a/b.vol"
    with pytest.raises(Exception, match="expected a .vol file"):
        df.select(context.resolve(F.lit("/a/b.txt"), "str", "volume")).collect()


def test_graph_operators_agree_with_the_planner(spark):
    rows = [(e.src, e.dst, e.weight) for e in SMALL]
    paths = {r.node: (r.cost, r.path) for r in graph.shortest_paths(spark.createDataFrame(rows, "src string, dst string, weight long"), F.lit("A")).collect()}
    assert paths == {"A": (0, "A"), "B": (0, "A>B"), "C": (0, "A>B>C"), "Base": (1, "A>Base")}
    odd = spark.createDataFrame([("a>b", "c", 1)], "src string, dst string, weight long")
    (way_on,) = graph.paths_via(odd, F.lit("a>b"), F.lit("c")).collect()
    assert (way_on.node, way_on.cost, way_on.path) == ("c", 1, "a>b>c")


def test_ancestors_are_in_linear_order(spark):
    """Both forms of the closure against the order that Python gives classes with the same parents."""
    import random

    random.seed(11)
    made, parents = {"object": object}, {}
    for k in range(40):
        name = f"t{k}"
        chosen = random.sample(sorted(parents), min(len(parents), random.randrange(4)))
        try:
            made[name] = type(name, tuple(made[p] for p in chosen), {})
        except TypeError:  # no linear order
            chosen = []
            made[name] = type(name, (), {})
        parents[name] = chosen
    assert sum(len(ps) > 1 for ps in parents.values()) > 5
    want = {(name, c.__name__, k) for name, cls in made.items() for k, c in enumerate(cls.__mro__) if k}
    registry = Registry()
    for name, ps in parents.items():
        registry.declare(name, *ps)
    assert {(name, a, k) for name in parents for k, a in enumerate(registry.ancestors(name)) if k} == want
    rows = [(name, p, k) for name, ps in parents.items() for k, p in enumerate(ps or ["object"])]
    table = spark.createDataFrame(rows, "sub string, sup string, place int")
    assert {tuple(r) for r in graph.ancestors_closure(table, "place").collect()} == want
    with pytest.raises(ValueError, match="no linear order"):
        registry.declare("x", "t0", "t1")
        registry.declare("y", "t1", "t0")
        registry.declare("z", "x", "y")
        registry.ancestors("z")


def test_golden_conversion_graph(spark):
    """A graph of ten types whose best chain is known, by the planner and by joins."""
    # fixed values: origin, target and weight of the graph's edges, loops of a type to itself included
    links = [
        ("object", "str", 0), ("str", "str", 0), ("str", "object", 1), ("str", "FuncParam", 0), ("tuple", "str", 0), ("tuple", "object", 1),
        ("Path", "FuncParam", 0), ("Path", "PurePath", 1), ("Path", "object", 2), ("FuncParam", "FuncParam", 0), ("FuncParam", "object", 1),
        ("Proxy", "FuncParam", 0), ("Proxy", "object", 1), ("Output", "Volume", 0), ("Output", "Generic", 1), ("Output", "object", 2),
        ("Volume", "Volume", 0), ("Volume", "Proxy", 1), ("Volume", "object", 2),
    ]
    found = shortest_path(edges(*[(a, b, w, "m") for a, b, w in links]), "Output", "FuncParam")
    assert way(found) == ["Output", "Volume", "Proxy", "FuncParam"]
    table = spark.createDataFrame(links, "src string, dst string, weight long")
    (best,) = graph.shortest_paths(table, F.lit("Output")).where("node = 'FuncParam'").collect()
    assert (best.cost, best.hops, best.path) == (1, 3, "Output>Volume>Proxy>FuncParam")


def test_types_are_checked_at_both_ends(spark):
    registry = default_registry()
    registry.add("float", "int", lambda v: F.concat(F.lit("no number "), v.cast("string")), "faulty")
    row = spark.range(1).select(F.lit(1.5).alias("x"), F.lit("a").alias("s"), F.array(F.lit(True), F.lit(False)).alias("t"))
    with pytest.raises(Exception, match="value: float expected, not string"):
        row.select(Context(registry).resolve(F.col("s"), "float", "str")).collect()
    with pytest.raises(Exception, match="result: int expected, not string"):
        row.select(Context(registry).inside("faulty").resolve(F.col("x"), "float", "int")).collect()
    good = row.select(Context(registry).resolve(F.col("x"), "float", "str").alias("a"))
    assert good.first().a == "1.5" and "raise_error" not in good._jdf.queryExecution().optimizedPlan().toString()


def test_tuple_elements_keep_their_types(spark):
    context = Context(default_registry())
    row = spark.range(1).select(F.array(F.lit(True), F.lit(False)).alias("b"), F.array(F.lit(1), F.lit(2)).alias("i"), F.lit(2.5).alias("x"))
    got = row.select(
        context.resolve(F.col("b"), "tuple[bool]", "str").alias("b"),
        context.resolve(F.col("i"), "tuple[int]", "param").alias("i"),
        context.resolve([(F.lit(True), "bool"), (F.col("x"), "float"), (F.lit("a/b"), "path")], "tuple", "str").alias("m"),
    ).first()
    assert (got.b, got.i.str_rep, got.m) == ("True False", "1 2", "True 2.5 a/b")
