"""Closures that grow, and scopes of many callers, against the driver's own."""

import random

import pytest

from typeflow.functions.linear import linear_order
from typeflow.operators import graph
from typeflow.plans import scopes


def orders(parents):
    """The linear order of every type, or an error where parents contradict each other."""
    lines = {}

    def line(t):
        if t not in lines:
            above = [p for p in parents.get(t, ())]
            lines[t] = [t, *linear_order([*(line(p) for p in above), above])] if above else [t]
        return lines[t]

    for t in {*parents, *(p for ps in parents.values() for p in ps)}:
        line(t)
    return {(t, s, k) for t, x in lines.items() for k, s in enumerate(x) if k}


def frame(spark, parents):
    return spark.createDataFrame([(t, p, k) for t, ps in parents.items() for k, p in enumerate(ps)], "sub string, sup string, at int")


def test_closure_after_each_of_many_additions(spark):
    rng = random.Random(8)
    parents = {f"t{k}": [f"t{rng.randrange(k)}"] for k in range(1, 25)}
    closure = graph.ancestors_closure(frame(spark, parents), "at").checkpoint()
    assert {tuple(r) for r in closure.collect()} == orders(parents)
    made, number = 0, 25
    while made < 5:
        new = {t: list(ps) for t, ps in parents.items()}
        kind = rng.choice(["type", "type", "parent", "root"])
        if kind == "type":  # a new type of one to three parents
            changed = f"t{number}"
            new[changed] = rng.sample([f"t{k}" for k in range(number)], rng.randint(1, 3))
        elif kind == "parent":  # another parent of a type that has others below it
            k = rng.randrange(2, number)
            changed = f"t{k}"
            new[changed] = [*new.get(changed, []), rng.choice([f"t{j}" for j in range(k)])]
        else:  # a root gets a parent
            changed, new = "t0", new | {"t0": [f"r{number}"]}
        try:
            want = orders(new) if len(set(new[changed])) == len(new[changed]) else None
        except ValueError:
            want = None
        if want is None:
            continue
        parents, made, number = new, made + 1, number + (kind == "type")
        only = spark.createDataFrame([(changed,)], "sub string")
        touched = {r.sub for r in graph.types_below(closure, only).collect()}
        assert touched == {changed} | {t for t, s, _ in closure.collect() if s == changed}
        closure = graph.update_closure(closure, frame(spark, parents), only, "at").checkpoint()
        assert {tuple(r) for r in closure.collect()} == want


def test_parents_that_go_and_types_that_come_together(spark):
    parents = {"b": ["a"], "c": ["b"], "d": ["c"], "e": ["a"]}
    closure = graph.ancestors_closure(frame(spark, parents)).checkpoint()
    after = {"c": ["x"], "x": ["y"], "d": ["c"], "e": ["a"]}  # b has no parent now, c another one, which is new
    changed = spark.createDataFrame([("b",), ("c",), ("x",)], "sub string")
    got = graph.update_closure(closure, frame(spark, after), changed)
    assert {tuple(r) for r in got.collect()} == orders(after)
    none = spark.createDataFrame([], "sub string")
    assert {tuple(r) for r in graph.update_closure(closure, frame(spark, parents), none).collect()} == orders(parents)


@pytest.mark.parametrize("seed", range(2))
def test_scopes_of_many_callers(spark, seed):
    rng = random.Random(seed)
    name = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    seen = [(c, name()) for c in range(12) for _ in range(rng.randint(1, 4))] + [(12, "zz.a")]
    registered = [name() for _ in range(15)]
    got = graph.visible_to_callers(spark.createDataFrame(seen, "caller int, scope string"), spark.createDataFrame([(r,) for r in registered], "scope string"), "caller", "scope")
    want = {(c, v) for c in range(13) for v in scopes.visible([s for k, s in seen if k == c], registered)}
    assert {tuple(r) for r in got.collect()} == want
