"""Graph operators against plain models on random graphs, and small fixtures with known answers."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tracegrove.operators import graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def bfs(pairs, roots, depth=None):
    out = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            out[a].add(b)
    seen, todo = {r: 0 for r in roots}, deque(roots)
    while todo:
        x = todo.popleft()
        if depth is not None and seen[x] == depth:
            continue
        for y in out[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def random_pairs(seed, n=14, m=22):
    rd = random.Random(seed)
    pairs = [(f"n{rd.randrange(n)}", f"n{rd.randrange(n)}") for _ in range(m)]
    return pairs + pairs[:3] + [(None, "n1"), ("n1", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable(spark, seed):
    pairs = random_pairs(seed)
    for depth in (None, 2):
        got = {r.id: r.depth for r in graph.reachable(frame(spark, pairs), ids(spark, ["n0", "n1", None]), depth).collect()}
        assert got == bfs(pairs, ["n0", "n1"], depth)


def test_hot_keys_are_spread_with_the_same_result(spark):
    pairs = [("hub", f"x{i}") for i in range(50)] + [("x1", "y"), ("z", "hub")]
    a = graph.Adjacency(frame(spark, pairs), hot=10)
    assert a.any_hot
    got = sorted(r.id for r in a.step(ids(spark, ["hub", "z"])).collect())
    assert got == sorted([f"x{i}" for i in range(50)] + ["hub"])


def test_shortest_path_is_the_smallest(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "z"), ("z", "c")]
    got = {r.id: (r.hops, r.path) for r in graph.shortest_paths(frame(spark, pairs), ids(spark, ["a"])).collect()}
    assert got["d"] == (3, ["a", "b", "c", "d"]) and got["a"] == (0, ["a"])
    assert "c" not in {r.id for r in graph.shortest_paths(frame(spark, pairs), ids(spark, ["a"]), 1).collect()}


def test_tree_marks_recursion(spark):
    rows = graph.dependency_tree(frame(spark, [("a", "b"), ("b", "a"), ("b", "c")]), ids(spark, ["a"]), 3).collect()
    assert sorted(("/".join(r.path), r.recursive) for r in rows) == [("a", False), ("a/b", False), ("a/b/a", True), ("a/b/c", False)]


def test_pagerank(spark):
    pairs = [(a, b) for a, b in random_pairs(5) if a and b]
    names = sorted({x for p in pairs for x in p} | {"alone"})
    rank = {r.id: r.rank for r in graph.pagerank(frame(spark, pairs), ids(spark, names), tolerance=1e-11, rounds=200).collect()}
    want, n = dict.fromkeys(names, 1 / len(names)), len(names)
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    for _ in range(200):
        new = dict.fromkeys(names, 0.15 / n + 0.85 * sum(want[x] for x in names if not out[x]) / n)
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * want[a] / len(bs)
        want = new
    assert abs(sum(rank.values()) - 1) < 1e-9
    assert all(abs(rank[x] - want[x]) < 1e-9 for x in names)
    assert graph.pagerank(frame(spark, []), ids(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_components(spark, seed):
    pairs = random_pairs(seed, 9, 13)
    good = [(a, b) for a, b in pairs if a and b]
    reach = {x: set(bfs(good, [x])) for x in {n for p in good for n in p}}
    again = {x: {y for a, b in good if a == x for y in bfs(good, [b])} for x in reach}
    want = {x: max(y for y in reach[x] if x in reach[y]) for x in reach if x in again[x]}
    assert {r.id: r.component for r in graph.components(frame(spark, pairs)).collect()} == want
    assert graph.components(frame(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_contract_degrees_budget(spark):
    e = frame(spark, [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("a", "c")])
    groups = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, group string")
    assert sorted((r.src, r.dst, r.weight) for r in graph.contract(e, groups).collect()) == [("x", "y", 2), ("y", "x", 1)]
    assert {r.id: r.degree for r in graph.degrees(e).collect()} == {"a": 6, "b": 3, "c": 1}
    rows = spark.createDataFrame([("a", 3), ("b", 3), ("c", 5), ("d", 1)], "id string, cost int")
    assert sorted(r.id for r in graph.budget_cut(rows.withColumn("one", F.lit(1)), ["id"], "cost", 7, "one").collect()) == ["a", "b"]


def test_a_search_for_one_node_stops_there(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(9)]
    got = {r.id: r.hops for r in graph.shortest_paths(frame(spark, pairs), ids(spark, ["n0"]), stop_at="n2").collect()}
    assert got == {"n0": 0, "n1": 1, "n2": 2}
    assert graph.shortest_paths(frame(spark, pairs), ids(spark, ["n0"]), stop_at="n0").count() == 1
