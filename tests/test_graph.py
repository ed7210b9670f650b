"""Graph operators against plain searches, on graphs of awkward shapes."""

import math
import random
from collections import deque

import pytest

from auralake.operators import graph


def _components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _shapes():
    rng = random.Random(6)
    n = 300
    order = list(range(1, n))
    rng.shuffle(order)
    yield "chain from its end", [(0, n - 1), *[(i, i - 1) for i in range(2, n)]]
    yield "chain in any order", list(zip([0, *order], order, strict=False))
    yield "star about the largest", [(n, i) for i in range(n)]
    yield "sparse", [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
    yield "loops", [(i, i) for i in range(20)]
    yield "nothing", []


@pytest.mark.parametrize(("name", "edges"), list(_shapes()), ids=[n for n, _ in _shapes()])
def test_components_of_any_shape_take_few_rounds(spark, name, edges):
    nodes = sorted({n for e in edges for n in e} | {5000, 5001})
    rounds = []
    found = graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long"), rounds)
    assert {r.node: r.component for r in found.collect()} == _components(nodes, edges)
    assert len(rounds) <= math.log2(len(nodes)) + 2


def _graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def _search(edges, starts):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    hops, todo = dict.fromkeys(starts, 0), deque(starts)
    while todo:
        a = todo.popleft()
        for b in after.get(a, ()):
            if b not in hops:
                hops[b] = hops[a] + 1
                todo.append(b)
    return hops


def test_searches_from_many_starts_in_many_graphs(spark):
    scenes = {s: _graph(s, 40, 70) for s in range(3)}
    edges = spark.createDataFrame([(s, a, b) for s, own in scenes.items() for a, b in own], "scene long, src long, dst long")
    starts = [(s, k, (7 * k + s) % 40) for s in range(3) for k in range(5)] + [(0, 0, 39), (9, 1, 1)]
    found = graph.distances(edges, spark.createDataFrame(starts, "scene long, k long, node long"), ["scene"], ["k"]).collect()
    got = {}
    for r in found:
        assert got.setdefault((r.scene, r.k), {}).setdefault(r.node, (r.hops, r.parent)) == (r.hops, r.parent)
    for key in {s[:2] for s in starts}:
        own = scenes.get(key[0], [])
        want = _search(own, [n for s, k, n in starts if (s, k) == key])
        assert {n: h for n, (h, _) in got[key].items()} == want
        for node, (hops, parent) in got[key].items():
            before = [a for a, b in own if b == node and want.get(a) == hops - 1]
            assert parent == (min(before) if hops else None)


def test_paths_are_in_order(spark):
    chain = [(i, i + 1) for i in range(15)] + [(i + 1, i) for i in range(15)]
    edges = spark.createDataFrame([*chain, (100, 101)], "src long, dst long")
    tree = graph.distances(edges, spark.createDataFrame([(5,)], "node long"))
    found = graph.paths(tree, spark.createDataFrame([(n,) for n in (0, 5, 6, 14, 15, 100, 999)], "node long")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.place):
        got.setdefault(r.end, []).append(r.node)
    assert got == {0: [5, 4, 3, 2, 1, 0], 5: [5], 6: [5, 6], 14: list(range(5, 15)), 15: list(range(5, 16))}


def test_paths_of_many_searches(spark):
    own = _graph(4, 60, 120)
    edges = spark.createDataFrame([(s, a, b) for s in (0, 1) for a, b in own], "scene long, src long, dst long")
    tree = graph.distances(edges, spark.createDataFrame([(0, 3), (1, 8)], "scene long, node long"), ["scene"])
    ends = tree.select("scene", "node")
    steps = set(own)
    got = {}
    for r in graph.paths(tree, ends, ["scene"]).collect():
        got.setdefault((r.scene, r.end), {})[r.place] = r.node
    hops = {(r.scene, r.node): r.hops for r in tree.collect()}
    assert set(got) == set(hops)
    for (scene, end), path in got.items():
        nodes = [path[i] for i in range(hops[scene, end] + 1)]
        assert nodes[0] == (3, 8)[scene] and nodes[-1] == end and all(p in steps for p in zip(nodes, nodes[1:], strict=False))


def test_no_start_reaches_nothing(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    none = spark.createDataFrame([], "node long")
    assert graph.distances(edges, none).count() == 0
    assert graph.paths(graph.distances(edges, none), none).count() == 0
