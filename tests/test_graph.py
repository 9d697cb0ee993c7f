import random

import numpy as np
import pytest

from veyra.operators.graph import _relaxed, components, earliest_arrivals, hilbert, shortest_paths, simplify


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in list(root)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_shortest_paths_and_their_join_form(spark):
    rng = random.Random(3)
    e = [(rng.randrange(25), rng.randrange(25), rng.random() * 10) for _ in range(70)]
    d = {(i, i): 0.0 for i in range(25)}
    for a, b, c in e:
        d[a, b] = min(d.get((a, b), 1e9), c)
    for k in range(25):
        for i in range(25):
            for j in range(25):
                if (i, k) in d and (k, j) in d:
                    d[i, j] = min(d.get((i, j), 1e9), d[i, k] + d[k, j])
    src, edges = spark.createDataFrame([(0,), (7,), (99,)], "s long"), spark.createDataFrame(e, "a long, b long, c double")
    for got in (shortest_paths(src, edges, "s", "a", "b", "c", 12.0), _relaxed(src, edges, "s", "a", "b", "c", 12.0)):
        have = {(r.source, r.node): round(r.cost, 6) for r in got.collect()}
        assert have == {**{k: round(v, 6) for k, v in d.items() if k[0] in (0, 7) and v <= 12}, (99, 99): 0.0}


def test_earliest_arrivals(spark):
    st = spark.createDataFrame([(1, 1, 10, 100, 100), (1, 2, 11, 200, 210), (1, 3, 12, 400, 400), (2, 1, 11, 215, 220), (2, 2, 12, 300, 300), (3, 1, 12, 310, 320), (3, 2, 13, 330, 330)], "trip long, seq int, stop long, arrival long, departure long")
    src = spark.createDataFrame([(10,), (77,)], "source long")
    go = lambda **k: {(r.source, r.stop): (r.arrival, r.rides) for r in earliest_arrivals(src, st, 100, **k).collect()}
    assert go() == {(10, 10): (100, 0), (10, 11): (200, 1), (10, 12): (300, 2), (10, 13): (330, 3), (77, 77): (100, 0)}
    assert go(rides=1)[10, 12] == (400, 1) and go(slack=30)[10, 12] == (400, 1)


def test_lines_and_curves():
    p = np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0.0]])
    assert simplify(p, 0.1).tolist() == [0, 2, 3, 4] and simplify(p[:1], 1).tolist() == [0] and simplify(p[:0], 1).tolist() == []
    x, y = np.meshgrid(np.arange(8), np.arange(8))
    h = hilbert(x.ravel(), y.ravel(), 3)
    assert sorted(h) == list(range(64))
    o = np.argsort(h)
    assert (np.abs(np.diff(x.ravel()[o])) + np.abs(np.diff(y.ravel()[o])) == 1).all()
