"""Density clusters against the definition over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import density as D

SCHEMA = "id long, x array<double>"


def by_hand(xs, reach, neighbours, least):
    """Clusters as sets of rows, by components at every length that there is."""
    n = len(xs)
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, neighbours - 1] if n >= neighbours else np.full(n, np.inf)
    reachable = np.maximum(d, np.maximum(core[:, None], core[None]))
    lengths = sorted({w for w in reachable[np.triu_indices(n, 1)] if w <= reach})
    comp = {i: frozenset([i]) for i in range(n)}
    alive, tree, joined = {}, {}, {}  # component -> node; node -> [born, dies, children]; point -> (node, length)

    def rate(w):
        return 1 / max(w, reach * 1e-9)

    for w in lengths:
        old = dict(comp)
        for i, j in zip(*np.where(np.triu(reachable == w, 1))):
            if comp[i] != comp[j]:
                both = comp[i] | comp[j]
                for k in both:
                    comp[k] = both
        for new in set(comp.values()) - set(old.values()):
            parts = {old[k] for k in new}
            large = [alive.pop(p) for p in parts if p in alive]
            if len(large) == 1:
                node = large[0]
            elif len(new) >= least:
                node = len(tree)
                tree[node] = [w, None, large]
                for c in large:
                    tree[c][1] = w
            else:
                continue
            alive[new] = node
            for p in parts:
                for k in p:
                    if k not in joined:
                        joined[k] = (node, w)
    for node in alive.values():
        tree[node][1] = reach
    points = {node: {k: w for k, (at, w) in joined.items() if at == node} for node in tree}

    def under(node):
        return {k for c in tree[node][2] for k in set(points[c]) | under(c)}

    def best(node):
        born, dies, children = tree[node]
        own = sum(rate(max(w, born)) - rate(dies) for w in points[node].values()) + len(under(node)) * (rate(born) - rate(dies))
        rest = [best(c) for c in children]
        if not children or own >= sum(s for s, _ in rest):
            return own, [set(points[node]) | under(node)]
        return sum(s for s, _ in rest), [c for _, cs in rest for c in cs]

    return {frozenset(c) for node in alive.values() for c in best(node)[1]}


def found(spark, xs, *options):
    rows = [(i, x.tolist()) for i, x in enumerate(xs)]
    got = {}
    for r in D.density_clusters(spark.createDataFrame(rows, SCHEMA).repartition(5), *options).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert sum(map(len, got.values())) == len(xs)
    assert all(c == min(ids) for c, ids in got.items() if c != -1)
    return {frozenset(ids) for c, ids in got.items() if c != -1}


def planted(seed, d=2):
    r = np.random.default_rng(seed)
    centres = r.uniform(-8, 8, (4, d))
    return np.concatenate([c + r.normal(size=(n, d)) * s for c, n, s in zip(centres, (60, 40, 25, 50), (0.3, 0.6, 0.2, 0.4))] + [r.uniform(-12, 12, (40, d))]), centres


@pytest.mark.parametrize(("seed", "d", "options", "block"), [(2, 2, (1.5, 4, 8), 16), (3, 3, (6.0, 5, 12), 64)])
def test_equals_the_definition_over_all_pairs(spark, monkeypatch, seed, d, options, block):
    monkeypatch.setattr(D, "BLOCK", block)
    xs, _ = planted(seed, d)
    expected = by_hand(xs, *options)
    assert found(spark, xs, *options) == expected
    assert len(expected) > 1


def test_planted_clusters_and_outliers_are_found(spark):
    r = np.random.default_rng(5)
    centres = np.array([[0, 0], [10, 0], [0, 10]], float)
    xs = np.concatenate([c + r.normal(size=(50, 2)) * 0.3 for c in centres] + [np.array([[30, 30], [-30, 5], [5, -30]], float)])
    clusters = found(spark, xs, 3.0, 5, 10)
    assert len(clusters) == 3
    for k in range(3):
        own = set(range(50 * k, 50 * k + 50))
        assert max(len(own & c) for c in clusters) >= 45
    assert not {150, 151, 152} & set().union(*clusters)


def test_copies_missing_coordinates_and_empty_tables(spark):
    rows = [(i, [1.0, 1.0]) for i in range(12)] + [(20 + i, [5.0 + i % 2, 5.0]) for i in range(12)] + [(40, None), (41, [float("nan"), 0.0]), (42, [None, 0.0]), (43, [99.0, 99.0])]
    got = {r.id: r.cluster for r in D.density_clusters(spark.createDataFrame(rows, SCHEMA), 2.0, 4, 6).collect()}
    assert {got[i] for i in range(12)} == {0} and {got[i] for i in range(40, 44)} == {-1}
    assert D.density_clusters(spark.createDataFrame([], SCHEMA), 1.0).count() == 0
    assert {r.cluster for r in D.density_clusters(spark.createDataFrame([(1, [0.0]), (2, [9.0])], SCHEMA), 1.0).collect()} == {-1}


def test_a_crowded_cell_is_not_met_as_a_whole(spark, monkeypatch):
    """All points within one cell of the reach, some of them copies: few pairs are looked at, with the same distances."""
    met, meetings = [], D._meetings

    def seen(asking, points, *rest):
        met.append(asking.select("cell").join(points.select(F.col("cell").alias("cell")), "cell").count())
        return meetings(asking, points, *rest)

    monkeypatch.setattr(D, "_meetings", seen)
    monkeypatch.setattr(D, "BLOCK", 64)
    xs = np.random.default_rng(7).uniform(0, 0.99, (2000, 2))
    xs[1900:] = xs[1890]
    cores = D.core_distances(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], SCHEMA), 1.0, 5)
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2))
    expected = np.sort(d, 1)[:, 4]
    assert {r.id: r.core for r in cores.collect()} == dict(enumerate(expected.tolist()))
    edges = D.forest_edges(cores, 1.0).toPandas()
    w = np.maximum(d, np.maximum(expected[:, None], expected[None]))
    u, v = np.triu_indices(2000, 1)
    whole = np.sort(w[u, v][D.spanning_forest(u, v, w[u, v])])
    assert np.array_equal(np.sort(edges.w[D.spanning_forest(*(edges[c].to_numpy() for c in "uvw"))]), whole) and len(whole) == 1999
    assert sum(met) < 2000 * 2000 // 2
