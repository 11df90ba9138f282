"""Registered queries over whole tables against brute force in NumPy on the smallest tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from weftgraph.graph import Graph
from weftgraph.operators import components, ppr
from weftgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF).toPandas()


def dense(df, n, a="src", b="dst", v="weight", m=None):
    out = np.zeros((n, m or n))
    np.add.at(out, (df[a].to_numpy(), df[b].to_numpy()), df[v].to_numpy())
    return out


@pytest.fixture(scope="module")
def graph():
    """Adjacency, attributes and normalised adjacency of the catalogue's graph."""
    nodes = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    orders, n = pd.read_parquet(f"{SF}/orders.parquet"), len(nodes)
    u, v = orders.o_orderkey % n, orders.o_custkey % n
    a = np.zeros((n, n))
    a[u, v] = a[v, u] = 1
    np.fill_diagonal(a, 0)
    s = 1 / np.sqrt(a.sum(0) + 1)
    return a, np.array(nodes.embedding.tolist(), dtype=float), (a + np.eye(n)) * s[:, None] * s[None, :]


@pytest.fixture(scope="module")
def scores(graph):
    norm = graph[2]
    return 0.15 * np.linalg.inv(np.eye(len(norm)) - 0.85 * norm)


def largest(scores, k):
    kept = np.zeros_like(scores)
    for i, row in enumerate(scores):
        top = np.lexsort((np.arange(len(row)), -row.round(9)))[:k]
        kept[i, top] = row[top]
    return kept


def test_ppr_queries_equal_the_inverse(spark, graph, scores):
    n, top, d = len(scores), largest(scores, 16), graph[0].sum(1)
    assert np.allclose(dense(run(spark, "ppr_power_topk"), n), top, atol=2e-6)
    assert np.allclose(dense(run(spark, "gdc_edges"), n), top / top.sum(1, keepdims=True), atol=2e-6)
    assert run(spark, "ppr_missing_rows").empty
    some = np.outer(d > 0, d > 0)
    safe = np.where(d > 0, d, 1)
    assert np.allclose(dense(run(spark, "ppr_norm_sym"), n), scores * np.sqrt(safe)[:, None] / np.sqrt(safe) * some, atol=2e-6)
    assert np.allclose(dense(run(spark, "ppr_norm_col"), n), scores * safe[:, None] / safe * some, atol=2e-6)
    assert run(spark, "ppr_weighted_logits").id.nunique() == n


def test_larger_graphs_stay_off_the_driver(spark, monkeypatch):
    """Beyond max_edges no part of the graph is collected."""
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (0, 0, 0.5), (1, 1, 0.5)], "src long, dst long, weight double")
    monkeypatch.setattr(type(edges), "toPandas", lambda self: (_ for _ in ()).throw(AssertionError("collected")))
    got = {(r.src, r.dst): r.weight for r in ppr.power_rows(edges, spark.range(2), 0.2, 3, max_edges=3).collect()}
    assert np.isclose(sum(got.values()), 2 * (1 - 0.8**4)) and len(got) == 4


def test_power_rows_equal_the_joins(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(i) * 10, int(j) * 10): float(w) for i, j, w in zip(rng.integers(0, 9, 30), rng.integers(0, 9, 30), rng.random(30) / 3, strict=True)}
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in pairs.items()], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(i,) for i in (0, 10, 40, 77)], "id long")
    for k in (None, 3):
        want = ppr.power_series(edges, seeds, 0.2, 5) if k is None else ppr.top_k_rows(ppr.power_series(edges, seeds, 0.2, 5), k)
        for limit in (5_000_000, 2):
            got = ppr.power_rows(edges, seeds, 0.2, 5, k, max_edges=limit)  # rounds that are given stay
            assert np.allclose(dense(got.toPandas(), 100), dense(want.toPandas(), 100), atol=1e-12)


def test_scores_reach_their_tolerance(spark, graph):
    """The series of joins, the kernel and its acceleration against the inverse, for symmetric and row-normalised graphs."""
    rng = np.random.default_rng(4)
    n = 30
    a = np.triu(rng.random((n, n)) < 0.15, 1).astype(float)
    a += a.T + np.eye(n)
    s = 1 / np.sqrt(a.sum(0))
    for alpha in (0.15, 0.5):
        for matrix, symmetric in ((a * s[:, None] * s, True), (a / a.sum(1, keepdims=True), False)):
            edges = spark.createDataFrame([(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix), strict=True)], "src long, dst long, weight double")
            want = alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * matrix)
            got = ppr.power_rows(edges, spark.range(n), alpha, symmetric=symmetric, tolerance=1e-6)
            assert np.abs(dense(got.toPandas(), n) - want).max() <= 1e-6
    joins = ppr.power_series(edges, spark.range(3), 0.5, tolerance=1e-3)
    assert np.abs(dense(joins.toPandas(), n)[:3] - want[:3]).sum(1).max() <= 1e-3
    assert len(ppr.chebyshev_factors(0.15, 1e-6)) < ppr.rounds_for(0.15, 1e-6) / 3


def test_scores_of_a_long_path_lose_no_row(spark):
    """Nodes further away than the rounds that the tolerance takes have positive scores too, and a node without edges its own."""
    n = 60
    a = np.eye(n) + np.eye(n, k=1) + np.eye(n, k=-1)
    s = 1 / np.sqrt(a.sum(0))
    matrix = a * s[:, None] * s
    edges = spark.createDataFrame([(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix), strict=True)], "src long, dst long, weight double")
    got = ppr.power_rows(edges, spark.range(n + 1), 0.15, symmetric=True, tolerance=1e-10).toPandas()
    assert len(got) == n * n + 1 and (got.weight > 0).all()
    want = 0.15 * np.linalg.inv(np.eye(n) - 0.85 * matrix)
    assert np.abs(dense(got, n + 1)[:n, :n] - want).max() <= 1e-10
    top = ppr.power_rows(edges, spark.range(n), 0.15, k=50, digits=9, symmetric=True, tolerance=1e-10).toPandas()
    assert np.allclose(dense(top, n), largest(want, 50), atol=1e-10) and (top.groupby("src").size() == 50).all()


def test_exact_scores_take_as_few_products_as_the_graph_allows(monkeypatch):
    rng, n = np.random.default_rng(8), 400
    a = np.triu(rng.random((n, n)) < 0.3, 1)
    a = a + a.T + np.eye(n)
    s = 1 / np.sqrt(a.sum(0))
    matrix = a * s[:, None] * s
    rows, columns = np.nonzero(matrix)
    kinds, times = [], ppr._Hops.times
    monkeypatch.setattr(ppr._Hops, "times", lambda self, x, out: kinds.append(x.dtype.itemsize) or times(self, x, out))
    hops = ppr._Hops(np.searchsorted(rows, np.arange(n + 1)), columns, 0.85 * matrix[rows, columns])
    got = ppr._solved(hops, np.arange(n), n, 0.15, 1e-10, 86)
    assert np.abs(got - 0.15 * np.linalg.inv(np.eye(n) - 0.85 * matrix)).max() <= 1e-10
    assert len(kinds) < 14 and kinds.count(8) < 7  # 43 in double precision before


def neighbour_weights(spark, n):
    return dense(catalogue.weighted_view(spark, SF).toPandas(), n)


def medoids(weights, x, temperature=None):
    out = {}
    for i, row in enumerate(weights):
        near = np.flatnonzero(row)
        if len(near):
            cost = np.linalg.norm(x[near][:, None] - x[near][None], axis=2) @ row[near]
            w = np.eye(len(near))[cost.round(9).argmin()] if temperature is None else np.exp((cost.min() - cost) / temperature)
            out[i] = row.sum() * (w / w.sum()) @ x[near]
    return out


@pytest.mark.parametrize(("name", "temperature"), [("medoid", None), ("soft_medoid", 1.0)])
def test_medoids_see_all_neighbours(spark, graph, name, temperature):
    got = run(spark, name)
    x = graph[1][:, : got.k.max() + 1]
    want = medoids(neighbour_weights(spark, len(x)), x, temperature)
    found = dense(got, len(x), "id", "k", "v", x.shape[1])
    assert set(got.id) == set(want) and all(np.allclose(found[i], v, atol=2e-6) for i, v in want.items())


def test_attribute_queries_read_all_columns(spark, graph):
    a, x, norm = graph
    n, m = x.shape
    weights = neighbour_weights(spark, n)
    assert np.allclose(dense(run(spark, "sgc_two_hop"), n, "id", "k", "v", m), norm @ norm @ x, atol=2e-6)
    w1 = (np.cos(np.arange(m)[:, None] * 3 + np.arange(6) * 7) / 4).round(6)
    w2 = (np.sin(np.arange(6)[:, None] * 5 + np.arange(10) * 2) / 2).round(6)
    assert np.allclose(dense(run(spark, "gcn_forward"), n, "id", "k", "z", 10), norm @ np.maximum(norm @ x @ w1, 0) @ w2, atol=2e-6)
    median = np.zeros_like(x)
    for i, row in enumerate(weights):
        near = np.flatnonzero(row)
        for k in range(m if len(near) else 0):
            order = near[np.lexsort((near, x[near, k]))]
            median[i, k] = row.sum() * x[order[np.argmax(2 * row[order].cumsum() >= row.sum() - 1e-12)], k]
    assert np.allclose(dense(run(spark, "dimwise_median"), n, "id", "k", "v", m), median, atol=2e-6)
    got = run(spark, "pairwise_distance_topk")
    assert np.allclose(got.dist, np.linalg.norm(x[got.j] - x[got.m], axis=1), atol=2e-6)
    for name in ("medoid", "k_medoid", "soft_medoid", "soft_k_medoid", "soft_median"):
        assert set(run(spark, name).k) == set(range(m)), name
    assert catalogue.surrogate().weight.shape[0] == m


def test_components_two_hops_and_scores_cover_the_graph(spark, graph):
    a, x, norm = graph
    n, comp = len(a), np.arange(len(a))
    for _ in range(n):
        low = np.minimum(comp, np.where(a > 0, comp[None], n).min(1))
        if (low == comp).all():
            break
        comp = low
    ids, sizes = np.unique(comp, return_counts=True)
    assert dict(run(spark, "component_sizes").itertuples(index=False)) == dict(zip(ids, sizes, strict=True))
    inside = comp == ids[sizes.argmax()]
    assert len(run(spark, "largest_component")) == a[np.ix_(inside, inside)].sum()
    assert np.allclose(dense(run(spark, "two_hop_weights"), n), norm @ norm, atol=2e-6)
    h = x @ catalogue.surrogate().weight
    label = pd.read_parquet(f"{SF}/embeddings.parquet").set_index("vec_id").label[3]
    got = run(spark, "nettack_struct_score").set_index("dst").score
    assert set(got.index) == set(range(n)) - {3}
    for v in got.index:
        b = a + np.eye(n)
        b[3, v] = b[v, 3] = 1 - b[3, v]
        s = 1 / np.sqrt(b.sum(0))
        z = ((b[3] * s[3] * s) @ (b * s[:, None] * s)) @ h
        assert abs(got[v] - (z[label] - np.delete(z, label).max())) < 1e-5


def test_several_components(spark):
    edges = spark.createDataFrame([(i, j, 1.0) for p, q in [(0, 1), (1, 2), (4, 5), (6, 7), (7, 8), (8, 9)] for i, j in ((p, q), (q, p))], "src long, dst long, weight double")
    nodes = spark.range(10)
    assert dict(components.component_sizes(components.components(nodes, edges)).toPandas().itertuples(index=False)) == {0: 3, 3: 1, 4: 2, 6: 4}
    assert components.largest_components(Graph(edges, nodes)).edges.count() == 6
