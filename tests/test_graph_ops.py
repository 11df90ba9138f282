"""Graph operators against hand-computed values, dense algebra and invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import ACTIVATIONS, clamp, close, distance, uniform
from weftgraph.graph import Graph, long_form
from weftgraph.operators import attacks, components, losses, models, normalize, ppr, propagate, reshape, robust

X = {0: [-10.0, 10.0, 10.0], 1: [-1.0, 1.0, 1.0], 2: [0.0, 0.0, 0.0], 3: [10.0, -10.0, -10.0]}
A = {(0, 0): 0.5, (0, 1): 0.3, (0, 3): 0.4, (1, 0): 0.3, (1, 1): 0.2, (2, 2): 0.9, (2, 3): 0.3, (3, 0): 0.4, (3, 2): 0.4, (3, 3): 0.4}
SUMS = {0: 1.2, 1: 0.5, 2: 1.2, 3: 1.2}


def edges_of(spark, weights):
    return spark.createDataFrame([(int(i), int(j), float(w)) for (i, j), w in weights.items()], "src long, dst long, weight double")


def nodes_of(spark, x, labels=None):
    return spark.createDataFrame([(i, v, (labels or {}).get(i, 0)) for i, v in x.items()], "id long, attr array<double>, label int")


def matrix(df, n, a="src", b="dst", v="weight", m=None):
    out = np.zeros((n, m or n))
    for r in df.collect():
        out[r[a], r[b]] += r[v]
    return out


def rows_equal(got, want):
    found = matrix(got, 4, "id", "k", "v", 3)
    for i, j in want.items():
        options = [np.array(X[k]) * SUMS[i] for k in (j if isinstance(j, tuple) else (j,))]
        assert any(np.allclose(found[i], o, atol=1e-6) for o in options), (i, found[i], options)


@pytest.fixture(scope="module")
def f1(spark):
    edges, nodes = edges_of(spark, A).cache(), nodes_of(spark, X).cache()
    return edges, nodes, long_form(nodes).cache()


def test_top_k(spark, f1):
    edges, nodes, _ = f1
    got = {(r.src, r.rnk): (r.dst, r.weight) for r in robust.top_k(edges, 2).collect()}
    assert [got[0, 1], got[0, 2], got[1, 1], got[1, 2], got[2, 1], got[2, 2]] == [(0, 0.5), (3, 0.4), (0, 0.3), (1, 0.2), (2, 0.9), (3, 0.3)]
    padded = {(r.src, r.rnk): (r.dst, r.weight) for r in robust.top_k_padded(nodes, edges, 3).collect()}
    assert padded[1, 3] == (-1, 0.0) and padded[0, 3] == (1, 0.3) and len(padded) == 12


def test_medoids_and_medians(f1):
    edges, nodes, x = f1
    rows_equal(robust.medoid(edges, nodes), {0: 1, 1: 0, 2: 2, 3: 2})
    rows_equal(robust.soft_medoid(edges, nodes, 1e-3), {0: 1, 1: 0, 2: 2, 3: 2})
    rows_equal(robust.k_medoid(edges, nodes, 2), {0: 0, 1: 0, 2: 2, 3: (0, 2, 3)})
    rows_equal(robust.k_medoid(edges, nodes, 3), {0: 1, 1: 0, 2: 2, 3: 2})
    rows_equal(robust.soft_k_medoid(edges, nodes, 3, 1e-3), {0: 1, 1: 0, 2: 2, 3: 2})
    rows_equal(robust.dimwise_median(edges, x), {0: 1, 1: 0, 2: 2, 3: 2})
    rows_equal(robust.soft_median(edges, nodes, x, 1e-3), {0: 1, 1: 0, 2: 2, 3: 2})
    for name, f in robust.ROBUST_MEANS.items():
        assert f(edges, nodes, x, k=3, temperature=1.0).count() == 12, name


def test_unweighted_variants_and_disconnected_row(spark):
    ones = edges_of(spark, {(i, j): 1.0 for i, js in {0: (0, 1, 3), 1: (0, 1), 2: (2, 3), 3: (0, 2, 3)}.items() for j in js})
    nodes = nodes_of(spark, X)
    got = matrix(robust.soft_medoid(ones, nodes, 1e-3), 4, "id", "k", "v", 3)
    assert np.allclose(got[0], 3 * np.array(X[1]), atol=1e-5) and np.allclose(got[1], np.array(X[0]) + X[1], atol=1e-5) and np.allclose(got[2], np.array(X[2]) + X[3], atol=1e-5)
    lone = edges_of(spark, {(0, 0): 0.5, (0, 1): 0.3, (0, 3): 0.3, (1, 0): 0.3, (1, 1): 0.2, (2, 2): 0.9})
    got = matrix(robust.soft_k_medoid(lone, nodes, 2, 1e-3), 4, "id", "k", "v", 3)
    assert np.allclose(got[0], 1.1 * np.array(X[0])) and np.allclose(got[1], 0.5 * np.array(X[0])) and not got[3].any()


def test_median_of_mixed_coordinates(spark):
    x = {0: [-10.0, 10.0, 10.0], 1: [-1.0, 1.0, 0.0], 2: [0.0, 0.0, 1.0], 3: [10.0, -10.0, -10.0]}
    ones = edges_of(spark, {(i, j): 1.0 for i, js in {0: (0, 1, 3), 3: (1, 2, 3)}.items() for j in js})
    got = matrix(robust.dimwise_median(ones, long_form(nodes_of(spark, x))), 4, "id", "k", "v", 3)
    assert np.allclose(got[0] / 3, [-1, 1, 0]) and np.allclose(got[3] / 3, [0, 0, 0])


def test_reshaping(spark):
    e = edges_of(spark, {(0, 1): 2.0, (1, 0): 2.0, (1, 1): 1.0, (2, 0): 3.0})
    und = reshape.to_undirected(e)
    assert matrix(und, 3).tolist() == [[0, 2, 3], [2, 1, 0], [3, 0, 0]]
    with pytest.raises(ValueError):
        reshape.to_undirected(edges_of(spark, {(0, 1): 1.0, (1, 0): 2.0}))
    nodes = nodes_of(spark, {i: [1.0] for i in range(3)})
    s = reshape.stats(Graph(e, nodes)).first()
    assert (s.n_nodes, s.n_edges, s.directed, s.weighted, s.self_loops) == (3, 4, True, True, True)
    s = reshape.stats(Graph(e.limit(0), nodes)).first()
    assert (s.n_nodes, s.n_edges, s.directed, s.weighted, s.self_loops) == (3, 0, False, False, False)
    sub = reshape.induced_subgraph(Graph(und, nodes), remove=spark.createDataFrame([(1,)], "id long"))
    assert matrix(sub.edges, 2).tolist() == [[0, 3], [3, 0]]
    with pytest.raises(ValueError):
        reshape.induced_subgraph(Graph(und, nodes))
    with pytest.raises(ValueError):
        Graph(nodes, nodes)
    lists = spark.createDataFrame([(0, [1, 2], [0.5, 0.25])], "src long, neighbors array<long>, weights array<double>")
    assert matrix(reshape.neighbor_lists(lists), 3)[0].tolist() == [0, 0.5, 0.25]
    ptr = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 3)], "pos long, ptr long")
    val = spark.createDataFrame([(0, 1, 5.0), (1, 2, 6.0), (2, 0, 7.0)], "pos long, idx long, v double")
    assert matrix(reshape.csr_to_coo(ptr, val), 3).tolist() == [[0, 5, 6], [0, 0, 0], [7, 0, 0]]


@pytest.mark.parametrize("n", [2, 3, 5, 50, 111_059_956])
def test_triu_pairs_are_exact(spark, n):
    pairs = n * (n - 1) // 2
    lins = range(pairs) if n < 100 else [0, 1, n - 2, n - 1, pairs // 3, pairs - 1, *(i * (2 * n - i - 1) // 2 + o for i in (1, 10**5, 10**7, n - 3) for o in (-1, 0))]
    i, j = reshape.triu_pair(n, F.col("lin"))
    for r in spark.createDataFrame([(x,) for x in lins], "lin long").select("lin", i.alias("i"), j.alias("j")).collect():
        assert 0 <= r.i < r.j < n and r.i * (2 * n - r.i - 1) // 2 + r.j - r.i - 1 == r.lin
    row, col = reshape.full_pair(7, F.lit(23))
    assert tuple(spark.range(1).select(row, col).first()) == (3, 2)


def test_components_on_a_path_and_alone(spark):
    e = edges_of(spark, {(i, i + 1): 1.0 for i in range(30) if i != 10})
    nodes = nodes_of(spark, {i: [0.0] for i in range(33)})
    got = {r.id: r.comp for r in components.components(nodes, e).collect()}
    assert all(got[i] == (0 if i <= 10 else 11 if i <= 30 else i) for i in range(33))
    std = components.standardize(Graph(e, nodes))
    assert std.nodes.count() == 20 and std.edges.count() == 38
    with pytest.raises(ValueError):
        components.split_per_class(nodes, 20)


def random_graph(spark, n, p, seed):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) < p, 1).astype(float)
    a += a.T
    x = rng.normal(size=(n, 5))
    labels = {i: int(c) for i, c in enumerate(rng.integers(0, 3, n))}
    edges = edges_of(spark, {(i, j): 1.0 for i, j in zip(*np.nonzero(a), strict=True)})
    return a, x, labels, edges.cache(), nodes_of(spark, {i: v.tolist() for i, v in enumerate(x)}, labels).cache()


def dense_norm(a):
    full = a + np.diag((np.diag(a) == 0).astype(float))
    s = 1 / np.sqrt(full.sum(0))
    return full * s[:, None] * s[None, :]


def test_ppr_series_push_and_updates(spark):
    a, _, _, edges, nodes = random_graph(spark, 12, 0.4, 3)
    alpha, walk = 0.3, a / a.sum(1, keepdims=True)
    exact = alpha * np.linalg.inv(np.eye(12) - (1 - alpha) * walk)
    series = ppr.power_series(normalize.row(edges), nodes, alpha, 40).cache()
    assert np.allclose(matrix(series, 12), exact, atol=1e-5)
    pushed = ppr.push(edges, nodes, alpha, 1e-6)
    assert np.allclose(matrix(pushed, 12), exact, atol=1e-5)
    assert ppr.push(edges, nodes, alpha, 1e-4, 3).groupBy("src").count().filter("count > 3").isEmpty()
    p = np.zeros(12)
    p[[1, 4, 7]] = 0.3
    i = 2
    row = edges.filter("src = 2").select("dst", "weight")
    change = spark.createDataFrame([(j, 0.3) for j in (1, 4, 7)], "dst long, p double")
    new = a.copy()
    new[i] = np.where(a[i] + p > 1, 2 - a[i] - p, a[i] + p)
    again = alpha * np.linalg.inv(np.eye(12) - (1 - alpha) * new / new.sum(1, keepdims=True))
    got = np.zeros(12)
    for r in ppr.update_row(series, row, change, i, alpha).collect():
        got[r.dst] = r.weight
    assert np.allclose(got, again[i], atol=1e-5)
    assert np.allclose(matrix(ppr.update_all(series, row, change, i, alpha), 12), again, atol=1e-5)
    # Several rows at once, some rows only, and the largest entries without the whole product.
    more = spark.createDataFrame([(2, 1, 0.3), (2, 4, 1.0), (5, 0, 1.0), (5, 2, 0.5), (9, 11, 1.0)], "src long, dst long, p double")
    many = a.copy()
    for r in more.collect():
        w = a[r.src, r.dst] + r.p
        many[r.src, r.dst] = 2 - w if w > 1 else w
    sums = many.sum(1, keepdims=True)
    again = alpha * np.linalg.inv(np.eye(12) - (1 - alpha) * many / np.where(sums > 0, sums, 1))
    assert np.allclose(matrix(ppr.update_block(series, edges, more, alpha), 12), again, atol=1e-5)
    some = matrix(ppr.update_block(series, edges, more, alpha, rows=spark.createDataFrame([(3,), (5,)], "id long"), k=4), 12)
    for i in (3, 5):
        best = np.argsort(-again[i])[:4]
        assert np.allclose(some[i][best], again[i][best], atol=1e-5) and (some[i] > 0).sum() == 4
    sparse = ppr.update_block(series, edges, change.select(F.lit(2).cast("long").alias("src"), "dst", "p"), alpha, k=3)
    one = alpha * np.linalg.inv(np.eye(12) - (1 - alpha) * new / new.sum(1, keepdims=True))
    assert np.allclose(np.sort(matrix(sparse, 12), 1)[:, -3:], np.sort(one, 1)[:, -3:], atol=1e-5)
    sym = matrix(ppr.normalized(series, normalize.degree(edges), "sym"), 12)
    d = a.sum(1)
    assert np.allclose(sym, exact * np.sqrt(d)[:, None] / np.sqrt(d)[None, :], atol=1e-5)
    g = matrix(ppr.gdc(normalize.gcn(edges, nodes), nodes, 0.15, 4, 6), 12)
    assert np.allclose(g.sum(1), 1) and ((g > 0).sum(1) <= 4).all()
    parts = [series.filter("src < 4"), series.filter("src < 8").withColumn("weight", F.lit(0.0))]
    merged = matrix(ppr.merge_parts(parts), 12)
    assert np.allclose(merged[:4], exact[:4], atol=1e-5) and not merged[4:].any()


def test_edge_gradient_equals_central_differences(spark):
    a, x, labels, edges, nodes = random_graph(spark, 10, 0.4, 5)
    w = np.random.default_rng(1).normal(size=(5, 3))
    y = np.array([labels[i] for i in range(10)])
    pairs = [(0, 1), (2, 9), (3, 4), (5, 8)]

    def loss(m, name):
        z = dense_norm(m) @ (dense_norm(m) @ (x @ w))
        z = z - z.max(1, keepdims=True)
        lp = z - np.log(np.exp(z).sum(1, keepdims=True))
        own = z[np.arange(10), y]
        other = np.where(np.eye(3)[y] == 1, -np.inf, z).max(1)
        return {"CE": -lp[np.arange(10), y].mean(), "Margin": (other - own).mean(), "tanhMargin": np.tanh(other - own).mean()}[name]

    block = spark.createDataFrame(pairs, "src long, dst long")
    for name in ("CE", "Margin", "tanhMargin"):
        got = {(r.src, r.dst): r.grad for r in attacks.edge_gradient(edges, nodes, attacks.Linear2(w), nodes, block, name).collect()}
        for i, j in pairs:
            hi, lo = a.copy(), a.copy()
            for m, step in ((hi, 1e-5), (lo, -1e-5)):
                m[i, j] += step
                m[j, i] += step
            assert got[i, j] == pytest.approx((loss(hi, name) - loss(lo, name)) / 2e-5, abs=1e-6)


def test_attacks_keep_their_budget_and_hurt(spark):
    a, x, labels, edges, nodes = random_graph(spark, 14, 0.3, 8)
    w = np.random.default_rng(2).normal(size=(5, 3))
    model = attacks.Linear2(w)
    before = attacks._loss(edges, nodes, model, nodes, "CE")
    runs = {
        "greedy": attacks.greedy_rbcd(edges, nodes, model, nodes, 4, 2, 60),
        "prbcd": attacks.prbcd(edges, nodes, model, nodes, 4, 2, 1, 60, 10.0, samples=2),
        "fgsm": attacks.fgsm(edges, nodes, model, nodes, 2),
    }
    for name, run in runs.items():
        pairs = {(r.src, r.dst) for r in run.pairs.collect()}
        new = matrix(run.edges, 14)
        assert 0 < len(pairs) <= 4 and np.allclose(new, new.T), name
        flipped = {(i, j) for i in range(14) for j in range(i + 1, 14) if abs(new[i, j] - a[i, j]) > 0.5}
        assert flipped == pairs, name
        assert attacks._loss(run.edges, nodes, model, nodes, "CE") > before, name


def test_nettack_scores_equal_brute_force(spark):
    a, x, labels, edges, nodes = random_graph(spark, 14, 0.4, 9)
    w = np.random.default_rng(4).normal(size=(5, 3))
    cand = nodes.filter("id <> 3").select(F.lit(3).cast("long").alias("src"), F.col("id").alias("dst"))
    got = {r.dst: r.score for r in attacks.struct_scores(edges, nodes, attacks.Linear2(w), 3, cand).collect()}
    for v in range(14):
        if v == 3:
            continue
        m = a.copy()
        m[3, v] = m[v, 3] = 1 - m[3, v]
        z = (dense_norm(m) @ dense_norm(m) @ x @ w)[3]
        assert got[v] == pytest.approx(z[labels[3]] - max(z[c] for c in range(3) if c != labels[3]))
    run = attacks.nettack(edges, nodes, attacks.Linear2(w), 3, 1, cutoff=10.0)
    assert run.pairs.count() == 1 and (matrix(run.edges, 14).sum(1) > 0).all()
    assert attacks.sga(edges, nodes, attacks.Linear2(w), 3, 1).pairs.count() == 1

    def margin(m, x):
        z = (dense_norm(m) @ dense_norm(m) @ x @ w)[3]
        return z[labels[3]] - max(z[c] for c in range(3) if c != labels[3])

    def flipped(i, v):
        m = a.copy()
        m[i, v] = m[v, i] = 1 - m[i, v]
        return m

    # Indirect flips, in and out of the node's reach, and the neighbours without which the margin is least.
    every = attacks.indirect_candidates(nodes, 3, [i for i in range(14) if i != 3])
    scores = {(r.src, r.dst): r.score for r in attacks.struct_scores(edges, nodes, attacks.Linear2(w), 3, every).collect()}
    assert len(scores) == 13 * 12 and all(s == pytest.approx(margin(flipped(i, v), x)) for (i, v), s in scores.items())
    near = sorted((margin(flipped(3, v), x), v) for v in np.flatnonzero(a[3]))
    assert [r.id for r in attacks.influencers(edges, nodes, attacks.Linear2(w), 3, 2).collect()] == [v for _, v in near[:2]]
    turned = x * (np.arange(5) % 2)
    zeros = nodes_of(spark, {i: v.tolist() for i, v in enumerate(turned)}, {i: int(labels[i]) for i in range(14)})
    found = attacks.feature_scores(edges, zeros, attacks.Linear2(w), 3, nodes.filter("id % 2 = 1")).collect()
    assert len(found) == 7 * 5
    for r in found:
        other = turned.copy()
        other[r.id, r.k] = 0.0 if other[r.id, r.k] else 1.0
        assert r.score == pytest.approx(margin(a, other))
    run = attacks.nettack(edges, nodes, attacks.Linear2(w), 3, 1, cutoff=100.0, direct=False, n_influencers=2)
    step = run.trace[0]
    assert step["src"] in {v for _, v in near[:2]} and step["margin"] == pytest.approx(min(s for (i, _), s in scores.items() if i in {v for _, v in near[:2]}))
    run = attacks.nettack(edges, zeros, attacks.Linear2(w), 3, 2, structure=False, features=True)
    assert [set(t) for t in run.trace] == [{"id", "k", "margin"}] * 2 and run.pairs.isEmpty() and run.trace[0]["margin"] <= min(r.score for r in found if r.id == 3) + 1e-9
    assert attacks.create_attack("PRBCD") is attacks.prbcd
    with pytest.raises(ValueError):
        attacks.create_attack("none")


def test_projection_meets_the_budget(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(0.6, 0.5, 200)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id long, p double")
    got = np.array([r.p for r in attacks.project(df, 30, 1e-7).orderBy("id").collect()])
    assert got.sum() == pytest.approx(30, abs=1e-3) and got.min() >= 1e-7 and got.max() <= 1 - 1e-7
    free = np.array([r.p for r in attacks.project(df, 500, 0.0).orderBy("id").collect()])
    assert np.allclose(free, np.clip(p, 0, 1))


def test_losses_by_hand(spark):
    z = np.array([[2.0, 1.0, 0.0], [0.0, 3.0, 1.0], [1.0, 1.5, 4.0]])
    y = [0, 2, 2]
    logits = spark.createDataFrame([(i, c, float(z[i, c])) for i in range(3) for c in range(3)], "id long, class int, z double")
    labels = spark.createDataFrame(list(enumerate(y)), "id long, label int")
    m = np.array([1.0, -2.0, 2.5])
    ce = np.log(np.exp(z).sum(1)) - z[np.arange(3), y]
    want = {
        "CW": -np.maximum(m, 0).mean(),
        "LCW": -np.where(m >= 0, m, 0.1 * m).mean(),
        "Margin": -m.mean(),
        "tanhMargin": np.tanh(-m).mean(),
        "tanhMarginCW-0.25": (0.25 * np.tanh(-m) - 0.75 * np.maximum(m, 0)).mean(),
        "tanhMarginMCE-0.25": 0.25 * np.tanh(-m).mean() + 0.75 * ce[[0, 2]].mean(),
        "eluMargin": -np.where(m > 0, m, np.exp(m) - 1).mean(),
        "MCE": ce[[0, 2]].mean(),
        "NCE": -(np.log(np.exp(z).sum(1)) - np.array([1.0, 3.0, 1.5])).mean(),
        "CE": ce.mean(),
    }
    for name, value in want.items():
        assert losses.loss(logits, labels, name).first().loss == pytest.approx(value), name
    assert losses.accuracy(logits, labels).first().accuracy == pytest.approx(2 / 3)
    hist = losses.margin_histogram(losses.classification_statistics(logits, labels)).orderBy("bin").collect()
    assert sum(r.n for r in hist) == 3 and hist[-1].cumulative == 1.0


def test_gcn_sgc_and_training(spark):
    a, x, labels, edges, nodes = random_graph(spark, 60, 0.1, 12)
    rng = np.random.default_rng(3)
    w1, w2 = rng.normal(size=(5, 4)), rng.normal(size=(4, 3))

    def frame(w):
        return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])], "k int, h int, w double")

    norm = normalize.gcn(edges, nodes)
    z = matrix(models.gcn_forward(norm, long_form(nodes), [(frame(w1), None), (frame(w2), None)]), 60, "id", "k", "v", 3)
    assert np.allclose(z, dense_norm(a) @ np.maximum(dense_norm(a) @ (x @ w1), 0) @ w2)
    r = models.rgnn_forward(norm, nodes, [(frame(w1), None), (frame(w2), None)], "soft_median", temperature=1.0)
    assert r.count() == 180
    dense = models.dense_gcn_forward(edges, nodes, long_form(nodes), [(frame(w1), None), (frame(w2), None)])
    assert dense.groupBy("id").agg(F.sum(F.exp("v")).alias("s")).filter("abs(s - 1) > 1e-9").isEmpty()
    g = models.rgcn_forward(edges, nodes, long_form(nodes), [frame(w1), frame(w2)], [frame(np.abs(w1)), frame(np.abs(w2))], seed=1)
    assert g.count() == 180
    scores = ppr.top_k_rows(ppr.power_series(normalize.row(edges), nodes, 0.2, 5), 8).cache()
    out = matrix(models.pprgo_forward(scores, long_form(nodes), [frame(w1), frame(w2)]), 60, "id", "k", "v", 3)
    assert np.allclose(out, matrix(scores, 60) @ (np.maximum(x @ w1, 0) @ w2))
    assert models.robust_pprgo_forward(scores, long_form(nodes), [frame(w1), frame(w2)], k=4).count() > 0
    # Labels that the features decide: training must find them.
    easy = {i: int(x[i, 0] > 0) for i in range(60)}
    simple = nodes_of(spark, {i: v.tolist() for i, v in enumerate(x)}, easy)
    split = spark.createDataFrame([(i, "train" if i % 3 else "val") for i in range(60)], "id long, part string")
    loops = edges_of(spark, {(i, i): 1.0 for i in range(60)})
    weights, bias, features = models.train_sgc(loops, simple, split)
    assert weights.shape == (5, 2) and features.count() == 60
    _, trace = models.train_mlp(models.ppr_rows(loops, simple, split), 5, 2, 4, 12, 0.05)
    assert trace[-1]["train"] < 0.8 * trace[0]["train"]
    values, u = models.truncated_svd(edges, nodes, 3, 6)
    assert np.allclose(values, np.sort(np.abs(np.linalg.eigvalsh(a)))[::-1][:3], rtol=0.05) and u.count() == 180


def test_column_functions(spark):
    row = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0], -0.5)], "a array<double>, b array<double>, x double")
    got = row.select(distance(F.col("a"), F.col("b")), distance(F.col("a"), F.col("b"), 1.0), clamp(F.col("x"), 0, 1), close(F.col("x"), F.col("x") + 1e-10), ACTIVATIONS["Identiy"](F.col("x")), ACTIVATIONS["ELU"](F.col("x"))).first()
    assert got[0] == 5.0 and got[1] == pytest.approx(7.0) and got[2] == 0.0 and got[3] and got[4] == -0.5 and got[5] == pytest.approx(math.exp(-0.5) - 1)
    u = spark.range(1000).select(uniform(1, "id").alias("u")).collect()
    assert 0 <= min(r.u for r in u) and max(r.u for r in u) < 1 and 0.45 < np.mean([r.u for r in u]) < 0.55


def test_dice_keeps_its_rules(spark):
    a, x, labels, edges, nodes = random_graph(spark, 40, 0.2, 21)
    for r in attacks.dice_delete(edges, nodes, 10).collect():
        assert a[r.src, r.dst] and labels[r.src] == labels[r.dst]
    added = attacks.dice_add(edges, nodes, 12).collect()
    assert len(added) == 12 and all(not a[r.src, r.dst] and labels[r.src] != labels[r.dst] for r in added)
    new = matrix(attacks.dice(edges, nodes, 20), 40)
    assert np.allclose(new, new.T) and abs(new - a).sum() / 2 == 20
    row = attacks.local_dice(edges, nodes, 5, 8, 0.5).collect()
    assert len(row) == 8 and all((r.op == "del") == bool(a[5, r.dst]) for r in row)


def test_blocks_of_wide_rows_equal_the_product(spark):
    """One and two hops over several blocks, with long rows, repeated edges and rows without any."""
    rng = np.random.default_rng(11)
    n, width = 60, 5
    a = np.where(rng.random((n, n)) < 0.4, rng.random((n, n)), 0.0)
    a[3] = a[:, 4] = 0.0
    x = rng.normal(size=(n, width)).astype(np.float32)
    ids = np.arange(n) * 1_000_003
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, attr array<float>")
    cells = [(int(ids[i]), int(ids[j]), float(a[i, j] / 2)) for i, j in np.argwhere(a)] * 2
    edges = spark.createDataFrame(cells, "src long, dst long, weight double").repartition(5)
    for blocks in (1, 7):
        got = {r.id: r.attr for r in propagate.product(edges, rows, blocks).collect()}
        assert set(got) == {int(i) for i, r in zip(ids, a, strict=True) if r.any()}
        assert all(np.allclose(got[int(i)], r @ x.astype(float)) for i, r in zip(ids, a, strict=True) if r.any())
    two = {(r.id, r.k): r.v for r in propagate.spmm_rows(edges, rows, 2).collect()}
    want = a @ (a @ x.astype(float))
    assert all(np.isclose(v, want[i // 1_000_003, k]) for (i, k), v in two.items()) and len(two) == width * sum(bool((r > 0).any()) for r in a @ a)


def test_spgemm_and_jaccard(spark):
    a, x, labels, edges, nodes = random_graph(spark, 15, 0.3, 30)
    assert np.allclose(matrix(propagate.spgemm(edges, edges), 15), a @ a)
    kept = {(r.src, r.dst) for r in reshape.drop_dissimilar(edges, nodes, 0.4).collect()}
    b = x > 0
    want = {(i, j) for i, j in zip(*np.nonzero(a), strict=True) if (b[i] | b[j]).sum() == 0 or (b[i] & b[j]).sum() / (b[i] | b[j]).sum() > 0.4}
    assert kept == want


def test_rank_one_margins_equal_brute_force(spark):
    a, x, labels, edges, nodes = random_graph(spark, 10, 0.5, 17)
    z = np.random.default_rng(5).normal(size=(10, 3))
    logits = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    alpha, i = 0.4, 3
    for r in attacks.rank_one_margins(edges, nodes, logits, i, alpha, 24).collect():
        m = a.copy()
        m[i, r.dst] = 1 - m[i, r.dst]
        out = (alpha * np.linalg.inv(np.eye(10) - (1 - alpha) * m / m.sum(1, keepdims=True)) @ z)[i]
        assert r.present == bool(a[i, r.dst])
        assert r.margin == pytest.approx(out[labels[i]] - max(out[c] for c in range(3) if c != labels[i]), abs=1e-4)
    run = attacks.greedy_row_flips(edges, nodes, logits, i, 1, alpha, 6)
    assert run.pairs.count() == 1


def test_gcn_training_finds_labels(spark):
    a, x, _, edges, _ = random_graph(spark, 24, 0.15, 41)
    hop = dense_norm(a) @ x
    nodes = nodes_of(spark, {i: v.tolist() for i, v in enumerate(x)}, {i: int(hop[i, 0] > 0) for i in range(24)})
    split = spark.createDataFrame([(i, ["train", "train", "val"][i % 3]) for i in range(24)], "id long, part string")
    weights, trace = models.train_gcn(edges, nodes, split, 4, epochs=5, lr=0.1)
    assert trace[-1]["train"] < trace[0]["train"] and weights["w1"].shape == (5, 4)
    assert models.batch_ids(split, 4).groupBy("part").agg(F.max("batch").alias("m")).filter("m > 3").isEmpty()


@pytest.mark.parametrize("name", [*losses.LOSSES, "tanhMarginCW-0.3", "tanhMarginMCE-0.8"])
def test_loss_gradients_match_central_differences(spark, name):
    rng = np.random.default_rng(1)
    z, labels = rng.normal(size=(7, 4)) * 2, rng.integers(0, 4, 7)
    label_table = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "id long, label int")
    wide = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(z)], "id long, z array<double>")
    got = np.array([r.g for r in attacks.loss_gradient(wide, label_table, name).orderBy("id").collect()])
    kind, a = losses.split_name(name)

    def value(z):
        y = z[np.arange(7), labels]
        other = np.where(np.eye(4, dtype=bool)[labels], -np.inf, z).max(1)
        m, lse = y - other, np.log(np.exp(z).sum(1))
        ce, hit = lse - y, z.argmax(1) == labels
        mce, hinge = (ce * hit).sum() / max(1, hit.sum()), np.maximum(m, 0).mean()
        return {
            "CE": ce.mean(), "CW": -hinge, "LCW": -np.where(m >= 0, m, 0.1 * m).mean(), "Margin": -m.mean(), "tanhMargin": np.tanh(-m).mean(),
            "tanhMarginCW": a * np.tanh(-m).mean() - (1 - a) * hinge, "tanhMarginMCE": a * np.tanh(-m).mean() + (1 - a) * mce,
            "eluMargin": -np.where(m > 0, m, np.exp(m) - 1).mean(), "MCE": mce, "NCE": -(lse - other).mean(),
        }[kind]

    for i in range(7):
        for c in range(4):
            step = np.zeros_like(z)
            step[i, c] = 1e-6
            assert got[i, c] == pytest.approx((value(z + step) - value(z - step)) / 2e-6, abs=1e-6)


def test_unknown_losses_are_errors(spark):
    for name in ("Margn", "CE-0.5", ""):
        with pytest.raises(ValueError):
            losses.split_name(name)


def test_pairs_are_exact_and_draws_reach_all_of_them(spark):
    from weftgraph.functions import below
    from weftgraph.operators.reshape import triu_pair

    for n in (5, 10**6, 3 * 10**8, 10**9):
        last = n * (n - 1) // 2 - 1
        rng = np.random.default_rng(3)
        lins = [0, n - 2, n - 1, last, last - 1, last - 2, last - 3, *(int(x) for x in rng.integers(0, last + 1, 200)), *(last - int(x) for x in rng.integers(0, min(last, 10**6), 200))]
        frame = spark.createDataFrame([(x,) for x in lins if 0 <= x <= last], "lin long")
        i, j = triu_pair(n, F.col("lin"))
        for lin, a, b in frame.select("lin", i, j).collect():
            assert 0 <= a < b < n and lin == a * (2 * n - a - 1) // 2 + b - a - 1
    n = 10**6
    bound = n * (n - 1) // 2
    drawn = [r[0] for r in spark.range(4000).select(below(bound, "s", "id")).collect()]
    assert len(set(drawn)) > 3990 and 0 <= min(drawn) and max(drawn) < bound and abs(np.mean(drawn) / bound - 0.5) < 0.03
    assert len({x % 1024 for x in drawn}) > 900  # low bits vary too


def test_additions_over_the_room_are_errors(spark):
    nodes = spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, label int")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, weight double")
    assert attacks.dice_add(edges, nodes, 8).count() == 8
    with pytest.raises(ValueError):
        attacks.dice_add(edges, nodes, 9)


@pytest.mark.parametrize(("activation", "biased"), [("ReLU", True), ("Tanh", False)])
def test_gcn_gradient_equals_central_differences(spark, activation, biased):
    a, x, labels, edges, nodes = random_graph(spark, 9, 0.4, 6)
    rng = np.random.default_rng(2)
    weights = [rng.normal(size=(5, 4)), rng.normal(size=(4, 4)), rng.normal(size=(4, 3))]
    biases = [rng.normal(size=4), rng.normal(size=4), rng.normal(size=3)] if biased else None
    y = np.array([labels[i] for i in range(9)])
    act = {"ReLU": lambda v: np.maximum(v, 0), "Tanh": np.tanh}[activation]

    def logits(m):
        h, norm = x, dense_norm(m)
        for k, w in enumerate(weights):
            h = norm @ (h @ w) + (biases[k] if biases else 0)
            h = act(h) if k < 2 else h
        return h

    def loss(m):
        z = logits(m)
        own, other = z[np.arange(9), y], np.where(np.eye(3)[y] == 1, -np.inf, z).max(1)
        return np.tanh(other - own).mean()

    model = attacks.Gcn(weights, biases, activation)
    got = np.array([r.z for r in attacks.surrogate_logits(edges, nodes, model).orderBy("id").collect()])
    assert np.allclose(got, logits(a), atol=1e-9)
    pairs = [(0, 1), (2, 8), (3, 4)]
    found = {(r.src, r.dst): r.grad for r in attacks.edge_gradient(edges, nodes, model, nodes, spark.createDataFrame(pairs, "src long, dst long"), "tanhMargin").collect()}
    for i, j in pairs:
        hi, lo = a.copy(), a.copy()
        for m, step in ((hi, 1e-6), (lo, -1e-6)):
            m[i, j] += step
            m[j, i] += step
        assert found[i, j] == pytest.approx((loss(hi) - loss(lo)) / 2e-6, abs=1e-5)


def test_connectedness(spark):
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    assert components.is_connected(spark.range(3), path) and not components.is_connected(spark.range(4), path)
