"""Gradients through robust means, attacks on PageRank models and residual push against dense algebra and central differences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import attacks, models, ppr, ppr_attacks, propagate, robust, robust_gradients

N, CLASSES = 11, 3


def table(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "src long, dst long, weight double")


def graph(spark, seed, n=N, share=0.5, weighted=True):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) < share, 1) * (rng.uniform(0.3, 0.9, (n, n)) if weighted else 1.0)
    a = a + a.T
    x, labels = rng.normal(size=(n, 4)), rng.integers(0, CLASSES, n)
    nodes = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))], "id long, attr array<double>, label int")
    return a, x, labels, nodes


def near(row, k):
    there = np.flatnonzero(row)
    return np.sort(there[np.lexsort((there, -row[there]))[:k]])


def soft_k_medoid(a, x, k, t, corrected):
    out = np.zeros((len(a), x.shape[1]))
    for i, row in enumerate(a):
        at = near(row, k)
        if len(at):
            cost = np.linalg.norm(x[at][:, None] - x[at][None], axis=2) @ row[at]
            q = np.exp(-cost / t) * (row[at] if corrected else 1)
            out[i] = row.sum() * (q / q.sum()) @ x[at]
    return out


def soft_median(a, x, t, p, *_):
    out = np.zeros((len(a), x.shape[1]))
    for i, row in enumerate(a):
        at = np.flatnonzero(row)
        if len(at):
            order = x[at].argsort(0, kind="stable")
            hit = (2 * row[at][order].cumsum(0) >= row.sum() - 1e-12).argmax(0)
            med = x[at][order[hit, range(x.shape[1])], range(x.shape[1])]
            d = (np.abs(x[at] - med) ** p).sum(1) ** (1 / p) / x.shape[1] ** (1 / p)
            q = np.exp(-d / t) * row[at]
            out[i] = row.sum() * (q / q.sum()) @ x[at]
    return out


MEANS = {
    "soft_k_medoid": (soft_k_medoid, {"k": 4, "temperature": 0.7, "with_weight_correction": True}),
    "plain": (soft_k_medoid, {"k": 4, "temperature": 0.7, "with_weight_correction": False}),
    "soft_median": (soft_median, {"temperature": 0.4, "p": 2.0}),
    "soft_median_3": (soft_median, {"temperature": 0.4, "p": 3.0}),
}


def mean_name(name):
    return {"plain": "soft_k_medoid", "soft_median_3": "soft_median"}.get(name, name)


def entropy(z, labels):
    e = z - z.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(e).sum(1)) - e[np.arange(len(z)), labels]))


def dense_loss(a, x, labels, model, mean, parameters):
    full = a + np.eye(len(a))
    d = full.sum(0)
    norm = full / np.sqrt(d[:, None] * d[None, :])
    h = x
    for i, (w, b) in enumerate(zip(model.weights, model.biases, strict=True)):
        h = mean(norm, h @ w, *parameters.values()) + (0 if b is None else b)
        h = np.tanh(h) if i < len(model.weights) - 1 else h
    return entropy(h, labels), h


@pytest.mark.parametrize("name", ["soft_k_medoid", "soft_median"])
def test_gradients_through_robust_means_equal_central_differences(spark, name):
    mean, parameters = MEANS[name]
    a, x, labels, nodes = graph(spark, 3)
    rng = np.random.default_rng(9)
    model = attacks.Rgnn([rng.normal(size=(4, 3)), rng.normal(size=(3, CLASSES))], [rng.normal(size=3), None], "Tanh", mean=mean_name(name), parameters=parameters)
    edges = table(spark, a)
    z = attacks.surrogate_logits(edges, nodes, model)
    got = np.array([r.z for r in z.orderBy("id").collect()])
    base, want = dense_loss(a, x, labels, model, mean, parameters)
    assert np.allclose(got, want, atol=1e-9)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(a)), strict=True)]
    found = attacks.edge_gradient(edges, nodes, model, nodes, spark.createDataFrame(pairs, "src long, dst long"))
    step = 1e-6
    rows = found.collect()
    assert len(rows) == len(pairs)
    for r in rows:
        sides = []
        for sign in (1, -1):
            m = a.copy()
            m[r.src, r.dst] += sign * step
            m[r.dst, r.src] += sign * step
            sides.append(dense_loss(m, x, labels, model, mean, parameters)[0])
        assert r.grad == pytest.approx((sides[0] - sides[1]) / (2 * step), abs=2e-6)


@pytest.mark.parametrize("corrected", [True, False])
def test_medoid_row_equals_central_differences(corrected):
    """The kernel of one row: by weights, by vectors, with and without weight correction."""
    rng = np.random.default_rng(6)
    x, a, g = rng.normal(size=(5, 3)), rng.uniform(0.2, 1, 5), rng.normal(size=3)

    def value(x, a):
        return float(g @ (a.sum() * robust.soft_weights(x, a, 0.7, corrected)[2] @ x))

    base, by_weight, by_vector = robust_gradients.medoid_row(x, a, a.sum(), g, 0.7, corrected)
    for j in range(5):
        h = np.eye(5)[j] * 1e-6
        assert base + by_weight[j] == pytest.approx((value(x, a + h) - value(x, a - h)) / 2e-6, abs=1e-6)
        for c in range(3):
            h = np.zeros((5, 3))
            h[j, c] = 1e-6
            assert by_vector[j, c] == pytest.approx((value(x + h, a) - value(x - h, a)) / 2e-6, abs=1e-6)


def test_median_gradient_of_other_powers(spark):
    """One layer with the third power."""
    mean, parameters = MEANS["soft_median_3"]
    a, x, labels, nodes = graph(spark, 4, 8)
    model = attacks.Rgnn([np.random.default_rng(9).normal(size=(4, CLASSES))], [None], mean="soft_median", parameters=parameters)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(a)), strict=True)]
    for r in attacks.edge_gradient(table(spark, a), nodes, model, nodes, spark.createDataFrame(pairs, "src long, dst long")).collect():
        h = np.zeros(a.shape)
        h[r.src, r.dst] = h[r.dst, r.src] = 1e-6
        want = (dense_loss(a + h, x, labels, model, mean, parameters)[0] - dense_loss(a - h, x, labels, model, mean, parameters)[0]) / 2e-6
        assert r.grad == pytest.approx(want, abs=2e-6)


def test_relaxed_attacks_run_on_robust_networks(spark):
    a, x, labels, nodes = graph(spark, 5, weighted=False)
    rng = np.random.default_rng(2)
    model = attacks.Rgnn([rng.normal(size=(4, CLASSES))], [None], mean="soft_median", parameters={"temperature": 0.5})
    edges = table(spark, a)
    before = dense_loss(a, x, labels, model, soft_median, {"t": 0.5, "p": 2.0})[0]
    for run in (attacks.prbcd(edges, nodes, model, nodes, 4, 2, 1, 40, 50.0, samples=1, seed=1), attacks.greedy_rbcd(edges, nodes, model, nodes, 3, 1, 40, seed=1)):
        m = np.zeros((N, N))
        for r in run.edges.collect():
            m[r.src, r.dst] = r.weight
        assert run.pairs.count() <= 4 and dense_loss(m, x, labels, model, soft_median, {"t": 0.5, "p": 2.0})[0] > before
    with pytest.raises(ValueError):
        attacks.edge_gradient(edges, nodes, attacks.Rgnn([np.ones((4, 3))], [None], mean="medoid"), nodes, edges)


def test_robust_forward_with_bias_equals_the_long_form(spark):
    a, x, labels, nodes = graph(spark, 6)
    edges, rng = table(spark, a), np.random.default_rng(3)
    w, b = rng.normal(size=(4, 3)), rng.normal(size=3)
    frame = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(4) for j in range(3)], "k int, h int, w double")
    bias = spark.createDataFrame([(j, float(v)) for j, v in enumerate(b)], "h int, b double")
    long = models.rgnn_forward(edges, nodes, [(frame, bias)], "soft_k_medoid", k=4, temperature=0.7)
    got = np.zeros((N, 3))
    for r in long.collect():
        got[r.id, r.k] = r.v
    want = soft_k_medoid(a, x @ w, 4, 0.7, True)
    assert np.allclose(got[a.sum(1) > 0], (want + b)[a.sum(1) > 0], atol=1e-9)


def test_medians_of_hubs_equal_those_of_gathered_rows(spark):
    """A row over the bound is dealt out by dimension; medians, their owners and gaps are the same."""
    rng = np.random.default_rng(8)
    n = 60
    a = np.zeros((n, n))
    a[0, 1:] = a[1, ::2] = 1.0
    a[2, :5] = rng.random(5)
    a[3, 7] = 0.5
    x = np.round(rng.normal(size=(n, 3)), 1)  # ties
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, attr array<double>")
    edges = table(spark, a).repartition(5)
    rows = [{r.src: (r.med, r.arg, round(r.low, 12)) for r in robust.wide_median(edges, nodes, hub=hub).collect()} for hub in (1000, 20, 1)]
    assert rows[0] == rows[1] == rows[2] and set(rows[0]) == {0, 1, 2, 3}
    for src, (med, arg, _) in rows[0].items():
        at = np.flatnonzero(a[src])
        for c in range(3):
            best = min((v, i) for v, i in zip(x[at, c], at, strict=True) if 2 * a[src][at][(x[at, c] < v) | ((x[at, c] == v) & (at <= i))].sum() >= a[src].sum() - 1e-12)
            assert (med[c], arg[c]) == best
    wide = robust.dimwise_median(edges, nodes).collect()
    long = robust.dimwise_median(edges, nodes.select("id", F.posexplode("attr").alias("k", "v"))).collect()
    assert sorted(map(tuple, wide)) == sorted(map(tuple, long)) and robust.dimwise_median(edges.limit(0), nodes).isEmpty()


def test_rows_stay_whole_under_adaptive_execution(spark):
    """The edges come dealt by src from a join that adaptive execution drops; the shuffle before it must not be read in pieces."""
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # the nodes, not the edges
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        pairs = spark.range(0, 20000, 1, 8).select((F.col("id") % 97).alias("src"), (F.col("id") * 7 % 211).alias("dst")).filter("src <> dst").distinct()
        edges = pairs.withColumn("weight", 1.0 + F.col("dst") % 3)
        nodes = spark.range(211).select("id", F.array(F.sin("id"), F.cos("id")).alias("attr"))
        for found in (robust.dimwise_median(edges, nodes), robust.soft_median(edges, nodes), robust.medoid(edges, nodes), robust.soft_medoid(edges, nodes)):
            assert found.count() == found.select("id", "k").distinct().count() == 2 * 97
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_all_pairs_of_hubs_equal_those_of_gathered_rows(spark):
    """Medoids and soft means of rows over the bound, in pieces, equal brute force; copies and vectors of any length too."""
    rng = np.random.default_rng(9)
    n = 40
    a = np.zeros((n, n))
    a[0, 1:] = rng.random(n - 1)
    a[1, ::2] = 1.0
    a[2, :5] = rng.random(5)
    x = rng.normal(size=(n, 3)) * 10.0 ** rng.integers(-3, 3, (n, 1))
    x[7:12] = x[6]
    x[13] = x[12] + 1e-7
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, attr array<double>")
    edges = table(spark, a).repartition(5)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for hub in (1000, 10, 1):
        hard, soft, median = (matrix_of(f, n, 3) for f in (robust.medoid(edges, nodes, hub), robust.soft_medoid(edges, nodes, 5.0, hub), robust.soft_median_rows(edges, nodes, 0.5, hub=hub).select(F.col("src").alias("id"), F.posexplode("mean").alias("k", "v"))))
        for i in range(3):
            at = np.flatnonzero(a[i])
            cost = far[np.ix_(at, at)] @ a[i, at]
            best = at[np.lexsort((at, cost.round(9)))[0]]
            w = np.exp((cost.min() - cost) / 5.0)
            assert np.allclose(hard[i], a[i].sum() * x[best], rtol=1e-12) and np.allclose(soft[i], a[i].sum() * (w / w.sum()) @ x[at], rtol=1e-9)
            order = x[at].argsort(0, kind="stable")
            middle = np.array([x[at[order[:, c]], c][np.argmax(2 * a[i, at[order[:, c]]].cumsum() >= a[i].sum() - 1e-12)] for c in range(3)])
            gap = np.sqrt(((x[at] - middle) ** 2).sum(1) / 3)
            w = np.exp((gap.min() - gap) / 0.5) * a[i, at]
            assert np.allclose(median[i], w / w.sum() @ x[at], rtol=1e-9)


def matrix_of(long, n, width):
    out = np.zeros((n, width))
    for r in long.collect():
        out[r.id, r.k] = r.v
    return out


# ---------------------------------------------------------------- PageRank rows


def changed_row(a, i, p, sign):
    m = a.copy()
    for v, (weight, s) in enumerate(zip(p, sign, strict=True)):
        if s:
            m[i, v] = 1 - weight if s < 0 else weight
    return m


def dense_output(m, z, i, alpha, mean, parameters):
    walk = m / np.where(m.sum(1, keepdims=True) > 0, m.sum(1, keepdims=True), 1)
    row = np.maximum(alpha * np.linalg.inv(np.eye(len(m)) - (1 - alpha) * walk)[i], 0)
    return row @ z if mean is None else mean(row[None, :], z, *parameters.values())[0]


@pytest.mark.parametrize("name", ["sum", "soft_k_medoid", "soft_median"])
def test_relaxed_rows_equal_the_dense_inverse(spark, name):
    alpha, i, n = 0.5, 2, 12
    a, _, labels, nodes = graph(spark, 12, n, 0.35, weighted=False)
    rng = np.random.default_rng(1)
    z = rng.normal(size=(n, CLASSES))
    logits = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(z)], "id long, z array<double>")
    mean, parameters = (None, {}) if name == "sum" else MEANS[name]
    victim = ppr_attacks.PprVictim(logits, alpha, name, parameters)
    edges = table(spark, a)
    exact = alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * a / a.sum(1, keepdims=True))
    state = ppr_attacks.SumRow(edges, victim, i, 1e-10) if name == "sum" else ppr_attacks.RobustRow(edges, victim, i, table(spark, exact))
    ids = nodes.filter("id % 4 <> 1")
    block = ppr_attacks.with_presence(ids, edges, i, 0.5).withColumn("p", F.round(0.1 + F.rand(3) / 2, 3)).cache()
    p, sign = np.zeros(n), np.zeros(n)
    for r in block.collect():
        p[r.dst], sign[r.dst] = r.p, r.sign
    assert (sign < 0).any() and (sign > 0).any() and sign[i] == 0
    block = state.prepare(block)
    label = int(labels[i])
    found = state.step(block, label, "CE")
    assert np.allclose(found.z, dense_output(changed_row(a, i, p, sign), z, i, alpha, mean, parameters), atol=1e-8)

    def loss(p):
        out = dense_output(changed_row(a, i, p, sign), z, i, alpha, mean, parameters)
        return entropy(out[None, :], [label])

    for r in found.block.collect():
        h = np.zeros(n)
        h[r.dst] = 1e-6
        assert r.grad == pytest.approx((loss(p + h) - loss(p - h)) / 2e-6, abs=2e-6)


@pytest.mark.parametrize("name", ["sum", "soft_median"])
def test_local_attack_lowers_the_margin(spark, name):
    alpha, n = 0.5, 14
    a, _, _, _ = graph(spark, 21, n, 0.3, weighted=False)
    rng = np.random.default_rng(4)
    labels = np.arange(n) % CLASSES
    z = np.eye(CLASSES)[labels] * 2 + rng.normal(size=(n, CLASSES)) / 5
    nodes = spark.createDataFrame([(j, int(y)) for j, y in enumerate(labels)], "id long, label int")
    logits = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(z)], "id long, z array<double>")
    mean, parameters = (None, {}) if name == "sum" else MEANS[name]
    victim = ppr_attacks.PprVictim(logits, alpha, name, parameters)
    exact = alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * a / a.sum(1, keepdims=True))
    run = attacks.create_attack("LocalBatchedPRBCD")
    result = run(table(spark, a), nodes, victim, 5, 2, 2, 1, 10, 1.0, samples=2, ppr=None if name == "sum" else table(spark, exact))
    pairs = [(r.src, r.dst) for r in result.pairs.collect()]
    assert 0 < len(pairs) <= 2 and all(s == 5 for s, _ in pairs)
    m = a.copy()
    for s, t in pairs:
        m[s, t] = m[t, s] = 1 - m[s, t]
    clean = ppr_attacks.margin_of(dense_output(a, z, 5, alpha, mean, parameters).tolist(), int(labels[5]))
    after = ppr_attacks.margin_of(dense_output(m, z, 5, alpha, mean, parameters).tolist(), int(labels[5]))
    assert result.trace[-1]["exact_margin"] == pytest.approx(after, abs=1e-6) and result.trace[-1]["margin"] < clean
    assert all(t["mass"] <= 2 + 1e-3 for t in result.trace[:-1])
    if name != "sum":
        with pytest.raises(ValueError):
            run(table(spark, a), nodes, victim, 5, 1)


def test_local_transfer_and_poisoning(spark):
    """Edges found on a linear surrogate, judged on a PageRank model and on one that is trained anew; epochs chosen by accuracy."""
    from weftgraph.graph import Graph
    from weftgraph.plans import experiments

    n = 14
    a, x, _, _ = graph(spark, 21, n, 0.3, weighted=False)
    labels = np.arange(n) % CLASSES
    nodes = spark.createDataFrame([(j, v.tolist(), int(y)) for j, (v, y) in enumerate(zip(x, labels, strict=True))], "id long, attr array<double>, label int")
    logits = spark.createDataFrame([(j, (np.eye(CLASSES)[y] * 2).tolist()) for j, y in enumerate(labels)], "id long, z array<double>")
    surrogate, victim = attacks.Linear2(np.random.default_rng(0).normal(size=(4, CLASSES))), ppr_attacks.PprVictim(logits, 0.5)
    whole = Graph(table(spark, a), nodes)
    degree = int(a[5].sum())

    def attack(*args):
        return attacks.nettack(*args, cutoff=1e9)

    rows = experiments.run_local_transfer(whole, surrogate, {"linear": surrogate, "ppr": victim}, [5], attack, [0.0, 1.01 / degree]).collect()
    assert [(r.label, r.n_perturbations, r.degree) for r in rows] == [("linear", 1, degree), ("ppr", 1, degree)] and rows[0].margin <= rows[0].initial_margin
    m = a.copy()
    for s, t in rows[1].perturbed_edges:
        m[s, t] = m[t, s] = 1 - m[s, t]
    z = np.eye(CLASSES)[labels] * 2
    assert rows[1].margin == pytest.approx(ppr_attacks.margin_of(dense_output(m, z, 5, 0.5, None, {}).tolist(), int(labels[5])), abs=1e-5)
    split = spark.createDataFrame([(j, ["train", "train", "val", "test"][j % 4]) for j in range(n)], "id long, part string")
    poisoned = experiments.run_local_poisoning(whole, surrogate, split, [5], attack, [1.01 / degree], hidden=3, epochs=1).collect()
    assert len(poisoned) == 1 and poisoned[0].perturbed_edges == rows[0].perturbed_edges and -1 <= poisoned[0].margin <= 1
    run = attacks.prbcd(whole.edges, nodes, surrogate, nodes, 2, 2, 1, 30, 50.0, samples=1, seed=1, best_by="accuracy")
    assert [set(t) for t in run.trace] == [{"epoch", "loss", "accuracy", "mass", "nonzero_weights"}] * 2 and run.pairs.count() <= 2
    with pytest.raises(ValueError):
        attacks.prbcd(whole.edges, nodes, surrogate, nodes, 2, best_by="margin")


def dense_push(a, alpha, eps):
    """All seeds' rounds in one array."""
    d = (a > 0).sum(1)
    spread = (a > 0) / np.maximum(d, 1)[:, None]
    mass, left, go = np.zeros(a.shape), np.eye(len(a)) * alpha, np.eye(len(a)) > 0
    while go.any():
        r = np.where(go, left, 0)
        mass += r
        left = np.where(go, 0, left) + (1 - alpha) * r @ spread
        go = (left > 0) & (left >= alpha * eps * d[None, :] * (1 - 1e-9))
    return mass


def test_push_in_rounds_is_within_its_bound(spark):
    rng = np.random.default_rng(7)
    n, alpha = 40, 0.15
    a = np.triu(rng.random((n, n)) < 0.08, 1).astype(float)
    a = a + a.T
    a[0, 1:] = a[1:, 0] = 1  # a hub
    a[n - 1] = a[:, n - 1] = 0  # no edges
    d = a.sum(1)
    exact = alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * a / np.maximum(d, 1)[:, None])
    seeds = spark.range(n)
    for eps in (1e-2, 1e-4):
        got = np.zeros((n, n))
        for r in ppr.push(table(spark, a), seeds, alpha, eps).collect():
            got[r.src, r.dst] = r.weight
        assert np.allclose(got, dense_push(a, alpha, eps), atol=1e-12)
        assert (got <= exact + 1e-12).all() and (exact - got <= eps * d[None, :] + 1e-12).all()
    assert got[n - 1, n - 1] == alpha and got[n - 1].sum() == alpha
    diffused = ppr.gdc_approximate(table(spark, a), seeds, alpha, 1e-3, 5)
    sums = {r.src: (r.n, round(r.s, 9)) for r in diffused.groupBy("src").agg(F.count("*").alias("n"), F.sum("weight").alias("s")).collect()}
    assert len(sums) == n and all(k <= 5 and s == 1 for k, s in sums.values())


def test_propagation_helpers(spark):
    a, x, _, nodes = graph(spark, 30)
    edges = table(spark, a)
    out = robust_gradients.forward(edges, nodes.select("id", F.col("attr").alias("h")), "medoid", {})
    assert out.count() == (a.sum(1) > 0).sum() and propagate.wide(robust.medoid(edges, nodes), 4).count() == out.count()
