"""Gradients of the trained models against central differences, and training runs on small labelled graphs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import models, training


def entropy(z, labels):
    e = z - z.max(1, keepdims=True)
    return np.log(np.exp(e).sum(1)) - e[np.arange(len(z)), labels]


def block_graph(spark, n=18, seed=0, share=0.3):
    """Two groups with more edges inside, and attributes that lean to the group."""
    rng = np.random.default_rng(seed)
    labels = np.arange(n) % 2
    a = np.triu(rng.random((n, n)) < np.where(labels[:, None] == labels[None], share, 0.05), 1)
    a = (a + a.T).astype(float)
    x = rng.normal(size=(n, 4)) + np.where(labels, 1, -1)[:, None] * 0.8
    i, j = np.nonzero(a)
    edges = spark.createDataFrame([(int(p), int(q), 1.0) for p, q in zip(i, j, strict=True)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(k, v.tolist(), int(y)) for k, (v, y) in enumerate(zip(x, labels, strict=True))], "id long, attr array<double>, label int")
    split = spark.createDataFrame([(k, ["train", "train", "val"][k % 3]) for k in range(n)], "id long, part string")
    return a, x, labels, edges, nodes, split


def pprgo(rng, batch_norm, reduce):
    p = {"w0": rng.normal(size=(4, 5)), "w1": rng.normal(size=(5, 3)), "w2": rng.normal(size=(3, 2))}
    moments = None
    if batch_norm:
        p |= {"gamma0": rng.uniform(0.5, 1.5, 5), "gamma1": rng.uniform(0.5, 1.5, 3), "beta0": rng.normal(size=5), "beta1": rng.normal(size=3)}
        moments = [(rng.normal(size=5), rng.uniform(0.5, 2, 5)), (rng.normal(size=3), rng.uniform(0.5, 2, 3))]
    return training.PprGo(p, moments, reduce, {"k": 3, "temperature": 0.8})


@pytest.mark.parametrize("batch_norm,reduce", [(False, "sum"), (True, "sum"), (True, "soft_k_medoid")])
def test_pprgo_gradient_equals_central_differences(batch_norm, reduce):
    rng = np.random.default_rng(4)
    model = pprgo(rng, batch_norm, reduce)
    ends, labels = np.array([4, 6, 11]), np.array([0, 1, 1])
    x, s = rng.normal(size=(11, 4)), rng.uniform(0.1, 1, 11)
    owner, place = np.array([7] * 4 + [8] * 2 + [9] * 5), np.concatenate([np.arange(4), np.arange(2), np.arange(5)])

    def masks(i, n):
        return training.mask(0.4, n, 3, 1, i, owner, place)

    g, losses, _, seen = training.pprgo_gradient(model, x, s, ends, labels, masks)
    assert losses == pytest.approx(float(entropy(model.logits(x, s, ends, masks)[0], labels).sum())) and len(seen) == 2
    for name, array in model.p.items():
        for at in list(np.ndindex(array.shape))[::3]:
            sides = []
            for h in (1e-6, -1e-6):
                moved = array.copy()
                moved[at] += h
                other = training.PprGo({**model.p, name: moved}, model.moments, reduce, model.parameters)
                sides.append(float(entropy(other.logits(x, s, ends, masks)[0], labels).sum()))
            assert g[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-5)


def test_masks_and_draws_depend_on_their_keys_only():
    ids = np.arange(2000)
    m = training.mask(0.3, 6, 1, 2, 3, ids)
    assert np.array_equal(m[::-1], training.mask(0.3, 6, 1, 2, 3, ids[::-1])) and abs((m == 0).mean() - 0.3) < 0.02
    assert not np.array_equal(m, training.mask(0.3, 6, 1, 3, 3, ids)) and np.allclose(np.unique(m), [0, 1 / 0.7])
    z = training.normal(5, 1, 2, 3, ids)
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    assert training.cosine(1.0, 0, 10) == 1 and training.cosine(1.0, 5, 10) == pytest.approx(0.5) and training.cosine(1.0, 3, 10, 3) == 1


def test_pprgo_training_in_batches(spark):
    """Two runs give one model; the validation curve falls, schedules and optimisers work, and the fit is that of a NumPy run of the same steps."""
    a, x, labels, edges, nodes, split = block_graph(spark, 30, 2)
    walk = (a + np.eye(30)) / (a + np.eye(30)).sum(1, keepdims=True)
    scores = 0.2 * np.linalg.inv(np.eye(30) - 0.8 * walk)
    kept = [(int(i), int(j), float(scores[i, j])) for i in range(30) for j in np.argsort(-scores[i], kind="stable")[:8]]
    table = spark.createDataFrame(kept, "src long, dst long, weight double")
    rows = training.ppr_batches(table, nodes, split, 8).cache()
    assert rows.filter("part = 'train'").select("batch").distinct().count() > 1 and rows.count() == 30
    model, trace = training.train_pprgo(rows, (6,), 3, 0.05, dropout=0.2, batch_norm=True, schedule="restarts", seed=3)
    assert trace[-1]["val"] < trace[0]["val"] and [round(t["lr"], 4) for t in trace] == [0.05, 0.0375, 0.0125]
    plain, curve = training.train_pprgo(rows, (6,), 2, 0.3, decay=0.01, optimizer="SGD", schedule="cosine", seed=3)
    # The same steps in NumPy.
    number = {r.id: (r.part, r.batch) for r in rows.select("id", "part", "batch").collect()}
    rng = np.random.default_rng(3)
    w0, w1 = rng.normal(0, (2 / 4) ** 0.5, (4, 6)), rng.normal(0, (2 / 6) ** 0.5, (6, 2))
    best = (np.inf, None)
    s = np.zeros((30, 30))
    for i, j, w in kept:
        s[i, j] = w
    for epoch in range(2):
        for b in rng.permutation(sorted({b for part, b in number.values() if part == "train"})).tolist():
            at = [i for i, found in number.items() if found == ("train", b)]
            pre = x @ w0
            z = s[at] @ (np.maximum(pre, 0) @ w1)
            q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            q[range(len(at)), labels[at]] -= 1
            g = s[at].T @ q / len(at)
            lr = training.cosine(0.3, epoch, 2)
            g1, g0 = np.maximum(pre, 0).T @ g, x.T @ (g @ w1.T * (pre > 0))
            w0, w1 = w0 - lr * (g0 + 0.01 * w0), w1 - lr * (g1 + 0.01 * w1)
        at = [i for i, (part, _) in number.items() if part == "val"]
        val = entropy(s[at] @ (np.maximum(x @ w0, 0) @ w1), labels[at]).mean()
        assert curve[epoch]["val"] == pytest.approx(val)
        best = min(best, (val, epoch))
    if best[1] == 1:
        assert np.allclose(plain.p["w0"], w0) and np.allclose(plain.p["w1"], w1)
    z = {r.id: r.z for r in training.predict(model, rows).collect()}
    assert len(z) == 30 and np.mean([int(np.argmax(z[i])) == labels[i] for i in range(30)]) > 0.7
    with pytest.raises(ValueError):
        training.train_pprgo(rows, schedule="step")


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gcn_gradients_of_three_layers_equal_central_differences(spark, dropout):
    a, x, labels, edges, nodes, split = block_graph(spark, 9, 5, 0.5)
    rng = np.random.default_rng(1)
    weights = [rng.normal(size=s) for s in ((4, 3), (3, 3), (3, 2))]
    run = training.GcnPass(edges, nodes, split, dropout, 5)
    tables = run.forward(weights, 2, dropout)
    got = run.gradients(weights, tables, 2)
    full = a + np.eye(9)
    norm = full / np.sqrt(full.sum(0)[:, None] * full.sum(0)[None])
    ids, fit = np.arange(9), np.arange(9) % 3 < 2

    def loss(weights):
        z = x
        for layer, w in enumerate(weights, 1):
            h = z if layer == 1 else np.maximum(z, 0)
            z = norm @ ((h * training.mask(dropout, h.shape[1], 5, 2, layer, ids)) @ w)
        return float(entropy(z[fit], labels[fit]).mean())

    assert run.judged(tables[-1])["train"] == pytest.approx(loss(weights))
    for layer, w in enumerate(weights):
        for at in np.ndindex(w.shape):
            sides = []
            for h in (1e-6, -1e-6):
                moved = [v.copy() for v in weights]
                moved[layer][at] += h
                sides.append(loss(moved))
            assert got[layer][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)


def test_gaussian_gradients_equal_central_differences(spark):
    a, x, labels, edges, nodes, split = block_graph(spark, 8, 7, 0.5)
    rng = np.random.default_rng(2)
    p = {"m1": rng.normal(size=(4, 3)), "v1": rng.normal(size=(4, 3)), "m2": rng.normal(size=(3, 2)), "v2": rng.normal(size=(3, 2))}
    run = training.GaussPass(edges, nodes, split, 0.7, 0.01, 0.02, seed=4)
    between, z, divergence = run.forward(p, 1, 0.0)
    got = run.gradients(p, between, z, 1)
    full = a + np.eye(8)
    d = full.sum(1)
    half, whole = full / np.sqrt(d[:, None] * d[None]), full / (d[:, None] * d[None])
    noise, fit = training.normal(2, 4, 1, 9, np.arange(8)), np.arange(8) % 3 < 2

    def elu(v):
        return np.where(v > 0, v, np.exp(np.minimum(v, 0)) - 1)

    def loss(p):
        m, s = elu(x @ p["m1"]), np.maximum(x @ p["v1"], 0)
        kl = 0.5 * (m**2 + s - np.log(1e-8 + s)).mean(1).sum()
        e = np.exp(-0.7 * s)
        mean, var = half @ (m * e), whole @ (s * e * e)
        m2, s2 = elu(mean @ p["m2"]), np.maximum(var @ p["v2"], 0)
        out = half @ (m2 * np.exp(-0.7 * s2)) + noise * np.sqrt(s2 + 1e-8)
        return float(entropy(out[fit], labels[fit]).mean()) + 0.01 * kl + 0.02 * ((p["m1"] ** 2).sum() + (p["v1"] ** 2).sum()), kl

    assert divergence == pytest.approx(loss(p)[1])
    for name, array in p.items():
        for at in np.ndindex(array.shape):
            sides = []
            for h in (1e-6, -1e-6):
                moved = {**p, name: array.copy()}
                moved[name][at] += h
                sides.append(loss(moved)[0])
            assert got[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=2e-5, rel=1e-4)


def test_gaussian_network_learns_a_block_graph(spark):
    *_, edges, nodes, split = block_graph(spark, 18, 1)
    weights, trace = training.train_rgcn(edges, nodes, split, 4, 4, 0.1, seed=1)
    assert trace[-1]["loss"] < trace[0]["loss"] and set(weights) == {"m1", "v1", "m2", "v2"}


def test_gcn_training_takes_any_depth(spark):
    *_, edges, nodes, split = block_graph(spark, 18, 1)
    weights, trace = models.train_gcn(edges, nodes, split, [4, 3], epochs=3, lr=0.1, seed=2)
    assert [w.shape for w in weights.values()] == [(4, 4), (4, 3), (3, 2)] and trace[-1]["train"] < trace[0]["train"]
    assert nodes.filter(F.col("label") > 1).isEmpty()
