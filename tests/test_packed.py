"""Products over packed edges: equal to dense ones after changes, and what the steps above them shuffle."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import attacks, propagate, reshape
from weftgraph.operators.packed import Adjacency


def shuffled(spark) -> int:
    """Bytes that all stages of the session have written to shuffles so far."""
    context = spark.sparkContext
    util = context._jvm.java.util
    stages = context._jsc.sc().statusStore().stageList(util.ArrayList(), False, False, context._gateway.new_array(context._jvm.double, 0), util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def large(spark):
    """No table counts as small, as on large graphs."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Some 80000 edges between 400 nodes."""
    rng, n = np.random.default_rng(4), 400
    a = np.triu(rng.random((n, n)) < 0.5, 1)
    a = a | a.T
    folder = str(tmp_path_factory.mktemp("crowd"))
    pairs = np.argwhere(a)
    spark.createDataFrame([(int(i), int(j), 1.0) for i, j in pairs], "src long, dst long, weight double").repartition(6).write.parquet(f"{folder}/e")
    spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)], i % 3) for i in range(n)], "id long, attr array<double>, label int").write.parquet(f"{folder}/n")
    return spark.read.parquet(f"{folder}/e"), spark.read.parquet(f"{folder}/n"), a.astype(float)


def dense(a: np.ndarray) -> np.ndarray:
    full = a + np.diag((np.diag(a) == 0).astype(float))
    s = full.sum(0) ** -0.5
    return full * s[:, None] * s[None, :]


def test_hops_after_changes_equal_dense_products(spark):
    rng, n = np.random.default_rng(1), 30
    a = np.where(rng.random((n, n)) < 0.2, rng.choice([1.0, 1.0, 0.25], (n, n)), 0.0)  # directed, weighted, some loops
    h = rng.normal(size=(n, 3))
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i, h[i].tolist()) for i in range(n)], "id long, h array<double>")
    graph = Adjacency.of(edges, nodes)

    def check(graph, a):
        for back in (False, True):
            got = np.array([r.h for r in graph.hop(nodes, 3, back=back).orderBy("id").collect()])
            assert np.allclose(got, (dense(a).T if back else dense(a)) @ h)

    check(graph, a)
    for block in ([(0, 1, 1.0), (2, 9, 0.5), (3, 4, 1e-7)], [(0, 1, 1.0), (5, 6, 0.25)]):
        graph = graph.perturbed(spark.createDataFrame(block, "src long, dst long, p double"))
        for i, j, p in block:
            for x, y in ((i, j), (j, i)):
                a[x, y] = 2 - a[x, y] - p if a[x, y] + p > 1 else a[x, y] + p
        check(graph, a)
        pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(n) if i != j], "src long, dst long")
        assert all(abs(r.own - a[r.src, r.dst]) < 1e-12 and r.present == (a[r.src, r.dst] > 1e-9) for r in graph.matches(pairs).collect())


def test_gradient_shuffles_no_wide_row_an_edge(spark, crowd, large):
    edges, nodes, a = crowd
    pairs = spark.createDataFrame([(0, 1), (5, 9)], "src long, dst long")
    before = shuffled(spark)
    assert attacks.edge_gradient(edges, nodes, attacks.Linear2(np.eye(4)), nodes, pairs).count() == 2
    assert shuffled(spark) - before < 54 * a.sum()  # 62 with terms an edge, now 45


def test_page_rank_rounds_shuffle_no_edge_with_its_weight(spark, crowd, large):
    edges, nodes, a = crowd
    h = nodes.select("id", F.col("attr").alias("h"))
    before = shuffled(spark)
    got = np.array([r.h for r in attacks.ppr_propagate(edges, h, 4, 0.15, 8).orderBy("id").collect()])
    cost = shuffled(spark) - before
    x = np.array([r.h for r in h.orderBy("id").collect()])
    walk, out = 0.85 * a / a.sum(1, keepdims=True), 0.15 * x
    for _ in range(8):
        out = walk @ out + 0.15 * x
    assert np.allclose(got, out)
    assert cost < 40 * a.sum()  # 62 with a weighted edge a round, now 22


def test_sparse_products_shuffle_edges_and_not_products(spark, crowd, large, monkeypatch):
    monkeypatch.setattr(propagate, "PIECE", 64)  # rows of some 200 edges in several pieces
    edges, _, a = crowd
    start = shuffled(spark)
    rows = propagate.spgemm(edges, edges, strip=20000).toPandas()
    assert shuffled(spark) - start < 20 * int(a.sum()) * 12  # some 16 million products
    out = np.zeros(a.shape)
    np.add.at(out, (rows.src, rows.dst), rows.weight)
    assert np.allclose(out, a @ a)
    assert len(rows) == int((a @ a > 0).sum()) and not rows.duplicated(["src", "dst"]).any()


def test_sparse_products_shuffle_an_edge_twice_however_many_strips(spark, crowd, large):
    edges, _, a = crowd
    start = shuffled(spark)
    rows = propagate.spgemm(edges, edges, strip=8000)  # 10 strips
    assert rows.count() == int((a @ a > 0).sum())
    assert shuffled(spark) - start < 60 * int(a.sum())  # 15 copies of an edge before, 2 now


def test_sparse_products_of_different_and_empty_matrices(spark):
    rng, n = np.random.default_rng(7), 40
    a, b = (np.where(rng.random((n, n)) < density, rng.normal(size=(n, n)), 0.0) for density in (0.3, 0.03))

    def table(m: np.ndarray):
        return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)], "src long, dst long, weight double")

    for left, right in ((a, b), (b, a), (np.array([[1.0, 1.0]]), np.array([[0.0, 2.0], [0.0, -2.0]])), (a, np.zeros((n, n)))):
        rows = propagate.spgemm(table(left), table(right), strip=50).toPandas()
        out = np.zeros((len(left), right.shape[1]))
        out[rows.src, rows.dst] = rows.weight
        assert np.allclose(out, left @ right)
        assert len(rows) == int(((left != 0).astype(int) @ (right != 0).astype(int) > 0).sum())  # a sum of 0 is a row too


def test_changes_meet_the_edges_once(spark, crowd, large):
    edges, _, a = crowd
    pairs = [(0, 1), (3, 2), (5, 9)]
    added, removed = (spark.createDataFrame(p, "src long, dst long") for p in (pairs, [(4, 8), (9, 5)]))
    start = shuffled(spark)
    rows = reshape.apply_delta(edges, added, removed).toPandas()
    assert shuffled(spark) - start < 15 * a.sum()  # 19 with two copies of the edges, now 11
    want = a.copy()
    for (i, j), w in [((4, 8), 0.0), *[(p, 1.0) for p in pairs]]:
        want[i, j] = want[j, i] = w
    out = np.zeros(a.shape)
    np.add.at(out, (rows.src, rows.dst), rows.weight)
    assert (out == want).all() and len(rows) == want.sum()


def test_changes_keep_weights_and_repeated_edges(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.25), (1, 0, 2.0), (2, 3, 3.0), (3, 2, 3.0), (4, 4, 1.0), (5, 6, 7.0), (5, 6, 8.0)], "src long, dst long, weight double")
    added = spark.createDataFrame([(1, 0), (5, 6), (7, 8), (8, 7), (9, 9)], "src long, dst long")  # there, leaves too, absent (twice), a loop
    removed = spark.createDataFrame([(2, 3), (6, 5), (10, 11)], "src long, dst long")
    rows = sorted(tuple(r) for r in reshape.apply_delta(edges, added, removed).collect())
    assert rows == [(0, 1, 0.25), (0, 1, 0.5), (1, 0, 2.0), (4, 4, 1.0), (5, 6, 1.0), (6, 5, 1.0), (7, 8, 1.0), (8, 7, 1.0), (9, 9, 1.0)]


def test_robust_gradient_keeps_what_a_row_has_alike_in_the_row(spark, crowd, large):
    edges, nodes, a = crowd
    pairs = spark.createDataFrame([(0, 1), (5, 9)], "src long, dst long")
    start = shuffled(spark)
    assert attacks.edge_gradient(edges, nodes, attacks.Rgnn([np.eye(4)], mean="soft_k_medoid", parameters={}), nodes, pairs).count() == 2
    assert shuffled(spark) - start < 92 * a.sum()  # 101 with a term an edge, now 84
