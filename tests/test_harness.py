"""Sources, artifact store, configurations, runs, streaming and the catalogue's oracles."""

from __future__ import annotations

import math
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import streaming
from weftgraph.graph import Graph
from weftgraph.operators import attacks, reshape
from weftgraph.plans import catalogue, experiments
from weftgraph.sources import artifacts, npz, shards

SF = "/root/testdata/sf0.001"


def test_store_round_trip_and_subset_match(spark, tmp_path):
    store = artifacts.Store(str(tmp_path))
    store.save("t", {"a": 1, "b": {"c": 3}}, {"d": 1})
    store.save("t", {"a": 2, "b": {"c": 3}}, {"d": 4})
    assert store.load("t", {"a": 1, "b": {"c": 3}}) == {"d": 1} and store.load("t", {"a": 3}) is None
    assert [len(store.find(spark, "t", m)) for m in ({"a": 3}, {"a": 1}, {"b": {"c": 3}}, {})] == [0, 1, 2, 2]
    assert store.find(spark, "t", {}, first=True)[0][0] == {"d": 4}
    store.save("t", {"a": 1, "b": {"c": 3}}, {"d": 9})
    assert store.load("t", {"b": {"c": 3}, "a": 1}) == {"d": 9} and len(store.find(spark, "t", {})) == 2
    assert store.find(spark, "other", {}) == []
    frame = spark.range(5)
    assert store.save_table("m", {"k": "x"}, frame) and store.save_table("m", {"k": "x"}, frame, ignore_duplicate=True) is None
    assert store.load("m", {"k": "x"}, spark).count() == 5
    assert store.remove(spark, "m", {"k": "x"}) == 1 and store.load("m", {"k": "x"}, spark) is None
    assert artifacts.id_fingerprint(frame) == artifacts.id_fingerprint(frame.orderBy(F.desc("id")))


def test_store_with_concurrent_writers(spark, tmp_path):
    store = artifacts.Store(str(tmp_path))
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda i: store.save("c", {"a": i, "b": i * i}, {"c": i + 3}), range(100)))
    assert len(store.find(spark, "c", {})) == 100
    assert all(store.load("c", {"a": i, "b": i * i}) == {"c": i + 3} for i in range(100))


def test_archives_and_tables(spark, tmp_path):
    path = f"{tmp_path}/g.npz"
    np.savez(
        path, **{"adj_data": [1.0, 1, 1, 1], "adj_indices": [1, 0, 2, 3], "adj_indptr": [0, 1, 2, 3, 4], "adj_shape": [4, 4], "attr.data": [2.0, -1.0], "attr.indices": [0, 1]},
        **{"attr.indptr": [0, 1, 2, 2, 2], "attr.shape": [4, 2], "labels": np.array([0.0, 1, np.nan, 0]), "type": "x"},
    )
    g = npz.load_npz(spark, path)
    assert g.edges.count() == 4 and g.nodes.filter("label is null").count() == 1
    assert [r.attr for r in g.nodes.orderBy("id").collect()] == [[2.0, 0.0], [0.0, -1.0], [0.0, 0.0], [0.0, 0.0]]
    std = npz.load_graph(spark, path, binary_attr=True)
    assert std.nodes.count() == 2 and std.edges.count() == 2 and sorted(r.attr for r in std.nodes.collect()) == [[0.0, 1.0], [1.0, 0.0]]
    npz.save_npz(g.with_edges(g.edges), f"{tmp_path}/again.npz")
    assert npz.load_npz(spark, f"{tmp_path}/again.npz").edges.exceptAll(g.edges).isEmpty()
    npz.write_graph(g, f"{tmp_path}/t")
    assert npz.load_graph(spark, f"{tmp_path}/t", standardize=False).edges.count() == 4
    with pytest.raises(Exception):  # noqa: B017
        npz.load_npz(spark, f"{tmp_path}/none.npz").edges.count()


def test_shards_prune_partitions(spark, tmp_path):
    scores = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25)], "src long, dst long, weight double")
    shards.write_ppr(scores, str(tmp_path), dataset="a", alpha=0.1, topk=2)
    shards.write_ppr(scores.limit(1), str(tmp_path), dataset="b", alpha=0.1, topk=2)
    found = shards.read_ppr(spark, str(tmp_path), dataset="a", alpha=0.1)
    assert found.count() == 2 and "PartitionFilters: [isnotnull(dataset" in found._jdf.queryExecution().toString()
    seeds = spark.createDataFrame([(0,), (7,)], "id long")
    full = shards.complete_ppr(found, seeds, lambda missing: missing.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))
    assert sorted((r.src, r.weight) for r in full.collect()) == [(0, 0.5), (7, 1.0)]


def test_configuration_grids():
    config = {
        "fixed": {"a": 1, "m": {"x": 0}},
        "grid": {"lr": {"type": "choice", "options": [0.1, 0.2]}, "r": {"type": "range", "min": 0, "max": 4, "step": 2}},
        "one": {"fixed": {"m.x": 5}, "grid": {"p": {"type": "parameter_collection", "params": {"q": {"type": "loguniform", "min": 1, "max": 100, "num": 3}}}}},
        "two": {"fixed": {"a": 2}, "random": {"samples": 2, "seed": 1, "z": {"type": "uniform", "min": 0, "max": 1}}},
    }
    found = experiments.generate_configs(config)
    ones = [c for c in found if c["m"]["x"] == 5]
    assert len(ones) == 12 and {round(c["p"]["q"], 6) for c in ones} == {1, 10, 100} and all(c["a"] == 1 for c in ones)
    twos = [c for c in found if c["a"] == 2]
    assert len(twos) == 8 and len({c["z"] for c in twos}) == 8
    assert experiments.generate_configs({"fixed": {"a": 1}, "x": {}, "y": {}}) == [{"a": 1}]
    assert experiments.unflatten({"a.b": 1, "a.c.d": 2}) == {"a": {"b": 1, "c": {"d": 2}}} and experiments.flatten({"a": {"b": 1}}) == {"a.b": 1}
    with pytest.raises(experiments.ConfigError):
        experiments.generate_configs({"fixed": {"a": 1}, "grid": {"a": {"type": "choice", "options": [1]}}})
    with pytest.raises(experiments.ConfigError):
        experiments.unflatten({"a": 1, "a.b": 2})
    assert experiments.budget(0.1, 50) == 2 and experiments.budget(0.5, 3, False) == 2
    with pytest.raises(ValueError):
        experiments.check_epsilons([0.2, 0.1])


def test_rows_are_numbered_in_order(spark):
    """Numbers follow the order over any number of partitions; empty tables stay empty."""
    rows = [(i * 7 % 1000, i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = sorted(tuple(r) for r in reshape.numbered(df, ["b", "a"], "n").collect())
    assert got == sorted((a, b, i) for i, (b, a) in enumerate(sorted((b, a) for a, b in rows)))
    assert reshape.numbered(df.limit(0), ["a"], "n").isEmpty()
    pointers = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 3)], "pos long, ptr long")
    values = spark.createDataFrame([(0, 5, 1.0), (1, 6, 2.0), (2, 7, 3.0)], "pos long, idx long, v double")
    assert sorted(map(tuple, reshape.csr_to_coo(pointers, values).collect())) == [(0, 5, 1.0), (0, 6, 2.0), (2, 7, 3.0)]
    with pytest.raises(ValueError):
        attacks.random_block(spark.createDataFrame([(1,), (2,)], "id long"), 5, 0)


def test_runs(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = np.triu(rng.random((16, 16)) < 0.4, 1)
    edges = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a | a.T), strict=True)], "src long, dst long, weight double").cache()
    nodes = spark.createDataFrame([(i, rng.normal(size=3).tolist(), i % 2) for i in range(16)], "id long, attr array<double>, label int").cache()
    split = spark.createDataFrame([(i, "test") for i in range(16)], "id long, part string")
    model = attacks.Linear2(rng.normal(size=(3, 2)))
    store = artifacts.Store(str(tmp_path))

    def greedy(*args, **kw):
        return attacks.greedy_rbcd(*args, epochs=1, block_size=50, **kw)

    out = experiments.run_global(Graph(edges, nodes), model, split, greedy, [0.0, 0.1], store)
    assert out.count() == 2 and len(store.find(spark, "perturbation", {"epsilon": 0.1})) == 1
    local = experiments.run_local(Graph(edges, nodes), model, [2], lambda *x: attacks.nettack(*x, cutoff=100.0), [0.3]).first()
    assert local.n_perturbations == len(local.perturbed_edges) == int(0.3 * local.degree) and local.margin <= local.initial_margin + 1e-9


def test_cached_scores_results_and_config_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    split = spark.createDataFrame([(0, "train"), (2, "val")], "id long, part string")
    experiments.cache_ppr(edges, split, f"{tmp_path}/ppr", topk=2, rounds=4)
    assert {r.src for r in shards.read_ppr(spark, f"{tmp_path}/ppr", split="val").collect()} == {2}
    path = experiments.write_results(split, f"{tmp_path}/results")
    assert spark.read.json(path).count() == 2
    (tmp_path / "c.yaml").write_text("fixed: {a: 1}\ngrid: {b: {type: choice, options: [1, 2, 1]}}\n")
    assert experiments.run_configs([f"{tmp_path}/c.yaml"], lambda a, b: a + b) == [2, 3]
    (tmp_path / "twice.yaml").write_text("fixed: {a: 1}\ngrid:\n  b: 1\n  b: 2\n")
    with pytest.raises(ValueError, match="twice"):
        experiments.read_config(f"{tmp_path}/twice.yaml")


def test_delta_stream(spark, tmp_path):
    spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, weight double").write.parquet(f"{tmp_path}/edges/v0")
    spark.createDataFrame([(2, 3, "add"), (0, 1, "del")], streaming.DELTA).coalesce(1).write.parquet(f"{tmp_path}/deltas")
    streaming.ingest(spark, f"{tmp_path}/deltas", f"{tmp_path}/edges", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.src, r.dst) for r in spark.read.parquet(f"{tmp_path}/edges/v1").collect())
    assert got == [(2, 3), (3, 2)]


FAST = ["graph_edges_undirected", "graph_stats", "sym_norm", "dimwise_median", "topk_rowwise", "loss_ce", "component_sizes", "jaccard_edges", "flagship_hop_norms"]


@pytest.mark.parametrize("name", FAST)
def test_catalogue_matches_its_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")

    def rows(df):
        return sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df())


def test_entry_point_lists_queries_with_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())
    assert not math.isnan(len(entry.queries()))


def test_training_transfer_and_poisoning(spark, tmp_path):
    """Train, attack a surrogate, judge victims and retrain on a small graph of two blocks, with stated bounds."""
    rng = np.random.default_rng(1)
    label = np.arange(24) % 2
    a = np.triu(rng.random((24, 24)) < np.where(label[:, None] == label, 0.4, 0.05), 1)
    edges = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a | a.T), strict=True)], "src long, dst long, weight double").cache()
    nodes = spark.createDataFrame([(i, [*(np.eye(2)[label[i]] + rng.normal(0, 0.4, 2)).tolist(), 1.0], int(label[i])) for i in range(24)], "id long, attr array<double>, label int").cache()
    split = spark.createDataFrame([(i, ["train", "val", "test", "test"][i // 2 % 4]) for i in range(24)], "id long, part string").cache()
    graph, store = Graph(edges, nodes), artifacts.Store(str(tmp_path))
    model, found = experiments.train_model(graph, split, store, {"dataset": "blocks"}, hidden=8, epochs=12, lr=0.1)
    assert found["train"] >= 0.8 and found["test"] >= 0.7
    again, same = experiments.train_model(graph, split, store, {"dataset": "blocks"}, hidden=8, epochs=12, lr=0.1)
    assert same == found and all(np.allclose(x, y) for x, y in zip(model.weights, again.weights, strict=True))
    assert len(store.find_models(spark, {"dataset": "blocks"})) == 1 and store.load_model({"dataset": "none"}) is None

    def greedy(*args):
        return attacks.greedy_rbcd(*args, epochs=1, block_size=400, seed=1)

    victims = {"gcn": model, "flat": lambda e, n: n.select("id", F.posexplode(F.slice("attr", 1, 2)).alias("k", "v"))}
    rows = {(r.label, r.epsilon): r.accuracy for r in experiments.run_transfer(graph, model, victims, split, greedy, [0.0, 0.3], store).collect()}
    assert rows["gcn", 0.0] == found["test"] and rows["gcn", 0.3] <= rows["gcn", 0.0] and rows["flat", 0.0] == rows["flat", 0.3]
    poisoned = experiments.run_poisoning(graph, model, split, greedy, [0.2], hidden=4, epochs=2, lr=0.1)
    assert {r.part for r in poisoned.collect()} == {"train", "val", "test"}


def test_documents_move_to_their_digest(spark, tmp_path):
    store = artifacts.Store(str(tmp_path))
    store.save("result", {"a": 1}, 5)
    old = next((tmp_path / "index").glob("*.json"))
    old.rename(tmp_path / "index" / "result-17.json")
    assert store.load("result", {"a": 1}) is None and store.migrate() == 1 and store.load("result", {"a": 1}) == 5 and store.migrate() == 0
