"""Graph archives (.npz) as a Spark data source: compressed rows to edges and attributes.

Keys are ``adj_data`` (or ``adj.data``), ``adj_indices``, ``adj_indptr``, ``adj_shape``, the same
for ``attr`` (or a dense ``attr``), ``labels`` and names. Some keys are dropped on reading.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

DROPPED = ("type", "edge_attr_matrix", "edge_attr_names")


def _open(content: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as f:
        return {k.replace(".", "_"): f[k] for k in f.files if k not in DROPPED}


def _coo(data: dict, name: str) -> pd.DataFrame:
    pointers = data[f"{name}_indptr"].astype(np.int64)
    rows = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
    return pd.DataFrame({"src": rows, "dst": data[f"{name}_indices"].astype(np.int64), "weight": data[f"{name}_data"].astype(np.float64)})


def _node_rows(data: dict) -> pd.DataFrame:
    labels = data.get("labels")
    n = int(data["adj_shape"][0])
    if labels is not None and labels.ndim == 2:
        labels = labels.argmax(1)
    if "attr" in data:
        attr = [row.tolist() for row in data["attr"].astype(np.float64)]
    else:
        dense = np.zeros(tuple(data["attr_shape"]))
        coo = _coo(data, "attr")
        np.add.at(dense, (coo["src"], coo["dst"]), coo["weight"])
        attr = dense.tolist()
    known = [None] * n if labels is None else [None if np.isnan(float(x)) else int(x) for x in labels]
    return pd.DataFrame({"id": np.arange(n), "attr": attr, "label": pd.array(known, dtype="Int32")})


def load_npz(spark: SparkSession, path: str) -> Graph:
    """Reads archives by Spark's own file reader, so any store works; one task parses one archive."""
    files = spark.read.format("binaryFile").load(path).select("content")
    if files.isEmpty():
        raise ValueError(f"no archive at {path}")

    def read(part):
        def run(batches):
            for batch in batches:
                for content in batch["content"]:
                    yield part(_open(content))

        return run

    edges = files.mapInPandas(read(lambda d: _coo(d, "adj")), "src long, dst long, weight double")
    nodes = files.mapInPandas(read(_node_rows), "id long, attr array<double>, label int")
    return Graph(edges, nodes)


def save_npz(graph: Graph, path: str) -> None:
    """Writes one small graph to a local archive; it is gathered on the driver, as an archive is one file."""
    edges = graph.edges.orderBy("src", "dst").toPandas()
    nodes = graph.nodes.orderBy("id").toPandas()
    n = len(nodes)
    np.savez(
        path, adj_data=edges["weight"].to_numpy(), adj_indices=edges["dst"].to_numpy(), adj_indptr=np.searchsorted(edges["src"].to_numpy(), np.arange(n + 1)),
        adj_shape=np.array([n, n]), attr=np.array(nodes["attr"].tolist()), labels=nodes["label"].fillna(-1).to_numpy().astype(np.int64),
    )


def load_graph(spark: SparkSession, path: str, make_undirected: bool = True, binary_attr: bool = False, feat_norm: bool = False, standardize: bool = True) -> Graph:
    """An archive or a folder with nodes and edges Parquet, prepared: unweighted, symmetric, standardised, attributes binary or normalised."""
    from ..operators.components import standardize as prepare
    from ..operators.reshape import prepare_attributes, symmetrize_binary, to_unweighted

    if path.endswith(".npz"):
        graph = load_npz(spark, path)
    else:
        graph = Graph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes"))
    if standardize:
        graph = prepare(graph.with_edges(symmetrize_binary(graph.edges) if make_undirected else graph.edges), make_undirected=make_undirected)
    else:
        graph = graph.with_edges(symmetrize_binary(graph.edges) if make_undirected else to_unweighted(graph.edges))
    return Graph(graph.edges, prepare_attributes(graph.nodes, binary_attr, feat_norm) if "attr" in graph.nodes.columns else graph.nodes)


def write_graph(graph: Graph, path: str, buckets: int | None = None) -> None:
    """Parquet tables nodes and edges; edges are clustered by src, so joins on src prune row groups."""
    edges = graph.edges.repartition(buckets, "src") if buckets else graph.edges.repartition("src")
    edges.sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def one_hot(nodes: DataFrame, classes: int) -> DataFrame:
    return nodes.withColumn("onehot", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == F.col("label"), 1.0).otherwise(0.0)))
