"""Weakly connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.lineage import cut
from .reshape import induced_subgraph


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, comp): comp is the smallest node id of the component. Rounds grow with the logarithm of the diameter in the usual case."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = cut(both, "pairs")
    label = cut(nodes.select("id", F.col("id").alias("comp")), "label")
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("comp").alias("low"))
        least = label.join(near, "id", "left").select("id", "comp", F.least("comp", F.coalesce("low", "comp")).alias("low"))
        target = least.select(F.col("id").alias("low"), F.col("low").alias("jump"))
        new = cut(least.join(target, "low", "left").select("id", "comp", F.least("low", F.coalesce("jump", "low")).alias("new")), "label")
        changed = not new.filter("comp <> new").isEmpty()
        label = new.select("id", F.col("new").alias("comp"))
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def is_connected(nodes: DataFrame, edges: DataFrame) -> bool:
    """Whether the graph has exactly one component; an empty one has none."""
    return components(nodes, edges).select("comp").distinct().limit(2).count() == 1


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("comp").agg(F.count("*").alias("size"))


def largest_components(graph: Graph, n: int = 1) -> Graph:
    """The subgraph of the n largest components; equal sizes go by the smallest component id."""
    labels = components(graph.nodes, graph.edges)
    top = component_sizes(labels).orderBy(F.col("size").desc(), "comp").limit(n)
    return induced_subgraph(graph, keep=labels.join(top, "comp", "left_semi").select("id"))


def standardize(graph: Graph, make_unweighted: bool = True, make_undirected: bool = True, no_self_loops: bool = True, select_lcc: bool = True) -> Graph:
    """Each step only where asked for; returns a new graph."""
    from .reshape import remove_self_loops, to_undirected, to_unweighted

    edges = graph.edges
    edges = to_unweighted(edges) if make_unweighted else edges
    edges = to_undirected(edges) if make_undirected else edges
    edges = remove_self_loops(edges) if no_self_loops else edges
    graph = graph.with_edges(edges)
    return largest_components(graph) if select_lcc else graph


def split_per_class(nodes: DataFrame, per_class: int = 20, seed: int = 0) -> DataFrame:
    """(id, part): per class the first per_class nodes by draw are train, the next per_class val, the rest test; too small a class is an error."""
    from ..functions import uniform

    if not nodes.filter("label is not null").groupBy("label").count().filter(F.col("count") < 2 * per_class).isEmpty():
        raise ValueError(f"a class has fewer than {2 * per_class} nodes")
    order = Window.partitionBy("label").orderBy(uniform(seed, "id"), "id")
    rank = F.row_number().over(order)
    return nodes.filter("label is not null").select("id", "label", F.when(rank <= per_class, "train").when(rank <= 2 * per_class, "val").otherwise("test").alias("part"))


def stratified_split(nodes: DataFrame, train: float = 0.5, val: float = 0.3, seed: int = 0) -> DataFrame:
    """(id, part) with the shares held inside each label."""
    from ..functions import uniform

    order = Window.partitionBy("label").orderBy(uniform(seed, "id"), "id")
    share = (F.row_number().over(order) - 1) / F.count("*").over(Window.partitionBy("label"))
    return nodes.select("id", "label", F.when(share < train, "train").when(share < train + val, "val").otherwise("test").alias("part"))
