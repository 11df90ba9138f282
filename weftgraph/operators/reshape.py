"""Reshaping, predicates and set operations on edge and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, nonzero_form
from ..plans.lineage import cut


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def coalesce(edges: DataFrame, how: str = "sum") -> DataFrame:
    """One row per pair; duplicates are merged by sum, mean, max or min."""
    merge = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return edges.groupBy("src", "dst").agg(merge("weight").alias("weight"))


def symmetrize(edges: DataFrame, how: str = "mean") -> DataFrame:
    return coalesce(edges.unionByName(reversed_edges(edges)), how)


def symmetrize_binary(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(reversed_edges(edges)).filter("weight <> 0")
    return both.select("src", "dst").distinct().withColumn("weight", F.lit(1.0))


def to_undirected(edges: DataFrame) -> DataFrame:
    """Adds the missing opposite edges; opposite weights that differ are an error, self loops stay once."""
    spread = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    if not spread.agg((F.max("weight") - F.min("weight")).alias("gap")).filter("gap > 1e-8").isEmpty():
        raise ValueError("opposing edges have different weights")
    return coalesce(edges.unionByName(reversed_edges(edges)), "max")


def to_unweighted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def stats(graph: Graph, tolerance: float = 1e-8) -> DataFrame:
    """One row: nodes, edges, and whether the graph is directed, weighted and has self loops. One pass over the edges."""
    pairs = graph.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.count("*").alias("c"),
        F.sum(F.when(F.col("src") <= F.col("dst"), F.col("weight")).otherwise(0.0)).alias("up"),
        F.sum(F.when(F.col("src") >= F.col("dst"), F.col("weight")).otherwise(0.0)).alias("down"),
        F.max(F.when(F.col("weight") != 1, 1).otherwise(0)).alias("w"),
        F.max(F.when((F.col("src") == F.col("dst")) & (F.abs("weight") > tolerance), 1).otherwise(0)).alias("l"),
    )
    found = pairs.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.max(F.abs(F.col("up") - F.col("down")) > tolerance), F.lit(False)).alias("directed"),
        F.coalesce(F.max("w") == 1, F.lit(False)).alias("weighted"),
        F.coalesce(F.max("l") == 1, F.lit(False)).alias("self_loops"),
    )
    return graph.nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(found))


def neighbors(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("src") == node).select("dst")


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with a number from 0 in the order of the columns `by`: a range sort, and an offset for each of its partitions."""
    rows = cut(df.orderBy(*by).withColumn("place_", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("part_", F.shiftright("place_", 33)).withColumn("place_", F.col("place_").bitwiseAND(F.lit((1 << 33) - 1)))
    fronts, front = [], 0
    for part, count in sorted(rows.groupBy("part_").agg(F.count("*")).collect()):  # a row a partition
        fronts.append((part, front))
        front += count
    offsets = df.sparkSession.createDataFrame(fronts, "part_ long, front_ long")
    return rows.join(F.broadcast(offsets), "part_").withColumn(name, F.col("front_") + F.col("place_")).drop("part_", "place_", "front_")


def edge_ids(edges: DataFrame) -> DataFrame:
    """Edges numbered in (src, dst) order, from 0."""
    return numbered(edges.select("src", "dst", "weight"), ["src", "dst"], "edge_id")


def csr_to_coo(indptr: DataFrame, values: DataFrame) -> DataFrame:
    """indptr(pos, ptr), positions from 0 on, and values(pos, idx, v) of a compressed matrix to (src, dst, weight)."""
    ends = indptr.select((F.col("pos") - 1).alias("pos"), F.col("ptr").alias("end"))
    rows = indptr.join(ends, "pos").filter("end > ptr")
    places = rows.select(F.col("pos").alias("src"), F.explode(F.expr("sequence(ptr, end - 1)")).alias("pos"))
    return places.join(values, "pos").select("src", F.col("idx").alias("dst"), F.col("v").alias("weight"))


def neighbor_lists(edges: DataFrame, ids: str = "neighbors", weights: str = "weights") -> DataFrame:
    """Rows (src, neighbors, weights) of arrays to edges."""
    return edges.select("src", F.explode(F.arrays_zip(F.col(ids).alias("dst"), F.col(weights).alias("weight"))).alias("e")).select("src", "e.dst", "e.weight")


def induced_subgraph(graph: Graph, keep: DataFrame | None = None, remove: DataFrame | None = None) -> Graph:
    """The subgraph of the nodes in keep(id), or not in remove(id); exactly one is given. Ids are made dense in order."""
    if (keep is None) == (remove is None):
        raise ValueError("give exactly one of keep and remove")
    nodes = graph.nodes.join(keep.select("id").distinct(), "id", "left_semi") if keep is not None else graph.nodes.join(remove.select("id"), "id", "left_anti")
    number = numbered(nodes.select("id"), ["id"], "new")
    edges = (
        graph.edges.join(number.withColumnRenamed("id", "src").withColumnRenamed("new", "s"), "src")
        .join(number.withColumnRenamed("id", "dst").withColumnRenamed("new", "d"), "dst")
        .select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
    )
    return Graph(edges, nodes.join(number, "id").withColumn("id", F.col("new")).drop("new"))


def binarize(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("attr", F.transform("attr", lambda v: F.when(v != 0, 1.0).otherwise(0.0)))


def attr_row_norm(nodes: DataFrame) -> DataFrame:
    """Attributes divided by their row sum; rows of sum 0 stay as they are."""
    total = F.aggregate("attr", F.lit(0.0), lambda s, v: s + v)
    return nodes.withColumn("total", total).withColumn("attr", F.when(F.col("total") != 0, F.transform("attr", lambda v: v / F.col("total"))).otherwise(F.col("attr"))).drop("total")


def prepare_attributes(nodes: DataFrame, binary: bool = False, norm: bool = False) -> DataFrame:
    """Binary attributes take precedence over normalised ones."""
    return binarize(nodes) if binary else attr_row_norm(nodes) if norm else nodes


def apply_delta(edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The undirected pairs of removed leave, those of added come in with weight 1; a pair of both comes in anew.

    One outer join of the edges with all changes, so that the edges are read and shuffled once.
    """

    def both(pairs: DataFrame, new: bool) -> DataFrame:
        two = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return two.withColumn("new", F.lit(new))

    changes = both(added, True).unionByName(both(removed, False)).groupBy("src", "dst").agg(F.max("new").alias("new"), (~F.min("new")).alias("gone"))
    # A pair that leaves and comes in is a row that meets its edges and one, without an end to meet them by, that stays.
    ends = F.when(F.col("new") & F.col("gone"), F.array("dst", F.lit(None).cast("long"))).otherwise(F.array("dst"))
    changes = changes.select(F.col("src").alias("s"), F.col("dst").alias("d"), "new", "gone", F.explode(ends).alias("at"))
    there = F.col("there").isNotNull()
    met = edges.select("src", "dst", "weight", F.lit(True).alias("there")).join(changes, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("at")), "full")
    stays = F.when(there, ~F.coalesce("gone", F.lit(False))).otherwise(F.col("new") & (F.col("at").isNull() | ~F.col("gone")))
    pair = [F.when(there, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("src", "s"), ("dst", "d"))]
    return met.filter(stays).select(*pair, F.when(there, F.col("weight")).otherwise(1.0).alias("weight"))


def jaccard(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, weight, j) with the Jaccard similarity of binary attributes; null j if both rows are empty. Arrays stay beside their node: one join per end."""
    sets = nonzero_form(nodes).groupBy("id").agg(F.collect_set("k").alias("ks"))
    a = sets.select(F.col("id").alias("src"), F.col("ks").alias("ka"))
    b = sets.select(F.col("id").alias("dst"), F.col("ks").alias("kb"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    none = F.array().cast("array<int>")
    ka, kb = F.coalesce("ka", none), F.coalesce("kb", none)
    both = F.size(F.array_intersect(ka, kb))
    union = F.size(ka) + F.size(kb) - both
    return joined.select("src", "dst", "weight", F.when(union > 0, both / union).alias("j"))


def drop_dissimilar(edges: DataFrame, nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Drops both directions of pairs with a similarity of threshold or less; an undefined one keeps the edge."""
    return jaccard(edges, nodes).filter(F.col("j").isNull() | (F.col("j") > threshold)).select("src", "dst", "weight")


def filter_singletons(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (src, dst) whose flip leaves both ends with an edge; edges are undirected."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    there = edges.select("src", "dst", F.lit(1).alias("e"))
    found = candidates.join(there, ["src", "dst"], "left")
    for end in ("src", "dst"):
        found = found.join(degree.select(F.col("id").alias(end), F.col("d").alias(f"d_{end}")), end, "left")
    change = F.when(F.col("e") == 1, -1).otherwise(1)
    return found.filter((F.coalesce("d_src", F.lit(0)) + change != 0) & (F.coalesce("d_dst", F.lit(0)) + change != 0)).select(*candidates.columns)


def triu_pair(n: int | Column, lin: Column) -> tuple[Column, Column]:
    """The pair (i, j), i < j < n, with number lin in row order, for n up to 3 * 10^9.

    The root is taken of an exact whole number, so that it is off by less than one, and a
    correction by one makes the row exact.
    """
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    odd = (2 * n - 1).cast("decimal(19,0)")
    inside = odd * odd - lin.cast("decimal(19,0)") * F.lit(8).cast("decimal(19,0)")
    guess = F.floor(((2 * n - 1).cast("double") - F.sqrt(inside.cast("double"))) / 2).cast("long")

    def start(i: Column) -> Column:
        return F.shiftright(i * (2 * n - i - 1), 1)

    i = F.when(lin < start(guess), guess - 1).when(lin >= start(guess + 1), guess + 1).otherwise(guess)
    return i, lin - start(i) + i + 1


def full_pair(n: int, lin: Column) -> tuple[Column, Column]:
    row = F.floor(lin / F.lit(n)).cast("long")
    return row, lin % F.lit(n)


def perturb(edges: DataFrame, block: DataFrame, symmetric: bool = True) -> DataFrame:
    """Edges with a relaxed block (src, dst, p): weights are summed, and an edge whose weight is over 1 is flipped to 2 - weight."""
    added = block.select("src", "dst", F.col("p").alias("weight"))
    if symmetric:
        added = added.unionByName(reversed_edges(added))
    summed = coalesce(edges.select("src", "dst", "weight").unionByName(added), "sum")
    return summed.withColumn("weight", F.when(F.col("weight") > 1, 2 - F.col("weight")).otherwise(F.col("weight")))


def replace_row(edges: DataFrame, row: int, change: DataFrame, symmetric: bool = True) -> DataFrame:
    """Row `row` becomes flip(row + change(dst, p)); if symmetric, both directions get the larger weight."""
    own = edges.filter(F.col("src") == row).select("src", "dst", "weight")
    fresh = own.unionByName(change.select(F.lit(row).cast("long").alias("src"), "dst", F.col("p").alias("weight")))
    fresh = coalesce(fresh).withColumn("weight", F.when(F.col("weight") > 1, 2 - F.col("weight")).otherwise(F.col("weight")))
    rest = edges.filter(F.col("src") != row).select("src", "dst", "weight")
    if symmetric:
        rest = rest.filter(F.col("dst") != row)
        fresh = coalesce(fresh.unionByName(reversed_edges(fresh)), "max")
    return rest.unionByName(fresh)


def block_matches(block: DataFrame, edges: DataFrame) -> DataFrame:
    """block with a flag `present`: whether the pair is an edge."""
    there = edges.select("src", "dst", F.lit(True).alias("present"))
    return block.join(there, ["src", "dst"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def cooccurrence(nodes: DataFrame) -> DataFrame:
    """(k1, k2, c): in how many nodes two attributes, k1 < k2, occur together."""
    nz = nonzero_form(nodes)
    other = nz.withColumnRenamed("k", "k2")
    return nz.withColumnRenamed("k", "k1").join(other, "id").filter("k1 < k2").groupBy("k1", "k2").agg(F.count("*").alias("c"))


def khop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within hops of seeds(id), with the least number of hops."""
    reached = seeds.select("id", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        front = reached.filter(F.col("hop") == h - 1).select(F.col("id").alias("src"))
        new = edges.join(front, "src").select(F.col("dst").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        reached = cut(reached.unionByName(new.withColumn("hop", F.lit(h))), "reached")  # a hop reads it twice
    return reached
