"""Adjacency normalisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reciprocal_power
from .reshape import coalesce, reversed_edges


def degree(edges: DataFrame, end: str = "src", name: str = "d") -> DataFrame:
    """(id, d): sum of weights by row (src) or by column (dst)."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.sum("weight").alias(name))


def degree_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees of all nodes, 0 for isolated ones."""
    return nodes.select("id").join(degree(edges), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))


def scale(edges: DataFrame, factors: DataFrame, left: str | None, right: str | None) -> DataFrame:
    """weight * left(src) * right(dst); factors(id, ...) has the columns named, absent ids have factor 0."""
    out, weight = edges.select("src", "dst", "weight"), F.col("weight")
    for end, name in (("src", left), ("dst", right)):
        if name:
            own = factors.select(F.col("id").alias(end), F.col(name).alias(f"f_{end}"))
            out = out.join(own, end, "left")
            weight = weight * F.coalesce(f"f_{end}", F.lit(0.0))
    return out.select("src", "dst", weight.alias("weight"))


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds 1 to the diagonal."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    return coalesce(edges.select("src", "dst", "weight").unionByName(loops))


def add_remaining_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Loops of weight 1 for nodes that have none; existing loops stay."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    return edges.select("src", "dst", "weight").unionByName(loops.join(edges.filter("src = dst").select("src"), "src", "left_anti").select("src", "dst", "weight"))


def symmetric(edges: DataFrame, end: str = "dst", power: float = 0.5) -> DataFrame:
    """d^-power * weight * d^-power with the sums at one end."""
    factors = degree(edges, end).withColumn("f", reciprocal_power(F.col("d"), power))
    return scale(edges, factors, "f", "f")


def row(edges: DataFrame) -> DataFrame:
    """Rows divided by their sum of absolute weights; zero rows stay."""
    sums = edges.groupBy(F.col("src").alias("id")).agg(F.sum(F.abs("weight")).alias("d"))
    return scale(edges, sums.withColumn("f", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1.0)), "f", None)


def gcn(edges: DataFrame, nodes: DataFrame, self_loops: bool = True, by_row: bool = False) -> DataFrame:
    """Remaining self loops, then symmetric normalisation by column sums, or row normalisation."""
    full = add_remaining_self_loops(edges, nodes) if self_loops else edges
    return row(full) if by_row else symmetric(full, "dst")


def a_hat(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 by row sums."""
    return symmetric(add_self_loops(edges, nodes), "src")


def power(edges: DataFrame, nodes: DataFrame, exponent: float) -> DataFrame:
    """D^exponent (A + I) D^exponent; exponent is negative."""
    return symmetric(add_self_loops(edges, nodes), "src", -exponent)


def dense(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The upper triangle is mirrored and the diagonal is 1, then symmetric normalisation."""
    upper = edges.filter("src < dst").select("src", "dst", "weight")
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    return symmetric(upper.unionByName(reversed_edges(upper)).unionByName(loops), "src")


def subgraph(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """A subgraph normalised with the degrees(id, d) of the whole graph."""
    return scale(edges, degrees.withColumn("f", reciprocal_power(F.col("d"), 0.5)), "f", "f")
