"""The data model: attributed graphs as two tables, and graph views over the driver's tables.

``edges(src long, dst long, weight double)`` and ``nodes(id long, attr array<double>, label int)``.
The long form of the attributes, ``x(id long, k int, v double)``, serves joins and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = ("src", "dst", "weight")


@dataclass(frozen=True)
class Graph:
    """An attributed graph. Steps return new graphs; tables are never changed in place."""

    edges: DataFrame
    nodes: DataFrame

    def __post_init__(self) -> None:
        for table, needed in ((self.edges, EDGE), (self.nodes, ("id",))):
            missing = set(needed) - set(table.columns)
            if missing:
                raise ValueError(f"missing columns: {sorted(missing)}")

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    @classmethod
    def from_pairs(cls, pairs: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> Graph:
        """A missing weight column, and a null weight, count as 1."""
        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
        return cls(pairs.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("weight")), nodes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("attr"), "label"
    )


def vectors_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like nodes_view, with the attributes in the table's own type, which is half as wide in a shuffle."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("attr"), "label")


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (u, v) of node ids drawn from orders; the node count is a one-row side."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(F.broadcast(n)).select((F.col("o_orderkey") % F.col("n")).alias("u"), (F.col("o_custkey") % F.col("n")).alias("v"))


def edges_view(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The undirected, unweighted graph without self loops, in both directions; if dealt, by its pairs into all shuffle partitions, none of them put together."""
    pairs = raw_pairs(spark, sf_dir).filter("u <> v")
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e"))
    both = both.select("e.*")
    if dealt:
        both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src", "dst")
    return both.distinct().withColumn("weight", F.lit(1.0))


def directed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directed graph with self loops; the weight counts repeated pairs."""
    return raw_pairs(spark, sf_dir).groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def graph_view(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(edges_view(spark, sf_dir), nodes_view(spark, sf_dir))


def long_form(nodes: DataFrame, dims: int | None = None) -> DataFrame:
    """x(id, k, v) of the attribute arrays, of the first dims columns if given."""
    attr = F.slice("attr", 1, dims) if dims else F.col("attr")
    return nodes.select("id", F.posexplode(attr).alias("k", "v"))


def nonzero_form(nodes: DataFrame) -> DataFrame:
    """attr_nz(id, k): the columns with a positive value, as binary attributes."""
    return long_form(nodes).filter("v > 0").select("id", "k")
