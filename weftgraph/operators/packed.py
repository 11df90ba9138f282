"""A graph that many products share: its edges are gathered by their end and written once, so that a hop moves node rows only.

A hop is a join by the end and a sum that every partition begins on its own: rows x partitions
wide rows are shuffled, and of an edge its start alone. A few changed edges
stand beside the table as differences, so that a search over perturbed graphs never writes
the edges again.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reciprocal_power
from ..plans.lineage import cut
from .normalize import add_remaining_self_loops
from .reshape import coalesce, reversed_edges

#: Nodes for each of which the parts of a packed table are once the number of cores.
SHARE = 1 << 20


def parts_for(nodes: DataFrame) -> int:
    return nodes.sparkSession.sparkContext.defaultParallelism * max(1, -(-nodes.count() // SHARE))


def pack(edges: DataFrame, parts: int) -> DataFrame:
    """(id, weight, srcs): a row for all edges of one weight that end in id, dealt by id, and written."""
    dealt = edges.select("src", F.col("dst").alias("id"), "weight").repartition(parts, "id")
    return cut(dealt.groupBy("id", "weight").agg(F.collect_list("src").alias("srcs")), "packed")


def unpack(packed: DataFrame) -> DataFrame:
    """The edges (src, dst, weight)."""
    return packed.select(F.explode("srcs").alias("src"), F.col("id").alias("dst"), "weight")


def hop(packed: DataFrame, rows: DataFrame, columns: list[str], parts: int, extra: DataFrame | None = None) -> DataFrame:
    """A @ X for rows(id, columns...): (id, columns...), in so few parts that their sums are short; extra(src, dst, weight), some edges more, are added to A."""
    moved = packed.join(rows, "id").select(F.explode("srcs").alias("src"), *[(F.col("weight") * F.col(c)).alias(c) for c in columns]).coalesce(parts)
    sums = moved.groupBy("src").agg(*[F.sum(c).alias(c) for c in columns])
    if extra is not None:
        more = extra.select("src", F.col("dst").alias("id"), "weight").join(rows, "id").select("src", *[(F.col("weight") * F.col(c)).alias(c) for c in columns])
        sums = sums.unionByName(more).groupBy("src").agg(*[F.sum(c).alias(c) for c in columns])
    return sums.withColumnRenamed("src", "id")


@dataclass
class Adjacency:
    """The adjacency with remaining self loops, symmetrically normalised by column sums, after a few changes (extra).

    factors(id, d, s): the column sums and their reciprocal roots, as rows of the products are
    scaled by them and no edge is.
    """

    packed: DataFrame
    parts: int
    extra: DataFrame | None = None
    factors: DataFrame | None = None
    back: list = field(default_factory=list)

    @classmethod
    def of(cls, edges: DataFrame, nodes: DataFrame) -> Adjacency:
        parts = parts_for(nodes)
        return cls(pack(add_remaining_self_loops(coalesce(edges), nodes), parts), parts)._with_factors()

    def _with_factors(self) -> Adjacency:
        d = self.packed.groupBy("id").agg(F.sum(F.col("weight") * F.size("srcs")).alias("d"))
        if self.extra is not None:
            d = d.unionByName(self.extra.select(F.col("dst").alias("id"), F.col("weight").alias("d"))).groupBy("id").agg(F.sum("d").alias("d"))
        return replace(self, factors=cut(d.select("id", "d", reciprocal_power(F.col("d"), 0.5).alias("s")), "factors"))

    def _reversed(self) -> DataFrame:
        """The table packed by the edges' start; made once, and shared with what was made from this by changes."""
        if not self.back:
            self.back.append(pack(reversed_edges(unpack(self.packed)), self.parts))
        return self.back[0]

    def hop(self, rows: DataFrame, width: int, name: str = "h", back: bool = False) -> DataFrame:
        """A @ H, or its transpose's product, for rows(id, h array): (id, name)."""
        columns = [f"c{c}" for c in range(width)]
        scaled = rows.join(self.factors.select("id", "s"), "id").select("id", *[(F.col("s") * F.col("h")[c]).alias(n) for c, n in enumerate(columns)])
        extra = reversed_edges(self.extra) if back and self.extra is not None else self.extra
        out = hop(self._reversed() if back else self.packed, scaled, columns, self.parts, extra)
        s = F.coalesce("s", F.lit(0.0))
        return out.join(self.factors.select("id", "s"), "id", "left").select("id", F.array(*[s * F.col(n) for n in columns]).alias(name))

    def starts(self, node: int) -> DataFrame:
        """(id, a): the ends of the node's edges and their weights."""
        found = self.packed.filter(F.array_contains("srcs", F.lit(node).cast("long"))).select("id", F.col("weight").alias("a"))
        if self.extra is None:
            return found
        more = self.extra.filter(F.col("src") == node).select(F.col("dst").alias("id"), F.col("weight").alias("a"))
        return found.unionByName(more).groupBy("id").agg(F.sum("a").alias("a")).filter("a > 1e-9")

    def matches(self, pairs: DataFrame) -> DataFrame:
        """pairs(src, dst, ...), each once, with `present`, whether it is an edge, and its weight `own`, else 0."""
        there = pairs.select("src", F.col("dst").alias("id")).join(self.packed, "id").filter(F.array_contains("srcs", F.col("src")))
        there = there.select("src", F.col("id").alias("dst"), F.col("weight").alias("own"), F.lit(False).alias("moved"))
        if self.extra is not None:
            there = there.unionByName(self.extra.select("src", "dst", F.col("weight").alias("own"), F.lit(True).alias("moved")))
            there = there.groupBy("src", "dst").agg(F.sum("own").alias("own"), F.max("moved").alias("moved")).filter("not moved or own > 1e-9")
        found = pairs.join(there.withColumn("present", F.lit(True)), ["src", "dst"], "left").drop("moved")
        return found.withColumns({"present": F.coalesce("present", F.lit(False)), "own": F.coalesce("own", F.lit(0.0))})

    def perturbed(self, block: DataFrame) -> Adjacency:
        """After a relaxed block(src, dst, p) in both directions, as of reshape.perturb: p is added, and a weight over 1 is flipped to 2 - weight."""
        added = block.select("src", "dst", F.col("p").alias("weight"))
        added = self.matches(coalesce(added.unionByName(reversed_edges(added)))).withColumn("weight", F.col("own") + F.col("weight"))
        change = F.when(F.col("weight") > 1, 2 - F.col("weight")).otherwise(F.col("weight")) - F.col("own")
        extra = added.select("src", "dst", change.alias("weight"))
        if self.extra is not None:
            extra = coalesce(self.extra.unionByName(extra))
        return replace(self, extra=cut(extra, "changes"))._with_factors()
