"""Local attacks on PageRank models by relaxed weights of one node's row.

The victim's logits are fixed and its output for a node is a mean of them over the node's
PageRank row. Changing the node's adjacency row changes that row by a rank-one formula: with
P the PageRank matrix, delta the difference of the normalised rows i and ratio =
(1 - alpha) / alpha, row i becomes P_i + ratio P_ii (delta P) / (1 - ratio (delta P)_i). So
output and gradient by all relaxed weights of a block follow from delta P alone, in sums over
the block's rows of P. The weighted sum of the logits Z needs no such rows, only P Z and the
column P_.i, both from one propagation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uniform
from ..plans.lineage import cut
from . import normalize, robust_gradients
from .attacks import Result, loss_gradient, ppr_propagate, project
from .ppr import power_series, rounds_for, second_order_factors
from .reshape import replace_row


@dataclass
class PprVictim:
    """A PageRank model over fixed logits(id, z array): their weighted sum by the PageRank row, or a robust mean with derivatives (robust_gradients.BACKWARD)."""

    logits: DataFrame
    alpha: float = 0.1
    mean: str = "sum"
    parameters: dict = field(default_factory=dict)


@dataclass
class Step:
    """The victim's output for the node at the block's present weights, and the block with `grad`, the derivative of the loss by p."""

    z: list[float]
    block: DataFrame


def with_presence(ids: DataFrame, edges: DataFrame, node: int, p: float) -> DataFrame:
    """(dst, p, sign): candidates of the node's row; sign is -1 for neighbours, whose weight is 1 - p, and 1 for others, whose weight is p."""
    near = edges.filter(F.col("src") == node).select("dst", F.lit(-1.0).alias("sign"))
    return ids.filter(F.col("id") != node).select(F.col("id").alias("dst"), F.lit(p).alias("p")).join(near, "dst", "left").withColumn("sign", F.coalesce("sign", F.lit(1.0)))


def _loss_slope(victim: PprVictim, node: int, z: list[float], label: int, loss_name: str) -> np.ndarray:
    spark = victim.logits.sparkSession
    one = spark.createDataFrame([(node, [float(x) for x in z])], "id long, z array<double>")
    return np.array(loss_gradient(one, spark.createDataFrame([(node, label)], "id long, label int"), loss_name).first().g)


class SumRow:
    """The node's row of a weighted sum: its state is P Z and P_.i for all nodes, wide rows from one propagation of the logits.

    undirected: the graph is, so that the propagation can be accelerated.
    """

    def __init__(self, edges: DataFrame, victim: PprVictim, node: int, tolerance: float = 1e-9, undirected: bool = True) -> None:
        self.victim, self.node = victim, node
        self.classes = len(victim.logits.first().z)
        h = victim.logits.select("id", F.concat("z", F.array(F.when(F.col("id") == node, 1.0).otherwise(0.0))).alias("h"))
        self.table = cut(ppr_propagate(edges, h, self.classes + 1, victim.alpha, rounds_for(victim.alpha, tolerance), second_order_factors(victim.alpha, tolerance) if undirected else None), "scores")
        self.own = np.array(self.table.filter(F.col("id") == node).first().h)
        start = np.array(h.filter(F.col("id") == node).first().h)
        self.before = (self.own - victim.alpha * start) / (1 - victim.alpha)  # the normalised row times the table
        self.degree = edges.filter(F.col("src") == node).count()

    def prepare(self, block: DataFrame) -> DataFrame:
        """The block with its rows of the table."""
        return block.join(self.table.select(F.col("id").alias("dst"), "h"), "dst")

    def step(self, block: DataFrame, label: int | None = None, loss_name: str = "Margin") -> Step:
        """One aggregate over the block and a few numbers a class; without a label there is no gradient."""
        signed = F.col("sign") * F.col("p")
        found = block.agg(F.sum(signed).alias("b"), *[F.sum(signed * F.col("h")[c]).alias(f"c{c}") for c in range(self.classes + 1)]).first()
        mass = self.degree + (found.b or 0.0)
        if mass <= 0:  # a row without weight keeps its old scores
            return Step(self.own[:-1].tolist(), block.withColumn("grad", F.lit(0.0)))
        sums = self.degree * self.before + np.array([x or 0.0 for x in found[1:]])
        ratio = (1 - self.victim.alpha) / self.victim.alpha
        change = sums / mass - self.before
        bottom = 1 - ratio * change[-1]
        scale = ratio * self.own[-1] / bottom
        z = self.own[:-1] + scale * change[:-1]
        if label is None:
            return Step(z.tolist(), block)
        g = _loss_slope(self.victim, self.node, z.tolist(), label, loss_name)
        pull = np.append(scale * g, ratio * scale / bottom * float(g @ change[:-1]))
        level = float(pull @ sums) / mass**2
        inner = sum((F.col("h")[c] * float(x / mass) for c, x in enumerate(pull)), F.lit(0.0))
        return Step(z.tolist(), block.withColumn("grad", F.col("sign") * (inner - level)))


class RobustRow:
    """The node's row under a robust mean, from stored exact rows ppr(src, dst, weight) of the unchanged graph; only those of the node, its neighbours and the block are read."""

    def __init__(self, edges: DataFrame, victim: PprVictim, node: int, ppr: DataFrame) -> None:
        self.victim, self.node, self.ppr = victim, node, ppr
        self.near = cut(edges.filter(F.col("src") == node).select("dst"), "neighbours")
        self.degree = self.near.count()
        self.own = cut(ppr.filter(F.col("src") == node).select("dst", "weight"), "row")
        self.p_ii = self.own.filter(F.col("dst") == node).first().weight
        self.z = victim.logits.select("id", F.col("z").alias("h"))
        self.classes = len(victim.logits.first().z)
        self.rows = None

    def prepare(self, block: DataFrame) -> DataFrame:
        needed = block.select(F.col("dst").alias("src")).unionByName(self.near.select(F.col("dst").alias("src"))).distinct()
        self.rows = cut(self.ppr.join(needed, "src").select("src", "dst", "weight"), "rows")
        return block

    def _row(self, block: DataFrame) -> tuple[DataFrame, DataFrame, float, float, float]:
        """delta(src, new, delta), the changed row(src, dst, weight, r), and the formula's numbers."""
        old = self.near.select("dst", F.lit(1.0).alias("old"), F.lit(1.0).alias("new"))
        more = block.select("dst", F.lit(0.0).alias("old"), (F.col("sign") * F.col("p")).alias("new"))
        both = cut(old.unionByName(more).groupBy(F.col("dst").alias("src")).agg(F.sum("old").alias("old"), F.sum("new").alias("new")), "delta")
        mass = both.agg(F.sum("new")).first()[0] or 0.0
        share = (F.col("new") / mass if mass > 0 else F.lit(0.0)) - (F.col("old") / self.degree if self.degree else F.lit(0.0))
        both = both.withColumn("delta", share)
        moved = cut(self.rows.join(both.select("src", "delta"), "src").groupBy("dst").agg(F.sum(F.col("weight") * F.col("delta")).alias("r")), "moved")
        ratio = (1 - self.victim.alpha) / self.victim.alpha
        at = moved.filter(F.col("dst") == self.node).first()
        bottom = 1 - ratio * (at.r if at else 0.0)
        scale = ratio * self.p_ii / bottom
        row = self.own.join(moved, "dst", "full").select(
            F.lit(self.node).cast("long").alias("src"), "dst", (F.coalesce("weight", F.lit(0.0)) + scale * F.coalesce("r", F.lit(0.0))).alias("weight"), F.coalesce("r", F.lit(0.0)).alias("r")
        )
        return both, cut(row.filter("weight > 0"), "row"), mass, bottom, scale

    def step(self, block: DataFrame, label: int | None = None, loss_name: str = "Margin") -> Step:
        both, row, mass, bottom, scale = self._row(block)
        mean, parameters = self.victim.mean, self.victim.parameters
        found = robust_gradients.forward(row, self.z, mean, parameters).first()
        z = list(found.h) if found else [0.0] * self.classes
        if label is None or found is None or mass <= 0:
            return Step(z, block if label is None else block.withColumn("grad", F.lit(0.0)))
        spark = block.sparkSession
        g = _loss_slope(self.victim, self.node, z, label, loss_name)
        one = spark.createDataFrame([(self.node, g.tolist())], "id long, g array<double>")
        terms = cut(robust_gradients.backward(row, self.z, one, self.classes, mean, parameters, False)[0].select("dst", "term"), "terms")
        across = row.join(terms, "dst").agg(F.sum(F.col("term") * F.col("r"))).first()[0] or 0.0
        ratio = (1 - self.victim.alpha) / self.victim.alpha
        pull = F.col("term") * scale + F.when(F.col("dst") == self.node, ratio * scale / bottom * across).otherwise(0.0)
        own = spark.createDataFrame([(self.node, 0.0)], "dst long, term double")  # the bottom moves even where the node's own score is 0
        by_entry = terms.unionByName(own).groupBy("dst").agg(F.sum("term").alias("term")).select("dst", pull.alias("pull"))
        by_row = cut(self.rows.join(by_entry, "dst").groupBy("src").agg(F.sum(F.col("weight") * F.col("pull")).alias("h")), "pulls")
        level = both.join(by_row, "src").agg(F.sum(F.col("new") * F.col("h"))).first()[0] or 0.0
        found = block.join(by_row.withColumnRenamed("src", "dst"), "dst", "left")
        return Step(z, found.withColumn("grad", F.col("sign") * (F.coalesce("h", F.lit(0.0)) - level / mass) / mass).drop("h"))


def margin_of(z: list[float], label: int) -> float:
    """Probability of the label less that of the best other class."""
    e = np.exp(np.array(z) - max(z))
    e /= e.sum()
    return float(e[label] - max(x for c, x in enumerate(e) if c != label))


def candidates(nodes: DataFrame, node: int, size: int, seed: int | str) -> DataFrame:
    """Up to size other nodes, by the order of a draw."""
    return nodes.filter(F.col("id") != node).select("id").orderBy(uniform(seed, "id"), "id").limit(size)


def exact_logits(edges: DataFrame, victim: PprVictim, node: int, tolerance: float = 1e-7) -> list[float]:
    """The victim's output for the node on a graph, from its PageRank row computed anew; a node without edges has its own logits."""
    spark = edges.sparkSession
    row = power_series(cut(normalize.row(edges), "walk"), spark.createDataFrame([(node,)], "id long"), victim.alpha, tolerance=tolerance)
    if victim.mean == "sum":
        classes = len(victim.logits.first().z)
        found = row.join(victim.logits.withColumnRenamed("id", "dst"), "dst").agg(*[F.sum(F.col("weight") * F.col("z")[c]) for c in range(classes)]).first()
        return list(found)
    return list(robust_gradients.forward(row, victim.logits.select("id", F.col("z").alias("h")), victim.mean, victim.parameters).first().h)


def local_batched_prbcd(
    edges: DataFrame, nodes: DataFrame, victim: PprVictim, node: int, budget: int, epochs: int = 150, fine_tune: int = 50, block_size: int = 10_000, lr_factor: float = 1.0,
    loss_name: str = "Margin", samples: int = 20, seed: int = 0, eps: float = 1e-14, ppr: DataFrame | None = None, symmetric: bool = True,
) -> Result:
    """Projected randomised block coordinate descent on the relaxed weights of one node's row.

    An epoch is the gradient of the loss by the rank-one update, a step, the projection on
    the budget, and (until the last fine_tune epochs) a block whose lower half is drawn
    anew. The epoch of least margin wins. Final pairs: the best of the `budget` largest
    weights and of Bernoulli draws within the budget; none if the margin never fell. The last
    trace row has the margin of the changed graph, its PageRank row computed anew. edges are
    unweighted and without loops; a robust victim needs ppr, the exact rows of its graph;
    symmetric: the pairs are flipped in both directions in the result.
    """
    if victim.mean != "sum" and ppr is None:
        raise ValueError("a robust mean needs the PageRank rows")
    state = SumRow(edges, victim, node) if victim.mean == "sum" else RobustRow(edges, victim, node, ppr)
    label = nodes.filter(F.col("id") == node).first().label
    n = nodes.count()
    factor = lr_factor * max(math.sqrt(n / block_size), 1.0) * budget

    def fresh(name: str) -> DataFrame:
        return with_presence(candidates(nodes, node, block_size, f"{seed}-{name}"), edges, node, eps)

    block = cut(state.prepare(fresh("0")), "block")
    extra = [c for c in block.columns if c not in ("dst", "p", "sign")]
    start = margin_of(state.step(block.limit(0)).z, label)
    trace, best = [], (math.inf, None)
    for epoch in range(epochs):
        found = state.step(block, label, loss_name)
        lr = factor / math.sqrt(max(0, epoch - (epochs - fine_tune)) + 1)
        block = cut(found.block.withColumn("p", F.col("p") + lr * F.col("grad")).drop("grad"), "moved")
        block = cut(project(block, budget, eps), "block")
        margin = margin_of(state.step(block).z, label)
        trace.append({"epoch": epoch, "margin": margin, "mass": block.agg(F.sum("p")).first()[0]})
        if margin < best[0]:
            best = (margin, block)
        if epoch < epochs - fine_tune - 1:
            total, low = block.agg(F.count("*"), F.count(F.when(F.col("p") <= eps, 1))).first()
            kept = block.drop(*extra).orderBy(F.col("p").desc(), "dst").limit(total - max(low, total // 2))
            new = fresh(str(epoch + 1)).join(kept.select("dst"), "dst", "left_anti").limit(max(0, block_size - (total - max(low, total // 2))))
            block = cut(state.prepare(kept.unionByName(new)), "block")
        elif epoch == epochs - fine_tune - 1:
            block = cut(state.prepare(best[1].drop(*extra)), "block")
    spark = edges.sparkSession
    none = spark.createDataFrame([], "src long, dst long")
    if best[1] is None or best[0] > start:
        return Result(none, edges, trace)
    block = cut(state.prepare(best[1].drop(*extra)), "block")
    final = (math.inf, None)
    for s in range(samples):
        if s == 0:
            drawn = block.filter(F.col("p") > eps).orderBy(F.col("p").desc(), "dst").limit(budget)
        else:
            drawn = block.filter((F.col("p") > eps) & (uniform(f"{seed}-final-{s}", "dst") < F.col("p")))
        drawn = cut(drawn.withColumn("p", F.lit(1.0)), "drawn")
        if 0 < drawn.count() <= budget:
            margin = margin_of(state.step(drawn).z, label)
            if margin < final[0]:
                final = (margin, drawn)
    if final[1] is None:
        return Result(none, edges, trace)
    changed = cut(replace_row(edges, node, final[1].select("dst", "p"), symmetric).filter("weight > 1e-9"), "edges")
    trace.append({"epoch": epochs, "margin": final[0], "exact_margin": margin_of(exact_logits(changed, victim, node), label)})
    return Result(final[1].select(F.lit(node).cast("long").alias("src"), "dst"), changed, trace)
