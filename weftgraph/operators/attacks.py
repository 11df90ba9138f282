"""Edge-perturbation analysis: budgets, random and gradient attacks, greedy and local variants."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ACTIVATIONS, below, clamp, dot, reciprocal_power, uniform
from ..plans.lineage import cut
from . import normalize, robust_gradients
from .losses import split_name
from .packed import Adjacency, hop, pack, parts_for, unpack
from .reshape import block_matches, khop, perturb, replace_row, reversed_edges, triu_pair

# ---------------------------------------------------------------- budget and blocks


def project(block: DataFrame, budget: float, eps: float = 0.0, value: str = "p") -> DataFrame:
    """Clamps p to [eps, 1 - eps]; if the clamped sum is over the budget, first shifts p by the mu that meets it.

    The sum of clamp(p - mu, 0, 1) falls piecewise linearly in mu. Bisection runs as one
    aggregate a round over a whole grid of candidates, so a few passes settle it.
    """
    if (block.agg(F.sum(clamp(F.col(value), 0.0, 1.0))).first()[0] or 0.0) <= budget:
        return block.withColumn(value, clamp(F.col(value), eps, 1 - eps))
    lo, hi = block.agg(F.min(value) - 1, F.max(value)).first()
    for _ in range(6):
        grid = np.linspace(lo, hi, 33)[1:-1].tolist()
        sums = block.agg(*[F.sum(clamp(F.col(value) - m, 0.0, 1.0)) for m in grid]).first()
        above = [m for m, s in zip(grid, sums, strict=True) if s > budget]
        below = [m for m, s in zip(grid, sums, strict=True) if s <= budget]
        lo, hi = max(above, default=lo), min(below, default=hi)
    return block.withColumn(value, clamp(F.col(value) - (lo + hi) / 2, eps, 1 - eps))


def random_block(nodes: DataFrame, size: int, seed: int | str, eps: float = 1e-7) -> DataFrame:
    """(lin, src, dst, p): up to size distinct pairs src < dst drawn from all pairs; ids must be 0 to n - 1."""
    n, low, high = nodes.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if n and (low, high) != (0, n - 1):
        raise ValueError("a block needs node ids from 0 to n - 1; see components.standardize")
    pairs = n * (n - 1) // 2
    drawn = nodes.sparkSession.range(size).select(below(pairs, seed, "id").alias("lin")).distinct()
    i, j = triu_pair(n, F.col("lin"))
    return drawn.select("lin", i.alias("src"), j.alias("dst"), F.lit(eps).alias("p"))


def keep_upper_half(block: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Drops the max(count of p <= eps, half) lowest entries, ties by id."""
    total, low = block.agg(F.count("*"), F.count(F.when(F.col("p") <= eps, 1))).first()
    keep = total - max(low, total // 2)
    return block.orderBy(F.col("p").desc(), "lin").limit(keep) if keep else block.limit(0)


def resample(block: DataFrame, nodes: DataFrame, size: int, seed: int | str, eps: float = 1e-7) -> DataFrame:
    """The kept upper half with its weights, refilled with new pairs."""
    kept = keep_upper_half(block, eps)
    fresh = random_block(nodes, size, seed, eps).join(kept.select("lin"), "lin", "left_anti")
    return kept.unionByName(fresh.limit(max(0, size - kept.count())))


# ---------------------------------------------------------------- random attacks


def dice_delete(edges: DataFrame, nodes: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """Budget existing pairs src < dst with equal labels, in the order of a draw."""
    a, b = (nodes.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst"))
    same = edges.filter("src < dst").join(a, "src").join(b, "dst").filter("l_src = l_dst")
    return same.select("src", "dst", uniform(f"{seed}-del", "src", "dst").alias("u")).orderBy("u", "src", "dst").limit(budget).select("src", "dst")


def dice_add(edges: DataFrame, nodes: DataFrame, budget: int, seed: int = 0, factor: int = 8) -> DataFrame:
    """Budget absent pairs src < dst with different labels, among factor * budget drawn candidates; more are drawn while that falls short.

    A budget over the number of such pairs is an error.
    """
    n = nodes.count()
    room = None
    a, b = (nodes.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst"))
    while True:
        count = max(64, budget * factor)
        ids = nodes.sparkSession.range(count)
        i, j = F.floor(uniform(f"{seed}-i", "id") * n).cast("long"), F.floor(uniform(f"{seed}-j", "id") * n).cast("long")
        drawn = ids.select("id", F.least(i, j).alias("src"), F.greatest(i, j).alias("dst")).filter("src < dst")
        drawn = drawn.groupBy("src", "dst").agg(F.min("id").alias("id"))
        good = drawn.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").join(a, "src").join(b, "dst").filter("l_src <> l_dst")
        picked = good.orderBy("id").limit(budget).select("src", "dst")
        if picked.count() == budget:
            return picked
        if room is None:  # all pairs of different labels, less those that are edges
            same = nodes.groupBy("label").agg(F.count("*").alias("c")).agg(F.sum(F.expr("c * (c - 1) div 2"))).first()[0] or 0
            joined = edges.filter("src < dst").select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("l_src <> l_dst")
            room = n * (n - 1) // 2 - same - joined.count()
        if budget > room:
            raise ValueError(f"a budget of {budget} additions, but only {room} absent pairs have different labels")
        factor *= 8


def dice(edges: DataFrame, nodes: DataFrame, budget: int, add_ratio: float = 0.6, seed: int = 0) -> DataFrame:
    """The perturbed edge table: int(budget * add_ratio) additions, then the rest as deletions."""
    from .reshape import apply_delta

    adds = int(budget * add_ratio)
    return apply_delta(edges, dice_add(edges, nodes, adds, seed), dice_delete(edges, nodes, budget - adds, seed))


def local_dice(edges: DataFrame, nodes: DataFrame, node: int, budget: int, add_ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """(op, dst): deletions of same-label neighbours first, what they leave of the budget as additions of other-label non-neighbours."""
    label = nodes.filter(F.col("id") == node).first().label
    quota = budget - int(budget * add_ratio)
    near = edges.filter(F.col("src") == node).select(F.col("dst").alias("id"))
    others = nodes.filter(F.col("id") != node)
    same = others.filter(F.col("label") == label).join(near, "id", "left_semi").select("id", uniform(f"{seed}-del", "id").alias("u"))
    gone = same.orderBy("u", "id").limit(quota)
    n_gone = min(quota, same.count())
    far = others.filter(F.col("label") != label).join(near, "id", "left_anti").select("id", uniform(f"{seed}-add", "id").alias("u"))
    new = far.orderBy("u", "id").limit(budget - n_gone)
    return gone.select(F.lit("del").alias("op"), F.col("id").alias("dst")).unionByName(new.select(F.lit("add").alias("op"), F.col("id").alias("dst")))


# ---------------------------------------------------------------- gradients


@dataclass
class Linear2:
    """A surrogate: two hops of symmetric propagation, then a linear layer. weight is features x classes."""

    weight: np.ndarray
    bias: np.ndarray | None = None
    temperature: float = 1.0
    activation: str = "Identity"

    @property
    def layers(self) -> list[tuple]:
        return [(self.weight / self.temperature, None), (None, self.bias)]


@dataclass
class Gcn:
    """A graph convolutional network of any depth: Z_l = A act(Z_(l-1)) W_l + b_l. weights are inputs x outputs; a bias may be None.

    Dropout is off, as in evaluation. The weights go into the plan, so they are for layers of
    some ten thousand entries.
    """

    weights: list[np.ndarray]
    biases: list | None = None
    activation: str = "ReLU"
    temperature: float = 1.0

    @property
    def layers(self) -> list[tuple]:
        biases = self.biases or [None] * len(self.weights)
        out = list(zip(self.weights, biases, strict=True))
        w, b = out[-1]
        return [*out[:-1], (w / self.temperature, None if b is None else b / self.temperature)]


@dataclass
class Rgnn(Gcn):
    """A Gcn whose neighbour sum is a robust mean of robust.ROBUST_MEANS with these parameters; soft_k_medoid and soft_median have derivatives."""

    mean: str = "soft_k_medoid"
    parameters: dict = field(default_factory=dict)


Model = Linear2 | Gcn | Rgnn


def _times(h: Column, w: np.ndarray | None) -> Column:
    """An array column times a small matrix; None stands for the identity."""
    return h if w is None else F.array(*[dot(h, F.array(*map(F.lit, w[:, c].tolist()))) for c in range(w.shape[1])])


def _projected(nodes: DataFrame, model: Model) -> DataFrame:
    """(id, h): attributes times the first layer's weights."""
    return nodes.select("id", _times(F.col("attr"), model.layers[0][0]).alias("h"))


def _slope(z: Column, name: str) -> Column:
    """Derivative of an activation at z."""
    table = {
        "Identity": lambda v: F.lit(1.0),
        "ReLU": lambda v: F.when(v > 0, 1.0).otherwise(0.0),
        "LeakyReLU": lambda v: F.when(v >= 0, 1.0).otherwise(0.01),
        "ELU": lambda v: F.when(v > 0, 1.0).otherwise(F.exp(v)),
        "Tanh": lambda v: 1 - F.tanh(v) * F.tanh(v),
    }
    return F.transform(z, table[name])


def _forward(a: DataFrame | Adjacency, nodes: DataFrame, model: Model, keep=lambda z: z) -> list[tuple]:
    """Per layer (inputs times weights, outputs, width): (id, h) and (id, z) on the normalised adjacency a; keep may cut the outputs that another layer needs."""
    act = ACTIVATIONS[model.activation]
    out, h = [], nodes.select("id", F.col("attr").alias("h"))
    width = 0
    for w, b in model.layers:
        width = width if w is None else w.shape[1]
        p = h.select("id", _times(F.col("h"), w).alias("h"))
        p = keep(p) if isinstance(model, Rgnn) else p  # a robust mean reads its rows more than once
        z = (robust_gradients.forward(a, p, model.mean, model.parameters) if isinstance(model, Rgnn) else _product(a, p, width)).withColumnRenamed("h", "z")
        if b is not None:
            z = z.select("id", F.zip_with("z", F.array(*map(F.lit, np.asarray(b).tolist())), lambda x, y: x + y).alias("z"))
        z = keep(z) if len(out) < len(model.layers) - 1 else z
        out.append((p, z, width))
        h = z.select("id", F.transform("z", act).alias("h"))
    return out


def _hop(edges: DataFrame, h: DataFrame, classes: int, name: str = "h") -> DataFrame:
    """A @ H with wide rows."""
    joined = edges.select("src", F.col("dst").alias("id"), "weight").join(h, "id")
    sums = joined.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("weight") * F.col("h")[c]).alias(f"c{c}") for c in range(classes)])
    return sums.select("id", F.array(*[F.col(f"c{c}") for c in range(classes)]).alias(name))


def _product(a: DataFrame | Adjacency, h: DataFrame, classes: int) -> DataFrame:
    return a.hop(h, classes) if isinstance(a, Adjacency) else _hop(a, h, classes)


def surrogate_logits(edges: DataFrame | Adjacency, nodes: DataFrame, model: Model) -> DataFrame:
    """(id, z array) of the model on edges, which are normalised with remaining self loops."""
    if isinstance(edges, DataFrame):
        edges = normalize.gcn(edges, nodes) if isinstance(model, Rgnn) else Adjacency.of(edges, nodes)
    return _forward(edges, nodes, model)[-1][1]


def long_logits(wide: DataFrame) -> DataFrame:
    return wide.select("id", F.posexplode("z").alias("class", "z"))


def loss_gradient(logits: DataFrame, labels: DataFrame, name: str = "CE") -> DataFrame:
    """(id, g array): gradient of a loss of losses.LOSSES with respect to the logits of each node.

    Means over all nodes divide by their number, means over the rightly classified ones by
    theirs; both counts are one-row sides.
    """
    kind, share = split_name(name)
    joined = logits.join(labels.select("id", "label"), "id")
    top = F.array_max("z")
    e = F.transform("z", lambda v: F.exp(v - top))
    soft = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x))
    wrong = F.transform("z", lambda v, i: F.when(i == F.col("label"), F.lit(float("-inf"))).otherwise(v))
    best = F.array_position(wrong, F.array_max(wrong)) - 1
    m = F.element_at("z", F.col("label") + 1) - F.array_max(wrong)
    right = F.array_position("z", top) - 1 == F.col("label")
    joined = joined.withColumns({"soft": soft, "best": best, "m": m, "right": right})
    m, right = F.col("m"), F.col("right")
    tanh = 1 - F.tanh(m) * F.tanh(m)
    hinge = F.when(m > 0, 1.0).otherwise(0.0)
    # By loss: the factor on the margin's fall, on the cross entropy of all, of the right ones, and on that of the best wrong class.
    none = F.lit(0.0)
    factors = {
        "CE": (none, F.lit(1.0), none, none),
        "CW": (hinge, none, none, none),
        "LCW": (F.when(m > 0, 1.0).otherwise(0.1), none, none, none),
        "Margin": (F.lit(1.0), none, none, none),
        "tanhMargin": (tanh, none, none, none),
        "tanhMarginCW": (share * tanh + (1 - share) * hinge, none, none, none),
        "tanhMarginMCE": (share * tanh, none, F.lit(1.0 - share), none),
        "eluMargin": (F.when(m > 0, 1.0).otherwise(F.exp(m)), none, none, none),
        "MCE": (none, none, F.lit(1.0), none),
        "NCE": (none, none, none, F.lit(1.0)),
    }
    fall, entropy, of_right, of_wrong = factors[kind]
    counts = joined.agg(F.count("*").alias("n"), F.greatest(F.count(F.when(right, 1)), F.lit(1)).alias("n_right"))
    counted = joined.join(F.broadcast(counts))
    fall, entropy, of_wrong = (x / F.col("n") for x in (fall, entropy, of_wrong))
    entropy = entropy + F.when(right, of_right / F.col("n_right")).otherwise(0.0)
    y, b = F.col("label"), F.col("best")

    def one(i, at):
        return F.when(i == at, 1.0).otherwise(0.0)

    g = F.transform("soft", lambda p, i: fall * (one(i, b) - one(i, y)) + entropy * (p - one(i, y)) + of_wrong * (one(i, b) - p))
    return counted.select("id", g.alias("g"))


def edge_gradient(edges: DataFrame | Adjacency, nodes: DataFrame, model: Model, targets: DataFrame, pairs: DataFrame, loss_name: str = "CE", symmetric: bool = True) -> DataFrame:
    """pairs(src, dst, ...) with `grad`, the derivative of the loss by the weight of the pair before normalisation.

    Closed form for layers Z_l = A P_l, A = s a s, s = d^-1/2 of the column sums: with g_l the
    loss's gradient by Z_l, the terms G_ij = sum over layers of <g_l,i , P_l,j> give dL/da_ij =
    G_ij s_i s_j - 1/2 d_j^-1 b_j with b_j = sum_l G_jl A_jl + sum_k G_kj A_kj = sum over layers
    of <g_l,j , (A P_l)_j> + <(A^T g_l)_j , P_l,j>, so that no edge meets a wide row but in
    the hops. Backwards, g_(l-1) is (A^T g_l W_l^T) times the activation's slope. The pairs meet
    wide rows. A robust mean gives its own terms G_ij instead, for the edges only
    (robust_gradient). edges may be packed already, but for a robust mean.
    """
    if isinstance(model, Rgnn):
        return robust_gradient(edges, nodes, model, targets, pairs, loss_name, symmetric)
    a = Adjacency.of(edges, nodes) if isinstance(edges, DataFrame) else edges
    passed = _forward(a, nodes, model, lambda z: cut(z, "layer"))

    def zero(width: int) -> Column:
        return F.array(*[F.lit(0.0)] * width)

    last = cut(passed[-1][1], "logits")
    parts = nodes.select("id").join(a.factors, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"), F.lit(0.0).alias("b"))
    g = loss_gradient(last, targets, loss_name)
    for layer in range(len(passed), 0, -1):
        p, z, width = passed[layer - 1]
        z, bias = last if layer == len(passed) else z, model.layers[layer - 1][1]
        g = cut(nodes.select("id").join(g, "id", "left").select("id", F.coalesce("g", zero(width)).alias("g")), "gradient")
        back = a.hop(g.withColumnRenamed("g", "h"), width, "u", back=True)
        back = cut(back, "back") if layer > 1 else back
        sums = z if bias is None else z.select("id", F.zip_with("z", F.array(*map(F.lit, np.asarray(bias).tolist())), lambda x, y: x - y).alias("z"))
        for rows, old, new in ((g, "g", f"g{layer}"), (p, "h", f"p{layer}"), (sums, "z", "z"), (back, "u", "u")):
            parts = parts.join(rows.withColumnRenamed(old, new), "id", "left").withColumn(new, F.coalesce(new, zero(width)))
        parts = parts.withColumn("b", F.col("b") + dot(F.col(f"g{layer}"), F.col("z")) + dot(F.col("u"), F.col(f"p{layer}"))).drop("z", "u")
        if layer > 1:
            w = model.layers[layer - 1][0]
            slope = passed[layer - 2][1].select("id", _slope(F.col("z"), model.activation).alias("s"))
            g = back.select("id", _times(F.col("u"), None if w is None else w.T).alias("u")).join(slope, "id").select("id", F.zip_with("u", "s", lambda x, y: x * y).alias("g"))
    number = range(len(passed), 0, -1)
    parts = cut(parts.select("id", "d", "b", F.concat(*[F.col(f"g{i}") for i in number]).alias("g"), F.concat(*[F.col(f"p{i}") for i in number]).alias("h")), "parts")
    left = parts.select(F.col("id").alias("src"), "g", F.col("d").alias("d_i"))
    right = parts.select(F.col("id").alias("dst"), "h", F.col("d").alias("d_j"), "b")
    each = _ways(pairs, symmetric).join(left, "src").join(right, "dst")
    return _by_pair(pairs, each, dot(F.col("g"), F.col("h")))


def _ways(pairs: DataFrame, symmetric: bool) -> DataFrame:
    """Each pair once, or forth and back."""
    two = pairs.select("src", "dst").distinct()
    ways = two.select("src", "dst", F.lit(True).alias("forth"))
    if symmetric:
        ways = ways.unionByName(two.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("forth")))
    return ways


def _by_pair(pairs: DataFrame, each: DataFrame, term: Column) -> DataFrame:
    """pairs with `grad`, by the weights before normalisation; each way has its degrees d_i and d_j, and b, the sum of the terms times the normalised weights of the edges at dst."""
    scaled = term / F.sqrt(F.col("d_i") * F.col("d_j")) - F.coalesce("b", F.lit(0.0)) / (2 * F.col("d_j"))
    each = each.select(F.when(F.col("forth"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(F.col("forth"), F.col("dst")).otherwise(F.col("src")).alias("dst"), scaled.alias("grad"))
    return pairs.join(each.groupBy("src", "dst").agg(F.sum("grad").alias("grad")), ["src", "dst"])


def robust_gradient(edges: DataFrame, nodes: DataFrame, model: Rgnn, targets: DataFrame, pairs: DataFrame, loss_name: str = "CE", symmetric: bool = True) -> DataFrame:
    """edge_gradient through robust means. The pairs are edges, of however small a weight, as those of a relaxed block are.

    Each layer's mean gives the derivatives G_ij by its normalised weights and those by its
    rows; the weights before normalisation follow as in edge_gradient. What all edges of a row
    have alike stays a number of the row, so that their share of b is a row's sum of weights and
    one hop of a number a node.
    """
    full = cut(normalize.add_remaining_self_loops(edges, nodes), "graph")  # its degrees and its weights
    degrees = cut(normalize.degree(full, "dst"), "degrees")
    a = cut(normalize.scale(full, degrees.withColumn("f", reciprocal_power(F.col("d"), 0.5)), "f", "f"), "adjacency")
    passed = _forward(a, nodes, model, lambda z: cut(z, "layer"))
    g = loss_gradient(passed[-1][1], targets, loss_name)
    base = terms = None
    for layer in range(len(passed), 0, -1):
        p, _, width = passed[layer - 1]
        g = cut(g, "gradient")
        row, found, by_rows = robust_gradients.derivatives(a, p, g, width, model.mean, model.parameters, layer > 1)
        terms = found if terms is None else terms.unionByName(found)
        base = row if base is None else base.unionByName(row)
        if layer > 1:
            back = by_rows.select("id", _times(F.col("g"), model.layers[layer - 1][0].T).alias("u"))
            slope = passed[layer - 2][1].select("id", _slope(F.col("z"), model.activation).alias("s"))
            g = back.join(slope, "id").select("id", F.zip_with("u", "s", lambda x, y: x * y).alias("g"))
    own = cut(terms if len(passed) == 1 else terms.groupBy("src", "dst").agg(F.sum("term").alias("term"), F.max("weight").alias("weight")), "terms")
    shares = own.select(F.explode(F.array("src", "dst")).alias("dst"), (F.col("term") * F.col("weight")).alias("t"))
    ways = _ways(pairs, symmetric)
    each = ways.join(own.select("src", "dst", "term"), ["src", "dst"], "left")
    if base is not None:
        base = base if len(passed) == 1 else base.groupBy("src").agg(F.sum("base").alias("base"), F.max("s").alias("s"))
        shares = shares.unionByName(base.select(F.col("src").alias("dst"), (F.col("base") * F.col("s")).alias("t")))
        shares = shares.unionByName(a.join(base, "src").select("dst", (F.col("base") * F.col("weight")).alias("t")))
        there = a.select("src", "dst").join(ways.select("src", "dst"), ["src", "dst"], "left_semi").join(base.select("src", "base"), "src")
        each = each.join(there, ["src", "dst"], "left").withColumn("term", F.coalesce("base", F.lit(0.0)) + F.coalesce("term", F.lit(0.0))).drop("base")
    for end, name in (("src", "d_i"), ("dst", "d_j")):
        each = each.join(degrees.select(F.col("id").alias(end), F.col("d").alias(name)), end)
    bracket = shares.groupBy("dst").agg(F.sum("t").alias("b"))
    return _by_pair(pairs, each.join(bracket, "dst", "left"), F.coalesce("term", F.lit(0.0)))


def block_gradient(edges: DataFrame | Adjacency, nodes: DataFrame, model: Model, targets: DataFrame, block: DataFrame, loss_name: str = "CE") -> DataFrame:
    """block with `grad` by p: of an existing edge the sign turns, as its weight is 1 - p after the flip. edges may be packed already, but for a robust mean."""
    if isinstance(model, Rgnn):
        flagged, graph = block_matches(block, edges), perturb(edges, block)
    else:
        edges = Adjacency.of(edges, nodes) if isinstance(edges, DataFrame) else edges
        flagged, graph = edges.matches(block).drop("own"), edges.perturbed(block)
    found = edge_gradient(graph, nodes, model, targets, flagged, loss_name)
    return found.withColumn("grad", F.when(F.col("present"), -F.col("grad")).otherwise(F.col("grad"))).drop("present")


# ---------------------------------------------------------------- attack loops


@dataclass
class Result:
    """The perturbed pairs (src, dst), the perturbed edges and one trace row an epoch."""

    pairs: DataFrame
    edges: DataFrame
    trace: list[dict] = field(default_factory=list)


def _flip(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return perturb(edges, pairs.select("src", "dst", F.lit(1.0).alias("p"))).filter("weight > 1e-9")


def _loss(edges, nodes, model, targets, loss_name) -> float:
    from .losses import loss

    return float(loss(long_logits(surrogate_logits(edges, nodes, model)), targets, loss_name).first()[0] or 0.0)


def _judge(edges, nodes, model, targets, loss_name) -> tuple[float, float]:
    """Loss and accuracy on the targets, from one pass."""
    from .losses import loss_column, margins

    found = margins(long_logits(surrogate_logits(edges, nodes, model)), targets)
    row = found.agg(loss_column(loss_name).alias("loss"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy")).first()
    return float(row.loss or 0.0), float(row.accuracy or 0.0)


def prbcd(
    edges: DataFrame, nodes: DataFrame, model: Model, targets: DataFrame, budget: int, epochs: int = 400, fine_tune: int = 100, block_size: int = 1_000_000,
    lr_factor: float = 100.0, loss_name: str = "CE", samples: int = 20, seed: int = 0, eps: float = 1e-7, block: DataFrame | None = None, best_by: str = "loss",
) -> Result:
    """Projected randomised block coordinate descent over a random block of pairs.

    A block that is given stays for all epochs. Final pairs: the best of `samples` Bernoulli
    draws within the budget, and of the `budget` largest weights. best_by: the epoch and the
    draw of the largest loss, or of the least accuracy on the targets (ties by the loss).
    """
    if best_by not in ("loss", "accuracy"):
        raise ValueError(f"best_by is loss or accuracy, not {best_by}")

    def value_of(graph: DataFrame | Adjacency) -> tuple[tuple, dict]:
        """What is to be largest, and the trace's entries."""
        if best_by == "loss":
            value = _loss(graph, nodes, model, targets, loss_name)
            return (value,), {"loss": value}
        value, accuracy = _judge(graph, nodes, model, targets, loss_name)
        return (-accuracy, value), {"loss": value, "accuracy": accuracy}

    packed = None if isinstance(model, Rgnn) else Adjacency.of(edges, nodes)

    def relaxed(block: DataFrame) -> DataFrame | Adjacency:
        return packed.perturbed(block) if packed else perturb(edges, block)

    def flipped(pairs: DataFrame) -> DataFrame | Adjacency:
        return packed.perturbed(pairs.withColumn("p", F.lit(1.0))) if packed else _flip(edges, pairs)

    fixed = block is not None
    block = cut(block if fixed else random_block(nodes, block_size, f"{seed}-0", eps), "block")
    if block.count() < budget:
        raise ValueError(f"the block has fewer pairs than the budget of {budget}")
    n, trace, best = nodes.count(), [], ((-math.inf,), block)
    for epoch in range(epochs):
        grads = block_gradient(packed or edges, nodes, model, targets, block, loss_name)
        lr = budget / n / 2 * lr_factor / math.sqrt(max(0, epoch - (epochs - fine_tune)) + 1)
        moved = cut(grads.withColumn("p", F.col("p") + lr * F.col("grad")).drop("grad"), "moved")  # the projection reads it many times
        block = cut(project(moved, budget, eps), "block")
        value, entries = value_of(relaxed(block))
        mass, positive = block.agg(F.sum("p"), F.count(F.when(F.col("p") > eps, 1))).first()
        trace.append({"epoch": epoch, **entries, "mass": mass, "nonzero_weights": positive})
        if value > best[0]:
            best = (value, block)
        if not fixed and epoch < epochs - fine_tune - 1:
            block = cut(resample(block, nodes, block_size, f"{seed}-{epoch + 1}", eps), "block")
        elif not fixed and epoch == epochs - fine_tune - 1:
            block = best[1]
    block = best[1]
    found = ((-math.inf,), None)
    for s in range(samples):
        if s == 0:
            pairs = block.filter(F.col("p") > eps).orderBy(F.col("p").desc(), "lin").limit(budget)
        else:
            pairs = block.filter(uniform(f"{seed}-final-{s}", "lin") < F.col("p"))
        pairs = cut(pairs.select("src", "dst"), "pairs")
        if pairs.count() <= budget:
            value = value_of(flipped(pairs))[0]
            if value > found[0]:
                found = (value, pairs)
    return Result(found[1], _flip(edges, found[1]), trace)


def greedy_rbcd(edges: DataFrame, nodes: DataFrame, model: Model, targets: DataFrame, budget: int, epochs: int = 500, block_size: int = 1_000_000, loss_name: str = "CE", seed: int = 0, eps: float = 1e-7) -> Result:
    """Each step draws a fresh block and flips the pairs with the largest gradients; the budget is dealt evenly over the steps."""
    epochs = min(epochs, budget)
    quota = [budget // epochs + (1 if s < budget % epochs else 0) for s in range(epochs)] if epochs else []
    now = edges if isinstance(model, Rgnn) or not quota else Adjacency.of(edges, nodes)
    picked, trace = None, []
    for step, k in enumerate(quota):
        block = random_block(nodes, block_size, f"{seed}-{step}", eps)
        if picked is not None:
            block = block.join(picked, ["src", "dst"], "left_anti")
        grads = block_gradient(now, nodes, model, targets, block, loss_name)
        pairs = cut(grads.orderBy(F.col("grad").desc(), "src", "dst").limit(k).select("src", "dst"), "pairs")
        picked = pairs if picked is None else cut(picked.unionByName(pairs), "pairs")
        trace.append({"epoch": step, "flipped": k})
        if step + 1 < len(quota):
            now = now.perturbed(pairs.withColumn("p", F.lit(1.0))) if isinstance(now, Adjacency) else _flip(edges, picked)
    if picked is None:
        return Result(edges.select("src", "dst").limit(0), edges, trace)
    return Result(picked, _flip(edges, picked), trace)  # no pair is picked twice


def all_pairs(nodes: DataFrame, eps: float) -> DataFrame:
    """Every pair by number, for small node counts."""
    n = nodes.count()
    i, j = triu_pair(n, F.col("id"))
    return nodes.sparkSession.range(n * (n - 1) // 2).select(F.col("id").alias("lin"), i.alias("src"), j.alias("dst"), F.lit(eps).alias("p"))


def pgd(edges: DataFrame, nodes: DataFrame, model: Model, targets: DataFrame, budget: int, epochs: int = 200, loss_name: str = "CE", base_lr: float = 0.01, samples: int = 20, seed: int = 0) -> Result:
    """Projected gradient descent over all pairs (small graphs)."""
    return prbcd(edges, nodes, model, targets, budget, epochs, epochs, 0, base_lr * nodes.count(), loss_name, samples, seed, 1e-5, all_pairs(nodes, 1e-5))


def fgsm(edges: DataFrame, nodes: DataFrame, model: Model, targets: DataFrame, budget: int, loss_name: str = "CE") -> Result:
    """Flips the pair with the largest gradient, one at a time, over all pairs (small graphs); a pair is flipped once."""
    now, picked, trace = edges, [], []
    spark = nodes.sparkSession
    for step in range(budget):
        grads = block_gradient(now, nodes, model, targets, all_pairs(nodes, 0.0), loss_name)
        if picked:
            grads = grads.join(spark.createDataFrame(picked, "src long, dst long"), ["src", "dst"], "left_anti")
        best = grads.orderBy(F.col("grad").desc(), "src", "dst").first()
        picked.append((best.src, best.dst))
        now = cut(_flip(now, spark.createDataFrame(picked[-1:], "src long, dst long")), "edges")
        trace.append({"epoch": step, "gradient": best.grad})
    return Result(spark.createDataFrame(picked, "src long, dst long"), now, trace)


def local_prbcd(edges: DataFrame, nodes: DataFrame, model: Model, node: int, budget: int, epochs: int = 150, fine_tune: int = 50, block_size: int = 10_000, lr_factor: float = 1.0, loss_name: str = "Margin", seed: int = 0, samples: int = 20, eps: float = 1e-14) -> Result:
    """The block is drawn from the pairs of one node; the loss is that node's."""
    others = nodes.filter(F.col("id") != node).select("id").orderBy(uniform(seed, "id"), "id").limit(block_size)
    block = others.select(F.col("id").alias("lin"), F.least("id", F.lit(node)).alias("src"), F.greatest("id", F.lit(node)).alias("dst"), F.lit(eps).alias("p"))
    n = nodes.count()
    factor = lr_factor * n * max(math.sqrt(n / block_size), 1.0)
    return prbcd(edges, nodes, model, nodes.filter(F.col("id") == node), budget, epochs, fine_tune, block_size, factor, loss_name, samples, seed, eps, block)


def sga_candidates(edges: DataFrame, nodes: DataFrame, node: int, wrong: int) -> DataFrame:
    """(src, dst): potential new edges of the target: nodes of the wrong class that are not its neighbours."""
    near = edges.filter(F.col("src") == node).select(F.col("dst").alias("id"))
    potential = nodes.filter((F.col("label") == wrong) & (F.col("id") != node)).select("id").join(near, "id", "left_anti")
    return potential.select(F.lit(node).cast("long").alias("src"), F.col("id").alias("dst"))


def sga(edges: DataFrame, nodes: DataFrame, model: Model, node: int, budget: int, hops: int = 2) -> Result:
    """Simplified gradient attack on the k-hop subgraph of the target, normalised with the degrees of the whole graph."""
    spark = nodes.sparkSession
    label = nodes.filter(F.col("id") == node).first().label
    z = surrogate_logits(edges, nodes, model).filter(F.col("id") == node).first().z
    wrong = max((c for c in range(len(z)) if c != label), key=lambda c: (z[c], -c))
    candidates = sga_candidates(edges, nodes, node, wrong)
    target = nodes.filter(F.col("id") == node)
    soft = replace(model, temperature=5.0)
    near = khop(edges, target.select("id"), hops).select("id")
    now, picked = edges, []
    away = target.withColumn("label", F.lit(wrong))
    existing = edges.filter(F.col("src") == node).select("src", "dst")
    for _ in range(budget):
        space = candidates.unionByName(existing).distinct()
        keep = near.unionByName(space.select(F.col("dst").alias("id"))).distinct()
        inside = now.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
        ordered = space.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(0.0).alias("p")).distinct()
        if picked:
            ordered = ordered.join(spark.createDataFrame(picked, "src long, dst long"), ["src", "dst"], "left_anti")
        own = block_matches(ordered, now)
        up = edge_gradient(inside, nodes, soft, target, own).withColumnRenamed("grad", "a")
        down = edge_gradient(inside, nodes, soft, away, own).select("src", "dst", F.col("grad").alias("b"))
        score = (F.col("a") - F.col("b")) * F.when(F.col("present"), -1.0).otherwise(1.0)
        best = up.join(down, ["src", "dst"]).select("src", "dst", score.alias("score")).orderBy(F.col("score").desc(), "src", "dst").first()
        if best is None:
            break
        picked.append((best.src, best.dst))
        now = cut(_flip(now, spark.createDataFrame(picked[-1:], "src long, dst long")), "edges")
    return Result(spark.createDataFrame(picked, "src long, dst long"), now)


def ppr_propagate(edges: DataFrame, h: DataFrame, columns: int, alpha: float, rounds: int, factors: list[float] | None = None, every: int = 6) -> DataFrame:
    """(id, h): alpha * sum over t <= rounds of ((1 - alpha) W)^t H for wide rows, without forming the PPR matrix; W has the edges' weights over their row's sum.

    S' = (1 - alpha) W S + alpha H needs S once, so a round is one hop over the packed edges,
    whose rows are scaled afterwards, and one grouped sum.
    factors: relaxation factors instead of a number of rounds, as of ppr.second_order_factors for
    the walk on an undirected graph: S' = f ((1 - alpha) W S + alpha H) + (1 - f) S'', where a
    row carries S and S''.
    """
    factors = factors or [1.0] * rounds
    names = [f"c{c}" for c in range(columns)]
    before = [f"b{c}" for c in range(columns)]
    start = h.select("id", *[(alpha * F.col("h")[c]).alias(f"c{c}") for c in range(columns)])
    parts = parts_for(h)
    packed = pack(edges, parts)
    sums = unpack(packed).groupBy(F.col("src").alias("id")).agg(F.sum(F.abs("weight")).alias("d"))
    sums = cut(sums.select("id", ((1 - alpha) * F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1.0)).alias("w")), "sums")
    total = start
    relaxed = any(f != 1.0 for f in factors)
    for t, factor in enumerate(factors, 1):
        f = F.lit(factor)
        moved = hop(packed, total.select("id", *names), names, parts).join(sums, "id").select("id", *[(F.col("w") * F.col(n) * f).alias(n) for n in names])
        terms = moved.unionByName(start.select("id", *[(F.col(n) * f).alias(n) for n in names]))
        if relaxed:
            terms = terms.select("id", *names, *[F.lit(0.0).alias(b) for b in before])
            own = [(F.lit(0.0) if t == 1 else F.col(b) * (1 - f)).alias(n) for n, b in zip(names, before, strict=True)]
            terms = terms.unionByName(total.select("id", *own, *[F.col(n).alias(b) for n, b in zip(names, before, strict=True)]))
        total = terms.groupBy("id").agg(*[F.sum(n).alias(n) for n in (names + before if relaxed else names)])
        if t % every == 0 and t < len(factors):
            total = cut(total, "total")
    return total.select("id", F.array(*names).alias("h"))


def rank_one_margins(edges: DataFrame, nodes: DataFrame, logits: DataFrame, node: int, alpha: float = 0.1, rounds: int = 30) -> DataFrame:
    """(dst, present, margin): the node's margin on z = PPR @ logits(id, z array) after flipping dst in its own row.

    The rank-one update of one row needs, of every candidate v, only its PPR-weighted logits
    and its score for the node: both come from one propagation of the logits with one
    more column that marks the node. edges are unweighted.
    """
    label = nodes.filter(F.col("id") == node).first().label
    classes = len(logits.first().z)
    h = logits.select("id", F.concat("z", F.array(F.when(F.col("id") == node, 1.0).otherwise(0.0))).alias("h"))
    total = cut(ppr_propagate(edges, h, classes + 1, alpha, rounds), "scores")
    own = total.filter(F.col("id") == node).first().h
    start = h.filter(F.col("id") == node).first().h
    near = [(o - alpha * x) / (1 - alpha) for o, x in zip(own, start, strict=True)]  # the node's row of W P H
    k = edges.filter(F.col("src") == node).count()
    there = edges.filter(F.col("src") == node).select(F.col("dst").alias("id"), F.lit(True).alias("present"))
    rows = total.filter(F.col("id") != node).join(there, "id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    size = F.when(F.col("present"), F.lit(float(1 - k))).otherwise(F.lit(float(k + 1)))
    rows = rows.filter(size != 0)
    ratio = (1 - alpha) / alpha
    change = [(F.col("h")[c] - near[c]) / size for c in range(classes + 1)]
    scale = own[classes] * ratio / (1 - ratio * change[classes])
    z = [own[c] + scale * change[c] for c in range(classes)]
    return rows.select(F.col("id").alias("dst"), "present", (z[label] - F.array_max(F.array(*[x for c, x in enumerate(z) if c != label]))).alias("margin"))


def greedy_row_flips(edges: DataFrame, nodes: DataFrame, logits: DataFrame, node: int, budget: int, alpha: float = 0.1, rounds: int = 30) -> Result:
    """Attack on one node of a PPR model: every candidate of its row is scored by the exact rank-one update; the smallest margin is taken, one edge a step, and the scores are recomputed."""
    spark = nodes.sparkSession
    picked: list[int] = []
    trace = []
    for step in range(budget):
        found = rank_one_margins(edges, nodes, logits, node, alpha, rounds)
        best = found.filter(~F.col("dst").isin(picked or [-1])).orderBy("margin", "dst").first()
        if best is None:
            break
        picked.append(best.dst)
        trace.append({"epoch": step, "margin": best.margin})
        change = spark.createDataFrame([(best.dst, 1.0)], "dst long, p double")
        edges = cut(replace_row(edges, node, change, symmetric=False).filter("weight > 1e-9"), "edges")
    return Result(spark.createDataFrame([(node, v) for v in picked], "src long, dst long"), edges, trace)


# ---------------------------------------------------------------- Nettack


def power_law(degrees: DataFrame, d_min: int = 2) -> DataFrame:
    """One row: n, S = sum of ln d, alpha and log-likelihood over degrees of d_min or more."""
    sums = degrees.filter(F.col("d") >= d_min).agg(F.count("*").alias("n"), F.sum(F.log("d")).alias("s"))
    return sums.withColumn("alpha", alpha_of(F.col("n"), F.col("s"), d_min)).withColumn("ll", likelihood_of(F.col("n"), F.col("s"), F.col("alpha"), d_min))


def alpha_of(n, s, d_min: int = 2):
    return n / (s - n * F.lit(math.log(d_min - 0.5))) + 1


def likelihood_of(n, s, alpha, d_min: int = 2):
    return n * F.log(alpha) + n * alpha * F.lit(math.log(d_min)) + (alpha + 1) * s


def likelihood_ratio(edges: DataFrame, candidates: DataFrame, d_min: int = 2) -> DataFrame:
    """candidates(src, dst) with the power-law test statistic of flipping each; edges are undirected."""
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("d"))
    return _ratios(_with_degrees(block_matches(candidates, edges), degrees), degrees, d_min).select(*candidates.columns, "ratio")


def _with_degrees(found: DataFrame, degrees: DataFrame) -> DataFrame:
    """found(src, dst, present) with the ends' degrees d_src and d_dst, and what a flip adds to them."""
    for end in ("src", "dst"):
        found = found.join(degrees.select(F.col("id").alias(end), F.col("d").alias(f"d_{end}")), end, "left").withColumn(f"d_{end}", F.coalesce(f"d_{end}", F.lit(0.0)))
    return found.withColumn("change", F.when(F.col("present"), -1.0).otherwise(1.0))


def _ratios(found: DataFrame, degrees: DataFrame, d_min: int) -> DataFrame:
    base = power_law(degrees, d_min).select("n", "s", "alpha", "ll")
    n, s = F.col("n").cast("double"), F.col("s")
    joined = found.join(F.broadcast(base))
    for end in ("src", "dst"):
        old, new = F.col(f"d_{end}"), F.col(f"d_{end}") + F.col("change")
        n = n - F.when(old >= d_min, 1.0).otherwise(0.0) + F.when(new >= d_min, 1.0).otherwise(0.0)
        s = s - F.when(old >= d_min, F.log(old)).otherwise(0.0) + F.when(new >= d_min, F.log(new)).otherwise(0.0)
    joined = joined.withColumn("n1", n).withColumn("s1", s).withColumn("alpha1", alpha_of(F.col("n1"), F.col("s1"), d_min))
    ll1 = likelihood_of(F.col("n1"), F.col("s1"), F.col("alpha1"), d_min)
    n2, s2 = F.col("n1") + F.col("n"), F.col("s1") + F.col("s")
    both = likelihood_of(n2, s2, alpha_of(n2, s2, d_min), d_min)
    return joined.withColumn("ratio", -2 * both + 2 * (ll1 + F.col("ll")))


def filter_chisquare(ratios: DataFrame, cutoff: float = 0.004) -> DataFrame:
    return ratios.filter(F.col("ratio") < cutoff)


def struct_scores(edges: DataFrame | Adjacency, nodes: DataFrame, model: Model, node: int, candidates: DataFrame) -> DataFrame:
    """candidates(src, dst) with the margin of the node after each flip, exactly; direct ones (src is the node) and indirect ones alike. dst is not the node.

    With u the node, d degrees with loops, S_m = sum over t of a_mt h_t / sqrt(d_t), T_t = sum
    over m of a_um a_mt / d_m and Z = sum over m of a_um S_m / d_m, the output is Z / sqrt(d_u).
    A flip of (i, v) changes the degrees of i and v and two entries, so that the new output
    follows from Z and from d, h, S, T and the three entries a_ui, a_uv, a_iv of the pair: a few
    lookups a candidate, for any number of candidates at once. edges count as unweighted, and
    may be packed already.
    """
    classes = model.weight.shape[1]
    width = range(classes)
    h = _projected(nodes, model)
    loops = edges if isinstance(edges, Adjacency) else unweighted(edges, nodes)
    own = h.join(loops.factors.select("id", "d"), "id")
    near = cut(loops.starts(node), "near")
    rows = own.join(near, "id", "left").withColumn("a", F.coalesce("a", F.lit(0.0)))
    names = [f"c{c}" for c in range(classes)]
    sums = hop(loops.packed, rows.select("id", *[(F.col("h")[c] / F.sqrt("d")).alias(n) for c, n in enumerate(names)], (F.col("a") / F.col("d")).alias("t")), [*names, "t"], loops.parts, loops.extra)
    table = rows.join(sums.select("id", F.array(*names).alias("s"), "t"), "id")
    table = cut(table.select("id", "d", "h", "s", "a", "t"), "nodes")
    whole = table.filter("a > 0").agg(*[F.sum(F.col("s")[c] / F.col("d")).alias(f"z{c}") for c in width]).first()
    d_u = table.filter(F.col("id") == node).first().d
    label = nodes.filter(F.col("id") == node).first().label
    found = loops.matches(candidates.select("src", "dst").distinct())
    for end, at in (("src", "i"), ("dst", "v")):
        found = found.join(table.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{at}") for c in ("d", "h", "s", "a", "t")]), end)
    direct = (F.col("src") == node).cast("double")
    found = found.withColumn("a_iv", F.col("present").cast("double")).withColumn("delta", 1 - 2 * F.col("a_iv"))
    found = found.withColumn("e_i", F.col("d_i") + F.col("delta")).withColumn("e_v", F.col("d_v") + F.col("delta"))  # degrees after the flip
    gap_i, gap_v = (1 / F.sqrt(f"e_{x}") - 1 / F.sqrt(f"d_{x}") for x in ("i", "v"))
    a_i, a_v, a_iv, d_i, d_v, delta = (F.col(c) for c in ("a_i", "a_v", "a_iv", "d_i", "d_v", "delta"))
    rest_i, rest_v = F.col("t_i") - a_i / d_i - a_v * a_iv / d_v, F.col("t_v") - a_i * a_iv / d_i - a_v / d_v  # by way of others than i and v
    found = found.withColumns({"gap_i": gap_i, "gap_v": gap_v, "rest_i": rest_i, "rest_v": rest_v, "new_v": a_v + delta * direct, "e_u": F.lit(d_u) + delta * direct})

    def logit(c: int) -> Column:
        h_i, h_v, s_i, s_v = (F.col(x)[c] for x in ("h_i", "h_v", "s_i", "s_v"))
        other = F.lit(whole[c]) - a_i * s_i / d_i - a_v * s_v / d_v + h_i * F.col("gap_i") * F.col("rest_i") + h_v * F.col("gap_v") * F.col("rest_v")
        at_i = s_i + h_i * F.col("gap_i") + a_iv * h_v * F.col("gap_v") + delta * h_v / F.sqrt("e_v")
        at_v = s_v + h_v * F.col("gap_v") + a_iv * h_i * F.col("gap_i") + delta * h_i / F.sqrt("e_i")
        return (other + a_i * at_i / F.col("e_i") + F.col("new_v") * at_v / F.col("e_v")) / F.sqrt("e_u")

    z = [logit(c) for c in width]
    return found.select("src", "dst", (z[label] - F.array_max(F.array(*[x for c, x in enumerate(z) if c != label]))).alias("score"))


def unweighted(edges: DataFrame, nodes: DataFrame) -> Adjacency:
    return Adjacency.of(edges.select("src", "dst").distinct().withColumn("weight", F.lit(1.0)), nodes)


def feature_scores(edges: DataFrame, nodes: DataFrame, model: Model, node: int, changed: DataFrame) -> DataFrame:
    """(id, k, score): the margin of the node after turning attribute k (0 or not) of each of the nodes in changed(id) on or off, exactly; a node out of two hops' reach leaves it as it is."""
    a = cut(normalize.gcn(edges, nodes), "adjacency")
    z = _forward(a, nodes, model)[-1][1].filter(F.col("id") == node).first().z
    label = nodes.filter(F.col("id") == node).first().label
    mids = a.filter(F.col("src") == node).select(F.col("dst").alias("src"), F.col("weight").alias("w"))
    reach = a.join(mids, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("weight")).alias("r"))
    rows = nodes.join(changed.select("id"), "id", "left_semi").join(reach, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r"), F.posexplode("attr").alias("k", "x"))
    step = F.col("r") * F.when(F.col("x") != 0, -F.col("x")).otherwise(1.0)
    weights = model.layers[0][0]
    table = nodes.sparkSession.createDataFrame([(k, w.tolist()) for k, w in enumerate(weights)], "k int, w array<double>")  # a row an attribute
    moved = [F.lit(float(z[c])) + step * F.col("w")[c] for c in range(weights.shape[1])]
    score = moved[label] - F.array_max(F.array(*[x for c, x in enumerate(moved) if c != label]))
    return rows.join(table, "k").select("id", "k", score.alias("score"))


def influencers(edges: DataFrame, nodes: DataFrame, model: Model, node: int, n: int) -> DataFrame:
    """(id, score): the n neighbours without whose edge the node's margin is least, ties by id."""
    near = edges.filter((F.col("src") == node) & (F.col("dst") != node)).select("src", "dst")
    return struct_scores(edges, nodes, model, node, near).orderBy("score", "dst").limit(n).select(F.col("dst").alias("id"), "score")


def indirect_candidates(nodes: DataFrame, node: int, by: list[int]) -> DataFrame:
    """(src, dst): pairs of an influencer and any other node, but the attacked one."""
    source = F.explode(F.array(*[F.lit(i).cast("long") for i in by])).alias("src")
    return nodes.filter(F.col("id") != node).select(source, F.col("id").alias("dst")).filter("src <> dst")


def nettack(
    edges: DataFrame, nodes: DataFrame, model: Model, node: int, budget: int, cutoff: float = 0.004, direct: bool = True, n_influencers: int = 5, structure: bool = True, features: bool = False
) -> Result:
    """Attack on one node of a two-hop linear model, smallest margin first.

    Edge candidates leave no singleton and pass the power-law test; direct ones are the node's
    own, indirect ones those of its n_influencers, chosen at the start. features: attributes of
    the node, or of the influencers, may be turned on or off too; a step takes the better of
    both. The trace has one row a step: an edge (src, dst), or an attribute (id, k).
    """
    spark = nodes.sparkSession
    now, picked, trace, turned = edges, [], [], []
    graph = degrees = None
    if structure and budget:
        graph = unweighted(edges, nodes)
        degrees = cut(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("d")), "degrees")
    at = [node] if direct else [r.id for r in influencers(edges, nodes, model, node, n_influencers).collect()]  # n_influencers at most
    changed = spark.createDataFrame([(i,) for i in at], "id long")
    for _ in range(budget if at else 0):
        best = None
        if structure:
            space = indirect_candidates(nodes, node, at) if not direct else nodes.filter(F.col("id") != node).select(F.lit(node).cast("long").alias("src"), F.col("id").alias("dst"))
            if picked:
                both = spark.createDataFrame(picked + [(b, a) for a, b in picked], "src long, dst long")
                space = space.join(both, ["src", "dst"], "left_anti")
            flips = _with_degrees(graph.matches(space), degrees).filter("d_src + change <> 0 and d_dst + change <> 0")  # leave no singleton
            good = filter_chisquare(_ratios(flips, degrees, 2), cutoff).select("src", "dst")
            best = struct_scores(graph, nodes, model, node, good).orderBy("score", "src", "dst").first()
        if features:
            space = feature_scores(now, nodes, model, node, changed)
            if turned:
                space = space.join(spark.createDataFrame(turned, "id long, k int"), ["id", "k"], "left_anti")
            found = space.orderBy("score", "id", "k").first()
            if found is not None and (best is None or found.score < best.score):
                turned.append((found.id, found.k))
                on = F.transform("attr", lambda x, k: F.when(k == found.k, F.when(x != 0, 0.0).otherwise(1.0)).otherwise(x))
                nodes = cut(nodes.withColumn("attr", F.when(F.col("id") == found.id, on).otherwise(F.col("attr"))), "nodes")
                trace.append({"id": found.id, "k": found.k, "margin": found.score})
                continue
        if best is None:
            break
        picked.append((best.src, best.dst))
        trace.append({"src": best.src, "dst": best.dst, "margin": best.score})
        pair = spark.createDataFrame([(min(best.src, best.dst), max(best.src, best.dst))], "src long, dst long")
        now = _flip(edges, spark.createDataFrame([(min(p), max(p)) for p in picked], "src long, dst long"))  # no pair is picked twice
        if len(trace) < budget:
            gone = graph.matches(pair).first().present
            graph = graph.perturbed(pair.withColumn("p", F.lit(1.0)))
            moved = pair.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(-1.0 if gone else 1.0).alias("d"))
            degrees = cut(degrees.unionByName(moved).groupBy("id").agg(F.sum("d").alias("d")).filter("d > 0"), "degrees")
    return Result(spark.createDataFrame(picked, "src long, dst long"), now, trace)


#: Attacks by lower-case name; that on PageRank models, localbatchedprbcd, is added by create_attack.
ATTACKS = {
    "prbcd": prbcd,
    "greedyrbcd": greedy_rbcd,
    "dice": dice,
    "fgsm": fgsm,
    "pgd": pgd,
    "localdice": local_dice,
    "localprbcd": local_prbcd,
    "sga": sga,
    "nettack": nettack,
}


def create_attack(name: str):
    """The attack of that name, in any case."""
    from .ppr_attacks import local_batched_prbcd

    try:
        return {**ATTACKS, "localbatchedprbcd": local_batched_prbcd}[name.lower()]
    except KeyError:
        raise ValueError(f"unknown attack {name}") from None
