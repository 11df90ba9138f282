"""Training by distributed gradients: mini-batches of PageRank rows, graph networks of any depth, Gaussian networks.

Weights stay on the driver, whose size is that of the model. A step's gradient is summed in
the tasks, then piece by piece across them, so that the driver gets one gradient however many
tasks there are. Dropout masks and noise are hashes of (seed, step, layer, node), the same on
any partitioning and when a lost task runs again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, written
from . import normalize
from .attacks import _hop
from .models import Adam, batch_ids
from .reshape import reversed_edges
from .robust_gradients import medoid_row

#: Entries of a gradient that one task sums up across the others.
PIECE = 1 << 14
_U = np.uint64


class Sgd:
    """Plain gradient steps with weight decay over named arrays."""

    def __init__(self, parameters: dict[str, np.ndarray], lr: float = 0.01, decay: float = 1e-3) -> None:
        self.p, self.lr, self.decay = parameters, lr, decay

    def step(self, grads: dict[str, np.ndarray]) -> None:
        for k, g in grads.items():
            self.p[k] = self.p[k] - self.lr * (g + self.decay * self.p[k])


OPTIMIZERS = {"Adam": Adam, "SGD": Sgd}


def cosine(lr: float, epoch: int, epochs: int, restart: int | None = None) -> float:
    """The annealed rate of an epoch: half a cosine over all epochs, or anew every `restart` ones."""
    share = (epoch % restart) / restart if restart else epoch / epochs
    return lr * (1 + math.cos(math.pi * share)) / 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def draws(units: int, seed: int, step: int, layer: int, *keys: np.ndarray) -> np.ndarray:
    """Uniform draws, one row a key and one column a unit."""
    h = np.full(len(keys[0]), seed * 1_000_003 + step * 101 + layer, _U)
    for key in keys:
        h = _mix(h * _U(0x9E3779B97F4A7C15) + key.astype(np.int64).view(_U))
    return (_mix(h[:, None] + np.arange(1, units + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(11)) / float(1 << 53)


def mask(rate: float, units: int, seed: int, step: int, layer: int, *keys: np.ndarray) -> np.ndarray:
    """Dropout factors: 0 with probability rate, else 1 / (1 - rate)."""
    if not rate:
        return np.ones((len(keys[0]), units))
    return (draws(units, seed, step, layer, *keys) >= rate) / (1 - rate)


def _add_up(found: DataFrame, size: int) -> np.ndarray:
    """The sum of all rows of found(g array<double>) of `size` entries, piece by piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                values = row.values
                parts = [values.slice(i, PIECE) for i in range(0, size, PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.to_pylist() for p in parts], pa.list_(pa.float64()))], names=["piece", "g"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = row.values.to_numpy()
                sums[piece] = sums[piece] + values if piece in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["piece", "g"])

    schema = "piece int, g array<double>"
    parts = found.mapInArrow(pieces, schema).repartition("piece").mapInArrow(total, schema).collect()
    out = np.zeros(size)
    for r in parts:
        out[r.piece * PIECE : r.piece * PIECE + len(r.g)] = r.g
    return out


def _task_sum(size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]):
    """A mapInArrow function: one row with the sum that `add` makes of the task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if len(batch):
                add(batch, out)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["g"])

    return run


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _packed(arrays: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays.values()])


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, a in like.items():
        out[name] = flat[at : at + a.size].reshape(a.shape)
        at += a.size
    return out


def cross_entropy(z: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Losses, their derivatives by the logits, and whether the largest logit is the label's."""
    q = np.exp(z - z.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    at = np.arange(len(z))
    losses, right = -np.log(np.maximum(q[at, labels], 1e-300)), z.argmax(1) == labels
    q[at, labels] -= 1
    return losses, q, right


# ---------------------------------------------------------------- PPRGo


@dataclass
class PprGo:
    """Layers of weights (and of batch normalisation) over each neighbour of a PageRank row, and a weighted sum or a soft k-medoid over the row.

    p: w0, w1, ... and, normalised, gamma0, beta0, ...; moments: running mean and variance of
    each hidden layer, which normalise in training too and count as fixed in a step.
    """

    p: dict[str, np.ndarray]
    moments: list[tuple[np.ndarray, np.ndarray]] | None = None
    reduce: str = "sum"
    parameters: dict = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return sum(k.startswith("w") for k in self.p)

    def layers(self, x: np.ndarray, masks: Callable[[int, int], np.ndarray]) -> tuple[np.ndarray, list[tuple]]:
        """Logits of neighbours, and per hidden layer what the way back needs."""
        cache = []
        for i in range(self.depth - 1):
            pre = x @ self.p[f"w{i}"]
            hat = pre if self.moments is None else (pre - self.moments[i][0]) / np.sqrt(self.moments[i][1] + 1e-5)
            y = hat if self.moments is None else hat * self.p[f"gamma{i}"] + self.p[f"beta{i}"]
            m = masks(i, y.shape[1])
            cache.append((x, pre, hat, y, m))
            x = np.maximum(y, 0) * m
        return x @ self.p[f"w{self.depth - 1}"], [*cache, (x,)]

    def back(self, cache: list[tuple], g: np.ndarray) -> dict[str, np.ndarray]:
        out = {f"w{self.depth - 1}": cache[-1][0].T @ g}
        g = g @ self.p[f"w{self.depth - 1}"].T
        for i in range(self.depth - 2, -1, -1):
            x, _, hat, y, m = cache[i]
            g = g * m * (y > 0)
            if self.moments is not None:
                out[f"gamma{i}"], out[f"beta{i}"] = (g * hat).sum(0), g.sum(0)
                g = g * self.p[f"gamma{i}"] / np.sqrt(self.moments[i][1] + 1e-5)
            out[f"w{i}"] = x.T @ g
            g = g @ self.p[f"w{i}"].T
        return {k: out[k] for k in self.p}

    def row(self, z: np.ndarray, s: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
        """The aggregate of one PageRank row with scores s, or the derivative of <g, aggregate> by the logits z."""
        if self.reduce == "sum":
            return s @ z if g is None else s[:, None] * g
        k, t = self.parameters.get("k", 64), self.parameters.get("temperature", 1.0)
        corrected = self.parameters.get("with_weight_correction", True)
        near = np.sort(np.lexsort((np.arange(len(s)), -s))[:k])
        if g is None:
            from .robust import soft_weights

            return s.sum() * soft_weights(z[near], s[near], t, corrected)[2] @ z[near]
        out = np.zeros_like(z)
        out[near] = medoid_row(z[near], s[near], s.sum(), g, t, corrected)[2]
        return out

    def logits(self, x: np.ndarray, s: np.ndarray, ends: np.ndarray, masks=lambda i, n: 1.0) -> tuple[np.ndarray, np.ndarray, list]:
        """Logits of rows whose neighbours lie one after the other in x and s, up to ends; those of the neighbours, and the cache."""
        z, cache = self.layers(x, masks)
        starts = np.concatenate([[0], ends[:-1]])
        return np.array([self.row(z[a:b], s[a:b]) for a, b in zip(starts, ends, strict=True)]), z, cache


def pprgo_gradient(model: PprGo, x: np.ndarray, s: np.ndarray, ends: np.ndarray, labels: np.ndarray, masks) -> tuple[dict[str, np.ndarray], float, int, list]:
    """The sum over rows of the cross entropy's gradient, the losses' sum, the number of rows that are right, and sums of what each hidden layer normalises."""
    rows, z, cache = model.logits(x, s, ends, masks)
    losses, g, right = cross_entropy(rows, labels)
    starts = np.concatenate([[0], ends[:-1]])
    by_z = np.concatenate([model.row(z[a:b], s[a:b], g[i]) for i, (a, b) in enumerate(zip(starts, ends, strict=True))])
    return model.back(cache, by_z), float(losses.sum()), int(right.sum()), [(c[1].sum(0), (c[1] ** 2).sum(0)) for c in cache[:-1]]


def ppr_batches(scores: DataFrame, nodes: DataFrame, split: DataFrame, size: int = 512) -> DataFrame:
    """(id, label, part, batch, attrs, scores): the PageRank row of each node of split(id, part) with its neighbours' attributes by id; rows are top-k bounded. Batches have about `size` rows."""
    joined = scores.join(nodes.select(F.col("id").alias("dst"), "attr"), "dst")
    rows = joined.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "attr", "weight"))).alias("near"))
    rows = rows.select("id", F.transform("near", lambda e: e["attr"]).alias("attrs"), F.transform("near", lambda e: e["weight"]).alias("scores"))
    return rows.join(nodes.select("id", "label"), "id").join(batch_ids(split.select("id", "part"), size), "id")


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, neighbours' attributes, scores and ends of a batch (id, label, attrs, scores)."""
    s = batch.column(3).flatten().to_numpy(zero_copy_only=False)
    x = _matrix(batch.column(2).flatten(), len(s))
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), x, s, np.cumsum(batch.column(3).value_lengths().to_numpy())


def predict(model: PprGo, rows: DataFrame) -> DataFrame:
    """(id, z): logits of rows with id, attrs and scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, _, x, s, ends = _rows(batch)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(shared.value.logits(x, s, ends)[0]), pa.list_(pa.float64()))], names=["id", "z"])

    return rows.select("id", F.lit(0).alias("label"), "attrs", "scores").mapInArrow(run, "id long, z array<double>")


def train_pprgo(
    rows: DataFrame, filters: tuple[int, ...] = (16,), epochs: int = 30, lr: float = 0.01, decay: float = 1e-4, patience: int = 10, dropout: float = 0.0, batch_norm: bool = False,
    optimizer: str = "Adam", schedule: str | None = None, restart: int = 3, reduce: str = "sum", parameters: dict | None = None, momentum: float = 0.1, seed: int = 0,
) -> tuple[PprGo, list[dict]]:
    """Mini-batch training on ppr_batches(): the model of the least validation loss, and one trace row an epoch.

    The rows are written once in folders by part and batch, and a step reads its own. schedule:
    None, "cosine" over all epochs, or "restarts" every `restart` epochs. Training stops after
    `patience` epochs without a better validation loss.
    """
    if schedule not in (None, "cosine", "restarts"):
        raise ValueError(f"unknown schedule {schedule}")
    if reduce not in ("sum", "soft_k_medoid"):
        raise ValueError(f"no derivatives of {reduce}")
    table = written(rows.filter("part in ('train', 'val')").select("id", F.col("label").cast("long").alias("label"), "attrs", "scores", "part", "batch"), "rows", ["part", "batch"])
    features = len(table.select("attrs").first().attrs[0])
    classes = int(table.agg(F.max("label")).first()[0]) + 1
    sizes = [features, *filters, classes]
    rng = np.random.default_rng(seed)
    p = {f"w{i}": rng.normal(0, (2 / a) ** 0.5, (a, b)) for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True))}
    moments = [(np.zeros(n), np.ones(n)) for n in filters] if batch_norm else None
    if batch_norm:
        p |= {f"gamma{i}": np.ones(n) for i, n in enumerate(filters)} | {f"beta{i}": np.zeros(n) for i, n in enumerate(filters)}
    steps = OPTIMIZERS[optimizer](p, lr, decay)
    counts = {r.batch: r.n for r in table.filter("part = 'train'").groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a row a batch
    weights = sum(a.size for a in p.values())
    size = weights + 4 + 2 * sum(filters)
    model = PprGo(steps.p, moments, reduce, parameters or {})
    best, trace, waited, number = (math.inf, model), [], 0, 0

    def sums(chosen: DataFrame, model: PprGo, step: int, rate: float) -> np.ndarray:
        shared = chosen.sparkSession.sparkContext.broadcast(model)

        def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
            ids, labels, x, s, ends = _rows(batch)
            lengths = np.diff(np.concatenate([[0], ends]))
            owner = np.repeat(ids, lengths)
            place = np.arange(len(s)) - np.repeat(ends - lengths, lengths)
            g, losses, right, seen = pprgo_gradient(shared.value, x, s, ends, labels, lambda i, n: mask(rate, n, seed, step, i, owner, place))
            out += np.concatenate([_packed(g), [len(ids), losses, right, len(s)], *(a for pair in seen for a in pair)])

        return _add_up(chosen.select("id", "label", "attrs", "scores").mapInArrow(_task_sum(size, add), "g array<double>"), size)

    for epoch in range(epochs):
        steps.lr = lr if schedule is None else cosine(lr, epoch, epochs, restart if schedule == "restarts" else None)
        train = np.zeros(3)
        for b in rng.permutation(sorted(counts)).tolist():
            out = sums(table.filter((F.col("part") == "train") & (F.col("batch") == b)), model, number, dropout)
            n, losses, right, seen = out[weights : weights + 4]
            train += (n, losses, right)
            steps.step({k: g / n for k, g in _unpacked(out, p).items()})
            if batch_norm:
                at = weights + 4
                fresh = []
                for width, (mean, var) in zip(filters, model.moments, strict=True):
                    m = out[at : at + width] / seen
                    v = np.maximum(out[at + width : at + 2 * width] / seen - m * m, 0)
                    fresh.append(((1 - momentum) * mean + momentum * m, (1 - momentum) * var + momentum * v))
                    at += 2 * width
                model = replace(model, moments=fresh)
            model = replace(model, p=dict(steps.p))
            number += 1
        val = sums(table.filter("part = 'val'"), model, number, 0.0)[weights : weights + 3]
        trace.append({"epoch": epoch, "lr": steps.lr, "train": train[1] / max(1, train[0]), "train_accuracy": train[2] / max(1, train[0]), "val": val[1] / max(1, val[0]), "val_accuracy": val[2] / max(1, val[0])})
        if trace[-1]["val"] < best[0]:
            best, waited = (trace[-1]["val"], model), 0
        else:
            waited += 1
            if waited > patience:
                break
    return best[1], trace


# ---------------------------------------------------------------- graph networks of any depth


def _map(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], name: str = "h") -> DataFrame:
    """(id, name): wide rows that f makes of batches whose first column is the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(f(batch)), pa.list_(pa.float64()))], names=["id", name])

    return df.mapInArrow(run, f"id long, {name} array<double>")


class GcnPass:
    """Forward and backward passes of Z_l = A (mask(relu(Z_(l-1))) W_l) over tables; without dropout A X is made once and the first layer needs no hop."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, split: DataFrame, dropout: float = 0.0, seed: int = 0) -> None:
        self.a = cut(normalize.gcn(edges, nodes), "adjacency")
        self.back = reversed_edges(self.a)
        self.dropout, self.seed = dropout, seed
        self.features = nodes.select(F.size("attr").alias("n")).first().n
        self.classes = int(nodes.agg(F.max("label")).first()[0]) + 1
        x = nodes.select("id", F.col("attr").cast("array<double>").alias("h"))
        self.x = cut(_hop(self.a, x, self.features), "features") if not dropout else cut(x, "features")
        self.known = cut(nodes.select("id", F.col("label").cast("long").alias("label")).join(split.filter("part in ('train', 'val')").select("id", "part"), "id"), "labels")
        self.count = max(1, self.known.filter("part = 'train'").count())

    def _inputs(self, layer: int, step: int, rate: float):
        """What layer's weights are multiplied with, of a batch (id, z of the layer before)."""
        seed = self.seed

        def make(ids: np.ndarray, z: np.ndarray) -> np.ndarray:
            z = z if layer == 1 else np.maximum(z, 0)
            return z * mask(rate, z.shape[1], seed, step, layer, ids) if rate else z

        return make

    def forward(self, weights: list[np.ndarray], step: int, rate: float) -> list[DataFrame]:
        """Tables (id, h) of X or A X, Z_1, ..., Z_L."""
        tables = [self.x]
        for layer, w in enumerate(weights, 1):
            make = self._inputs(layer, step, rate)
            p = _map(tables[-1], lambda b, make=make, w=w: make(b.column(0).to_numpy(), _matrix(b.column(1), len(b))) @ w)
            tables.append(cut(p if layer == 1 and not self.dropout else _hop(self.a, p, w.shape[1]), "layer"))
        return tables

    def judged(self, z: DataFrame) -> dict[str, float]:
        """Loss and accuracy of the train and val parts."""

        def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
            losses, _, right = cross_entropy(_matrix(batch.column(0), len(batch)), batch.column(1).to_numpy())
            fit = batch.column(2).to_numpy(zero_copy_only=False)
            for i, rows in ((0, fit), (3, ~fit)):
                out[i : i + 3] += (rows.sum(), losses[rows].sum(), right[rows].sum())

        n, loss, right, m, loss_v, right_v = _add_up(z.join(self.known, "id").select("h", "label", (F.col("part") == "train").alias("fit")).mapInArrow(_task_sum(6, add), "g array<double>"), 6)
        return {"train": loss / max(1, n), "train_accuracy": right / max(1, n), "val": loss_v / max(1, m), "val_accuracy": right_v / max(1, m)}

    def gradients(self, weights: list[np.ndarray], tables: list[DataFrame], step: int) -> list[np.ndarray]:
        """Derivatives of the train part's mean cross entropy by all weights: outer products of inputs and errors, summed over the nodes."""
        count, rate, seed, out = self.count, self.dropout, self.seed, []
        fit = tables[-1].join(self.known.filter("part = 'train'").select("id", "label"), "id").select("id", "h", "label")
        g = _map(fit, lambda b: cross_entropy(_matrix(b.column(1), len(b)), b.column(2).to_numpy())[1] / count, "g")
        for layer in range(len(weights), 0, -1):
            w, make = weights[layer - 1], self._inputs(layer, step, rate)
            by_p = g if layer == 1 and not self.dropout else _hop(self.back, g.withColumnRenamed("g", "h"), w.shape[1], "g")
            both = cut(tables[layer - 1].join(by_p, "id").select("id", "h", "g"), "errors")

            def add(batch: pa.RecordBatch, total: np.ndarray, make=make) -> None:
                h = make(batch.column(0).to_numpy(), _matrix(batch.column(1), len(batch)))
                total += (h.T @ _matrix(batch.column(2), len(batch))).ravel()

            out.append(_add_up(both.mapInArrow(_task_sum(w.size, add), "g array<double>"), w.size).reshape(w.shape))
            if layer > 1:

                def pull(batch: pa.RecordBatch, w=w, layer=layer) -> np.ndarray:
                    z = _matrix(batch.column(1), len(batch))
                    g = _matrix(batch.column(2), len(batch)) @ w.T * (z > 0)
                    return g * mask(rate, z.shape[1], seed, step, layer, batch.column(0).to_numpy()) if rate else g

                g = _map(both, pull, "g")
        return out[::-1]


def train_gcn(edges: DataFrame, nodes: DataFrame, split: DataFrame, hidden: int | list[int] = 16, epochs: int = 50, lr: float = 0.01, decay: float = 1e-3, patience: int = 20, seed: int = 0, dropout: float = 0.0):
    """Full-batch training by Adam with early stopping on the validation loss; returns (weights w1, w2, ..., trace).

    hidden: the width of each hidden layer. An epoch is a hop forward and one back for each
    layer (but for the first one without dropout), and a sum for each weight matrix. Labels
    are 0 to classes - 1; the weights of the least validation loss, dropout off, are returned.
    """
    run = GcnPass(edges, nodes, split, dropout, seed)
    sizes = [run.features, *([hidden] if isinstance(hidden, int) else hidden), run.classes]
    rng = np.random.default_rng(seed)
    p = {f"w{i}": rng.normal(0, ((2 if i < len(sizes) - 1 else 1) / a) ** 0.5, (a, b)) for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True), 1)}
    adam = Adam(p, lr, decay)
    best, trace, waited = (math.inf, dict(p)), [], 0
    for epoch in range(epochs):
        weights = list(adam.p.values())
        tables = run.forward(weights, epoch, dropout)
        found = run.judged(tables[-1])
        if dropout:
            found |= {k: v for k, v in run.judged(run.forward(weights, epoch, 0.0)[-1]).items() if k.startswith("val")}
        trace.append({"epoch": epoch, **found})
        if found["val"] < best[0]:
            best, waited = (found["val"], dict(adam.p)), 0
        else:
            waited += 1
            if waited > patience:
                break
        adam.step(dict(zip(p, run.gradients(weights, tables, epoch), strict=True)))
    return best[1], trace


# ---------------------------------------------------------------- Gaussian networks


def normal(units: int, seed: int, step: int, layer: int, ids: np.ndarray) -> np.ndarray:
    """Standard normal draws by hash."""
    a, b = draws(units, seed, step, layer, ids), draws(units, seed, step, layer + 50, ids)
    return np.sqrt(-2 * np.log(np.maximum(1 - a, 1e-300))) * np.cos(2 * math.pi * b)


@dataclass
class Gauss:
    """Mean and variance of one layer's nodes: M = elu(m Wm), S = relu(v Wv) and the damping exp(-gamma S)."""

    pre_mean: np.ndarray
    pre_var: np.ndarray
    gamma: float

    @classmethod
    def of(cls, mean: np.ndarray, var: np.ndarray, wm: np.ndarray, wv: np.ndarray, gamma: float) -> Gauss:
        return cls(mean @ wm, var @ wv, gamma)

    @property
    def mean(self) -> np.ndarray:
        return np.where(self.pre_mean > 0, self.pre_mean, np.expm1(np.minimum(self.pre_mean, 0)))

    @property
    def var(self) -> np.ndarray:
        return np.maximum(self.pre_var, 0)

    @property
    def damping(self) -> np.ndarray:
        return np.exp(-self.gamma * self.var)

    def back(self, by_mean: np.ndarray, by_var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Derivatives by m Wm and v Wv from those by M and S."""
        return by_mean * np.where(self.pre_mean > 0, 1.0, np.exp(np.minimum(self.pre_mean, 0))), by_var * (self.pre_var > 0)


class GaussPass:
    """Two Gaussian layers over tables: the first propagates mean and variance with exponents -1/2 and -1, the second its mean only; the output is a draw.

    loss: cross entropy of the train part, beta1 times the summed divergence of the first
    layer from the standard normal, and beta2 times its squared weights.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, split: DataFrame, gamma: float = 1.0, beta1: float = 5e-4, beta2: float = 5e-4, dropout: float = 0.0, seed: int = 0) -> None:
        self.half, self.full = cut(normalize.power(edges, nodes, -0.5), "half"), cut(normalize.power(edges, nodes, -1.0), "full")
        self.gamma, self.beta1, self.beta2, self.dropout, self.seed = gamma, beta1, beta2, dropout, seed
        self.x = cut(nodes.select("id", F.col("attr").cast("array<double>").alias("h")), "features")
        self.features = len(self.x.first().h)
        self.classes = int(nodes.agg(F.max("label")).first()[0]) + 1
        self.known = cut(nodes.select("id", F.col("label").cast("long").alias("label")).join(split.filter("part in ('train', 'val')").select("id", "part"), "id"), "labels")
        self.count = max(1, self.known.filter("part = 'train'").count())

    def _first(self, p: dict, step: int, rate: float):
        """The first layer of a batch (id, attributes), and its inputs."""
        gamma, seed = self.gamma, self.seed

        def make(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, Gauss]:
            x = x * mask(rate, x.shape[1], seed, step, 1, ids) if rate else x
            return x, Gauss.of(x, x, p["m1"], p["v1"], gamma)

        return make

    def _second(self, p: dict, step: int, rate: float):
        """The second layer of a batch (id, mean and variance side by side), and its inputs."""
        gamma, seed = self.gamma, self.seed

        def make(ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, Gauss]:
            h = h * mask(rate, h.shape[1], seed, step, 2, ids) if rate else h
            mean, var = np.split(h, 2, axis=1)
            return mean, var, Gauss.of(mean, var, p["m2"], p["v2"], gamma)

        return make

    def forward(self, p: dict, step: int, rate: float) -> tuple[DataFrame, DataFrame, float]:
        """(id, h) between the layers, (id, h) of the drawn output, and the first layer's divergence."""
        first, second, hidden, classes, seed = self._first(p, step, rate), self._second(p, step, rate), p["m1"].shape[1], p["m2"].shape[1], self.seed

        def sent(b: pa.RecordBatch) -> np.ndarray:
            g = first(b.column(0).to_numpy(), _matrix(b.column(1), len(b)))[1]
            return np.hstack([g.mean * g.damping, g.var * g.damping**2])

        def divergence(b: pa.RecordBatch, out: np.ndarray) -> None:
            g = first(b.column(0).to_numpy(), _matrix(b.column(1), len(b)))[1]
            out += 0.5 * (g.mean**2 + g.var - np.log(1e-8 + g.var)).mean(1).sum()

        out = cut(_map(self.x, sent), "sent")
        mean = _hop(self.half, out.select("id", F.slice("h", 1, hidden).alias("h")), hidden, "m")
        var = _hop(self.full, out.select("id", F.slice("h", hidden + 1, hidden).alias("h")), hidden, "v")
        between = cut(mean.join(var, "id").select("id", F.concat("m", "v").alias("h")), "between")

        def send(b: pa.RecordBatch) -> np.ndarray:
            g = second(b.column(0).to_numpy(), _matrix(b.column(1), len(b)))[2]
            return g.mean * g.damping

        def draw(b: pa.RecordBatch) -> np.ndarray:
            ids = b.column(0).to_numpy()
            g = second(ids, _matrix(b.column(1), len(b)))[2]
            return _matrix(b.column(2), len(b)) + normal(classes, seed, step, 9, ids) * np.sqrt(g.var + 1e-8)

        moved = _hop(self.half, _map(between, send), classes, "m")
        z = cut(_map(between.join(moved, "id").select("id", "h", "m"), draw), "output")
        return between, z, float(_add_up(self.x.mapInArrow(_task_sum(1, divergence), "g array<double>"), 1)[0])

    judged = GcnPass.judged

    def gradients(self, p: dict, between: DataFrame, z: DataFrame, step: int) -> dict[str, np.ndarray]:
        """Derivatives of the loss by all weights."""
        rate, gamma, beta1, count, seed = self.dropout, self.gamma, self.beta1, self.count, self.seed
        first, second, hidden, classes = self._first(p, step, rate), self._second(p, step, rate), p["m1"].shape[1], p["m2"].shape[1]
        fit = z.join(self.known.filter("part = 'train'").select("id", "label"), "id").select("id", "h", "label")
        g = cut(_map(fit, lambda b: cross_entropy(_matrix(b.column(1), len(b)), b.column(2).to_numpy())[1] / count, "g"), "errors")
        none = F.array(*[F.lit(0.0)] * classes)
        pulled = _hop(reversed_edges(self.half), g.withColumnRenamed("g", "h"), classes, "u")
        rows = between.join(pulled, "id", "left").join(g, "id", "left").select("id", "h", F.coalesce("u", none).alias("u"), F.coalesce("g", none).alias("g"))
        rows = cut(rows, "second")

        def errors(b: pa.RecordBatch) -> tuple:
            ids = b.column(0).to_numpy()
            mean, var, s = second(ids, _matrix(b.column(1), len(b)))
            u, g = _matrix(b.column(2), len(b)), _matrix(b.column(3), len(b))
            by_var = -gamma * u * s.mean * s.damping + g * normal(classes, seed, step, 9, ids) / (2 * np.sqrt(s.var + 1e-8))
            return ids, mean, var, *s.back(u * s.damping, by_var)

        def add_second(b: pa.RecordBatch, out: np.ndarray) -> None:
            _, mean, var, by_mean, by_var = errors(b)
            out += np.concatenate([(mean.T @ by_mean).ravel(), (var.T @ by_var).ravel()])

        def to_first(b: pa.RecordBatch) -> np.ndarray:
            ids, _, _, by_mean, by_var = errors(b)
            back = np.hstack([by_mean @ p["m2"].T, by_var @ p["v2"].T])
            return back * mask(rate, back.shape[1], seed, step, 2, ids) if rate else back

        second_sum = _add_up(rows.mapInArrow(_task_sum(2 * hidden * classes, add_second), "g array<double>"), 2 * hidden * classes)
        down = cut(_map(rows, to_first), "first")
        by_mean = _hop(reversed_edges(self.half), down.select("id", F.slice("h", 1, hidden).alias("h")), hidden, "m")
        by_var = _hop(reversed_edges(self.full), down.select("id", F.slice("h", hidden + 1, hidden).alias("h")), hidden, "v")
        last = self.x.join(by_mean.join(by_var, "id"), "id").select("id", "h", "m", "v")  # every node has a loop, so no row is missing

        def add_first(b: pa.RecordBatch, out: np.ndarray) -> None:
            x, s = first(b.column(0).to_numpy(), _matrix(b.column(1), len(b)))
            u, v = _matrix(b.column(2), len(b)), _matrix(b.column(3), len(b))
            d = s.damping
            by_m = u * d + beta1 / hidden * s.mean
            by_v = -gamma * u * s.mean * d + v * d * d * (1 - 2 * gamma * s.var) + beta1 / hidden * 0.5 * (1 - 1 / (1e-8 + s.var))
            pre_m, pre_v = s.back(by_m, by_v)
            out += np.concatenate([(x.T @ pre_m).ravel(), (x.T @ pre_v).ravel()])

        size = 2 * self.features * hidden
        first_sum = _add_up(last.mapInArrow(_task_sum(size, add_first), "g array<double>"), size)
        flat = {**_unpacked(first_sum, {k: p[k] for k in ("m1", "v1")}), **_unpacked(second_sum, {k: p[k] for k in ("m2", "v2")})}
        return {k: flat[k] + (2 * self.beta2 * p[k] if k.endswith("1") else 0) for k in p}


def train_rgcn(
    edges: DataFrame, nodes: DataFrame, split: DataFrame, hidden: int = 16, epochs: int = 50, lr: float = 0.01, gamma: float = 1.0, beta1: float = 5e-4, beta2: float = 5e-4, dropout: float = 0.0, seed: int = 0,
) -> tuple[dict[str, np.ndarray], list[dict]]:
    """Full-batch training of a two-layer Gaussian network by Adam; the weights m1, v1, m2, v2 of the best validation accuracy, and a trace row an epoch."""
    run = GaussPass(edges, nodes, split, gamma, beta1, beta2, dropout, seed)
    rng = np.random.default_rng(seed)
    shapes = {"m1": (run.features, hidden), "v1": (run.features, hidden), "m2": (hidden, run.classes), "v2": (hidden, run.classes)}
    adam = Adam({k: rng.uniform(-1, 1, s) * (6 / sum(s)) ** 0.5 for k, s in shapes.items()}, lr, 0.0)
    best, trace = (-1.0, dict(adam.p)), []
    for epoch in range(epochs):
        p = dict(adam.p)
        between, z, divergence = run.forward(p, epoch, dropout)
        found = run.judged(z)
        if dropout:
            found |= {k: v for k, v in run.judged(run.forward(p, epoch, 0.0)[1]).items() if k.startswith("val")}
        squares = sum(float((p[k] ** 2).sum()) for k in ("m1", "v1"))
        trace.append({"epoch": epoch, **found, "divergence": divergence, "loss": found["train"] + beta1 * divergence + beta2 * squares})
        if found["val_accuracy"] > best[0]:
            best = (found["val_accuracy"], p)
        adam.step(run.gradients(p, between, z, epoch))
    return best[1], trace
