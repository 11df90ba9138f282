"""Robust means of wide rows with their derivatives by edge weights and by the neighbours' vectors.

A row's aggregate is s * sum_j q_j x_j, where s is its sum of weights. With g the gradient by
the aggregate, m = sum_j q_j x_j and u_j = s q_j <g, x_j - m>, every weight of the row has
the derivative <g, m> by way of s, and what changes the softmax's exponent of j by one changes
the result by u_j. The rest is the exponents' own derivative: weighted distances to the k
heaviest neighbours, or the distance to the dimension-wise median.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .robust import ROBUST_MEANS, gathered, near_arrays, soft_median_rows, soft_weights

_VECTOR = pa.list_(pa.float64())


def _attr(p: DataFrame) -> DataFrame:
    return p.select("id", F.col("h").alias("attr"))


def forward(a: DataFrame, p: DataFrame, mean: str, parameters: dict) -> DataFrame:
    """(id, h): the robust mean of the rows p(id, h) by the edges a."""
    if mean == "soft_median":
        rows = soft_median_rows(a, _attr(p), parameters.get("temperature", 1.0), parameters.get("p", 2.0))
        return rows.select(F.col("src").alias("id"), F.transform("mean", lambda v: v * F.col("s")).alias("h"))
    out = ROBUST_MEANS[mean](a, _attr(p), None, **parameters)
    return out.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("h"))


def medoid_row(x: np.ndarray, a: np.ndarray, s: float, g: np.ndarray, temperature: float, corrected: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Derivatives of <g, soft k-medoid> of one row: by any weight through s, by the k weights besides, and by the k vectors."""
    far, r, q = soft_weights(x, a, temperature, corrected)
    m = q @ x
    lead = (x - m) @ g
    c = -s * q * lead / temperature  # by the weighted distances
    by_weight = c @ far
    if corrected:
        by_weight = by_weight + s * r / (r @ a) * lead
    pull = np.divide(c[:, None] * a[None, :] + a[:, None] * c[None, :], far, out=np.zeros_like(far), where=far > 0)
    return float(g @ m), by_weight, s * q[:, None] * g + pull.sum(1)[:, None] * x - pull @ x


def _sum_rows(rows: DataFrame, key: str, value: str, width: int) -> DataFrame:
    sums = rows.groupBy(F.col(key).alias("id")).agg(*[F.sum(F.col(value)[c]).alias(f"c{c}") for c in range(width)])
    return sums.select("id", F.array(*[F.col(f"c{c}") for c in range(width)]).alias("g"))


def _medoid_backward(a: DataFrame, p: DataFrame, g: DataFrame, width: int, parameters: dict, inner: bool) -> tuple[DataFrame | None, DataFrame, DataFrame | None]:
    temperature, corrected = parameters.get("temperature", 1.0), parameters.get("with_weight_correction", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sums, grads = batch.column(1).to_numpy(), batch.column(3).flatten().to_numpy().reshape(len(batch), -1)
            out = []
            for s, gradient, (ids, w, x) in zip(sums, grads, near_arrays(batch.column(2)), strict=True):
                base, by_weight, by_vector = medoid_row(x, w, s, gradient, temperature, corrected)
                out.append((base, ids, by_weight, w, list(by_vector) if inner else []))
            types = (pa.float64(), pa.list_(pa.int64()), _VECTOR, _VECTOR, pa.list_(_VECTOR))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["src", "s", "base", "dst", "term", "weight", "by_vector"])

    rows = gathered(a, _attr(p), parameters.get("k", 32)).join(g.withColumnRenamed("id", "src"), "src").select("src", "s", "near", "g")
    rows = cut(rows.mapInArrow(run, "src long, s double, base double, dst array<long>, term array<double>, weight array<double>, by_vector array<array<double>>"), "rows")
    own = rows.select("src", F.explode(F.arrays_zip("dst", "term", "weight")).alias("e")).select("src", "e.dst", "e.term", "e.weight")
    if not inner:
        return rows.select("src", "base", "s"), own, None
    return rows.select("src", "base", "s"), own, _sum_rows(rows.select(F.explode(F.arrays_zip("dst", "by_vector")).alias("e")).select("e.dst", "e.by_vector"), "dst", "by_vector", width)


def _median_backward(a: DataFrame, p: DataFrame, g: DataFrame, width: int, parameters: dict, inner: bool) -> tuple[DataFrame | None, DataFrame, DataFrame | None]:
    temperature, power = parameters.get("temperature", 1.0), parameters.get("p", 2.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            w, low, soft, s = (batch.column(i).to_numpy()[:, None] for i in (2, 3, 4, 5))
            x, med, mean, g = (batch.column(i).flatten().to_numpy().reshape(len(batch), -1) for i in (6, 7, 8, 9))
            gap = x - med
            norm = (np.abs(gap) ** power).sum(1, keepdims=True) ** (1 / power)
            scale = x.shape[1] ** (1 / power)
            e = np.exp((low - norm / scale) / temperature) / soft
            lead = ((x - mean) * g).sum(1, keepdims=True)
            term = (mean * g).sum(1) + (s * e * lead)[:, 0]
            unit = np.divide(np.sign(gap) * np.abs(gap) ** (power - 1), norm ** (power - 1) * scale, out=np.zeros_like(gap), where=norm > 0)
            turn = -s * e * w * lead / temperature * unit
            vectors = [list(s * e * w * g + turn), list(-turn)] if inner else [[[]] * len(batch)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(term), batch.column(2), *[pa.array(v, _VECTOR) for v in vectors]], names=["src", "dst", "term", "weight", "by_vector", "by_median"])

    rows = cut(soft_median_rows(a, _attr(p), temperature, power).join(g.withColumnRenamed("id", "src"), "src"), "rows")
    joined = a.select("src", "dst", "weight").join(p.select(F.col("id").alias("dst"), F.col("h").cast("array<double>").alias("x")), "dst").join(rows, "src")
    found = joined.select("src", "dst", "weight", "low", "soft", "s", "x", "med", "mean", "g").mapInArrow(run, "src long, dst long, term double, weight double, by_vector array<double>, by_median array<double>")
    if not inner:
        return None, found.select("src", "dst", "term", "weight"), None
    found = cut(found, "terms")
    medians = _sum_rows(found, "src", "by_median", width).withColumnRenamed("id", "src").join(rows.select("src", "arg"), "src")
    cells = medians.select(F.posexplode(F.arrays_zip("arg", "g")).alias("k", "e")).select(F.col("e.arg").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.when(c == F.col("k"), F.col("e.g")).otherwise(0.0)).alias("by_vector"))
    every = found.select(F.col("dst").alias("id"), "by_vector").unionByName(cells)
    return None, found.select("src", "dst", "term", "weight"), _sum_rows(every, "id", "by_vector", width)


#: Means with derivatives: functions of (edges, rows, gradient by the results, width, parameters, whether the rows' gradient is wanted).
BACKWARD = {"soft_k_medoid": _medoid_backward, "soft_median": _median_backward}


def derivatives(a: DataFrame, p: DataFrame, g: DataFrame, width: int, mean: str, parameters: dict, inner: bool = True) -> tuple[DataFrame | None, DataFrame, DataFrame | None]:
    """(src, base, s), (src, dst, term, weight) and (id, g): the derivatives by the weights of the edges a of the rows in g(id, g), in two parts, and those by the rows p(id, h) if `inner`.

    All edges of a row, whose weights' sum is s, have its base (None: 0), some have a term besides, with which their weight
    comes. The choice of the k heaviest and the order behind a median count as fixed, as they
    are almost everywhere.
    """
    if mean not in BACKWARD:
        raise ValueError(f"no derivatives of {mean}; there are those of {', '.join(BACKWARD)}")
    return BACKWARD[mean](a, p, g, width, parameters, inner)


def backward(a: DataFrame, p: DataFrame, g: DataFrame, width: int, mean: str, parameters: dict, inner: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst, term) and (id, g): derivatives(), with a whole term for each edge."""
    base, own, by_rows = derivatives(a, p, g, width, mean, parameters, inner)
    own = own.select("src", "dst", "term")
    if base is not None:
        own = a.select("src", "dst").join(base.select("src", "base"), "src").join(own, ["src", "dst"], "left")
        own = own.select("src", "dst", (F.col("base") + F.coalesce("term", F.lit(0.0))).alias("term"))
    return own, by_rows
