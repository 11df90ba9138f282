"""Column functions: reproducible draws, stable softmax, vector arithmetic, margins and losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A draw in [0, 1) that depends on the seed and the keys only, whatever the partitioning."""
    return F.conv(F.substring(_digest(seed, keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def below(bound: int, seed: int | str, *keys: Column | str) -> Column:
    """A whole number from 0 to bound - 1, drawn like uniform from 60 bits in exact arithmetic."""
    bits = F.conv(F.substring(_digest(seed, keys), 1, 15), 16, 10).cast("decimal(19,0)")
    return F.call_function("div", bits * F.lit(str(bound)).cast("decimal(19,0)"), F.lit(str(1 << 60)).cast("decimal(19,0)"))


def _digest(seed: int | str, keys: tuple) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def softmax(z: Column, *keys: str) -> Column:
    """Softmax of z within the rows that share keys."""
    rows = Window.partitionBy(*keys)
    e = F.exp(z - F.max(z).over(rows))
    return e / F.sum(e).over(rows)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def reciprocal_power(x: Column, p: float) -> Column:
    """x ** -p, and 0 where x is not positive."""
    return F.when(x > 0, F.pow(x, F.lit(-p))).otherwise(F.lit(0.0))


def distance(a: Column, b: Column, p: float = 2.0) -> Column:
    """Lp distance of two arrays."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y) if p != 2.0 else (x - y) * (x - y))
    if p == 2.0:
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d))
    return F.pow(F.aggregate(gaps, F.lit(0.0), lambda s, d: s + F.pow(d, F.lit(p))), F.lit(1.0 / p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, d: s + d)


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x >= 0, x).otherwise(slope * x)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


#: Activations by name; the misspelt identity is part of the interface.
ACTIVATIONS = {
    "ReLU": lambda x: F.greatest(x, F.lit(0.0)),
    "SELU": lambda x: F.lit(1.0507009873554805) * F.when(x > 0, x).otherwise(F.lit(1.6732632423543772) * (F.exp(x) - 1)),
    "LeakyReLU": leaky_relu,
    "ELU": elu,
    "Tanh": F.tanh,
    "Identity": lambda x: x,
    "Identiy": lambda x: x,
}


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
