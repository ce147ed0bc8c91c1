"""Dense vectors as arrays of doubles, and the activations, losses and updates over them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def axpy(k: Column | float, x: Column, y: Column) -> Column:
    """``k * x + y``."""
    return F.zip_with(x, y, lambda a, b: a * k + b)


def argmax(a: Column) -> Column:
    """Position from 0 of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column, floor: float = 1e-12) -> Column:
    """``a`` over the root of its squared length, the latter ``floor`` at least."""
    length = F.sqrt(F.greatest(dot(a, a), F.lit(floor)))
    return F.transform(a, lambda x: x.cast("double") / length)


def d_l2_normalized(a: Column, grad: Column, floor: float = 1e-12) -> Column:
    sq = F.greatest(dot(a, a), F.lit(floor))
    inner = dot(a, grad)
    return F.zip_with(a, grad, lambda x, g: (g - x * inner / sq) / F.sqrt(sq))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def d_relu(a: Column, grad: Column) -> Column:
    return F.zip_with(a, grad, lambda x, g: F.when(x > 0, g).otherwise(0.0))


def leaky_relu(a: Column, slope: float = 0.2) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, x).otherwise(x * slope))


def d_leaky_relu(a: Column, grad: Column, slope: float = 0.2) -> Column:
    return F.zip_with(a, grad, lambda x, g: F.when(x > 0, g).otherwise(g * slope))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    up = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(up, F.lit(0.0), lambda s, x: s + x)
    return F.transform(up, lambda x: x / total)


def d_softmax(p: Column, grad: Column) -> Column:
    inner = dot(p, grad)
    return F.zip_with(p, grad, lambda x, g: x * (g - inner))


def cross_entropy(p: Column, label: Column) -> Column:
    """Loss of a probability vector for the class ``label`` from 0; a probability of 0 counts as 1e-10."""
    own = F.element_at(p, (label + 1).cast("int"))
    return -F.ln(F.when(own == 0, F.lit(1e-10)).otherwise(own))


def d_cross_entropy(p: Column, label: Column) -> Column:
    return F.transform(p, lambda x, i: x - F.when(i == label, 1.0).otherwise(0.0))


def sigmoid_cross_entropy(a: Column, targets: Column) -> Column:
    """Summed multi-label loss in its stable form."""
    each = F.zip_with(a, targets, lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.ln(1 + F.exp(-F.abs(x))))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def dropout(a: Column, rate: float, *key: Column, seed: int = 1) -> Column:
    """``a`` with components dropped by a seeded hash of ``key`` and position; the rest is scaled by ``1 / (1 - rate)``."""
    unit = lambda i: (F.pmod(F.xxhash64(F.lit(seed), i, *key), F.lit(1 << 24)).cast("double") + 0.5) / (1 << 24)
    return F.transform(a, lambda x, i: F.when(unit(i) >= rate, x / (1 - rate)).otherwise(0.0))


def d_dropout(d: Column, rate: float, *key: Column, seed: int = 1) -> Column:
    """The gradient through :func:`dropout`, which for a fixed mask is linear: the same mask and scale."""
    return dropout(d, rate, *key, seed=seed)


def matvec(a: Column, weights: list[list[float]]) -> Column:
    """``a`` times a small matrix given by rows."""
    columns = list(zip(*weights, strict=True))
    return F.array(*[dot(a, F.array(*[F.lit(float(w)) for w in c])) for c in columns])
