"""Array and scalar expressions over membership vectors: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def simplex(a: Column) -> Column:
    """Clipped at 0 and divided by the sum; without mass uniform."""
    clipped = F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))
    mass = total(clipped)
    return F.when(mass > EPS, F.transform(clipped, lambda x: x / mass)).otherwise(F.transform(a, lambda x: F.lit(1.0) / F.size(a)))


def is_simplex(a: Column, atol: float = 1e-6) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -atol)) & (F.abs(total(a) - 1) <= atol)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def argmax(a: Column) -> Column:
    """The first of the greatest, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def entropy(a: Column) -> Column:
    return -total(F.transform(a, lambda x: x * F.ln(F.greatest(x, F.lit(EPS)))))


def blend(a: Column, b: Column, beta: float) -> Column:
    """simplex((1 - beta) a + beta b)."""
    return simplex(F.zip_with(a, b, lambda x, y: x * (1 - beta) + y * beta))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def bipolar(x: Column) -> Column:
    return F.tanh(x / 2)


def einstein(mu: Column, m: Column, strength: float) -> Column:
    """Centred Einstein sum of 2 mu - 1 and strength * m, back on [0, 1]; m = 0 changes nothing."""
    r = mu * 2 - 1
    d = F.greatest(F.least(m, F.lit(1.0)), F.lit(-1.0)) * min(max(strength, 0.0), 1 - 1e-9)
    return F.greatest(F.least(((r + d) / F.greatest(1 + r * d, F.lit(EPS)) + 1) / 2, F.lit(1.0)), F.lit(0.0))


def phase(t: Column, period: int) -> tuple[Column, Column]:
    x = t * (2 * 3.141592653589793 / period)
    return F.sin(x), F.cos(x)


def slot_membership(x: Column, centroids: Column, scale: float, temperature: float) -> Column:
    """softmax(-|x - c|^2 / max(2 scale^2 T, 1e-8)) over an array of centroids."""
    width = max(2 * scale * scale * temperature, 1e-8)
    return softmax(F.transform(centroids, lambda c: -sqdist(x, c) / width))


def affine(x: list[Column], rows: list, bias: list | None = None) -> list[Column]:
    """x times a matrix of literal rows, a column an entry, plus a bias: sums of products that code generation keeps in the JVM."""
    out = []
    for j in range(len(rows[0])):
        terms = [c * F.lit(float(rows[i][j])) for i, c in enumerate(x)]
        out.append(sum(terms[1:], terms[0]) + F.lit(float(bias[j]) if bias else 0.0))
    return out
