"""Conversions between the charts of hyperbolic space, as Column expressions.

The polar chart ``(r, v)`` with a unit direction ``v`` is the lossless one; the
others are read from it and into it.  Nulls give nulls; the origin has the
direction e0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from horograph.functions.vectors import combine, dot, first_axis, norm, norm2, scale, unit

# Guards of the charts: fixed values.
RIM, READ_RIM, FLAT_RIM = 1e-15, 1e-12, 1e-5
TURN = 2.0 * math.pi


def polar_to_ball(r: Column, v: Column, eps: float = RIM) -> Column:
    return scale(v, F.least(F.tanh(r / 2), F.lit(1.0 - eps)))


def ball_radius(x: Column, eps: float = READ_RIM) -> Column:
    return 2 * F.atanh(F.least(norm(x), F.lit(1.0 - eps)))


def ball_to_polar(x: Column, eps: float = READ_RIM) -> tuple[Column, Column]:
    return ball_radius(x, eps), unit(x)


def polar_to_hyperboloid(r: Column, v: Column) -> Column:
    return F.concat(F.array(F.cosh(r)), scale(v, F.sinh(r)))


def _space(h: Column) -> Column:
    return F.slice(h, F.lit(2), F.size(h) - 1)


def hyperboloid_to_polar(h: Column) -> tuple[Column, Column]:
    s = _space(h)
    return F.asinh(norm(s)), unit(s)


def ball_to_hyperboloid(x: Column, eps: float = READ_RIM) -> Column:
    n2 = F.least(norm2(x), F.lit(1.0 - eps))
    return F.concat(F.array((1 + n2) / (1 - n2)), scale(x, 2 / (1 - n2)))


def hyperboloid_to_ball(h: Column, eps: float = FLAT_RIM) -> Column:
    x = scale(_space(h), 1 / (1 + h[0]))
    n = norm(x)
    return F.when(n > 1 - eps, scale(x, (1 - eps) / n)).otherwise(x)


def flat_polar_to_ball(theta: Column, r: Column, zeta: float = 1.0, eps: float = FLAT_RIM) -> Column:
    rho = F.least(F.tanh(zeta * r / 2), F.lit(1.0 - eps))
    return F.array(rho * F.cos(theta), rho * F.sin(theta))


def ball_to_flat_polar(x: Column, zeta: float = 1.0, eps: float = READ_RIM) -> tuple[Column, Column]:
    n = F.greatest(F.least(norm(x), F.lit(1.0 - eps)), F.lit(eps))
    return F.pmod(F.atan2(x[1], x[0]), F.lit(TURN)), (2.0 / zeta) * F.atanh(n)


def angles_to_direction(angles: Column) -> Column:
    """Hyperspherical angles to the unit vector with one entry more."""
    start = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("u"))
    run = F.aggregate(angles, start, lambda s, a: F.struct((s["p"] * F.sin(a)).alias("p"), F.concat(s["u"], F.array(s["p"] * F.cos(a))).alias("u")))
    return F.concat(run["u"], F.array(run["p"]))


def hyperspherical_to_ball(angles: Column, r: Column, zeta: float = 1.0, eps: float = FLAT_RIM) -> Column:
    return scale(angles_to_direction(angles), F.least(F.tanh(zeta * r / 2), F.lit(1.0 - eps)))


def direction_to_angles(x: Column) -> Column:
    """Hyperspherical angles of a vector: arc cosines of suffix norms, the last one over the full turn."""
    d = F.size(x)
    tail = lambda k: F.sqrt(norm2(F.slice(x, k, d - k + 1)))
    inner = F.transform(
        F.when(d > 2, F.sequence(F.lit(1), d - 2)).otherwise(F.array().cast("array<int>")),
        lambda k: F.when(tail(k) == 0, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.element_at(x, k) / tail(k))))),
    )
    last = F.pmod(F.atan2(F.element_at(x, -1), F.element_at(x, d - 1)), F.lit(TURN))
    return F.concat(inner, F.array(last))


def ball_to_hyperspherical(x: Column, zeta: float = 1.0, eps: float = READ_RIM) -> tuple[Column, Column]:
    n = F.greatest(F.least(norm(x), F.lit(1.0 - eps)), F.lit(eps))
    return direction_to_angles(x), (2.0 / zeta) * F.atanh(n)


def recenter(x: Column, center: Column, curvature: float = 1.0) -> Column:
    """Moebius translation that carries ``center`` to the origin."""
    k = F.lit(curvature)
    inner, c2, x2 = -dot(center, x), norm2(center), norm2(x)
    den = 1 + 2 * k * inner + k * k * c2 * x2
    return combine(center, -(1 + 2 * k * inner + k * x2) / den, x, (1 - k * c2) / den)


def lift_angle(theta: Column, r: Column, d: int, zeta: float = 1.0) -> Column:
    """A plane point in ``d`` dimensions: the angle lies in the first two coordinates, the rest is 0."""
    flat = flat_polar_to_ball(theta, r, zeta)
    return F.concat(flat, F.array_repeat(F.lit(0.0), d - 2)) if d > 2 else flat


def fixed_radius(x: Column, rho: Column, eps: float = FLAT_RIM) -> Column:
    """Rescale to norm ``rho``, inside the rim."""
    n = norm(x)
    return scale(F.when(n == 0, first_axis(x)).otherwise(x), F.least(rho, F.lit(1.0 - eps)) / F.when(n == 0, 1.0).otherwise(n))
