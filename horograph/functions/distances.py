"""Distances between two points, as Column expressions, and the link functions built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from horograph.functions.vectors import distance2, dot, norm2

# Two points of the stored ball are never further apart than this: 2 artanh(1 - 1e-7).
BALL_CEILING = 2.0 * math.atanh(1.0 - 1e-7)
FLOOR = 1e-12


def polar(r1: Column, v1: Column, r2: Column, v2: Column) -> Column:
    """Stable law of cosines: no difference of large terms."""
    half = F.sinh((r1 - r2) / 2)
    m = F.greatest(F.lit(0.0), 2 * half * half + 0.5 * F.sinh(r1) * F.sinh(r2) * distance2(v1, v2))
    return F.log1p(m + F.sqrt(m * (m + 2) + 1e-30))


def ball(x: Column, y: Column, curvature: float = 1.0, ceiling: bool = False) -> Column:
    """Distance of ball points; with ``ceiling`` capped as stored ball coordinates are."""
    m = 2 * distance2(x, y) / ((1 - norm2(x)) * (1 - norm2(y)))
    d = F.log1p(m + F.sqrt(m * (m + 2))) / math.sqrt(curvature)
    return F.least(d, F.lit(BALL_CEILING)) if ceiling else d


def hyperboloid(h: Column, g: Column) -> Column:
    """arcosh of the negative Minkowski product."""
    return F.acosh(F.greatest(F.lit(1.0), 2 * h[0] * g[0] - dot(h, g)))


def plane(r1: Column, r2: Column, dtheta: Column, zeta: float = 1.0) -> Column:
    """Distance in the plane of curvature -zeta^2 from radii and the angle between."""
    arg = F.cosh(zeta * r1) * F.cosh(zeta * r2) - F.sinh(zeta * r1) * F.sinh(zeta * r2) * F.cos(dtheta)
    return F.when(dtheta == 0, F.abs(r1 - r2)).otherwise(F.acosh(F.greatest(arg, F.lit(1.0))) / zeta)


def angle_between(t1: Column, t2: Column) -> Column:
    return math.pi - F.abs(math.pi - F.abs(t1 - t2))


def circular(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(2 * math.pi))
    return F.least(d, 2 * math.pi - d)


def sigmoid(z: Column) -> Column:
    """Logistic function that never overflows."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_sigmoid(z: Column) -> Column:
    return -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def fermi_dirac(d: Column, r: Column | float, t: Column | float) -> Column:
    """Link probability at distance ``d``: 1 / (exp((d - r) / t) + 1)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return sigmoid((lit(r) - d) / lit(t))


def sphere_link(dtheta: Column, ka: Column, kb: Column, beta: float, mu: float, radius: float, dim: int) -> Column:
    """Link probability of the geometric soft configuration model on a sphere."""
    chi = radius * dtheta / F.pow(mu * ka * kb, F.lit(1.0 / dim))
    return 1 / (1 + F.pow(F.greatest(chi, F.lit(FLOOR)), F.lit(float(beta))))


def clamp(p: Column, eps: float = FLOOR) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps)
    return F.log(q / (1 - q))
