"""Random graphs from pair distances and samples of points.

Draws come from a hash of the pair, the graph and a seed, so a task that is run
again draws the same.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from horograph.functions import distances
from horograph.operators.ordering import kth, numbered, quantile
from horograph.runtime import materialize


#: Range of the slope of link probabilities.
SLOPES = (1e-6, 1e3)


#: Modulus and multipliers of the draws: a prime below 2^31, so every step stays within 64 bits in any engine.
PRIME, MULTIPLIER, LINEAR = 2147483647, 48271, 69621


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from whole numbers, by quadratic steps modulo a prime."""
    m, square = F.lit(PRIME).cast("bigint"), F.lit(-1).cast("bigint")
    # one fold over keys and marks, so the expression grows with the keys only
    steps = F.array(*[e for k in key for e in (F.pmod(k.cast("bigint"), m), square, square)])
    x = F.aggregate(steps, F.lit(PRIME // 3).cast("bigint"), lambda x, e: F.pmod(F.when(e < 0, x * x + x * LINEAR + 1).otherwise(x * MULTIPLIER + e + 1), m))
    return x / float(PRIME)


def uniform_sql(*key: str) -> str:
    """The same draw in SQL."""
    x = f"CAST({PRIME // 3} AS BIGINT)"
    for k in key:
        x = f"(({x} * {MULTIPLIER} + ((CAST({k} AS BIGINT) % {PRIME}) + {PRIME}) % {PRIME} + 1) % {PRIME})"
        for _ in range(2):
            x = f"list_transform([{x}], lambda z: (z * z + z * {LINEAR} + 1) % {PRIME})[1]"
    return f"({x} / {PRIME}.0)"


def threshold_graph(pairs: DataFrame, links: int) -> DataFrame:
    """The ``links`` closest pairs; equal distances by (i, j).  Only pairs up to the distance of the last one are sorted."""
    edge = kth(pairs, "d", links - 1) if links > 0 else None
    near = pairs.where(F.lit(links > 0)) if edge is None else pairs.where(F.col("d") <= edge)
    return numbered(near, [F.asc("d"), F.asc("i"), F.asc("j")]).where(F.col("rn") <= links).drop("rn")


def fermi_dirac_sample(pairs: DataFrame, r: float, t: float, graphs: int = 1, seed: int = 0) -> DataFrame:
    """(graph_id, i, j): each pair linked on its own with its probability, once per graph."""
    p = distances.fermi_dirac(F.col("d"), r, t)
    each = pairs.withColumn("p", p).withColumn("graph_id", F.explode(F.sequence(F.lit(0), F.lit(graphs - 1))))
    return each.where(uniform(F.col("i"), F.col("j"), F.col("graph_id"), F.lit(seed)) < F.col("p")).select("graph_id", "i", "j")


def fit_fermi_dirac(pairs: DataFrame, edges: DataFrame, steps: int = 25) -> dict[str, float]:
    """Maximum-likelihood (r, t): Newton steps in (r / t, 1 / t), each one pass of sums over the pairs."""
    e = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("a"))
    o = pairs.join(e, ["i", "j"], "left").select("d", F.coalesce("a", F.lit(0.0)).alias("a"))
    o = materialize(o)
    start = quantile(o, "d", 0.5)
    if start is None:
        raise ValueError("no pairs to fit")
    b, s = float(start), 1.0  # z = b - s d
    nll = math.inf
    for _ in range(steps):
        z = b - s * F.col("d")
        p = distances.sigmoid(z)
        w = p * (1 - p)
        g = o.agg(
            F.sum(-F.when(F.col("a") > 0, distances.log_sigmoid(z)).otherwise(distances.log_sigmoid(-z))).alias("nll"),
            F.sum(p - F.col("a")).alias("gb"), F.sum(-(p - F.col("a")) * F.col("d")).alias("gs"),
            F.sum(w).alias("hbb"), F.sum(-w * F.col("d")).alias("hbs"), F.sum(w * F.col("d") * F.col("d")).alias("hss"),
        ).first()
        det = g["hbb"] * g["hss"] - g["hbs"] ** 2
        if abs(nll - g["nll"]) < 1e-9 * max(1.0, abs(g["nll"])) or det <= 1e-300:
            break
        nll = g["nll"]
        db, ds = (g["hss"] * g["gb"] - g["hbs"] * g["gs"]) / det, (g["hbb"] * g["gs"] - g["hbs"] * g["gb"]) / det
        shrink = 1.0
        while s - shrink * ds <= 1e-6 and shrink > 1e-6:
            shrink /= 2
        b, s = b - shrink * db, s - shrink * ds
    return {"r": b / s, "t": 1 / s, "nll": nll}


class FermiDirac:
    """A generator of graphs whose links are independent given the distances of the nodes."""

    def __init__(self, pairs: DataFrame, r: float | None = None, t: float = 1.0) -> None:
        """``pairs``: (i, j, d) of all nodes; ``r`` is by default their median distance."""
        self.pairs, self.t = pairs, t
        self.r = r if r is not None else quantile(pairs, "d", 0.5) or 0.0

    @classmethod
    def from_embedding(cls, coordinates: DataFrame, r: float | None = None, t: float = 1.0) -> "FermiDirac":
        """From the coordinates (node_id, r, v) of a fit."""
        from horograph.operators.pairs import polar_distances

        return cls(materialize(polar_distances(coordinates)), r, t)

    def fit(self, edges: DataFrame) -> "FermiDirac":
        """The parameters that make ``edges`` most likely; nodes are matched by id."""
        found = fit_fermi_dirac(self.pairs, edges)
        self.r, self.t = found["r"], found["t"]
        return self

    def probabilities(self) -> DataFrame:
        return self.pairs.select("i", "j", distances.fermi_dirac(F.col("d"), self.r, self.t).alias("p"))

    def sample(self, graphs: int = 1, seed: int = 0) -> DataFrame:
        return fermi_dirac_sample(self.pairs, self.r, self.t, graphs, seed)


def estimate_temperature(pairs: DataFrame, arrival: DataFrame, edges: DataFrame, zeta: float = 1.0, steps: int = 60) -> float:
    """The temperature whose link probabilities fit the edges best, for coordinates that are given.

    Beyond its threshold (that of the end that arrived later, ``arrival``:
    node_id, pos, threshold) a pair is linked with the probability sigmoid(-s u),
    s = zeta / (2 temperature).  The likelihood is concave in s: Newton steps,
    each one pass of sums over the pairs, inside a bracket that shrinks by the
    sign of the slope.  Ends at the bounds of s with a warning.
    """
    from horograph.operators.pairs import gather

    e = edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct().withColumn("a", F.lit(1.0))
    g = gather(pairs, arrival, ["pos", "threshold"]).join(e, ["i", "j"], "left")
    later = F.when(F.col("pos_j") > F.col("pos_i"), F.col("threshold_j")).otherwise(F.col("threshold_i"))
    o = materialize(g.select((F.col("d") - later).alias("u"), F.coalesce("a", F.lit(0.0)).alias("a")))
    low, high = SLOPES
    s = 1.0
    for _ in range(steps):
        p = distances.sigmoid(-s * F.col("u"))
        slope, bend = o.agg(F.sum((F.col("a") - p) * F.col("u")), F.sum(p * (1 - p) * F.col("u") * F.col("u"))).first()
        if slope is None:
            raise ValueError("no pairs to fit")
        # the slope of the negative log-likelihood by s
        if slope > 0:
            high = s
        else:
            low = s
        new = s - slope / bend if bend > 0 else low
        new = new if low < new < high else math.sqrt(low * high)
        if abs(new - s) <= 1e-10 * s or high / low < 1 + 1e-12:
            s = new
            break
        s = new
    if s <= SLOPES[0] * 1.001 or s >= SLOPES[1] * 0.999:
        warnings.warn("link probabilities are nearly a step or nearly flat: the temperature is at its bound", stacklevel=2)
    return zeta / (2 * s)


def uniform_disk(spark: SparkSession, n: int, radius: float, seed: int = 0) -> DataFrame:
    """(node_id, r, theta) uniform by Euclidean area."""
    p = spark.range(n).withColumnRenamed("id", "node_id")
    return p.select("node_id", (radius * F.sqrt(uniform(F.col("node_id"), F.lit(seed), F.lit(0)))).alias("r"), (2 * math.pi * uniform(F.col("node_id"), F.lit(seed), F.lit(1))).alias("theta"))


def uniform_hyperbolic_disk(spark: SparkSession, n: int, radius: float, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(node_id, r, theta) with radial density proportional to sinh(alpha r)."""
    p = spark.range(n).withColumnRenamed("id", "node_id")
    u = uniform(F.col("node_id"), F.lit(seed), F.lit(0))
    return p.select("node_id", (F.acosh(1 + u * (math.cosh(alpha * radius) - 1)) / alpha).alias("r"), (2 * math.pi * uniform(F.col("node_id"), F.lit(seed), F.lit(1))).alias("theta"))


def dot_product_sample(positions: DataFrame, graphs: int = 1, seed: int = 0) -> DataFrame:
    """(graph_id, i, j) of random dot-product graphs: positions (node_id, x, signs), a pair linked with its signed product held to [0, 1]."""
    from horograph.operators.pairs import expand_pairs, gather

    g = gather(expand_pairs(positions), positions, ["x", "signs"])
    terms = F.zip_with(F.zip_with("x_i", "x_j", lambda a, b: a * b), "signs_i", lambda a, s: a * s)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)))
    each = g.select("i", "j", p.alias("p")).withColumn("graph_id", F.explode(F.sequence(F.lit(0), F.lit(graphs - 1))))
    return each.where(uniform(F.col("i"), F.col("j"), F.col("graph_id"), F.lit(seed)) < F.col("p")).select("graph_id", "i", "j")
