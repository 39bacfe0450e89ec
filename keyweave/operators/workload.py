"""Relations with a chosen correlation, made by Spark: the same rows for the same seed, at any number of partitions."""

from __future__ import annotations

from math import inf
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import uniform

DISTRIBUTIONS = ("uniform", "normal", "beta", "beta_order", "zipf")


def _normal(row: Column, seed: int) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(row, seed))) * F.cos(2 * F.lit(3.141592653589793) * uniform(row, seed + 1))


def _poly(x: Column, *factors: float) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


#: Fixed values of Acklam's approximation: numerators and denominators near the middle and in the tails, and where the tails begin.
NEAR = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
)
FAR = (
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)
TAIL = 0.02425


def _normal_within(u: Column, most: float) -> Column:
    """The normal deviate between -most and most below which lies a part u of those between them.

    By Acklam's rational approximation of the inverse, whose relative error is 1.2e-9.
    """
    low = NormalDist().cdf(-most)
    p = low + (u + 2.0**-33) * (1 - 2 * low)
    q, t = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    near = q * _poly(q * q, *NEAR[0]) / _poly(q * q, *NEAR[1])
    far = _poly(t, *FAR[0]) / _poly(t, *FAR[1])
    return F.when(F.least(p, 1 - p) >= TAIL, near).otherwise(F.when(q < 0, far).otherwise(-far))


def drawn(row: Column, keys: int, dist: str = "uniform", seed: int = 0, alpha: float = 1.0, beta: float = 1.0, dev: float = 1.0) -> Column:
    """The key from 0 to keys - 1 to which a row refers.

    normal: around the middle, with a deviation of dev quarters of the keys, distributed as
    if draws out of range were rejected. beta: by the inverse of Kumaraswamy's closed form. beta_order:
    the beta distribution itself for whole alpha and beta, as the alpha-th smallest of alpha + beta - 1 uniform numbers. zipf: by the inverse of the
    continuous distribution with density x^-alpha.
    """
    u, n = uniform(row, seed), float(keys)
    if dist == "uniform":
        x = u * n
    elif dist == "normal":
        x = F.greatest(n / 2 + _normal_within(u, 2 / dev if dev else inf) * (dev * n / 4), F.lit(0.0))
    elif dist == "beta":
        x = F.pow(1 - F.pow(1 - u, 1 / beta), 1 / alpha) * n
    elif dist == "beta_order":
        if min(alpha, beta) < 1 or alpha % 1 or beta % 1:
            raise ValueError("beta_order takes whole numbers from 1 on")
        x = F.array_sort(F.array(*(uniform(row, seed + i) for i in range(int(alpha + beta) - 1))))[int(alpha) - 1] * n
    elif dist == "zipf":
        if abs(alpha - 1) < 1e-9:
            x = F.exp(u * F.log(F.lit(n + 1))) - 1
        else:
            top = (n + 1) ** (1 - alpha)
            x = F.pow(u * (top - 1) + 1, 1 / (1 - alpha)) - 1
    else:
        raise ValueError(f"no distribution named {dist}; there are {', '.join(DISTRIBUTIONS)}")
    return F.least(F.floor(x), F.lit(keys - 1)).cast("long")


def pair(spark: SparkSession, r_rows: int, s_rows: int, dist: str = "uniform", payload: int = 1016, seed: int = 0, **shape: float) -> tuple[DataFrame, DataFrame]:
    """R (key, value) with r_rows keys and S (key, value) with s_rows rows that refer to them."""
    text = lambda c: F.substring(F.repeat(F.md5(c.cast("string").cast("binary")), payload // 32 + 1), 1, payload)
    r = spark.range(r_rows).select(F.col("id").alias("key"), text(F.col("id")).alias("value"))
    s = spark.range(s_rows).select(drawn(F.col("id"), r_rows, dist, seed, **shape).alias("key"), text(F.col("id") + r_rows).alias("value"))
    return r, s


def noisy(ct: DataFrame, deviation: float, seed: int = 0) -> DataFrame:
    """(key, m) with normal noise added to m: deviation is a part of the mean m. Never below 0."""
    mean = ct.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean"))
    return ct.crossJoin(F.broadcast(mean)).select("key", F.greatest(F.lit(0), F.round(F.col("m") + _normal(F.col("key"), seed) * deviation * F.col("mean"))).cast("long").alias("m"))


def rekeyed(s: DataFrame, s_key: str, row: Column, keys: int, dist: str, **shape: float) -> DataFrame:
    """S with its keys drawn anew."""
    return s.withColumn(s_key, drawn(row, keys, dist, **shape))


def hot_rekeyed(s: DataFrame, s_key: str, row: Column, part: float = 0.6, hot: int = 5, seed: int = 0) -> DataFrame:
    """S with that part of its rows moved to the keys 0 to hot - 1."""
    moved = F.floor(uniform(row, seed + 1) * hot).cast("long")
    return s.withColumn(s_key, F.when(uniform(row, seed) < part, moved).otherwise(F.col(s_key)))


def scattered(key: Column, keys: int, factor: int = 1_000_003, shift: int = 0) -> Column:
    """A one-to-one map of the keys 0 to keys - 1 among themselves, if factor has no divisor in common with keys."""
    return F.pmod(key * factor + shift, F.lit(keys))


def sparse(key: Column) -> Column:
    """Eight of every 32 keys are used."""
    return F.floor(key / 8) * 32 + F.pmod(key, F.lit(8))
