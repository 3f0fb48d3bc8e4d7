"""Scalar expressions: rounding, hashing to buckets and draws, logits, angles."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793
CLIP = 1e-7


def quantised(c: Column, digits: int = 6) -> Column:
    """Half-up to so many digits, the same in any engine."""
    k = float(10**digits)
    return F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)


def finite(c: Column) -> Column:
    """Nulls, NaN and infinities become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def _half(text: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, 16), 16, 10).cast("decimal(20,0)")


def md5_bucket(text: Column, buckets: int = 100) -> Column:
    """The 128-bit digest modulo ``buckets``, from its halves: (high * 2^64 + low) mod n."""
    wrap = F.lit(2**64 % buckets)
    return ((_half(text, 1) % buckets * wrap + _half(text, 17) % buckets) % buckets).cast("bigint")


def md5_seed(text: Column) -> Column:
    """First 64 bits of the digest modulo 2^32."""
    return (_half(text, 1) % F.lit(2**32).cast("decimal(20,0)")).cast("bigint")


def draw(*keys: Column) -> Column:
    """A number in [0, 1) from the keys alone, so that replicates don't depend on how rows are dealt."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def log_uniform(u: Column, low: float, high: float) -> Column:
    return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))


def logit(p: Column) -> Column:
    p = clipped(p)
    return F.log(p / (1 - p))


def yaw_of(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Heading of a unit quaternion."""
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


# Coefficients of a published rational approximation of the normal distribution's tail, good to 1e-15.
TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """The first coefficient has the highest power."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(k) / far
    bell = F.exp(-a * a / 2)
    tail = F.when(a < 7.07106781186547, bell * polynomial(a, TAIL_TOP) / polynomial(a, TAIL_BOTTOM)).otherwise(bell / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


# Coefficients of a published rational approximation of the normal quantile, good to 1e-9 relative.
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ENDS_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ENDS_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_quantile_of(p: Column) -> Column:
    """Of a column within (0, 1)."""
    low = F.least(p, 1 - p)
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    t = F.sqrt(-2 * F.log(low))
    end = polynomial(t, ENDS_TOP) / polynomial(t, ENDS_BOTTOM)
    return F.when(low >= 0.02425, q * polynomial(r, MIDDLE_TOP) / polynomial(r, MIDDLE_BOTTOM)).otherwise(F.when(p < 0.5, end).otherwise(-end))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
