"""Element-wise projections, index arithmetic and pseudo-random numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonneg(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def floor_small(x: Column, least: float, to: float) -> Column:
    """Values below least, negative ones too, become `to`."""
    return F.when(x < least, to).otherwise(x)


def floor_abs(x: Column, least: float, to: float) -> Column:
    """Values of absolute size below least become `to`."""
    return F.when(F.abs(x) < least, to).otherwise(x)


def truncate(x: Column, places: int = 12) -> Column:
    return F.floor(x * 10.0**places) / 10.0**places


def bound(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def adjust(x: Column, alpha: float, beta: float) -> Column:
    """ceil(alpha x + beta), and beta for negative values."""
    return F.when(x < 0, F.lit(float(beta))).otherwise(F.ceil(alpha * x + beta).cast("double"))


def safe_div(a: Column, b: Column, eps: float = 1e-17) -> Column:
    return a / (b + eps)


def split_size(n: Column, p: Column, r: Column) -> Column:
    """Size of block r when n is split over p blocks: the first n mod p have one more."""
    return F.floor(n / p) + F.when(r < n % p, 1).otherwise(0)


def split_start(n: Column, p: Column, r: Column) -> Column:
    return r * F.floor(n / p) + F.least(r, n % p)


def sub2ind(subs: list[Column], dims: list[int]) -> Column:
    """Linear index, first subscript fastest."""
    out, stride = F.lit(0).cast("long"), 1
    for s, d in zip(subs, dims, strict=True):
        out, stride = out + s * stride, stride * d
    return out


def ind2sub(ind: Column, dims: list[int]) -> list[Column]:
    out, stride = [], 1
    for d in dims:
        out.append(F.floor(ind / stride) % d)
        stride *= d
    return out


def uniform(seed: int, *keys: Column, portable: bool = False) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, so on no partitioning: 52 bits of their 64-bit hash, or with
    portable of an MD5 digest, which other engines have as well but takes longer."""
    if portable:
        digest = F.md5(F.concat_ws(",", F.lit(seed).cast("string"), *(k.cast("string") for k in keys)))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *(k.cast("long") for k in keys)), 12) / F.lit(float(1 << 52))


def normal(seed: int, *keys: Column, portable: bool = False) -> Column:
    """Box-Muller over two uniforms; the second one has a key more."""
    u, v = uniform(seed, *keys, portable=portable), uniform(seed, *keys, F.lit(-1), portable=portable)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(v * 6.283185307179586)
