"""Column functions used by several operators: entropy and divergence of distributions, kappa, correlation from sums, set similarity, seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(shares: Column) -> Column:
    """Entropy in bits of an array of shares; empty shares add nothing."""
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def divergence(p: Column, q: Column) -> Column:
    """One outcome's part of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson's r from sums; null without variance (corr would raise or give NaN)."""
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((vx > 1e-9) & (vy > 1e-9), (n * xy - x * y) / F.sqrt(vx * vy))


def kappa(n: Column, agreed: Column, expected: Column) -> Column:
    """Cohen's kappa from the number of items, of agreed ones, and the sum over labels of the product of the raters' counts; null without items, 1 where chance alone agrees fully."""
    po, pe = agreed / n, expected / (n * n)
    return F.when(n == 0, None).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))


def words_of(text: Column) -> Column:
    """Distinct words in small letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard similarity; 0 when both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def seeded(seed: int, *cols: str | Column) -> Column:
    """Hex SHA-256 of the seed and the columns, with zero bytes between; its order is a fixed shuffle."""
    parts = [F.lit(str(seed)), *(F.col(c) if isinstance(c, str) else c for c in cols)]
    joined = [x for p in parts for x in (p.cast("string"), F.lit("\0"))][:-1]
    return F.sha2(F.concat(*joined), 256)


def hash_index(digest: Column, size: Column) -> Column:
    """A number under size from the first 8 bytes of a hex digest, read big-endian."""
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), size.cast("decimal(20,0)")).cast("int")
