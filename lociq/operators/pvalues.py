"""Combining p-values of one variant over methods. Input: an array column of p-values, nulls ignored; all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def clean(p: str, z: float = 0.5) -> Column:
    """Sorted non-null p-values; those below 1e-300 become z times the least other one."""
    s = F.array_sort(F.filter(p, lambda x: x.isNotNull()))
    least = F.coalesce(F.array_min(F.filter(s, lambda x: x >= TINY)), F.lit(1.0))
    return F.transform(s, lambda x: F.when(x < TINY, z * least).otherwise(x))


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + f(x))


def simes(p: str) -> Column:
    s = clean(p)
    return F.least(F.lit(1.0), F.array_min(F.transform(s, lambda x, i: F.size(s).cast("double") * x / (i + 1).cast("double"))))


def fisher_statistic(p: str) -> Column:
    return -2.0 * _sum(clean(p), F.ln)


def fisher(p: str) -> Column:
    """Upper chi-square tail for 2m degrees of freedom, which has a closed form."""
    s = clean(p)
    half = -1.0 * _sum(s, F.ln)
    terms = F.aggregate(F.sequence(F.lit(1), F.size(s)), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")), lambda t, k: F.struct((t["term"] * half / k.cast("double")).alias("term"), (t["total"] + t["term"]).alias("total")), lambda t: t["total"])
    return F.exp(-half) * terms


def minimum(p: str) -> Column:
    return F.array_min(clean(p))


def maximum(p: str) -> Column:
    return F.array_max(clean(p))


def weighted(p: str) -> Column:
    """Product of p to equal weights that sum to one: the geometric mean."""
    s = clean(p)
    return F.exp(_sum(s, F.ln) / F.size(s).cast("double"))


def harmonic(p: str) -> Column:
    """The raw harmonic mean."""
    s = clean(p)
    return F.size(s).cast("double") / _sum(s, lambda x: 1.0 / x)


COMBINERS = {"simes": simes, "fisher": fisher, "minp": minimum, "maxp": maximum, "weight": weighted, "harmonic": harmonic}
