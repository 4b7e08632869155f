"""Expressions over a curve, an ``array<bigint>`` of counts indexed by age.

All are built-in expressions, evaluated in the JVM without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)


def peak_age(c: Column) -> Column:
    """First age of the highest count."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def beauty(c: Column) -> Column:
    """Sum over ages up to the peak of the distance of the count below the line
    from the first count to the peak, each over max(1, count)."""
    tm = peak_age(c)
    first, top = c[0].cast("double"), F.array_max(c).cast("double")
    step = F.when(tm > 0, (top - first) / tm).otherwise(0.0)
    terms = F.transform(F.slice(c, 1, tm + 1), lambda x, t: (first + step * t - x) / F.greatest(F.lit(1).cast("long"), x))
    return F.when(tm == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def awakening_age(c: Column) -> Column:
    """First age up to the peak at the greatest distance from that line; the
    distances share a denominator, so whole numbers decide."""
    tm = peak_age(c)
    far = F.transform(F.slice(c, 1, tm + 1), lambda x, t: F.abs((F.array_max(c) - c[0]) * t - tm * x + tm * c[0]))
    return (F.array_position(far, F.array_max(far)) - 1).cast("int")


def burstiness(c: Column) -> Column:
    n, s = F.size(c), total(c)
    mean = s / n
    var = F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when(s == 0, 0.0).otherwise(F.sqrt(var) / mean)


def gini(c: Column) -> Column:
    n, s = F.size(c), total(c)
    ranked = F.transform(F.array_sort(c), lambda x, i: x * (n - i))
    return F.when(s == 0, 0.0).otherwise((n + 1 - 2.0 * total(ranked) / s) / n)


def first_nonzero_age(c: Column) -> Column:
    return (F.array_position(F.transform(c, lambda x: x > 0), True) - 1).cast("int")


def longest_zero_run(c: Column) -> Column:
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, x):
        now = F.when(x == 0, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(c, start, step, lambda s: s["best"])


def resurgences(c: Column) -> Column:
    """Ages with citations that follow one without."""
    return F.size(F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda i: (F.get(c, i) > 0) & (F.get(c, i - 1) == 0)))


def citation_features(c: Column, n: int) -> dict[str, Column]:
    """The features of a curve up to age ``n``."""
    cum = total(F.slice(c, 1, n + 1))
    out = {"cum_citations": cum}
    out |= {f"cite_yr{a}": c[a] for a in range(n + 1)}
    out["cite_last1yr"] = c[n]
    out["cite_last3yr"] = c[n] + c[n - 1] + c[n - 2]
    out["cite_growth_rate"] = (c[n] - c[0]) / (c[0] + 1)
    out["cite_growth_last3"] = (c[n] - c[n - 3]) / (c[n - 3] + 1) if n >= 3 else F.lit(0.0)
    out["cite_acceleration"] = (c[n] - c[n - 1]) - (c[n - 1] - c[n - 2])
    out["cite_peak_ratio"] = F.array_max(F.slice(c, 1, n + 1)) / F.greatest(cum, F.lit(1).cast("long"))
    out["cite_active_years"] = F.size(F.filter(F.slice(c, 1, n + 1), lambda x: x > 0))
    out["zero_citation"] = (cum == 0).cast("int")
    return out
