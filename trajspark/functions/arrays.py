"""Interpolation and distances within arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it, inside of lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(a: Column, i: Column) -> Column:
    """Element ``i`` from 0, or null beyond the ends."""
    return F.get(a, i.cast("int"))


def by_index(a: Column, n: int) -> Column:
    """``n`` values spread evenly over the array's index, linearly interpolated."""

    def values(a: Column) -> Column:
        last = F.size(a) - 1
        step = (last / F.lit(float(max(n - 1, 1)))).cast("double")

        def value(k: Column) -> Column:
            p = F.least(k * step, last.cast("double"))
            i = F.least(F.floor(p), last)
            return at(a, i) + (at(a, F.least(i + 1, last)) - at(a, i)) * (p - i)

        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))

    return let(a, values)


def by_domain(t: Column, a: Column, n: int) -> Column:
    """``n`` values at even steps of the ascending domain ``t``, linearly interpolated; the first of equal domain values counts."""

    def values(both: Column) -> Column:
        t, a = both["t"], both["a"]
        last = F.size(t) - 1
        lo, hi = at(t, F.lit(0)), at(t, last)

        def value(k: Column) -> Column:
            x = F.when(k == n - 1, hi).otherwise(lo + (hi - lo) * k / F.lit(float(max(n - 1, 1))))
            # Number of domain values up to x: the segment that holds it.
            return let(F.struct(x.alias("x"), F.greatest(F.size(F.filter(t, lambda v: v <= x)) - 1, F.lit(0)).alias("i")), placed)

        def placed(p: Column) -> Column:
            x, i = p["x"], p["i"]
            j = F.least(i + 1, last)
            w = at(t, j) - at(t, i)
            return at(a, i) + F.when(w > 0, (at(a, j) - at(a, i)) * (x - at(t, i)) / w).otherwise(0.0)

        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))

    return let(F.struct(t.alias("t"), a.alias("a")), values)


def squared_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclid(a: Column, b: Column) -> Column:
    """Null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(squared_gap(a, b)))


def scaled(a: Column, weights: Sequence[float]) -> Column:
    """Each element times the square root of its weight, so that ``euclid`` of two is weighted."""
    w = F.array(*[F.lit(float(x) ** 0.5) for x in weights])
    return F.zip_with(a, w, lambda x, y: x * y)


def point_weights(n: int, groups: Sequence[tuple[int, int, float]], dims: int = 2, default: float = 1.0) -> list[float]:
    """Weights of ``n`` interleaved points: (first, last, weight) groups, ends included, later ones win."""
    w = [default] * n
    for first, last, value in groups:
        if value <= 0:
            raise ValueError("weights must be positive")
        for i in range(max(first, 0), min(last, n - 1) + 1):
            w[i] = float(value)
    return [x for x in w for _ in range(dims)]


def envelope(b: Column, radius: int) -> Column:
    """Least and greatest of each place's surroundings, as a struct of arrays (lo, hi)."""

    def around(b: Column) -> Column:
        window = lambda i: F.slice(b, F.greatest(i - radius, F.lit(0)) + 1, F.lit(2 * radius + 1) - F.greatest(F.lit(radius) - i, F.lit(0)))
        return F.struct(F.transform(b, lambda x, i: F.array_min(window(i))).alias("lo"), F.transform(b, lambda x, i: F.array_max(window(i))).alias("hi"))

    return let(b, around)


def envelope_bound(a: Column, env: Column) -> Column:
    """Lower bound of the squared-cost warping distance of two equally long series: what ``a`` leaves of the other's envelope."""
    gaps = F.zip_with(a, F.arrays_zip(env["lo"].alias("lo"), env["hi"].alias("hi")), lambda x, e: F.greatest(x - e["hi"], e["lo"] - x, F.lit(0.0)))
    return F.when(F.size(a) == F.size(env["lo"]), F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))


def to_energy(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / 10)


def to_db(energy: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(F.greatest(energy, F.lit(floor)))
