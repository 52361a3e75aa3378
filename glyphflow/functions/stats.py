"""Statistical expressions over columns, all inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy_of(p: Column) -> Column:
    """Aggregate: Shannon entropy in bits of probabilities (zeros and nulls give nothing)."""
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0))


def kl_divergence(p: list[Column], q: list[Column], epsilon: float = 1e-10) -> Column:
    """Sum of p log2(p/q) with epsilon added and both renormalised."""
    pe, qe = [x + epsilon for x in p], [x + epsilon for x in q]
    ps, qs = sum(pe[1:], pe[0]), sum(qe[1:], qe[0])
    terms = [(a / ps) * F.log2((a / ps) / (b / qs)) for a, b in zip(pe, qe, strict=True)]
    return sum(terms[1:], terms[0])


def ln_factorial(n: Column) -> Column:
    """Natural logarithm of n! of a small count; exact up to 20, else by Stirling's series (error below 1e-12)."""
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * F.lit(3.141592653589793) * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 1, F.lit(0.0)).when(n <= 20, F.ln(F.factorial(F.when(n <= 20, n).otherwise(1).cast("int")).cast("double"))).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def hypergeom_pmf(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """Probability of exactly k marked among ``drawn`` of ``total``; 0 where impossible."""
    possible = (k >= 0) & (k <= marked) & (k <= drawn) & (drawn - k <= total - marked)
    zero = F.lit(0).cast("long")
    safe = lambda c: F.when(possible, c).otherwise(zero)
    return F.when(possible, F.exp(ln_choose(marked, safe(k)) + ln_choose(total - marked, safe(drawn - k)) - ln_choose(total, drawn))).otherwise(F.lit(0.0))


def jaccard(n_ab: Column, n_a: Column, n_b: Column) -> Column:
    return n_ab / F.nullif(n_a + n_b - n_ab, F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays of numbers; null if one is zero."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: list[Column], b: list[Column]) -> Column:
    terms = [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]
    return F.sqrt(sum(terms[1:], terms[0]))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def round_product(c: Column, places: int) -> Column:
    """Rounds a double as DuckDB does, halves of the product with 10^places away from zero; F.round goes by the shortest decimal text."""
    m = 10.0**places
    return F.round(c * m) / m


def rounded_mean(c: Column, places: int = 6) -> Column:
    """Aggregate: the rounded mean of doubles, the same in whatever order the rows come.

    A sum of doubles depends on their order, which turns a mean half way between two
    rounded values either way. Values of at most nine decimals and 1000 in size are
    therefore summed as whole numbers and halves go away from zero. One or two values
    have no order; they, other values and sums too large take the mean of doubles.
    """
    n, k = F.count(c), F.rint(c * 1e9)
    fits = (F.abs(c) <= 1000) & (k / 1e9 == c)
    total, d = F.try_sum(F.when(fits, k.cast("long"))), n * 10 ** (9 - places)
    whole = F.call_function("div", F.abs(total), d) + (2 * (F.abs(total) % d) >= d).cast("long")
    exact = F.when(F.bool_and(fits) & (n > 2), F.signum(total) * whole / 10.0**places)
    return F.coalesce(exact, round_product(F.avg(c), places))
