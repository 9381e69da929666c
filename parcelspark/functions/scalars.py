"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ihs(y: Column) -> Column:
    """Inverse hyperbolic sine shifted by ln 2, about ln(y) for large y."""
    return F.asinh(y) - F.lit(math.log(2))


def ihs_count(v: Column, exposure: Column) -> Column:
    """The count behind an ihs density: half-even rounding, negative counts become 0; null for null."""
    n = F.bround(F.sinh(v + F.lit(math.log(2))) * exposure)
    return F.when(n < 0, 0.0).otherwise(n)


def square_miles(area_m2: Column) -> Column:
    """m² to square miles by way of km² and the factor 2.59."""
    return area_m2 / F.lit(1e6) / F.lit(2.59)


def is_violent(code: Column) -> Column:
    """Codes up to 400, and 800 and 1700."""
    return (code <= 400) | (code == 800) | (code == 1700)


def is_nonviolent(code: Column) -> Column:
    """Codes 500 and 600."""
    return code.isin(500, 600)


def plain_kind(text: Column) -> Column:
    """Text without blanks around it, in lower case; null and blank-only text stay null and ''."""
    return F.lower(F.trim(text))


#: Coefficients of Lanczos' series for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def ln_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0, to about 15 digits, in constant time; null for null and for other x."""
    y = F.when(x < 0.5, x + 1).otherwise(x).cast("double") - 1  # Γ(x) = Γ(x + 1) / x
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    value = F.lit(math.log(2 * math.pi) / 2) + (y + 0.5) * F.ln(t) - t + F.ln(series)
    return F.when(x > 0, value - F.when(x < 0.5, F.ln(x)).otherwise(0.0))


def ln_gamma_int(n: Column) -> Column:
    """ln Γ(n) for an integer column n ≥ 1; null for null or n < 1."""
    return F.when(n >= 1, F.when(n <= 2, 0.0).otherwise(ln_gamma(n)))


def ln_beta(a: Column, b: Column) -> Column:
    """ln B(a, b) for a, b > 0."""
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b)


def ln_choose(n: Column, k: Column) -> Column:
    """ln of n over k for 0 ≤ k ≤ n; null else."""
    return F.when((k >= 0) & (k <= n), ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1))


def ln_gamma_multi(a: Column, p: int) -> Column:
    """ln of the multivariate Γ of dimension p, for a > (p − 1) / 2."""
    total = F.lit(p * (p - 1) / 4 * math.log(math.pi))
    for j in range(p):
        total = total + ln_gamma(a - j / 2)
    return total


def known_year(date: Column, first: int, last: int) -> Column:
    """True where date lies in the years first..last."""
    return (date >= F.lit(f"{first}-01-01").cast("date")) & (date <= F.lit(f"{last}-12-31").cast("date"))
