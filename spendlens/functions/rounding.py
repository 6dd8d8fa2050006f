"""The two rounding rules of the reference, as exact column expressions.

* Python layer (features, scores): half-even on binary floats, i.e. ``rint(x*10^d)/10^d``
  (what numpy's ``round`` computes).
* SQL layer (reports): exact NUMERIC rounding, half away from zero.  Means and
  percentages are computed from integer sums (cents, counts) with integral division, so
  the result never depends on how an engine rounds an intermediate decimal quotient.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column, b: Column) -> Column:
    """Integral division of BIGINTs (SQL ``a div b``); NULL when ``b`` is 0."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def round_half_even(x: Column | str, digits: int) -> Column:
    """numpy/pandas ``round(x, digits)`` on a DOUBLE."""
    scale = float(10**digits)
    return F.rint(_c(x).cast("double") * F.lit(scale)) / F.lit(scale)


def cents(x: Column | str) -> Column:
    """DECIMAL(.,2) money as an exact BIGINT number of cents."""
    return (_c(x) * 100).cast("long")


def div_round_half_up(num: Column, den: Column, digits: int = 2) -> Column:
    """round(num/den, digits), half away from zero, exact for BIGINT num/den.

    Returns DOUBLE ``k / 10^digits``; NULL when ``den`` is 0 or NULL.
    """
    scale = 10**digits
    n = num.cast("long")
    d = den.cast("long")
    mag = idiv(F.abs(n) * (2 * scale) + F.abs(d), F.abs(d) * 2)
    signed = F.when(n * d < 0, -mag).otherwise(mag)
    return (signed.cast("double") / F.lit(float(scale))).cast("double")


def money(x: Column | str) -> Column:
    """Money output type for reports: DOUBLE converted from the exact decimal."""
    return _c(x).cast("double")
