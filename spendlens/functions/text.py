"""String column expressions with Python ``str`` semantics (JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace()`` accepts (what ``str.strip()``
# removes).  Spark's one-argument ``trim`` only removes U+0020.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (``trim`` with a set)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(col, F.lit(PY_WHITESPACE))


def upper_strip(c: Column | str) -> Column:
    """``text.upper().strip()`` — the key normalisation used for lookups and tokens."""
    col = F.col(c) if isinstance(c, str) else c
    return py_strip(F.upper(col))


def split_part(c: Column, sep: str, idx: int) -> Column:
    """0-based element of ``str.split(sep)``; NULL when out of range (never raises)."""
    return F.get(F.split(c, "\\" + sep if sep in ".|/\\^$*+?()[]{}" else sep, -1), idx)


def n_parts(c: Column, sep: str) -> Column:
    return F.size(F.split(c, "\\" + sep if sep in ".|/\\^$*+?()[]{}" else sep, -1))
