"""Rounding that does not depend on the order of a sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding. Means of decimals often end in an exact half, which engines round either way after sums in
#: different orders; the offset moves the borders between digits to where such values don't fall.
OFFSET = 3.7e-11


def rounded(x: Column | str, digits: int) -> Column:
    """``x`` rounded to so many digits, exact halves upward."""
    return F.round((F.col(x) if isinstance(x, str) else x) + OFFSET, digits)
