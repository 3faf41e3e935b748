"""Column helpers for exact, engine-independent numbers.

Doubles are rounded through a DECIMAL so that half-to-even rounding acts on
the decimal value (as the reference's numpy/pandas rounding appears to users)
and gives the same digits as the SQL oracle's ``round_even``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,6)"


def rnd(c: Column | str, scale: int) -> Column:
    """Half-to-even rounding of a double through decimal(38,6); returns double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(c.cast(WIDE), scale).cast("double")


def money(price: Column, discount: Column) -> Column:
    """Exact revenue of a line: decimal price times (1 - decimal discount)."""
    return price.cast("decimal(15,2)") * (F.lit(1) - discount.cast("decimal(4,2)"))


def exact_mean(c: Column | str) -> Column:
    """Mean of a double, summed as a decimal so the result is order-free."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(WIDE)).cast("double") / F.count(c)


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, ``default`` when den is 0 or null (zero_division=0)."""
    return F.coalesce(num / F.when(den != 0, den), F.lit(default))


def pct(num: Column, den: Column, scale: int) -> Column:
    """100 * num / den rounded half-to-even to ``scale`` digits."""
    return rnd(F.lit(100.0) * num / den, scale)
