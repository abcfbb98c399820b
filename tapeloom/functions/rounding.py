"""Half-up rounding on the decimal text of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round through DECIMAL(38,10), so float noise past ten digits cannot flip a half.

    NaN and infinities become NULL.
    """
    return F.round(value.try_cast("decimal(38,10)"), digits).cast("double")


def ratio(num: Column, den: Column, otherwise=None) -> Column:
    """``num / den``; ``otherwise`` (default NULL) where ``den`` is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(otherwise).cast("double"))
