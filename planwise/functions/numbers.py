"""Columns of rounded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """A double to so many places as the SQL twins round it: the product with 10^places to a whole number, halves away from zero.

    F.round takes the number's shortest text instead, which differs where a share of whole numbers lies on a half.
    """
    return F.round(x * float(10**places)) / F.lit(float(10**places))
