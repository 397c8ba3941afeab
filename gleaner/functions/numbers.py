"""Numbers: rounding and how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, places: int) -> Column:
    """Rounded in doubles, ties to even, as the SQL does. ``bround`` rounds the shortest decimal form instead, in which 0.59115 is a tie; times 10,000 it lies below one."""
    return F.rint(x * float(10**places)) / float(10**places)


def plain(x: Column) -> Column:
    """A number of up to four places as JSON writes it, never with an exponent; null as null."""
    small = F.regexp_replace(x.cast("decimal(18,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.coalesce(F.when((F.abs(x) < 0.001) & (x != 0), small).otherwise(x.cast("string")), F.lit("null"))
