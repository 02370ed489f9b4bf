"""Number columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_ratio(top: Column, bottom: Column, decimals: int) -> Column:
    """top / bottom rounded half to even, worked out in whole numbers."""
    scale = 10**decimals
    scaled = top.cast("bigint") * scale
    whole = F.floor(scaled / bottom)
    whole = F.when(whole * bottom > scaled, whole - 1).otherwise(whole)
    rest = scaled - whole * bottom
    up = (rest * 2 > bottom) | ((rest * 2 == bottom) & (whole % 2 != 0))
    return F.when(bottom > 0, (whole + up.cast("int")) / scale).otherwise(F.lit(0.0))
