"""Stage borders inside a plan.

Catalyst pushes a filter down by copying the filtered expression to every level below.
For pattern-heavy columns that repeats the work and makes plans explode. A generator
over a one-element array stops this: what stands below it is evaluated once per row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but filters on the new columns stay above."""
    kept = [F.col(f"`{n}`") for n in df.columns if n not in cols]
    entry = F.struct(*[v.alias(n) for n, v in cols.items()])
    return df.select(*kept, F.inline(F.array(entry)))


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """Like ``where`` for an expensive condition."""
    return hold(df, {"_keep": condition}).where("_keep").drop("_keep")
