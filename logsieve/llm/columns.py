"""Carrying columns of any name through a job that has names of its own."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "rest"


def pack(docs: DataFrame, *own: str) -> Column:
    """All columns of docs but its own, as one struct ``rest`` whose fields are named by number."""
    others = [n for n in docs.columns if n not in own]
    return F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(others)], F.lit(1).alias("end")).alias(REST)


def unpack(names: list[str], *own: str) -> list[Column]:
    """The columns of docs again, in their order; names are those of docs."""
    others = [n for n in names if n not in own]
    return [F.col(n) if n in own else F.col(f"{REST}.c{others.index(n)}").alias(n) for n in names]
