"""A step whose columns are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with the columns added, behind a generator of one row.

    Catalyst neither pushes a filter through it nor merges what stands above into what stands below. Without it an array
    that a later lambda refers to may be put into the lambda, and worked out anew for each element.
    """
    rest = [F.col(f"`{c}`") for c in rows.columns]
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select(*rest, F.explode_outer(F.array(packed)).alias("__held")).select(*rest, *[F.col("__held")[n].alias(n) for n in columns])
