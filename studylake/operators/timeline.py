"""Rows beside what held at their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, fields: list[str], tolerance: float | None = None) -> DataFrame:
    """Each row of left with the fields of the last row of right, of the same keys, that isn't later; nulls where there is none.

    Both sides are put in one order, and the last row of right is carried forward: a sort and no join, so work
    grows with the rows, not with pairs of them. Of right rows of one time the greatest fields count. Rows of
    left without a time, and right rows without one, match nothing; null keys match each other. tolerance: how
    much earlier (in units of at, a number) a right row may be.
    """
    ours = left.columns
    rows = left.select(*ours, F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(at, *fields)).schema[0].dataType).alias("__known"))
    known = right.filter(F.col(at).isNotNull()).select(*by, at, F.lit(0).alias("__side"), F.struct(at, *fields).alias("__known"))
    both = rows.unionByName(known, allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), "__side", F.col("__known").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("__last", F.last("__known", ignorenulls=True).over(order)).filter("__side = 1")
    near = F.col(at).isNotNull() if tolerance is None else F.col(at) - F.col(f"__last.{at}") <= tolerance
    return both.select(*ours, *(F.when(near, F.col(f"__last.{f}")).alias(f"last_{f}") for f in fields))
