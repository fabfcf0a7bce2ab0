"""What the corpus operators share: shared tables, null-safe joins and order over many partitions."""

from __future__ import annotations

import contextlib
import functools
import operator
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Rows that may be broadcast: at most so many, of at most so many bytes each.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Only a local session may do without: it gets a
    temporary folder of its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="studylake-")
        spark.conf.set("spark.checkpoint.dir", known)
    return f"{known.rstrip('/')}/studylake-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Jobs run within hand Python at most so many rows at once: for whole texts and what is made of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def join_on(left: DataFrame, right: DataFrame, on: dict[str, str] | list[str], how: str = "left") -> DataFrame:
    """An equi-join in which nulls match nulls; on maps left columns to right ones, which the result drops."""
    on = on if isinstance(on, dict) else {c: c for c in on}
    renamed = right.withColumnsRenamed({r: f"__{r}" for r in on.values()})
    cond = functools.reduce(operator.and_, (left[a].eqNullSafe(renamed[f"__{b}"]) for a, b in on.items()))
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"__{r}" for r in on.values()))


def running_sum(df: DataFrame, order: list[Column], size: str, out: str, within: list[str] | None = None) -> DataFrame:
    """Adds the sum of size over all rows before, in a total order, without one task that sees all rows.

    Rows are sorted into ranges; each range gets the sum of the ranges before it, of which there are
    as many as partitions. within: columns whose change starts the sum anew; they must lead the order.
    The order must be total, else repeated rows get their places as they come.
    """
    spark, n = df.sparkSession, parts(df.sparkSession)
    within = within or []
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sums = ranged.groupBy(*within, "__range").agg(F.sum(size).cast("long").alias("__sum"))
    ahead = W.partitionBy(*within).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*within, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranged = ranged.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0)).cast("long"))
    return join_on(ranged, sums, [*within, "__range"]).withColumn(out, F.col("__inside") + F.col("__ahead")).drop("__inside", "__ahead", "__range")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()
