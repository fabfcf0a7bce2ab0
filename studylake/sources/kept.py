"""Rows that are computed once, however often a plan reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(rows: DataFrame) -> DataFrame:
    """rows as a table in the session's spark.checkpoint.dir, which driver and executors share; only a local session may do without."""
    spark = rows.sparkSession
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="studylake-")
        spark.conf.set("spark.checkpoint.dir", known)
    path = f"{known.rstrip('/')}/studylake-{spark.sparkContext.applicationId}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
