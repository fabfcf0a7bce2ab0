"""Files dropped into a folder as a stream: read whole, judged by rules, filed or held; and whether a folder has settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import captures, dates

FILES_PER_BATCH = 25  # fixed value: files of one pass
SETTLE_SECONDS = 5


def dropped(spark: SparkSession, folder: str, archive: str | None = None, files: int = FILES_PER_BATCH) -> DataFrame:
    """path, modified and text of each new file; read files are moved to the archive, if one is named."""
    reader = spark.readStream.option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = reader.text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def settled(modified: Column, now: Column, seconds: int = SETTLE_SECONDS) -> Column:
    return F.unix_micros(now) - F.unix_micros(modified) >= seconds * 1_000_000


def judged(files: DataFrame, today: Column) -> DataFrame:
    """Each file with its title, the bucket that the rules suggest, and where it goes: that bucket, or the inbox if they aren't sure."""
    rows = files.withColumn("found", captures.verdict(captures.scores(F.col("text"), F.lit(""), today)))
    return rows.select("path", captures.title(F.col("text")).alias("title"), F.col("found.bucket").alias("suggested"), F.col("found.confidence").alias("confidence"), F.when(F.col("found.confidence") >= captures.AUTO_FLOOR, F.col("found.bucket")).otherwise("inbox").alias("bucket"), dates.deadline(F.col("text"), today)["date"].alias("deadline"))


def file_away(files: DataFrame, target: str, checkpoint: str, today: str, interval: str | None = None) -> StreamingQuery:
    """Files the stream of dropped files into target, a folder for each bucket; all that is there at once, or every interval."""
    writer = judged(files, F.to_date(F.lit(today))).writeStream.partitionBy("bucket").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def signature(files: DataFrame) -> DataFrame:
    """One digest over all files (path, modified, size): the sum of their own digests' halves, so order and number don't matter."""
    own = F.sha2(F.concat_ws("|", "path", F.unix_micros("modified").cast("string"), F.col("size").cast("string")), 256)
    halves = [F.conv(F.substring(own, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    return files.agg(F.count(F.lit(1)).alias("files"), F.concat_ws("-", *(F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in halves)).alias("signature"))


def due_rebuilds(ticks: DataFrame) -> DataFrame:
    """Ticks (tick, signature) at which an index is built: the first, and each whose signature repeats the one before but isn't the last one built."""
    from pyspark.sql import Window as W

    w = W.orderBy("tick")  # one row for each poll of a folder
    rows = ticks.withColumn("before", F.lag("signature").over(w))
    steady = rows.filter(F.col("before").isNull() | (F.col("before") == F.col("signature")))
    return steady.withColumn("built", F.lag("signature").over(w)).filter(F.col("built").isNull() | (F.col("built") != F.col("signature"))).select("tick", "signature")
