"""Requests for cards as a stream: kept while no model answers, replayed once each when one does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import vault

REQUEST = "note bigint, at timestamp, ord bigint, most int, source string"
PENDING = "note bigint, queued_at timestamp, requested_at timestamp, ord bigint, most int, source string, requests bigint"


class Queue:
    """The state of a queue as a table for each batch: what waits after it, what it has taken, what came of that.

    A batch reads what waited after the one before and writes its own tables over, so a batch that is run again,
    because it was killed at any point, ends the same way and no request is replayed twice or lost.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def waiting(self, batch: int) -> DataFrame:
        """What waits after a batch; nothing before the first."""
        try:
            return self.spark.read.schema(PENDING).parquet(self._table("waiting", batch))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], PENDING)

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results")

    def taken(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/taken")

    def keep(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._table(name, batch))
        return self.spark.read.schema(rows.schema).parquet(self._table(name, batch))


def merged(waiting: DataFrame, asked: DataFrame) -> DataFrame:
    """One entry a note: of what waits and what is newly asked the newest request, with the time of the first and how often it was asked."""
    new = vault.card_queue(asked.filter("note is not null"))
    new = new.join(asked.groupBy("note").agg(F.max(F.struct("at", "ord"))["ord"].alias("ord")), "note").select(waiting.columns)
    both = waiting.unionByName(new)
    newest = F.max(F.struct("requested_at", "ord", "most", "source")).alias("x")
    return both.groupBy("note").agg(F.min("queued_at").alias("queued_at"), newest, F.sum("requests").alias("requests")).select("note", "queued_at", "x.requested_at", "x.ord", "x.most", "x.source", "requests")


def drained(requests: DataFrame, folder: str, checkpoint: str, answers: Callable[[], bool], generate: Callable[[DataFrame], DataFrame], limit: int | None = None) -> StreamingQuery:
    """Starts a query that replays requests (REQUEST; rows without a note are mere ticks) through generate while a model answers.

    generate gives a row for each entry, with its note, and its error where one failed: a failed entry has been
    taken all the same, so it can't hold up the queue. limit: entries of a batch at most, the oldest first.
    """
    queue = Queue(requests.sparkSession, folder)

    def run(batch: DataFrame, number: int) -> None:
        pending = queue.keep(merged(queue.waiting(number - 1), batch), "pending", number)
        if not answers():
            queue.keep(pending, "waiting", number)
            return
        taken = queue.keep(pending.orderBy("queued_at", "note").limit(limit) if limit else pending, "taken", number)
        queue.keep(pending.join(taken, "note", "left_anti").select(pending.columns), "waiting", number)  # off the queue before it runs
        queue.keep(generate(taken), "results", number)

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
