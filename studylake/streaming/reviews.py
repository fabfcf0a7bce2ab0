"""Reviews as a stream: daily counts with late rows and repeated ids taken out, and card states in the order of reviews."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import memory

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
#: The state store that states with timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_counts(events: DataFrame, lateness: str = "3 days") -> DataFrame:
    """day, reviews, minutes of each event once; the state of a day is kept until lateness has passed."""
    once = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    days = once.groupBy(F.window("ts", "1 day").alias("w"))
    return days.agg(F.count(F.lit(1)).alias("reviews"), F.round(F.sum(F.least(F.lit(120.0), F.col("value"))) / 60, 1).alias("minutes")).select(F.to_date("w.start").alias("day"), "reviews", "minutes")


STATE = "s double, d double, reps int, lapses int, last double"
COLUMNS = ["card", "s", "d", "reps", "lapses", "last"]


class CardMemory(StatefulProcessor):
    """Keeps a card's state, and the reviews that the watermark hasn't passed yet by time and number.

    A review is applied when the watermark passes it, so late ones take their place in order. One that comes
    again with the same time and number counts once, as it was said last.
    """

    def __init__(self, weights: list[float]):
        self.weights = weights

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getMapState("waiting", "micros bigint, ord bigint", "grade int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for micros, number, grade in zip(batch["micros"].tolist(), batch["ord"].tolist(), batch["grade"].tolist(), strict=True):
                self.waiting.updateValue((micros, number), (grade,))
                self.handle.registerTimer(-(-micros // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(k for k in self.waiting.keys() if k[0] <= expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if not due:
            return
        s, d, reps, lapses, last = self.state.get() if self.state.exists() else (0.0, 0.0, 0, 0, 0.0)
        for k in due:
            grade, at = self.waiting.getValue(k)[0], k[0] / 86_400e6
            s, d = map(memory.kept, memory.after(s, d, grade, max(0.0, at - last), self.weights, memory.PLAIN))
            reps, lapses, last = reps + 1, lapses + (grade == 1), at
            self.waiting.removeKey(k)
        self.state.update((s, d, reps, lapses, last))
        yield pd.DataFrame([(key[0], s, d, reps, lapses, last)], columns=COLUMNS)


def card_changes(reviews: DataFrame, weights: list[float] | None = None, lateness: str = "3 days") -> DataFrame:
    """Each card's memory state after its reviews up to the watermark; the row with the most reps is its latest.

    reviews: card, at, ord, grade (1 to 4). They come in any order, at most lateness behind the newest; later
    ones are dropped. A card keeps five numbers and the reviews of that span. Needs the state store STORE.
    """
    rows = reviews.select("card", F.col("at").cast("timestamp").alias("at"), "ord", F.col("grade").cast("int").alias("grade")).withWatermark("at", lateness)
    rows = rows.filter("card is not null and grade between 1 and 4").withColumn("micros", F.unix_micros("at"))
    return rows.groupBy("card").transformWithStateInPandas(CardMemory(weights or memory.WEIGHTS), f"card bigint, {STATE}", "Append", "EventTime")


def reviews_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    grade = F.when(kind == "error", 1).when(kind == "signup", 2).when(kind == "purchase", 4).otherwise(3)
    return events.select(F.col("user_id").alias("card"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), grade.alias("grade"))
