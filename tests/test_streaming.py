"""The stream of card states ends where the batch fold does, whatever comes late; requests are replayed once; scales by cases."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from studylake.functions import scales
from studylake.operators import study
from studylake.streaming import requests
from studylake.streaming import reviews as stream


@pytest.fixture
def store(spark):
    name, value = next(iter(stream.STORE.items()))
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before)


def changes(spark, tmp_path, files, name, lateness):
    """The last state of each card, from files of (card, at, ord, grade) that come one by one, and one far ahead that lets the watermark pass."""
    schema = "card bigint, at timestamp, ord bigint, grade int"
    for i, rows in enumerate([*files, [(-1, dt.datetime(2030, 1, 1), 0, 3)], [(-2, dt.datetime(2031, 1, 1), 0, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    query = stream.card_changes(rows, lateness=lateness).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(400)
    return {r["card"]: r for r in spark.table(name).orderBy("reps").collect() if r["card"] >= 0}


def test_shuffled_late_reviews_end_where_the_batch_fold_does(spark, tmp_path, store):
    rng = random.Random(7)
    rows = [(rng.randrange(12), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 30)), i, rng.randint(1, 4)) for i in range(160)]
    rows.sort(key=lambda r: r[1].timestamp() + rng.random() * 2 * 86400)  # up to two days late
    again = [(c, at, i, 5 - g) for c, at, i, g in rows[40:50]]  # said again, otherwise: the last one counts
    files = [rows[:50] + again, rows[50:100], rows[100:]]
    got = changes(spark, tmp_path, files, "late_changes", "3 days")
    final = {(c, i): (c, at, i, g) for f in files for c, at, i, g in f}
    want = study.card_states(spark.createDataFrame(list(final.values()), "card bigint, at timestamp_ntz, ord bigint, grade int")).collect()
    assert {c: tuple(r)[1:] for c, r in got.items()} == {r["card"]: (r["s"], r["d"], r["reps"], r["lapses"], r["last"]) for r in want}


def requests_of(spark, tmp_path, number, rows):
    spark.createDataFrame(rows, requests.REQUEST).coalesce(1).write.parquet(f"{tmp_path}/in/{number:03d}")


def test_requests_wait_and_are_replayed_once(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    model = {"up": False, "dies": True}

    def generate(taken):
        if model["dies"]:
            raise RuntimeError("killed in the middle of a batch")
        return taken.select("note", "most", "queued_at", F.when(F.col("note") == 3, "no such note").alias("error"))

    def go(limit=None):
        rows = spark.readStream.schema(requests.REQUEST).parquet(f"{tmp_path}/in/*")
        query = requests.drained(rows, f"{tmp_path}/queue", f"{tmp_path}/ck", lambda: model["up"], generate, limit)
        query.awaitTermination(200)

    requests_of(spark, tmp_path, 0, [(1, at(1), 1, 5, "a"), (2, at(2), 2, 5, "b"), (1, at(3), 3, 9, "c")])
    go()
    queue = requests.Queue(spark, f"{tmp_path}/queue")
    assert {(r["note"], r["most"], r["requests"]) for r in queue.waiting(0).collect()} == {(1, 9, 2), (2, 5, 1)}
    model["up"] = True
    requests_of(spark, tmp_path, 1, [(2, at(4), 4, 7, "d"), (3, at(5), 5, 1, "e")])
    with pytest.raises(StreamingQueryException):
        go()
    assert queue.taken().count() == 3  # taken, but nothing came of it yet
    model["dies"] = False
    go()
    got = {(r["note"], r["most"], r["queued_at"].hour, r["error"]) for r in queue.results().collect()}
    assert queue.results().count() == 3 and got == {(1, 9, 1, None), (2, 7, 2, None), (3, 1, 5, "no such note")}
    requests_of(spark, tmp_path, 2, [(None, None, 0, None, None)])
    go()
    assert queue.results().count() == 3 and queue.waiting(2).count() == 0
    requests_of(spark, tmp_path, 3, [(4, at(7), 6, 1, ""), (5, at(6), 7, 1, "")])
    go(limit=1)
    assert [r["note"] for r in queue.waiting(3).collect()] == [4] and queue.results().count() == 4


def test_scales(spark):
    said = spark.createDataFrame([("sure", 0.9), ("85", 0.85), ("0.4", 0.4), ("banana", None), ("", None), (None, None), ("-3", 0.0)], "v string, p double")
    assert all(r["p"] == r["q"] for r in said.withColumn("q", scales.probability(F.col("v"))).collect())
    days = spark.createDataFrame([(0, "<1d"), (10, "10d"), (61, "2mo"), (400, "1.1y")], "n int, label string")
    assert all(r["label"] == r["x"] for r in days.withColumn("x", scales.day_label(F.col("n"))).collect())
