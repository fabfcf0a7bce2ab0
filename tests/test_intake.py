"""Dropped files as a stream, in several passes, and folders that settle."""

import datetime as dt

from pyspark.sql import functions as F

from studylake.streaming import intake


def test_dropped_files_are_filed_once(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    (drop / "a.md").write_text("submit the essay due 2026-12-01\nmore")
    (drop / "b.md").write_text("buy milk")

    def run():
        query = intake.file_away(intake.dropped(spark, str(drop), files=1), out, str(tmp_path / "ck"), "2024-01-31")
        query.awaitTermination(120)
        return {r["path"].split("/")[-1]: r for r in spark.read.parquet(out).collect()}

    first = run()
    assert {k: r["bucket"] for k, r in first.items()} == {"a.md": "project", "b.md": "inbox"}
    assert first["a.md"]["deadline"] == dt.date(2026, 12, 1) and first["a.md"]["title"] == "Submit the essay"
    (drop / "c.md").write_text("daily routine, 3x a week")
    assert {k: r["bucket"] for k, r in run().items()} == {"a.md": "project", "b.md": "inbox", "c.md": "area"}
    assert spark.read.parquet(out).count() == 3


def test_signatures_and_rebuilds(spark):
    at = dt.datetime(2024, 1, 1)
    files = [("a", at, 1), ("b", at, 2)]
    sign = lambda rows: intake.signature(spark.createDataFrame(rows, "path string, modified timestamp, size bigint")).first()["signature"]
    assert sign(files) == sign(files[::-1]) != sign([files[0]]) and sign([("a", at, 2), ("b", at, 2)]) != sign(files)
    ticks = spark.createDataFrame(list(enumerate("AABCCCA")), "tick int, signature string")
    assert [r["tick"] for r in intake.due_rebuilds(ticks).orderBy("tick").collect()] == [0, 4]
    late = spark.createDataFrame([(at, at + dt.timedelta(seconds=4)), (at, at + dt.timedelta(seconds=5))], "m timestamp, n timestamp")
    assert [r[0] for r in late.select(intake.settled(F.col("m"), F.col("n"))).collect()] == [False, True]
