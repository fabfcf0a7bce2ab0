"""What needs care: incidents, overdue steps, the week's work, and notes that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEEP_RESOLVED = 40  # fixed value: resolved incidents that are kept
# fixed values: titles that name nothing, and the length in words from which a note is long
VAGUE_TITLES = "notes note untitled misc miscellaneous stuff ideas todo inbox reading summary thoughts scratch temp".split()
VAGUE_SHAPE = r"^((chapter|lecture|week|day|part|session|class|page)[ \t]*[0-9]+|[0-9]{1,4}[-/.][0-9]{1,2}([-/.][0-9]{1,4})?)$"
LONG_WORDS = 500


def incidents(log: DataFrame) -> DataFrame:
    """Failures (key, at, ord, ok) up to the next success as one incident each: all open ones and the last resolved ones."""
    before = W.partitionBy("key").orderBy("at", "ord").rowsBetween(W.unboundedPreceding, -1)
    runs = log.withColumn("run", F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0)))
    bad = F.when(~F.col("ok"), F.col("at"))
    found = runs.groupBy("key", "run").agg(F.min(bad).alias("since"), F.max(bad).alias("last_seen"), F.count(bad).alias("count"), F.min(F.when(F.col("ok"), F.col("at"))).alias("resolved_at"))
    found = found.filter("count > 0").drop("run")
    done = found.filter("resolved_at is not null").orderBy(F.desc("resolved_at"), "key").limit(KEEP_RESOLVED)
    return found.filter("resolved_at is null").unionByName(done)


def overdue_steps(projects: DataFrame, steps: DataFrame, today: str, limit: int | None = 12) -> DataFrame:
    """Undone steps of live projects whose day is past; with a limit a top-k report, the oldest first."""
    now = F.to_date(F.lit(today))
    late = steps.filter(~F.col("done") & (F.col("scheduled") < now)).join(projects.filter("status <> 'done'").select("project"), "project")
    days = F.date_diff(now, F.col("scheduled"))
    rows = late.select("project", "step", "minutes", "scheduled", days.alias("days"))
    return rows if limit is None else rows.orderBy(F.desc("days"), "project", "step", "minutes").limit(limit)


def closed(steps: DataFrame, reviews: DataFrame, steps_until: str, reviews_until: str, days: int = 7) -> DataFrame:
    """Steps and reviews done and cards first seen in the days before a day: their number and minutes."""
    def within(day: Column, until: str) -> Column:
        end = F.to_date(F.lit(until))
        return (day >= F.date_sub(end, days)) & (day < end)

    done = steps.filter(F.col("done") & within(F.col("scheduled"), steps_until)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("minutes"), F.lit(0)).cast("double").alias("minutes"))
    seen = reviews.filter(within(F.col("day"), reviews_until)).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)) / 60, 1).alias("minutes"))
    new = reviews.groupBy("card").agg(F.min("day").alias("day")).filter(within(F.col("day"), reviews_until)).agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("minutes"))
    kinds = [x.select(F.lit(kind).alias("kind"), "n", "minutes") for kind, x in (("steps", done), ("reviews", seen), ("cards learned", new))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def is_vague(title: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"\.+$", "")
    return name.isin(*VAGUE_TITLES) | name.rlike(VAGUE_SHAPE) | (F.length(name) < 4)


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+"), 0))


def findings(notes: DataFrame, title: Column, text: Column) -> DataFrame:
    """How many notes break each rule, zeros kept: one pass with a count for each rule."""
    rules = {"vague-title": is_vague(title), "too-long": words(text) > LONG_WORDS, "many-sections": F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^##+ "), 0)) >= 3}
    one = notes.agg(*(F.count_if(broken).alias(name) for name, broken in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("notes")) for name in rules))).alias("x")).select("x.*")
