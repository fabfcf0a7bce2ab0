"""Urgency, next steps, what is coming up, and habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY_MINUTES = 180  # fixed value: minutes of work in a day
ALERT_AT, LOOKBACK = 2, 12  # fixed values: misses in a row that alert, periods looked at
SAME_TIME, ENOUGH_LOG = 90, 4  # fixed values: minutes around the usual hour, entries needed


def urgency(deadline: Column, remaining: Column, progress: Column, today: Column) -> Column:
    left = F.date_diff(deadline, today)
    pressure = 1.0 / (1.0 + left / 3.0)
    load = F.least(F.lit(1.0), remaining / (F.greatest(F.lit(1), left) * DAY_MINUTES))
    near = F.bround(F.least(F.lit(1.0), 0.6 * pressure + 0.4 * load), 4)
    return F.when(deadline.isNull(), 0.25 * (1.0 - progress)).when(left < 0, 1.0).otherwise(near)


def project_load(steps: DataFrame) -> DataFrame:
    open_ = ~F.col("done")
    return steps.groupBy("project").agg(F.sum(F.when(open_, F.col("minutes")).otherwise(0)).alias("remaining"), (F.count_if("done") / F.count(F.lit(1))).alias("progress"), F.min(F.when(open_, F.struct(F.col("scheduled").isNull().alias("later"), "scheduled", "step", "minutes"))).alias("next"))


def next_actions(projects: DataFrame, steps: DataFrame, today: str, limit: int | None = 10) -> DataFrame:
    """The next step of each active project; with a limit a top-k report, the most urgent first."""
    rows = projects.filter("status = 'active'").join(project_load(steps).filter("next is not null"), "project")
    rows = rows.withColumn("urgency", urgency(F.col("deadline"), F.col("remaining"), F.col("progress"), F.to_date(F.lit(today))))
    rows = rows.select("project", "deadline", F.col("next.step").alias("step"), F.col("next.minutes").alias("minutes"), F.col("next.scheduled").alias("scheduled"), "urgency")
    return rows if limit is None else rows.orderBy(F.desc("urgency"), "project").limit(limit)


def upcoming(projects: DataFrame, steps: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Deadlines up to the horizon and undone steps scheduled from today to it, of projects that aren't done."""
    now = F.to_date(F.lit(today))
    live = projects.filter("status <> 'done'")
    due = live.filter(F.col("deadline") <= F.date_add(now, days)).select("project", F.lit("deadline").alias("kind"), F.col("deadline").alias("on"), F.lit(None).cast("int").alias("step"))
    window = steps.filter(~F.col("done") & F.col("scheduled").between(now, F.date_add(now, days)))
    blocks = window.join(live.select("project"), "project").select("project", F.lit("block").alias("kind"), F.col("scheduled").alias("on"), "step")
    return due.unionByName(blocks)


def habit_misses(log: DataFrame, today: str, target: int = 3) -> DataFrame:
    """Whole weeks since a habit's first entry, at most 12: hits, and misses in a row up to now."""
    this = F.trunc(F.to_date(F.lit(today)), "week")
    weeks = log.groupBy("note", F.trunc("on", "week").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    first = weeks.groupBy("note").agg(F.min("week").alias("first"), F.coalesce(F.max(F.when(F.col("week") == this, F.col("n"))), F.lit(0)).alias("current"))
    # only the last weeks are looked at, however long the log is
    back = F.filter(F.sequence(F.lit(1), F.lit(LOOKBACK)), lambda b: b * 7 <= F.date_diff(this, F.col("first")))
    dense = first.withColumn("back", F.explode_outer(back))
    dense = dense.withColumn("week", F.date_sub(this, F.col("back") * 7))
    hit = F.coalesce(F.col("n"), F.lit(0)) >= target
    rows = dense.join(weeks, ["note", "week"], "left").groupBy("note").agg(F.max("current").alias("current"), F.count("back").alias("periods"), F.count_if(F.col("back").isNotNull() & hit).alias("hits"), F.min(F.when(hit, F.col("back"))).alias("last_hit"))
    run = F.coalesce(F.col("last_hit") - 1, F.col("periods")).cast("long")
    return rows.select("note", "current", "periods", "hits", run.alias("misses_in_row"), (run >= ALERT_AT).alias("alert"))


def habit_stability(log: DataFrame) -> DataFrame:
    """Usual hour and place with the share of entries near them; of equals the one seen first counts. The log is read once, as counts of minutes and places."""
    counts = log.groupBy("note", "minute", "place").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    counts = counts.withColumn("hour", F.floor(F.col("minute") / 60))

    def usual(name: str) -> DataFrame:
        found = counts.groupBy("note", name).agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
        return found.groupBy("note").agg(F.max_by(name, F.struct("n", -F.col("seen"))).alias(name), F.max("n").alias(f"{name}_n"))

    near = counts.select("note", "minute", "n").join(usual("hour"), "note")
    around = F.abs(F.col("minute") - (F.col("hour") * 60 + 30)) <= SAME_TIME
    near = near.groupBy("note").agg(F.first("hour").alias("hour"), F.sum("n").alias("n"), F.sum(F.when(around, F.col("n")).otherwise(0)).alias("near"))
    rows = near.join(usual("place"), "note")
    return rows.select("note", "n", "hour", F.round(F.col("near") / F.col("n"), 3).alias("time_share"), "place", F.round(F.col("place_n") / F.col("n"), 3).alias("place_share"), (F.col("n") >= ENOUGH_LOG).alias("enough"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; rows without a key stay."""
    last = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *(c for c in rows.columns if c not in (key, *order)))).alias("x"))
    return last.select(key, "x.*").select(*rows.columns).unionByName(rows.filter(F.col(key).isNull()))
