"""What an action makes of a note, a step, a habit or a card: each state after it, as DataFrames or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values: least minutes of a scaled step, bounds of a snooze and of a habit's target, a resource's cycle
LEAST_STEP, SNOOZE, TARGETS, CYCLE = 5, (1, 365), (1, 7), 90
SAME_ANSWER_SECONDS = 2.0  # fixed value: an answer with the grade of the one before within this time is a repeat


def _within(x: Column, bounds: tuple[int, int]) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), x))


def outside_view(steps: DataFrame, classes: DataFrame) -> DataFrame:
    """Steps (project, level, step, minutes) scaled by their class's multiplier, and their project's new total. classes is a row per level."""
    usable = classes.filter("enough")
    own = usable.filter("level is not null").select("level", F.col("multiplier").alias("own"))
    every = usable.filter("level is null").agg(F.max("multiplier").alias("every"))
    rows = steps.join(F.broadcast(own), "level", "left").crossJoin(F.broadcast(every))  # one row
    times = F.coalesce("own", "every", F.lit(1.0))
    scaled = F.when(times == 1.0, F.col("minutes")).otherwise(F.greatest(F.lit(LEAST_STEP), F.bround(F.col("minutes") * times).cast("int")))
    return rows.withColumn("scaled", scaled).groupBy("project").agg(F.sum("minutes").alias("before"), F.sum("scaled").alias("after"), F.count(F.lit(1)).alias("steps"))


def toggled(steps: DataFrame, which: Column, minutes: Column, learning: Column) -> DataFrame:
    """Projects after a tick on the steps that which picks: steps done and their measured minutes, and the status.

    A step that is done is opened again and loses its measurement. A project with all steps done is done,
    or stays active where it is learnt from.
    """
    flipped = F.when(which, ~F.col("done")).otherwise(F.col("done"))
    measured = F.when(~flipped, None).when(which, minutes).otherwise(F.col("actual"))
    rows = steps.select("project", flipped.alias("done"), measured.alias("actual"), learning.alias("learning"))
    every = F.bool_and("done")
    return rows.groupBy("project").agg(F.count_if("done").alias("done"), F.sum("actual").alias("actual"), F.when(every & ~F.bool_or("learning"), "done").otherwise("active").alias("status"))


def reviewed_resource(kind: Column, today: Column, days: Column, cycle: Column) -> Column:
    """(bucket, next) of a resource after an answer: keep, archive, restore or snooze for some days."""
    whole = F.date_add(today, F.coalesce(cycle, F.lit(CYCLE)))
    bucket = F.when(kind == "archive", "archive").otherwise("resource")
    ahead = F.when(kind == "archive", None).when(kind == "snooze", F.date_add(today, _within(days, SNOOZE))).otherwise(whole)
    return F.struct(bucket.alias("bucket"), ahead.alias("next"))


def move_event(before: Column, after: Column) -> Column:
    """The name of a move from one bucket to another."""
    pair = F.concat_ws(">", before, after)
    return F.when(pair == "project>resource", "graduated").when(pair == "resource>archive", "archived").when(pair == "archive>resource", "restored").otherwise("moved")


def habit_target(count: Column) -> Column:
    return _within(count, TARGETS)


def logged_occurrences(log: DataFrame) -> DataFrame:
    """A habit's occurrences (note, on, minute), once each, in order: how many there are, the first and the last."""
    once = log.select("note", "on", "minute").distinct()
    return once.groupBy("note").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("on", "minute")).alias("first"), F.max(F.struct("on", "minute")).alias("last")).select("note", "occurrences", F.col("first.on").alias("first_on"), F.col("first.minute").alias("first_minute"), F.col("last.on").alias("last_on"), F.col("last.minute").alias("last_minute"))


def edited_deadline(deadline: Column, kind: Column, action: Column, chosen: Column) -> Column:
    """(deadline, kind, confirmed) after confirm, replace or clear."""
    new = F.when(action == "clear", None).when(action == "replace", chosen).otherwise(deadline)
    source = F.when(action == "clear", "none").when(action == "replace", "manual").otherwise(kind)
    sure = F.when(action.isin("confirm", "replace"), new.isNotNull()).when(action == "clear", False).otherwise(F.coalesce(kind.isin("explicit", "exact", "manual"), F.lit(False)))
    return F.struct(new.alias("deadline"), source.alias("kind"), sure.alias("confirmed"))


def next_card_ids(cards: DataFrame, added: DataFrame) -> DataFrame:
    """Ids of added cards (note, ord): c1, c2 and so on after the highest number that the note's cards (note, id) have."""
    top = cards.groupBy("note").agg(F.max(F.regexp_extract("id", r"^c(\d+)$", 1).try_cast("long")).alias("top"))
    place = F.row_number().over(W.partitionBy("note").orderBy("ord"))
    return added.withColumn("place", place).join(top, "note", "left").select("note", "ord", F.concat(F.lit("c"), (F.coalesce("top", F.lit(0)) + F.col("place")).cast("string")).alias("id"))


def once_answered(reviews: DataFrame, seconds: float = SAME_ANSWER_SECONDS) -> DataFrame:
    """Reviews without those that repeat the grade of the card's review just before within so many seconds."""
    before = W.partitionBy("card").orderBy("at", "ord")
    rows = reviews.withColumns({"__grade": F.lag("grade").over(before), "__at": F.lag("at").over(before)})
    gap = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("__at").cast("timestamp"))
    repeat = (F.col("grade") == F.col("__grade")) & (gap <= seconds * 1e6)
    return rows.filter(~F.coalesce(repeat, F.lit(False))).drop("__grade", "__at")


def chosen_weights(configured: Column, fitted: Column, default: list[float]) -> Column:
    """The configured weights if there are as many as needed, else fitted ones, else the default."""
    whole = lambda w: F.when(F.size(w) == len(default), w)
    return F.coalesce(whole(configured), whole(fitted), F.array(*map(F.lit, default)))


def sessions(events: DataFrame) -> DataFrame:
    """Sessions (owner, started, ended) of events (owner, at, ord, kind start or end): a start closes an open one; an end without one is nothing."""
    w = W.partitionBy("owner").orderBy("at", "ord")
    rows = events.filter(F.col("kind").isin("start", "end")).withColumn("ended", F.lead("at").over(w))
    return rows.filter("kind = 'start'").select("owner", F.col("at").alias("started"), "ended")


def day_seed(day: Column) -> Column:
    """The number of a day, 1 on the first of the year 1."""
    return F.date_diff(day, F.to_date(F.lit("0001-01-01"))) + 1
