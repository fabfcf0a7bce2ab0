"""What to study now: sessions, buttons, folders with waiting cards, and the debrief afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import memory, scales

LEAST_KEY = 20  # fixed value: shorter sources make no siblings
JITTER = 0.02


def card_kind(front: Column, choices: Column, mode: Column) -> Column:
    return F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, "mcq").when(F.coalesce(front, F.lit("")).rlike(r"\{\{.+?\}\}"), "cloze").when(mode.isin("recall", "explain"), mode).otherwise("basic")


def sibling_key(source: Column) -> Column:
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(F.length(key) >= LEAST_KEY, key).otherwise("")


def _draw(seed: str, card: Column) -> Column:
    """A number below 1 that depends on the day's seed and the card alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), card.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def unburied(cards: DataFrame) -> DataFrame:
    """The first card of each sibling group in a note, due ones before new ones; cards without a key all stay.

    cards have rank, a struct that orders them. The least row of a group is an aggregate, so large groups
    are combined before they are shuffled.
    """
    own = F.when(F.col("key") == "", F.col("card"))
    rest = F.struct("rank", *(c for c in cards.columns if c not in ("note", "key", "rank")))
    first = cards.groupBy("note", "key", own.alias("own")).agg(F.min(rest).alias("x"))
    return first.select("note", "key", "x.*")


def session(cards: DataFrame, hot: DataFrame, today: str, due_budget: int, new_budget: int, size: int) -> DataFrame:
    """A session's cards in order. cards: card, note, topic, source, reps, due (card is unique); hot: card.

    The budgets and the size are the feature: the most overdue cards (hot ones first) and the day's draw of
    new ones. What follows the two top-k sorts has due_budget + new_budget rows at most.
    """
    now = F.to_date(F.lit(today))
    new = F.col("reps") == 0
    pool = cards.filter(new | (F.col("due") <= now)).join(hot.select("card", F.lit(True).alias("hot")), "card", "left")
    drawn = _draw(today, F.col("card"))
    pool = pool.select(
        "card",
        "note",
        "topic",
        sibling_key(F.col("source")).alias("key"),
        F.struct(
            new.cast("int").alias("lane"),
            F.when(new, 0).otherwise(F.col("hot").isNull().cast("int")).alias("cool"),
            F.when(~new, F.col("due")).alias("due"),
            F.when(~new, F.col("note")).alias("subject"),
            F.when(new, drawn).alias("drawn"),
            F.col("card").alias("tie"),
        ).alias("rank"),
    )
    kept = unburied(pool)
    picked = kept.filter("rank.lane = 0").orderBy("rank").limit(due_budget).unionByName(kept.filter("rank.lane = 1").orderBy("rank").limit(new_budget))
    lane = W.partitionBy("note", "topic")
    slot = (F.row_number().over(lane.orderBy("rank")) - 0.5) / F.count(F.lit(1)).over(lane)
    place = F.row_number().over(W.partitionBy().orderBy("slot", "note", "topic", "card"))  # no more rows than the budgets
    spread = picked.withColumn("slot", slot + (_draw(today + "/", F.col("card")) * 2 - 1) * JITTER).withColumn("place", place)
    return spread.filter(F.col("place") <= size).select("place", "card", "note", "topic", F.when(F.col("rank.lane") == 1, "new").otherwise("due").alias("reason"))


def buttons(cards: DataFrame, exam: Column, today: str, retention: float = 0.9, most: int = 3650) -> DataFrame:
    """The days until a card's next review for each answer, at most to the eve of its exam."""
    now = F.to_date(F.lit(today))
    rows = cards.select("card", exam.alias("exam"), "s", "d", (F.unix_date(now) - F.col("last")).alias("gone"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("grade"))
    later, _ = memory.after(F.col("s"), F.col("d"), F.col("grade"), F.greatest(F.lit(0.0), F.col("gone")), memory.WEIGHTS)
    rows = rows.select("card", "exam", "grade", later.alias("s"))
    free = memory.days_until_due(F.col("s"), F.col("grade"), retention, most)
    days = F.date_diff(scales.exam_capped(F.date_add(now, free), F.col("exam"), now), now)
    return rows.select("card", "grade", days.alias("days"), scales.day_label(days).alias("label"))


def folder_rollup(decks: DataFrame) -> DataFrame:
    """Decks (folder, due, new, active) counted in their folder and all that hold it; the root is ''."""
    parts = F.filter(F.split(F.coalesce("folder", F.lit("")), r"[\\/]+"), lambda p: p != "")
    counts = [F.sum(c).alias(c) for c in ("decks", "due", "new", "cards")]
    # folders are summed before they are dealt to their ancestors, of which the root gets one row of each
    whole = decks.filter("active > 0").select(parts.alias("parts"), F.lit(1).alias("decks"), "due", "new", F.col("active").alias("cards")).groupBy("parts").agg(*counts)
    paths = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
    out = whole.withColumn("path", F.explode(paths)).groupBy("path").agg(*counts)
    label = F.when(F.col("path") == "", "All notes").otherwise(F.substring_index("path", "/", -1))
    depth = F.when(F.col("path") == "", 0).otherwise(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))) + 1)
    return out.select("path", label.alias("label"), depth.alias("depth"), "decks", "due", "new", "cards")


def debrief(reviews: DataFrame, subject: Column, since: str) -> DataFrame:
    """By subject: reviews and right ones since a day, cards seen, and cards whose worst answer was the lowest."""
    recent = reviews.filter(F.col("day") >= F.to_date(F.lit(since)))
    worst = recent.groupBy(subject.alias("subject"), "card").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") >= 3).alias("right"), F.min("grade").alias("worst"))
    return worst.groupBy("subject").agg(F.sum("n").alias("reviewed"), F.sum("right").alias("correct"), F.count(F.lit(1)).alias("cards"), F.count_if(F.col("worst") == 1).alias("failed"))
