"""Reviews by day, streaks, card states, decks and forecasts.

A card's state depends on the one before, so its reviews are folded in order: they are dealt by card, sorted
within the partition (which spills) and streamed through a fold that holds one card's five numbers at a time.
No array of a card's history is built, so a card may have any number of reviews. What is shuffled is (card,
time, order, grade), not whole rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import memory
from ..sources.kept import kept
from ..sources.views import day_number

# fixed values: when a card is mature and a deck is ready, and the grid of retention targets
MATURE_REPS, MATURE_DAYS, READY_CARDS, READY_SHARE = 4, 21.0, 6, 0.85
RETENTION_GRID = (0.70, 0.75, 0.80, 0.85, 0.87, 0.90, 0.92, 0.95, 0.97)
USUAL_SECONDS, LEAST_TIMED = 12.0, 30
# fixed values: bounds of the fitted weights, samples that a fit needs, and those from which one is shown
FIT_BOUNDS = [(0.001, 100.0)] * 4
FIT_ENOUGH, PREVIEW_FROM = 1000, 200


def daily(reviews: DataFrame) -> DataFrame:
    grade = {name: F.count_if(F.col("grade") == g).alias(name) for g, name in enumerate(("again", "hard", "good", "easy"), 1)}
    return reviews.groupBy("day").agg(F.count(F.lit(1)).alias("reviews"), F.round(F.sum("seconds") / 60, 1).alias("minutes"), *grade.values())


def dense_days(counts: DataFrame, today: str, days: int) -> DataFrame:
    """day and reviews of the last days, zeros kept."""
    last = F.to_date(F.lit(today))
    spark = counts.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    return calendar.join(counts.select("day", "reviews"), "day", "left").select("day", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def accuracy(reviews: DataFrame, today: str, days: int = 30) -> DataFrame:
    recent = F.col("day") > F.date_sub(F.to_date(F.lit(today)), days)
    right = (F.col("grade") >= 2).cast("double")
    return reviews.agg(F.count(F.lit(1)).alias("reviews"), F.countDistinct("day").alias("days"), F.count_if(recent).alias("recent"), F.round(F.avg(F.when(recent, right)), 4).alias("accuracy_30d"))


def streaks(days: DataFrame, key: str, today: str) -> DataFrame:
    """Runs of days by key: the one that ends today (or yesterday), and the longest. days may repeat."""
    now = F.to_date(F.lit(today))
    distinct = days.select(key, "day").distinct()
    island = F.date_sub(F.col("day"), F.row_number().over(W.partitionBy(key).orderBy("day")))
    runs = distinct.withColumn("island", island).groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"))
    current = F.max(F.when(F.col("last").between(F.date_sub(now, 1), now), F.col("n")))
    return runs.groupBy(key).agg(F.coalesce(current, F.lit(0)).alias("streak"), F.max("n").alias("longest_streak"))


def _replayed(reviews: DataFrame, weights: list[float] | None, every: bool) -> DataFrame:
    """card, the state before and after a review: of every review with its elapsed days, or of each card's last one.

    A state is kept at four places between reviews (s, d); raw is the stability before that, which the due day comes from.
    """
    w = weights or memory.WEIGHTS
    names = ["card", "ord", "before", "elapsed", "s", "d", "reps", "lapses", "last", "grade", "raw"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        card: object = fold  # no card yet
        row: tuple = ()
        for batch in batches:
            done: list[tuple] = []
            for c, t, o, g in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != card:
                    if row and not every:
                        done.append(row)
                    card, s, d, reps, lapses, last = c, 0.0, 0.0, 0, 0, t
                before, elapsed = s, max(0.0, t - last)
                raw, d = memory.after(s, d, g, elapsed, w, memory.PLAIN)
                s, d = memory.kept(raw), memory.kept(d)
                reps, lapses, last = reps + 1, lapses + (g == 1), t
                row = (c, o, before, elapsed, s, d, reps, lapses, last, g, raw)
                if every:
                    done.append(row)
            yield packed(done)
        if row and not every:
            yield packed([row])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64()]
    schema = "card bigint, ord bigint, before double, elapsed double, s double, d double, reps int, lapses int, last double, grade int, raw double"
    rows = reviews.select(F.col("card").cast("long").alias("card"), day_number("at").alias("t"), F.col("ord").cast("long").alias("ord"), F.col("grade").cast("int").alias("grade"))
    rows = rows.filter("t is not null and grade between 1 and 4")
    return rows.repartition("card").sortWithinPartitions("card", "t", "ord").mapInArrow(fold, schema)


def card_states(reviews: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """The state of each card after its reviews, and its last grade; reviews without a time or a grade of 1 to 4 don't count."""
    return _replayed(reviews, weights, False).select("card", "s", "d", "reps", "lapses", "last", "grade", "raw")


def with_due(cards: DataFrame, retention: float = 0.9, most: int = 3650) -> DataFrame:
    rows = cards.withColumn("interval", memory.days_until_due(F.col("raw"), F.col("grade"), retention, most))
    return rows.withColumn("due", F.date_add(F.date_from_unix_date(F.floor("last").cast("int")), F.col("interval")))


def is_mature() -> Column:
    return (F.col("reps") >= MATURE_REPS) & (F.col("s") >= MATURE_DAYS)


def deck_progress(cards: DataFrame, deck: Column, today: str) -> DataFrame:
    now = F.unix_date(F.to_date(F.lit(today)))
    known = memory.retrievability(F.col("s"), now - F.col("last"))
    share = F.count_if(is_mature()) / F.count(F.lit(1))
    return cards.groupBy(deck.alias("deck")).agg(
        F.count(F.lit(1)).alias("active"),
        F.count_if(is_mature()).alias("mature"),
        F.round(share, 3).alias("mastery"),
        F.round(F.avg(known), 3).alias("retention"),
        F.count_if(F.col("due") <= F.to_date(F.lit(today))).alias("due"),
        F.min("due").alias("next_due"),
        ((F.count(F.lit(1)) >= READY_CARDS) & (share >= READY_SHARE)).alias("ready"),
    )


def load_forecast(cards: DataFrame, today: str, days: int = 14) -> DataFrame:
    """How many cards fall due on each of the next days; overdue ones today."""
    now = F.to_date(F.lit(today))
    counts = cards.groupBy(F.greatest("due", now).alias("day")).agg(F.count(F.lit(1)).alias("cards"))
    calendar = cards.sparkSession.range(1).select(F.explode(F.sequence(now, F.date_add(now, days - 1))).alias("day"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("cards", F.lit(0)).alias("cards"))


def seconds_per_review(reviews: DataFrame) -> DataFrame:
    timed = reviews.filter(F.col("seconds").between(1, 120))
    return timed.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= LEAST_TIMED, F.round(F.median("seconds"), 4)).otherwise(USUAL_SECONDS).alias("seconds"))


def retention_curve(cards: DataFrame, seconds: float = USUAL_SECONDS) -> DataFrame:
    """Work and knowledge at each target: one pass with a sum for each target."""
    sums = [F.sum(1 / memory.interval(F.col("s"), F.lit(r))).alias(f"r{i}") for i, r in enumerate(RETENTION_GRID)]
    one = cards.filter("s > 0").agg(F.count(F.lit(1)).alias("n"), *sums)
    points = one.select("n", F.explode(F.array(*(F.struct(F.lit(r).alias("retention"), F.col(f"r{i}").alias("per_day")) for i, r in enumerate(RETENTION_GRID)))).alias("p")).select("n", "p.*")
    minutes = F.col("per_day") * seconds / 60
    points = points.select("retention", "per_day", minutes.alias("minutes"), (F.col("n") * F.col("retention")).alias("known"))
    worth = F.when(F.col("minutes") > 0, F.col("known") / F.col("minutes"))
    best = F.row_number().over(W.partitionBy().orderBy(worth.desc_nulls_last(), "retention")) == 1  # nine rows
    return points.select("retention", F.round("per_day", 4).alias("per_day"), F.round("minutes", 4).alias("minutes"), F.round("known", 4).alias("known"), F.round(worth, 4).alias("known_per_minute"), best.alias("optimal"))


def review_samples(reviews: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """What the model had to predict: a card's stability before each review but its first, the days since, and whether it was remembered."""
    rows = _replayed(reviews, weights, True).filter("before > 0 and elapsed > 0")
    return rows.select("card", F.col("before").alias("stability"), "elapsed", (F.col("grade") >= 3).alias("remembered"))


def _loss(scale: float) -> Column:
    p = memory.retrievability(F.greatest(F.lit(1e-6), F.col("stability") * scale), F.col("elapsed"))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.avg(F.when(F.col("remembered"), -F.log(p)).otherwise(-F.log(1 - p)))


def scale_of(weights: list[float]) -> float:
    """How far the first four weights stretch all stabilities."""
    return (sum(weights[:4]) or 1.0) / sum(memory.WEIGHTS[:4])


def log_loss(samples: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """The number of samples (stability, elapsed, remembered) and their mean negative log likelihood."""
    return samples.agg(F.count(F.lit(1)).alias("n"), F.round(_loss(scale_of(weights or memory.WEIGHTS)), 6).alias("log_loss"))


def fit(samples: DataFrame, rounds: int = 40) -> DataFrame:
    """Coordinate descent over the four weights that the samples can tell apart: n, baseline_loss, loss, scale, improved, enough, preview, weights.

    The samples are written once; each trial pair is one aggregate over them, of which a few numbers reach the driver.
    """
    samples = kept(samples.select("stability", "elapsed", "remembered"))
    start = list(memory.WEIGHTS)
    known: dict[float, float] = {}

    def losses(trials: list[list[float]]) -> list[float]:
        scales = [scale_of(w) for w in trials]
        new = sorted({x for x in scales if x not in known})
        if new:
            row = samples.agg(*(_loss(x).alias(f"l{i}") for i, x in enumerate(new))).first()
            known.update((x, math.inf if row[i] is None else row[i]) for i, x in enumerate(new))
        return [known[x] for x in scales]

    def trial(weights: list[float], i: int, factor: float) -> list[float]:
        low, high = FIT_BOUNDS[i]
        return [min(high, max(low, x * factor)) if j == i else x for j, x in enumerate(weights)]

    n = samples.count()
    best, step = start, 0.35
    baseline = least = losses([start])[0]
    for _ in range(rounds if n >= PREVIEW_FROM else 0):
        moved = False
        for i in range(4):
            up = trial(best, i, 1 + step)
            losses([up, trial(best, i, 1 - step), trial(up, i, 1 - step)])  # what either outcome asks for, in one pass
            for factor in (1 + step, 1 - step):
                new = trial(best, i, factor)
                if new[i] != best[i] and losses([new])[0] < least - 1e-9:
                    best, least, moved = new, losses([new])[0], True
        if not moved:
            step /= 2
            if step < 1e-3:
                break
    shown = [None if math.isinf(x) else round(x, 6) for x in (baseline, least)]
    row = (n, *shown, round(scale_of(best), 4), n >= PREVIEW_FROM and least < baseline - 1e-6, n >= FIT_ENOUGH, PREVIEW_FROM <= n < FIT_ENOUGH, [round(x, 6) for x in best])
    return samples.sparkSession.createDataFrame([row], "n bigint, baseline_loss double, loss double, scale double, improved boolean, enough boolean, preview boolean, weights array<double>")
