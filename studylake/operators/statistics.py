"""Calibration of confidence, reference classes of estimates, and thresholds."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values: bounds of the confidence bins, of confident errors, and of estimates' ratios
BINS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0001))
CORRECT_FROM, CONFIDENT = 3, 0.8
OUTLIER, ENOUGH, LOWEST, HIGHEST = 12.0, 5, 0.5, 3.0
CUTOFFS = [round(0.30 + 0.02 * i, 2) for i in range(35)]
TARGET, ENOUGH_LABELS, USABLE_LABELS = 0.9, 40, 25


def calibration_bins(reviews: DataFrame) -> DataFrame:
    """Each bin with its number, mean confidence and share of correct answers; empty bins stay."""
    right = (F.col("grade") >= CORRECT_FROM).cast("double")
    which = F.coalesce(*(F.when((F.col("confidence") >= lo) & (F.col("confidence") < hi), i) for i, (lo, hi) in enumerate(BINS)))
    found = reviews.filter("confidence is not null").groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("predicted"), F.round(F.avg(right), 4).alias("actual"))
    bins = reviews.sparkSession.createDataFrame([(i, lo, min(hi, 1.0)) for i, (lo, hi) in enumerate(BINS)], "bin int, low double, high double")
    return F.broadcast(bins).join(found, "bin", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"), "predicted", "actual")


def calibration_summary(reviews: DataFrame) -> DataFrame:
    c, right = F.col("confidence"), F.col("grade") >= CORRECT_FROM
    hit = right.cast("double")
    return reviews.filter("confidence is not null").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.pow(c - hit, 2)), 4).alias("brier"),
        F.round(F.avg(c), 4).alias("mean_confidence"),
        F.round(F.avg(hit), 4).alias("mean_accuracy"),
        F.count_if((c >= CONFIDENT) & ~right).alias("overconfident"),
        F.count_if((c <= 1 - CONFIDENT) & right).alias("underconfident"),
    )


def overconfident_cards(reviews: DataFrame, limit: int = 25) -> DataFrame:
    """A top-k report: cards most often missed with confidence; of equals the one last seen earliest comes first."""
    rows = reviews.filter((F.col("confidence") >= CONFIDENT) & (F.col("grade") < CORRECT_FROM))
    cards = rows.groupBy("card").agg(F.count(F.lit(1)).alias("times"), F.max("at").alias("last"), F.round(F.max("confidence"), 4).alias("confidence"))
    return cards.orderBy(F.desc("times"), "last", "card").limit(limit)


def reference_classes(timed: DataFrame) -> DataFrame:
    """Median ratio of actual to estimated minutes, over all and by level (rows: level, minutes, actual)."""
    ratio = F.col("actual") / F.col("minutes")
    rows = timed.filter("minutes > 0").withColumn("ratio", ratio).filter((F.col("ratio") > 0) & (F.col("ratio") < OUTLIER))
    both = rows.groupingSets([[], ["level"]], "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("ratio"), 3).alias("median_ratio"), F.sum("minutes").alias("estimated"), F.sum("actual").alias("actual"))
    enough = F.col("n") >= ENOUGH
    multiplier = F.when(enough, F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.col("median_ratio")))).otherwise(1.0)
    name = F.when(F.col("level").isNull(), "all").otherwise(F.concat(F.lit("level "), F.col("level")))
    return both.select(name.alias("class"), "level", "n", "median_ratio", "estimated", "actual", enough.alias("enough"), multiplier.alias("multiplier"))


def adjusted(estimates: DataFrame, classes: DataFrame) -> DataFrame:
    """Estimates (level, minutes) by their level's class if it has enough, else by all. classes is a row per level."""
    usable = classes.filter("enough")
    own = usable.filter("level is not null").select("level", F.col("multiplier").alias("own"))
    every = usable.filter("level is null").agg(F.max("multiplier").alias("every"))
    rows = estimates.join(F.broadcast(own), "level", "left").crossJoin(F.broadcast(every))  # one row
    return rows.withColumn("adjusted", F.round(F.col("minutes") * F.coalesce("own", "every", F.lit(1.0))).cast("int")).drop("own", "every")


def project_accuracy(steps: DataFrame) -> DataFrame:
    done = steps.filter("done and minutes > 0 and actual > 0")
    return done.groupBy("project").agg(F.count(F.lit(1)).alias("steps"), F.sum("minutes").alias("estimated"), F.sum("actual").alias("actual")).withColumn("ratio", F.floor(F.col("actual") / F.col("estimated") * 100 + 0.5) / 100)


def sweep(pairs: DataFrame) -> DataFrame:
    """What each cutoff accepts, by one pass with two counts per cutoff (rows: score, correct)."""
    got = [x for i, c in enumerate(CUTOFFS) for x in (F.count_if(F.col("score") >= c).alias(f"a{i}"), F.count_if((F.col("score") >= c) & F.col("correct")).alias(f"c{i}"))]
    one = pairs.filter("score is not null").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("positives"), *got)
    points = F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"a{i}").alias("accepted"), F.col(f"c{i}").alias("right")) for i, c in enumerate(CUTOFFS)))
    rows = one.select("n", "positives", F.explode(points).alias("p")).select("n", "positives", "p.*")
    rows = rows.withColumn("precision", F.when(F.col("accepted") > 0, F.round(F.col("right") / F.col("accepted"), 4))).withColumn("recall", F.when(F.col("positives") > 0, F.round(F.col("right") / F.col("positives"), 4)))
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 4))
    lowest = F.min(F.when(F.col("precision") >= TARGET, F.col("cutoff"))).over(W.partitionBy())  # 35 rows
    return rows.select("cutoff", "accepted", "right", (F.col("n") - F.col("accepted")).alias("asks"), "precision", "recall", f1.alias("f1"), F.coalesce(F.col("cutoff") == lowest, F.lit(False)).alias("recommended"), (F.col("n") >= ENOUGH_LABELS).alias("enough"), (F.col("n") >= USABLE_LABELS).alias("usable"))


def report(sets: dict[str, DataFrame]) -> DataFrame:
    """One row for each named set of pairs: its size, whether that is enough, and the lowest cutoff precise enough."""
    def row(name: str, pairs: DataFrame) -> DataFrame:
        points = sweep(pairs)
        best = points.agg(F.min(F.when(F.col("recommended"), F.col("cutoff"))).alias("recommended"), F.first("enough").alias("enough"), F.first("usable").alias("usable"))
        size = pairs.filter("score is not null").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("positives"))
        return size.crossJoin(F.broadcast(best)).select(F.lit(name).alias("name"), "n", "positives", "enough", "usable", "recommended")  # one row each

    return functools.reduce(DataFrame.unionByName, (row(name, pairs) for name, pairs in sets.items()))
