"""Scales of answers and dates: predictions, grades, exam days, priorities and day labels."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a tap means, where a score becomes a better grade
TAPS = {"sure": 0.9, "think-so": 0.6, "no-idea": 0.2}
GRADE_FROM = ((0.95, 4), (0.7, 3), (0.45, 2))


def probability(value: Column) -> Column:
    """A tap's name, 0..1 or 0..100 as a probability; null for anything else."""
    name = F.lower(F.trim(value.cast("string")))
    number = name.try_cast("double")
    scaled = F.round(F.when(number > 1, number / 100).otherwise(number), 4)
    known = functools.reduce(lambda c, tap: c.when(name == tap[0], tap[1]), list(TAPS.items())[1:], F.when(name == "sure", TAPS["sure"]))
    return known.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def grade_of(score: Column) -> Column:
    (first, grade), *rest = GRADE_FROM
    return functools.reduce(lambda c, x: c.when(score >= x[0], x[1]), rest, F.when(score >= first, grade)).otherwise(1)


def exam_capped(due: Column, exam: Column, today: Column) -> Column:
    """The day a card falls due, at the latest on the eve of its exam, unless the eve is past."""
    eve = F.date_sub(exam, 1)
    return F.when(exam.isNull() | (eve <= today) | (due <= eve), due).otherwise(eve)


def priority(level: Column, deadline: Column, today: Column) -> Column:
    """1 (first) to 9: the level, moved by how near the deadline is."""
    left = F.date_diff(deadline, today)
    moved = F.when(left <= 1, -2).when(left <= 3, -1).when(left > 21, 1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(9), 6 - F.greatest(F.lit(1), F.least(F.lit(5), level)) + moved))


def day_label(days: Column) -> Column:
    def tenths(unit: float, name: str) -> Column:
        return F.replace(F.format_string(f"%.1f{name}", days / unit), F.lit(".0"), F.lit(""))

    return F.when(days < 1, "<1d").when(days < 31, F.format_string("%dd", days.cast("int"))).when(days < 365, tenths(30.44, "mo")).otherwise(tenths(365.25, "y"))
