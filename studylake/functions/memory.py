"""The memory model: a power-law forgetting curve and the state's transitions.

Each formula is written once and takes the operations it needs: SPARK makes Column expressions of it,
PLAIN numbers, for the folds that go through a card's reviews one by one.
"""

from __future__ import annotations

import math
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the curve's shape, the 19 default weights and the bounds of the state
DECAY = -0.5
FACTOR = 19 / 81
WEIGHTS = [0.40255, 1.18385, 3.17300, 15.69105, 7.19490, 0.53450, 1.46040, 0.00460, 1.54575, 0.11920, 1.01925, 1.93950, 0.11000, 0.29605, 2.26980, 0.23150, 2.98980, 0.51655, 0.66210]
LEAST_STABILITY = 0.01
KEPT_PLACES = 4
RETENTION_RANGE = (0.70, 0.99)




class Ops(NamedTuple):
    exp: Any
    power: Any
    least: Any
    greatest: Any
    choose: Any  # (condition, value where it holds, value elsewhere)


def _column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


SPARK = Ops(
    lambda x: F.exp(_column(x)),
    lambda x, y: F.pow(_column(x), _column(y)),
    lambda x, y: F.least(_column(x), _column(y)),
    lambda x, y: F.greatest(_column(x), _column(y)),
    lambda c, x, y: F.when(c, x).otherwise(y),
)
PLAIN = Ops(math.exp, pow, min, max, lambda c, x, y: x if c else y)


def retrievability(s: Any, elapsed: Any, o: Ops = SPARK) -> Any:
    s_ = o.greatest(s, 1e-300)
    return o.choose(s <= 0, 0.0, o.power(1 + FACTOR * o.greatest(0.0, elapsed) / s_, DECAY))


def interval(s: Any, retention: Any, o: Ops = SPARK) -> Any:
    """Days until the chance of recall has fallen to retention."""
    r = o.greatest(RETENTION_RANGE[0], o.least(RETENTION_RANGE[1], retention))
    return o.choose(s <= 0, 0.0, s / FACTOR * (o.power(r, 1 / DECAY) - 1))


def _clamped(d: Any, o: Ops) -> Any:
    return o.greatest(1.0, o.least(10.0, d))


def first_stability(grade: Any, w: list[float], o: Ops = SPARK) -> Any:
    given = o.choose(grade <= 1, w[0], o.choose(grade == 2, w[1], o.choose(grade == 3, w[2], w[3])))
    return o.greatest(LEAST_STABILITY, given)


def first_difficulty(grade: Any, w: list[float], o: Ops = SPARK) -> Any:
    return _clamped(w[4] - o.exp(w[5] * (grade - 1)) + 1, o)


def next_difficulty(d: Any, grade: Any, w: list[float], o: Ops = SPARK) -> Any:
    damped = d - w[6] * (grade - 3) * (10 - d) / 9
    return _clamped(w[7] * first_difficulty(4, w, o) + (1 - w[7]) * damped, o)


def next_stability(s: Any, d: Any, r: Any, grade: Any, elapsed: Any, w: list[float], o: Ops = SPARK) -> Any:
    """d is the difficulty after the review."""
    step = o.choose(grade == 2, w[15], o.choose(grade == 4, w[16], 1.0))
    recalled = s * (1 + o.exp(w[8]) * (11 - d) * o.power(s, -w[9]) * (o.exp(w[10] * (1 - r)) - 1) * step)
    lapsed = o.least(s, w[11] * o.power(d, -w[12]) * (o.power(s + 1, w[13]) - 1) * o.exp(w[14] * (1 - r)))
    again = s * o.exp(w[17] * (grade - 3 + w[18]))
    return o.greatest(LEAST_STABILITY, o.choose(elapsed < 1.0, again, o.choose(grade == 1, lapsed, recalled)))


def after(s: Any, d: Any, grade: Any, elapsed: Any, w: list[float], o: Ops = SPARK) -> tuple[Any, Any]:
    """Stability and difficulty after a review; s is 0 for a new card."""
    known = o.greatest(s, LEAST_STABILITY)
    harder = next_difficulty(d, grade, w, o)
    later = next_stability(known, harder, retrievability(known, elapsed, o), grade, elapsed, w, o)
    return o.choose(s <= 0, first_stability(grade, w, o), later), o.choose(s <= 0, first_difficulty(grade, w, o), harder)


def kept(x: float) -> float:
    """A number of a state as it is kept between reviews."""
    return round(x, KEPT_PLACES)


def days_until_due(s: Column, grade: Column, retention: float = 0.9, most: int = 3650) -> Column:
    """Whole days to the next review, 1 to most; a card answered with the lowest grade comes back after one."""
    free = F.bround(F.least(F.lit(float(most)), interval(s, retention))).cast("int")
    return F.when(grade == 1, 1).otherwise(F.greatest(F.lit(1), free))
