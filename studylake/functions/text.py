"""Words, digests and citations of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that no search looks for
STOP_WORDS = (
    "the a an and or of to in is are it that this for on with as by be was were at from "
    "what how why when which who do does did i my me you your about can should would there"
).split()
WORD = "[a-z0-9]{2,}"


def terms(text: Column) -> Column:
    """The distinct words of a text, stop words aside."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def fingerprint(title: Column, body: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", title, body), 256), 1, 16)


def cited(text: Column, count: Column) -> Column:
    """The distinct numbers n of [n] marks within 1..count, sorted."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= count))))


def excerpt(text: Column, most: int = 320) -> Column:
    """A passage without its title line, in one line of at most so many characters."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?\n\n", ""), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))
