"""Deadlines and periods in words, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of days and months, words that mark a date, and day names that are words as well
WEEKDAYS = {
    "monday": 0, "mon": 0, "tuesday": 1, "tue": 1, "tues": 1, "wednesday": 2, "wed": 2,
    "thursday": 3, "thu": 3, "thurs": 3, "friday": 4, "fri": 4, "saturday": 5, "sat": 5,
    "sunday": 6, "sun": 6,
}
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4,
    "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8,
    "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10,
    "nov": 11, "november": 11, "dec": 12, "december": 12,
}
MARKERS = "by|due|deadline|before|until|till|on|for"
WORDLIKE_DAYS = ("sat", "sun", "wed")
DAY_MARKERS = "by|on|due|until|till|before|this|next|every"
CONFIRMED = ("explicit", "exact", "manual")
MOST_MINUTES, FOCUS_DAY = 100_000, 240

LAST_DAY = "9999-12-31"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _guess(date: Column, phrase: Column, kind: str) -> Column:
    return let(date, lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), phrase.alias("phrase"), F.lit(kind).alias("kind"))))


def _made(year: Column, month: Column, day: Column) -> Column:
    """The date, null if there is none."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _names(table: dict[str, int], name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), name)


def weekday(day: Column) -> Column:
    """0 on Mondays, 6 on Sundays."""
    return F.weekday(day)


def coming_weekday(today: Column, number: Column, include_today: bool = False) -> Column:
    return F.date_add(today, F.pmod(number - weekday(today), F.lit(7)) if include_today else F.pmod(number - weekday(today) - 1, F.lit(7)) + 1)


def months_later(day: Column, n: Column | int) -> Column:
    """Calendar months, clamped to the end of short ones."""
    first = F.add_months(F.trunc(day, "month"), n)
    return F.date_add(first, F.least(F.dayofmonth(day), F.dayofmonth(F.last_day(first))) - 1)


def this_year_or_next(today: Column, month: Column, day: Column) -> Column:
    return let(_made(F.year(today), month, day), lambda here: F.when(here >= today, here).when(here.isNotNull(), _made(F.year(today) + 1, month, day)))


def period_start(day: Column, cadence: Column) -> Column:
    return F.when(cadence == "daily", day).when(cadence == "monthly", F.trunc(day, "month")).otherwise(F.trunc(day, "week"))


def period_length_days(cadence: Column) -> Column:
    return F.when(cadence == "daily", 1).when(cadence == "monthly", 30).otherwise(7)


def periods_between(start: Column, end: Column, cadence: Column) -> Column:
    """The starts of all periods from the one of start to the one of end."""
    a, b = period_start(start, cadence), period_start(end, cadence)
    def every(step: str) -> Column:
        return F.sequence(a, F.greatest(a, b), F.expr(f"interval {step}"))

    whole = F.when(cadence == "daily", every("1 day")).when(cadence == "monthly", every("1 month")).otherwise(every("7 days"))
    return F.when(a <= b, whole).otherwise(F.array().cast("array<date>"))


def _iso(t: Column, today: Column) -> Column:
    pattern = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    return let(_found(t, pattern), lambda x: _guess(_made(*(F.split(x, "-")[i] for i in range(3))), x, "explicit"))


def _numeric(t: Column, today: Column) -> Column:
    """Pairs count where a marker stands before them, with a year of four digits, or as the whole text."""
    pair = r"\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?"
    pattern = rf"\b(?:(?<=(?:{MARKERS}|due\s{{0,3}}:|deadline\s{{0,3}}:)\s{{1,9}}){pair}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}|(?<=^\s{{0,9}}){pair}(?=\s*$))\b"

    def dated(x: Column) -> Column:
        p = F.split(x, "[/-]")
        month, day, year = p[0].cast("int"), p[1].cast("int"), F.get(p, F.lit(2)).cast("int")
        whole = F.when(year < 100, year + 2000).otherwise(year)
        return F.struct(F.when(year.isNotNull(), _made(whole, month, day)).otherwise(this_year_or_next(today, month, day)).alias("date"), x.alias("phrase"), F.lit("explicit").alias("kind"))

    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), dated), lambda g: g["date"].isNotNull())
    return F.get(found, F.lit(0))


def _month_name(t: Column, today: Column) -> Column:
    before, behind = r"\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?\b", r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?([a-z]{3,9})\b"

    def rule(p: str, month: int, day: int) -> Column:
        return let(_found(t, p), lambda x: _guess(this_year_or_next(today, _names(MONTHS, F.regexp_extract(x, p, month)), F.regexp_extract(x, p, day).cast("int")), x, "explicit"))

    return F.coalesce(rule(before, 1, 2), rule(behind, 2, 1))


def _day_of_month(t: Column, today: Column) -> Column:
    pattern = r"\b(?:on|by|due|before|the)\s+(?:the\s+)?(\d{1,2})(?:st|nd|rd|th)\b"
    firsts = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.add_months(F.trunc(today, "month"), i))

    def dated(day: Column) -> Column:
        days = F.transform(F.filter(firsts, lambda m: F.dayofmonth(F.last_day(m)) >= day), lambda m: F.date_add(m, day - 1))
        return F.when(day.between(1, 31), F.get(F.filter(days, lambda d: d >= today), F.lit(0)))

    return let(_found(t, pattern), lambda x: _guess(let(F.regexp_extract(x, r"\d+", 0).cast("int"), dated), x, "exact"))


def _interval(t: Column, today: Column) -> Column:
    room = F.date_diff(F.to_date(F.lit(LAST_DAY)), today)

    def rule(pattern: str) -> Column:
        def dated(n: Column, unit: Column, x: Column) -> Column:
            days = n * F.when(unit == "week", 7).otherwise(1)
            date = F.when((unit != "month") & (days <= room), F.date_add(today, F.least(days, room).cast("int")))
            month = F.when((unit == "month") & (n * 31 <= room), months_later(today, F.least(n, F.lit(100_000)).cast("int")))
            return F.coalesce(_guess(date, x, "exact"), _guess(month, x, "ambiguous"))

        def number(x: Column) -> Column:
            said = F.regexp_extract(x, pattern, 1)
            return F.when(said.isin("a", "an"), F.lit(1).cast("long")).otherwise(F.least(said.try_cast("long"), F.lit(10**9)))

        return let(_found(t, pattern), lambda x: let(number(x), lambda n: dated(n, F.regexp_extract(x, pattern, 2), x)))

    return F.coalesce(rule(r"\bin\s+(a|an|\d+)\s+(day|week|month)s?\b"), rule(r"\b(a|an|\d+)\s+(day|week|month)s?\s+from\s+(?:now|today)\b"))


def _named_day(t: Column, today: Column) -> Column:
    kinds = ((r"\bday after tomorrow\b", 2), (r"\btomorrow\b", 1), (r"\btoday\b|\btonight\b|\beod\b|\bend of (?:the )?day\b", 0))

    def rule(p: str, n: int) -> Column:
        return let(_found(t, p), lambda x: _guess(F.when(x.isNotNull(), F.date_add(today, n)), x, "exact"))

    return F.coalesce(*(rule(p, n) for p, n in kinds))


def _weekend(t: Column, today: Column) -> Column:
    pattern = r"\b(this|next|the)?\s*weekend\b"
    saturday = coming_weekday(today, F.lit(5), include_today=True)
    return let(_found(t, pattern), lambda x: _guess(F.when(x.isNotNull(), F.date_add(saturday, F.when(F.startswith(x, F.lit("next")), 7).otherwise(0))), F.trim(x), "ambiguous"))


def _weekday_reference(t: Column, today: Column) -> Column:
    plain = "|".join(d for d in WEEKDAYS if d not in WORDLIKE_DAYS)
    pattern = rf"\b(?:(next|this)\s+)?\b((?:{plain})|(?<=\b(?:{DAY_MARKERS})\s{{1,9}})(?:{'|'.join(WORDLIKE_DAYS)}))\b"

    def dated(x: Column) -> Column:
        target = coming_weekday(today, _names(WEEKDAYS, F.regexp_extract(x, r"[a-z]+$", 0)))
        later = F.startswith(x, F.lit("next"))
        return F.coalesce(_guess(F.when(later, F.date_add(target, 7)), x, "ambiguous"), _guess(F.when(~later, target), x, "exact"))

    return let(_found(t, pattern), dated)


def _end_of_period(t: Column, today: Column) -> Column:
    week, month = r"\beow\b|\bend of (?:the )?week\b", r"\beom\b|\bend of (?:the )?month\b"
    friday = coming_weekday(today, F.lit(4), include_today=True)
    return F.coalesce(_guess(F.when(t.rlike(week), friday), _found(t, week), "ambiguous"), _guess(F.when(t.rlike(month), F.last_day(today)), _found(t, month), "exact"))


def _next_period(t: Column, today: Column) -> Column:
    week, month = r"\bnext week\b", r"\bnext month\b"
    friday = F.date_add(today, 7 - weekday(today) + 4)
    return F.coalesce(_guess(F.when(t.rlike(week), friday), _found(t, week), "ambiguous"), _guess(F.when(t.rlike(month), months_later(today, 1)), _found(t, month), "ambiguous"))


RULES = (_iso, _numeric, _month_name, _day_of_month, _interval, _named_day, _weekend, _weekday_reference, _end_of_period, _next_period)


def deadline(text: Column, today: Column) -> Column:
    """The deadline that a text names: (date, phrase, kind), null without one.

    kind is explicit where the text names a date, exact where there is one sane reading, else ambiguous.
    An explicit prefix (due: ...) comes first, then the rules in order.
    """
    prefix = r"\b(?:due|deadline)\s*[:=]\s*([^\n,;]+)"

    def guessed(t: Column) -> Column:
        inner = let(_found(t, prefix), lambda x: _guess(let(F.regexp_extract(x, prefix, 1), lambda y: F.coalesce(*(rule(y, today) for rule in RULES)))["date"], F.trim(x), "explicit"))
        return F.coalesce(inner, *(rule(t, today) for rule in RULES))

    def cased(g: Column, t: Column) -> Column:
        return F.when(g.isNotNull(), F.struct(g["date"].alias("date"), F.substring(text, F.position(g["phrase"], t), F.length(g["phrase"])).alias("phrase"), g["kind"].alias("kind")))

    return let(F.lower(F.coalesce(text, F.lit(""))), lambda t: let(guessed(t), lambda g: cased(g, t)))


def confirmed(kind: Column) -> Column:
    return F.coalesce(kind.isin(*CONFIRMED), F.lit(False))


def duration_minutes(text: Column) -> Column:
    """Hours, minutes and days of work named in a text, in minutes; null if there are none. "in 3 days" and "3 days ago" say when, not how long."""
    t = F.lower(text)

    def unit(pattern: str, minutes: int) -> tuple[Column, Column]:
        numbers = F.regexp_extract_all(t, F.lit(pattern), 1)
        return F.aggregate(numbers, F.lit(0).cast("double"), lambda a, x: a + F.floor(x.cast("double") * minutes)), F.size(numbers) > 0

    hours = unit(r"(?<![\d.])(\d+(?:\.\d+)?)\s*(?:hours?|hrs?|h)\b", 60)
    minutes = unit(r"(?<![\d.])(\d+(?:\.\d+)?)\s*(?:minutes?|mins?|m)\b", 1)
    days = unit(r"(?<![\d.])(?<!\bin\s{1,6})(\d+)\s*days?\b(?!\s+(?:from|left|away|before|after|later|ago)\b)", FOCUS_DAY)
    total = hours[0] + minutes[0] + days[0]
    return F.when((hours[1] | minutes[1] | days[1]) & (total > 0), F.least(F.lit(float(MOST_MINUTES)), total).cast("int"))
