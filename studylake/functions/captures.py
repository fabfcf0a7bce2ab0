"""What a captured text says about itself: title, level, steps, skills, materials, and the bucket it belongs to."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates

# fixed values: words and phrases that the rules look for
LEARNING_VERBS = (
    "learn", "study", "understand", "master", "revise", "review", "memorize",
    "practice", "read up on", "get good at", "teach myself", "figure out how",
)
HARD_SIGNALS = ("advanced", "deep dive", "from scratch", "internals", "proof", "theory")
EASY_SIGNALS = ("intro", "basics", "quick", "skim", "overview", "refresher", "cheat sheet")
STOP_WORDS = (
    "the a an and or to of for in on by with my me i learn study build make do read write how then "
    "before after next this that it about using use up book chapter notes today tomorrow week month day"
).split() + [*dates.WEEKDAYS, *dates.MONTHS]
# fixed values: (weight, pattern) of each bucket's evidence
EVIDENCE = {
    "project": [
        (2.0, r"\b(submit|turn in|hand in|finish|complete|apply|register|sign up|book|buy|order|email|call|schedule|pack|clean|fix|draft|write up|send|renew|file|pay|print|return)\b"),
        (2.0, r"\b(assignment|homework|hw|essay|lab|problem set|pset|exam|midterm|final|quiz|test|presentation|deliverable)\b"),
        (1.5, r"^\s*[-*]\s*\[[ xX]\]"),
        (1.5, r"\b(due|deadline|by end of|before)\b"),
        (1.0, r"\b(build|make|create|launch|ship|learn|study for|prepare|plan|set up|install|migrate|organi[sz]e)\b"),
        (1.0, r"^\s*(?:\d+[.)]\s+\S|[-*]\s+\S)"),
    ],
    "area": [
        (3.0, r"\b(every ?day|everyday|daily|nightly|weekly|monthly|each (?:day|morning|night|week|month)|every (?:morning|night|evening|week|month|monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b"),
        (2.5, r"\b\d+\s*(?:x|times?)\s*(?:a|per|each)\s*(?:day|week|month)\b"),
        (2.5, r"\b(habit|routine|ritual|practice regularly|keep up|stay on top of|maintain|upkeep|ongoing|recurring)\b"),
        (1.5, r"\b(never ends|no deadline|forever|always|as long as|indefinitely)\b"),
        (1.0, r"\b(m-f|mon-fri|weekdays|weekends|mwf)\b"),
    ],
    "resource": [
        (2.0, r"\b(notes? on|cheat ?sheet|reference|summary of|glossary|definitions?|overview of|documentation|docs|syllabus|reading|excerpt|transcript)\b"),
        (2.0, r"\b(is defined as|refers to|means that|consists of|is a (?:type|kind|form) of|in other words|for example|e\.g\.|i\.e\.)\b"),
        (1.5, r"https?://"),
        (1.0, r"\b(chapter|ch\.|lecture|article|paper|book|video|course|module|section)\s*\d*\b"),
        (1.0, r"\b(ingredients|steps to|how it works|formula|equation|theorem|syntax|api|command)\b"),
    ],
}
# fixed values: the weights of a date, of long prose and of headings, and what the confidence is made of
DATED, GUESSED, DATE_AGAINST_AREA, LONG_PROSE, HEADINGS = 3.0, 1.5, 0.5, 1.5, 1.0
LONG_WORDS, HEADING_WORDS, FULL_STRENGTH, BASE_SHARE, AUTO_FLOOR = 150, 80, 4.5, 0.45, 0.6
OWN_BOILERPLATE = r"(?ms)^#{1,3} (?:Steps|Materials|Hardware|Software|Related|Capture|Check-in log)\s*$|recurs on the calendar|No due date|·\s*due\s*\d{4}-\d{2}-\d{2}\s*·|<!-- sb:.*?-->"
# fixed values: clauses that say when, which a title goes without
TITLE_CUTS = (
    r"\bby\s+(?:next|this|the|tomorrow|today|mon|tue|wed|thu|fri|sat|sun|eod|end\b|\d)",
    r"\b(?:due|deadline|before|until|till)\b",
    r"\bin\s+(?:a|an|\d+)\s+(?:day|week|month)s?\b",
    r"\b(?:about|approx\.?|around|roughly|~)?\s*\d+(?:\.\d+)?\s*(?:hours?|hrs?|h|minutes?|mins?)\b",
    r"\b(?:tomorrow|tonight|next week|next month|this week)\b",
    r"\b(?:next|this)\s+(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*\b",
    r"\b(?:this|next)\s+weekend\b",
    r"\b(?:eow|eom|end of (?:the )?(?:week|month|day))\b",
)
TITLE_ENDS = " ,;:-—."


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def first_line(text: Column) -> Column:
    """The first line with more than white space and #, without them; null if there is none."""
    stripped = F.transform(_lines(text), lambda x: F.regexp_replace(_trimmed(x), r"^#*\s*", ""))
    return F.get(F.filter(stripped, lambda x: x != ""), F.lit(0))


def title(text: Column, most: int = 80) -> Column:
    """The first line without marks, and without the clauses that say when or how long."""
    line = F.regexp_replace(first_line(text), r"(?i)^(?:todo|task|note|project|remember)\s*[:\-]\s*", "")
    line = F.regexp_replace(line, r"^[-*+]\s+", "")
    cut = functools.reduce(lambda c, p: F.regexp_replace(c, rf"(?i)\s*[,;—-]?\s*{p}.*$", ""), TITLE_CUTS, line)
    bare = F.btrim(cut, F.lit(TITLE_ENDS))
    kept = dates.let(bare, lambda b: _trimmed(F.substring(F.when(F.length(b) < 3, F.btrim(line, F.lit(TITLE_ENDS))).otherwise(b), 1, most)))
    return dates.let(kept, lambda b: F.when(F.coalesce(b, F.lit("")) == "", "Untitled").otherwise(F.concat(F.upper(F.substring(b, 1, 1)), F.substring(b, F.lit(2), F.length(b)))))


def _holds(text: Column, words: tuple[str, ...]) -> list[Column]:
    return [F.contains(text, F.lit(w)) for w in words]


def level(text: Column) -> Column:
    """1 to 5: 3, more with each hard signal, less with each easy one, more for a long text."""
    t = F.lower(text)
    hard, easy = (functools.reduce(operator.add, (c.cast("int") for c in _holds(t, words))) for words in (HARD_SIGNALS, EASY_SIGNALS))
    return F.greatest(F.lit(1), F.least(F.lit(5), 3 + hard - easy + (F.length(text) > 400).cast("int")))


def is_learning(text: Column) -> Column:
    return functools.reduce(operator.or_, _holds(F.lower(text), LEARNING_VERBS))


def steps(text: Column) -> Column:
    """Bullets and numbered lines, or else the parts of a first line with "then"."""
    mark = r"^(?:[-*+]\s+|\d+[.)]\s+)(?:\[[ xX]?\]\s*)?(.+)$"
    lines = F.transform(_lines(text), lambda x: _trimmed(F.regexp_extract(_trimmed(x), mark, 1)))
    found = F.filter(lines, lambda x: x != "")
    first = F.get(_lines(_trimmed(F.coalesce(text, F.lit("")))), F.lit(0))
    chain = F.split(F.regexp_replace(first, r"(?i)\s+then\s+", "\n"), "\n")
    parts = F.transform(F.filter(chain, lambda p: _trimmed(p) != ""), lambda p: F.btrim(p, F.lit(" .,;")))
    return F.when(F.size(found) > 0, found).when((F.size(chain) > 1) & F.contains(F.lower(first), F.lit(" then ")), parts).otherwise(F.array().cast("array<string>"))


def _distinct(items: Column, key=lambda x: x) -> Column:
    """Items whose key none before them has, in order."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def skills(text: Column, most: int = 6) -> Column:
    """Code spans, hashtags and capitalised words, distinct whatever their case."""
    every = F.concat(F.regexp_extract_all(text, F.lit(r"`([^`]{2,30})`"), 1), F.regexp_extract_all(text, F.lit(r"#(\w{2,30})"), 1), F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9+#.]{2,20})\b"), 1))
    named = F.filter(F.transform(every, _trimmed), lambda x: (x != "") & ~F.lower(x).isin(STOP_WORDS))
    return F.slice(_distinct(named, F.lower), 1, most)


def materials(text: Column, most: int = 8) -> Column:
    """Addresses, linked titles and quotations, distinct."""
    patterns = (r"(https?://\S+)", r"\[\[([^\]]+)\]\]", r'"([^"]{3,60})"')
    return F.slice(_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in patterns))), 1, most)


def prior(text: Column, today: Column) -> Column:
    """All that the rules say of a project, as a struct."""

    def told(guess: Column, found: Column) -> Column:
        n = F.size(found)
        minutes = F.coalesce(dates.duration_minutes(text), F.when(n > 0, F.greatest(F.lit(30), 45 * n)).otherwise(60))
        return F.struct(
            guess["date"].alias("deadline"), guess["kind"].alias("deadline_kind"), guess["phrase"].alias("deadline_phrase"), dates.confirmed(guess["kind"]).alias("deadline_confirmed"),
            minutes.alias("estimate_minutes"), level(text).alias("level"), skills(text).alias("skills"), materials(text).alias("materials"), found.alias("steps"), is_learning(text).alias("learning"),
        )

    return dates.let(dates.deadline(text, today), lambda g: dates.let(steps(text), lambda found: told(g, found)))


def step_minutes(total: Column, n: Column) -> Column:
    """Minutes of each of n steps, 15 at least."""
    return F.greatest(F.lit(15), F.floor(total / F.greatest(F.lit(1), n)).cast("int"))


def scores(text: Column, title_: Column, today: Column) -> Column:
    """The evidence for each bucket: (project, area, resource), a tally of weights."""

    def tallied(blob: Column, low: Column, guess: Column) -> Column:
        dated, words = guess.isNotNull(), F.regexp_count(blob, F.lit(r"(?U)\w+"))
        tally = {b: functools.reduce(operator.add, (F.when(low.rlike(f"(?m){p}"), w).otherwise(0.0) for w, p in rules)) for b, rules in EVIDENCE.items()}
        project = tally["project"] + F.when(dated, F.when(dates.confirmed(guess["kind"]), DATED).otherwise(GUESSED)).otherwise(0.0)
        area = dates.let(tally["area"], lambda x: x - F.when(dated & (x != 0), DATE_AGAINST_AREA).otherwise(0.0))
        shaped = F.when((words >= LONG_WORDS) & ~dated, LONG_PROSE).otherwise(0.0) + F.when((words >= HEADING_WORDS) & blob.rlike(r"(?m)^#{1,6} \S"), HEADINGS).otherwise(0.0)
        return F.struct(project.alias("project"), area.alias("area"), (tally["resource"] + shaped).alias("resource"))

    blob = F.regexp_replace(F.concat(F.coalesce(title_, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))), OWN_BOILERPLATE, " ")
    return dates.let(blob, lambda b: dates.let(F.lower(b), lambda low: dates.let(dates.deadline(b, today), lambda g: tallied(b, low, g))))


def verdict(found: Column) -> Column:
    """(bucket, confidence, margin) of scores: strength of the first times how far the second lies behind; ties in the order project, area, resource."""
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(found[b].alias("score"), F.lit(-i).alias("place"), F.lit(b).alias("bucket")) for i, b in enumerate(EVIDENCE)))))

    def judged(r: Column) -> Column:
        top, second = r[0]["score"], F.greatest(F.lit(0.0), r[1]["score"])
        margin = F.when(top > 0, (top - second) / top).otherwise(0.0)
        sure = F.least(F.lit(1.0), top / FULL_STRENGTH) * (BASE_SHARE + (1 - BASE_SHARE) * margin)
        return F.struct(r[0]["bucket"].alias("bucket"), F.round(F.when(top > 0, sure).otherwise(0.0), 3).alias("confidence"), F.round(margin, 3).alias("margin"))

    return dates.let(ranked, judged)
