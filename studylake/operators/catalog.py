"""Categories, folders, tags and names: what a note is filed under, from parameter tables and its own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..sources import markdown

# fixed values: what a tag, a word of the title and one of the body count, and how much of the body is looked at
TAG, TITLE, BODY, BODY_CHARS, FALLBACK = 100, 10, 1, 4000, "general"
MOST_ELAPSED, MOST_TYPED = 12 * 60, 24 * 60  # fixed values: minutes of a step by the clock and by hand
PLACEHOLDER = r"<%.*?%>|\{\{.*?\}\}|^#{1,6} "


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def categories(notes: DataFrame, keywords: DataFrame, most_words: int = 3) -> DataFrame:
    """(note, category) of notes (note, title, tags, body, manual): a valid manual one, else the one with the highest score, else general.

    keywords (category, place, keyword) is a parameter, the user's own entries included; a keyword that is
    listed twice counts twice, and of equal scores the category with the lowest place wins. Words between
    separators are looked up by equality, keywords of several words as runs of up to most_words.
    """
    def runs(words: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: i + n <= F.size(words)), lambda i: F.array_join(F.slice(words, i + 1, n), " "))))

    key = F.array_join(_words(F.col("keyword")), " ")
    table = keywords.groupBy("category", "place", key.alias("name")).agg(F.count(F.lit(1)).alias("times"))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.array_join(_words(t), " "))
    parts = F.array(*(F.struct(F.lit(w).alias("weight"), F.array_distinct(x).alias("names")) for w, x in ((TAG, tags), (TITLE, runs(_words(F.col("title")))), (BODY, runs(_words(F.substring("body", 1, BODY_CHARS)))))))
    rows = notes.select("note", F.explode(parts).alias("p")).select("note", "p.weight", F.explode("p.names").alias("name"))
    scores = rows.join(table, "name").groupBy("note", "category", "place").agg(F.sum(F.col("weight") * F.col("times")).alias("score"))
    best = scores.groupBy("note").agg(F.max_by("category", F.struct("score", (-F.col("place")).alias("p"))).alias("found"))
    valid = keywords.select(F.col("category").alias("manual"), F.lit(True).alias("valid")).distinct()
    out = notes.select("note", "manual").join(best, "note", "left").join(valid, "manual", "left")
    return out.select("note", F.coalesce(F.when(F.col("valid"), F.col("manual")), "found", F.lit(FALLBACK)).alias("category"))


def decorated(text: Column, mark: Column) -> Column:
    """The text behind a category's mark, once."""
    return F.when(mark.isNull() | (mark == "") | F.startswith(text, mark), text).otherwise(F.concat(mark, F.lit(" "), text))


def is_usable(value: Column) -> Column:
    """Whether a field holds a value: not blank, no placeholder that was never filled, no pasted heading."""
    return F.coalesce((F.trim(value) != "") & ~F.trim(value).rlike(PLACEHOLDER), F.lit(False))


def folder_tags(folder: Column, own: Column) -> Column:
    """Tags from a note's folders, outermost first, and its own behind them, each once."""
    parts = F.transform(F.split(F.coalesce(folder, F.lit("")), "/"), lambda p: markdown.slug(p, 40))
    mine = F.transform(F.coalesce(own, F.array().cast("array<string>")), lambda t: markdown.slug(F.ltrim(t, F.lit("#")), 40))
    return F.filter(F.array_distinct(F.concat(parts, mine)), lambda t: t != "")


def safe_name(name: Column) -> Column:
    """A file name without folders and characters that systems refuse; "dropped" if nothing is left."""
    base = F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.btrim(F.trim(F.regexp_replace(base, r'[<>:"|?*\x00-\x1f]', "")), F.lit("."))

    def parts(c: Column) -> Column:
        suffix = F.lower(F.regexp_extract(c, r"^.+(\.[^.]*)$", 1))
        return F.concat(F.substring(F.substring(c, F.lit(1), F.length(c) - F.length(suffix)), 1, 80), suffix)

    return dates.let(clean, lambda c: F.when(c == "", "dropped").otherwise(parts(c)))


def elapsed_minutes(given: Column, started: Column, now: Column) -> Column:
    """Minutes that a step took: what was typed, else what has passed since its start, each within bounds; null without either. Times in minutes."""
    passed = now - started
    return F.when(given.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(MOST_TYPED), given))).when(passed > 0, F.greatest(F.lit(1), F.least(F.lit(MOST_ELAPSED), F.bround(passed).cast("int"))))


def settled_deadline(found: Column, kind: Column, said: Column) -> Column:
    """(deadline, kind, confirmed) of the rules' date and the one a model said: another one than the rules' is kept but never confirmed."""
    other = said.isNotNull() & (found.isNull() | (said != found))
    date = F.coalesce(F.when(other, said), found)
    source = F.when(other, "llm").otherwise(F.when(date.isNotNull(), kind))
    return F.struct(date.alias("deadline"), source.alias("kind"), (~other & date.isNotNull() & F.coalesce(dates.confirmed(kind), F.lit(False))).alias("confirmed"))


def next_checkin(cadence: Column, today: Column, weekday: int = 6) -> Column:
    """The day of a habit's next question: tomorrow, the first of the next month, or the next such weekday after today."""
    return F.when(cadence == "daily", F.date_add(today, 1)).when(cadence == "monthly", F.add_months(F.trunc(today, "month"), 1)).otherwise(dates.coming_weekday(today, F.lit(weekday)))


def after_answer(status: Column, lapses: Column, leech: int = 8) -> Column:
    """A card's status after an answer: a draft becomes active, a leech is suspended."""
    return F.when((lapses >= leech) & (F.lit(leech) > 0), "suspended").when(status == "draft", "active").otherwise(status)


def resolved_folders(asked: DataFrame, folders: DataFrame) -> DataFrame:
    """(ask, folder, how) of names that were asked for (ask, name): an existing folder (folder) with the same name, else the only one
    that begins with it, has all its words, or has words in a row that begin with its words; else a new one.

    Names meet folders by the first letter of a word, not all with all.
    """
    a = asked.select("ask", F.trim("name").alias("name"), _words(F.col("name")).alias("want")).withColumn("letter", F.explode(F.array_distinct(F.transform(F.slice("want", 1, 1), lambda w: F.substring(w, 1, 1)))))
    f = folders.select("folder", _words(F.col("folder")).alias("have")).distinct()
    f = f.withColumn("letter", F.explode(F.array_distinct(F.transform("have", lambda w: F.substring(w, 1, 1)))))
    pairs = a.join(f, "letter")
    starts = F.filter(F.sequence(F.lit(0), F.size("have")), lambda i: i + F.size("want") <= F.size("have"))
    row = F.exists(starts, lambda i: F.forall(F.transform("want", lambda w, j: F.startswith(F.get("have", i + j), w)), lambda ok: ok))
    low, other = F.lower("name"), F.lower("folder")
    how = F.array_compact(F.array(F.when(other == low, 1), F.when(F.startswith(other, low), 2), F.when(F.forall("want", lambda w: F.array_contains("have", w)), 3), F.when(row, 4)))
    hits = pairs.select("ask", "folder", F.explode(how).alias("rank")).groupBy("ask", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("folder").alias("folder"))
    best = hits.filter("n = 1 or rank = 1").groupBy("ask").agg(F.min(F.struct("rank", "folder")).alias("x"))
    names = F.element_at(F.array(*map(F.lit, ("exact", "prefix", "words", "initials"))), F.col("x.rank"))
    return asked.join(best, "ask", "left").select("ask", F.coalesce("x.folder", F.trim("name")).alias("folder"), F.when(F.trim("name") == "", "empty").otherwise(F.when(F.col("x").isNull(), "new").otherwise(names)).alias("how"))
