"""What a day asks for and what requests do: panels of the day and week, terms, held notes, decks to be made, habits and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.dates import let
from . import vault

# fixed values: grades after which a card is to be explained, words of a note that cards are made from, days between check-ins
EXPLAIN_GRADES, LEAST_WORDS, CHECKIN_DAYS = (1, 2), 40, 7
# fixed values: share of mature cards from which no example is worked, reviews from which half of one or none is shown, share of usual times that is steady
MATURE_SHARE, HALF_REPS, STEADY = 0.6, 3, 0.6


def wants_explanation(grade: Column) -> Column:
    return F.coalesce(grade.isin(*EXPLAIN_GRADES), F.lit(False))


def lane(note: Column, topic: Column) -> Column:
    """What cards are interleaved by: the note, and the topic within it if there is one."""
    return F.concat_ws("::", note.cast("string"), F.nullif(F.trim(F.coalesce(topic, F.lit(""))), F.lit("")))


def elapsed_days(last: Column, now: Column) -> Column:
    """Days since a card's last review, 0 for a new one and for one that lies ahead."""
    return F.coalesce(F.greatest(F.lit(0.0), now - last), F.lit(0.0))


def shuffled_options(card: Column, options: Column, answer: Column) -> Column:
    """A choice card's options with the answer among them, once each, in an order that only card and option decide (by their hash)."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    every = F.filter(F.transform(F.concat(F.coalesce(options, F.array().cast("array<string>")), F.array(F.coalesce(answer, F.lit("")))), lambda x: F.trim(x)), lambda x: x != "")
    once = let(every, lambda xs: let(F.transform(xs, flat), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))
    hashed = F.transform(once, lambda x: F.struct(F.xxhash64(card, x).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(hashed), lambda s: s["x"])


def worked_example(lines: Column, reps: Column, mature_share: Column) -> Column:
    """How much of a worked example is shown: all of it for a new card, its first half up to the third review, nothing later or where most cards of the deck are mature."""
    half = F.slice(lines, F.lit(1), F.ceil(F.size(lines) / 2).cast("int"))
    none = F.array().cast("array<string>")
    return F.when((mature_share >= MATURE_SHARE) | (reps >= HALF_REPS), none).when(reps == 0, lines).otherwise(half)


def decks_to_make(notes: DataFrame, decks: DataFrame, scopes: list[str], least: int = LEAST_WORDS, again: bool = False) -> DataFrame:
    """(note, title, folder, words, cards, why): projects and resources of some folders with why no cards are made from them, '' for those that cards are made from.

    notes: note, title, bucket, folder, status, words; decks: note, cards. Making goes by folder, then title.
    """
    rows = notes.filter(F.col("bucket").isin("project", "resource") & vault.in_folders(F.col("folder"), scopes)).join(decks.select("note", "cards"), "note", "left")
    cards = F.coalesce("cards", F.lit(0))
    why = (
        F.when((F.col("bucket") == "project") & (F.col("status") == "done"), "project already done")
        .when(F.coalesce("words", F.lit(0)) < least, F.concat(F.lit("only "), F.coalesce("words", F.lit(0)), F.lit(" words")))
        .when((cards > 0) & F.lit(not again), F.concat(F.lit("already has "), cards, F.lit(" cards")))
        .otherwise("")
    )
    return rows.select("note", "title", "folder", "words", cards.alias("cards"), why.alias("why"))


def filed_terms(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(ord, term, definition, action, note, tags): what each glossary entry (ord, term, definition) does.

    known: note, title, defined. An entry creates a note unless its term has one; it defines a term that has none
    of its own, and is skipped otherwise, as is a later entry of a term that an earlier one creates or defines.
    A note without a definition is tagged so.
    """
    name = F.lower(F.trim("term"))
    best = known.groupBy(F.lower(F.trim("title")).alias("name")).agg(F.max_by(F.struct("note", "defined"), F.struct("defined", -F.col("note"))).alias("k"))
    rows = entries.withColumns({"name": name, "told": F.trim(F.coalesce("definition", F.lit(""))) != ""}).filter("name <> ''").join(best, "name", "left")
    # the first entry of a term counts, or the first with a definition where only that adds something
    order = W.partitionBy("name").orderBy("ord")
    first, first_told = F.row_number().over(order) == 1, F.col("told") & (F.sum(F.col("told").cast("int")).over(order) == 1)
    rows = rows.withColumns({"first": first, "first_told": first_told})
    new = F.col("k").isNull()
    defined = F.coalesce(F.col("k.defined"), F.lit(False))
    action = F.when(new & F.col("first"), "create").when(~defined & F.col("first_told"), "define").otherwise("skip")
    tags = F.when(action == "create", F.when(F.col("told"), F.array(F.lit("term"))).otherwise(F.array(F.lit("term"), F.lit("needs-definition"))))
    return rows.select("ord", F.trim("term").alias("term"), "definition", action.alias("action"), F.col("k.note").alias("note"), tags.alias("tags"))


def filed_notes(held: DataFrame, choices: DataFrame) -> DataFrame:
    """(note, bucket, confidence, changed, agreed): held notes (note, guess, confidence, ord) where they were filed by hand (choices: note, bucket, ord).

    The last choice files a note; the label that is learnt from keeps the first guess and its confidence.
    """
    first = held.groupBy("note").agg(F.min_by(F.struct("guess", "confidence"), "ord").alias("g"))
    last = choices.groupBy("note").agg(F.max_by("bucket", "ord").alias("bucket"), (F.countDistinct("bucket") > 1).alias("changed"))
    return first.join(last, "note").select("note", "bucket", F.col("g.confidence").alias("confidence"), "changed", (F.col("bucket") == F.col("g.guess")).alias("agreed"))


def committed(items: DataFrame, buckets: list[str]) -> DataFrame:
    """(item, bucket, error): what each row of a batch (item, text, bucket, due) comes to; a bad row has an error and costs the others nothing."""
    due = F.trim(F.coalesce("due", F.lit("")))
    error = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text")
        .when(~F.coalesce(F.lower(F.trim("bucket")), F.lit("")).isin(*buckets), F.concat(F.lit("no such bucket: "), F.coalesce("bucket", F.lit(""))))
        .when((due != "") & F.try_to_date(due, "yyyy-MM-dd").isNull(), F.concat(F.lit("not a date: "), due))
    )
    return items.select("item", F.when(error.isNull(), F.lower(F.trim("bucket"))).alias("bucket"), error.alias("error"))


def checkins(habits: DataFrame, today: str) -> DataFrame:
    """(note, last) of habits (note, last) that were last checked a week ago or never."""
    return habits.filter(F.col("last").isNull() | (F.date_diff(F.to_date(F.lit(today)), F.col("last")) >= CHECKIN_DAYS)).select("note", "last")


def panel(name: str, rows: DataFrame, key: str, on: str | None = None, most: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows as (panel, note, on, size): the first most of them, and how many there are in all."""
    on_ = F.col(on).cast("date") if on else F.lit(None).cast("date")
    out = rows.select(F.lit(name).alias("panel"), F.col(key).cast("long").alias("note"), on_.alias("on"), *(x.alias(f"__{i}") for i, x in enumerate(order or [])))
    size = rows.agg(F.count(F.lit(1)).alias("size")).select(F.lit(name).alias("panel"), "size")
    if most is not None:
        out = out.orderBy(*(f"__{i}" for i in range(len(order or []))), "note", "on").limit(most)
    return out.select("panel", "note", "on").join(F.broadcast(size), "panel")


def habit_advice(habits: DataFrame) -> DataFrame:
    """(note, place, field): what a check-in asks about each habit, the strongest first.

    habits: note, cue, behaviour, anchor, easier, misses, enough, time_share, and whether there is a habit at all.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    asks = [
        ("intention", blank("cue") | blank("behaviour")),
        ("anchor", blank("anchor")),
        ("easier", blank("easier")),
        ("target_count", F.coalesce("misses", F.lit(0)) >= 2),
        ("schedule", F.coalesce("enough", F.lit(False)) & (F.coalesce("time_share", F.lit(1.0)) < STEADY)),
    ]
    fields = F.filter(F.array(*(F.when(ask, name) for name, ask in asks)), lambda f: f.isNotNull())
    return habits.select("note", F.posexplode(fields).alias("place", "field"))


def session_summary(sessions: DataFrame, captured: DataFrame) -> DataFrame:
    """(session, minutes, terms, undefined, notes): what came of each session (session, started, ended), as lists of links.

    captured: session, ord, title, term, defined. Terms are listed apart from other notes, and those without a
    definition once more, as what is left to look up.
    """
    line = F.concat(F.lit("- [["), "title", F.lit("]]"))
    open_ = F.col("term") & ~F.col("defined")

    def listed(which: Column, text: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("ord", text.alias("t"))))), lambda x: x["t"]), "\n")

    told = captured.groupBy("session").agg(
        listed(F.col("term"), F.concat(line, F.when(open_, "  — no definition yet").otherwise(""))).alias("terms"),
        listed(open_, F.concat(F.lit("- [ ] [["), "title", F.lit("]]"))).alias("undefined"),
        listed(~F.col("term"), line).alias("notes"),
    )
    minutes = F.greatest(F.lit(0), F.floor((F.unix_timestamp("ended") - F.unix_timestamp("started")) / 60)).cast("int")
    rows = sessions.select("session", minutes.alias("minutes")).join(told, "session", "left")
    notes = F.coalesce(F.nullif("notes", F.lit("")), F.lit("*Nothing was captured in this session.*"))
    return rows.select("session", F.coalesce("minutes", F.lit(0)).alias("minutes"), F.coalesce("terms", F.lit("")).alias("terms"), F.coalesce("undefined", F.lit("")).alias("undefined"), notes.alias("notes"))


def edited_cards(cards: DataFrame, edits: DataFrame) -> DataFrame:
    """cards (card, front, back, hint, source, status) after the edits of each, in the order of ord: (card, error) besides.

    edits: card, ord, front, back, hint, source, status, deleted. A field that is null stays; the last edit of a
    field counts; a deleted card goes; an unknown status is an error, and changes nothing.
    """
    fields = ("front", "back", "hint", "source")
    known = F.col("status").isNull() | (F.trim("status") == "") | F.col("status").isin("draft", "active", "suspended")
    wrong = F.max(F.when(~known, F.concat(F.lit("unknown card status "), "status")))
    last = [F.max_by(F.when(known, F.trim(c)), F.when(known & F.col(c).isNotNull(), F.col("ord"))).alias(f"new_{c}") for c in fields]
    status = F.max_by("status", F.when(known & (F.trim(F.coalesce("status", F.lit(""))) != ""), F.col("ord"))).alias("new_status")
    found = edits.groupBy("card").agg(*last, status, F.bool_or(F.coalesce("deleted", F.lit(False))).alias("gone"), wrong.alias("error"))
    rows = cards.join(found, "card", "left").filter(~F.coalesce("gone", F.lit(False)))
    return rows.select("card", *(F.coalesce(f"new_{c}", c).alias(c) for c in fields), F.coalesce("new_status", "status").alias("status"), "error")


def approved(cards: DataFrame, asked: DataFrame) -> DataFrame:
    """cards (card, note, status, and more) with drafts made active: asked has the notes, with a list of cards or null for all drafts."""
    rows = cards.join(asked.select("note", F.col("cards").alias("__cards"), F.lit(True).alias("__asked")), "note", "left")
    wanted = F.col("__asked") & (F.col("__cards").isNull() | (F.size("__cards") == 0) | F.array_contains("__cards", F.col("card")))
    status = F.when((F.col("status") == "draft") & F.coalesce(wanted, F.lit(False)), "active").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(cards.columns)


def graduating(notes: DataFrame, candidates: DataFrame) -> DataFrame:
    """notes (note, status) whose decks have stuck (candidates: note, mastery), waiting to be confirmed: the new status, and the line for the log, null for notes that waited before."""
    rows = notes.join(candidates.select("note", "mastery"), "note")
    line = F.concat(F.lit("mastered mastery="), F.bround(F.col("mastery") * 100).cast("int").cast("string"), F.lit("%"))
    return rows.select("note", F.lit("graduating").alias("status"), F.when(F.col("status") != "graduating", line).alias("log"))
