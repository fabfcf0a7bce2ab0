"""Panels and selections over notes, cards and logs: filters, joins and aggregates of the library."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEECH_LAPSES = 8  # fixed value: lapses from which a card is a leech
UNDEFINED, TERM = "needs-definition", "term"  # fixed values: tags
BUCKETS = ("inbox", "project", "area", "resource", "archive")
# fixed values: words and days from which a kept note counts, cards that an examined link needs
MIN_WORDS, GRACE_DAYS = 40, 14
OUTLIER = 12.0
LINKED_NOTES = 40
BIN_MINUTES = 24 * 60


def is_leech(lapses: Column, threshold: int = LEECH_LAPSES) -> Column:
    return (lapses >= threshold) if threshold > 0 else F.lit(False)


def is_due(cards: DataFrame, today: str) -> Column:
    return (cards["status"] == "active") & ~is_new(cards) & (cards["due"] <= F.to_date(F.lit(today)))


def is_new(cards: DataFrame) -> Column:
    return (cards["reps"] == 0) | (cards["s"] <= 0)


def deck_states(cards: DataFrame, today: str) -> DataFrame:
    """By note: cards by status, active ones due and new, leeches, and those that have a place in the schedule."""
    active = F.col("status") == "active"
    return cards.groupBy("note").agg(
        F.count(F.lit(1)).alias("cards"),
        F.count_if(active).alias("active"),
        F.count_if(F.col("status") == "draft").alias("drafts"),
        F.count_if(F.col("status") == "suspended").alias("suspended"),
        F.count_if(is_due(cards, today)).alias("due"),
        F.count_if(active & is_new(cards)).alias("new"),
        F.count_if(is_leech(F.col("lapses"))).alias("leeches"),
        F.count_if(active & (F.col("s") > 0)).alias("scheduled"),
    )


def study_summary(cards: DataFrame, today: str) -> DataFrame:
    return deck_states(cards, today).agg(F.count(F.lit(1)).alias("decks"), *(F.sum(c).alias(c) for c in ("due", "new", "drafts")))


def schedule_rollup(cards: DataFrame) -> DataFrame:
    """By note, over active cards: repetitions, lapses, mean stability, next due day and last review."""
    active = cards.filter("status = 'active'")
    return active.groupBy("note").agg(F.sum("reps").alias("reps"), F.sum("lapses").alias("lapses"), F.round(F.sum("s") / F.count(F.lit(1)), 2).alias("interval_days"), F.min("due").alias("due"), F.max("last").alias("last_review"))


def counted_on(reviews: DataFrame, day: str) -> DataFrame:
    """Reviews of a day, and cards first seen on it (their first review of all)."""
    on = F.to_date(F.lit(day))
    first = reviews.groupBy("card").agg(F.min("day").alias("first"), F.count_if(F.col("day") == on).alias("n"))
    return first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reviews"), F.count_if(F.col("first") == on).alias("introduced"))


def pending_dates(notes: DataFrame, confirmed: Column) -> DataFrame:
    """Live projects whose deadline was read from the text and awaits a yes."""
    live = (F.col("bucket") == "project") & (F.col("status") != "done") & F.col("deadline").isNotNull()
    return notes.filter(live & ~confirmed).select("note", "title", "deadline", "kind")


def undefined_terms(notes: DataFrame) -> DataFrame:
    return notes.filter(F.array_contains("tags", UNDEFINED)).select("note", "title", "created")


def deckable(notes: DataFrame, decks: DataFrame) -> DataFrame:
    """Notes worth cards that have no deck (decks: note): projects that aren't done, and resources."""
    wanted = F.col("bucket").isin("project", "resource") & ~((F.col("bucket") == "project") & (F.col("status") == "done"))
    rows = notes.filter(wanted).join(decks.select("note").distinct(), "note", "left_anti")
    return rows.select("note", "title", "bucket", "folder", F.coalesce((F.col("bucket") == "project") & F.col("learning"), F.lit(False)).alias("learning"), "words")


def normalized_folder(folder: Column) -> Column:
    return F.trim(F.trim(F.translate(F.coalesce(folder, F.lit("")), "\\", "/"), F.lit("/")))


def in_folders(folder: Column, scopes: list[str]) -> Column:
    """Whether folder is one of scopes or within one; no scopes, or an empty one, hold every folder."""
    here = normalized_folder(folder)
    names = [s.replace("\\", "/").strip("/").strip() for s in scopes]
    if not names or "" in names:
        return F.lit(True)
    return functools.reduce(operator.or_, ((here == s) | F.startswith(here, F.lit(s + "/")) for s in names))


def graduation(progress: DataFrame, notes: DataFrame) -> DataFrame:
    """Ready decks (deck, ready, mastery, mature, active) whose note is a project of learning."""
    ready = progress.filter("ready").withColumnRenamed("deck", "note")
    return ready.join(notes.filter("bucket = 'project' and learning").select("note", "title"), "note").select("note", "title", "mastery", "mature", "active")


def worst_answers(reviews: DataFrame, cards: DataFrame, since: str) -> DataFrame:
    """Cards whose worst answer since a day was the lowest, with their note."""
    worst = reviews.filter(F.col("day") >= F.to_date(F.lit(since))).groupBy("card").agg(F.min("grade").alias("worst"), F.count(F.lit(1)).alias("answers"))
    return worst.filter("worst = 1").join(cards.select("card", "note", "status"), "card")


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key stay."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("x")).select(key, "x.*")
    return first.select(*rows.columns).unionByName(rows.filter(F.col(key).isNull()))


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """(note, action): keep what is unchanged and has all its vectors, embed what is new, changed or lacks one, drop what is gone.

    old: note, fingerprint, vectors, chunks; new: note, fingerprint.
    """
    both = old.withColumnRenamed("fingerprint", "before").join(new, "note", "full_outer")
    whole = (F.col("before") == F.col("fingerprint")) & (F.col("vectors") == F.col("chunks"))
    return both.select("note", F.when(F.col("fingerprint").isNull(), "drop").when(F.coalesce(whole, F.lit(False)), "keep").otherwise("embed").alias("action"))


def carried_over(before: DataFrame, after: DataFrame) -> DataFrame:
    """Steps after a change, done if a done step of the project had the same text, whatever its case (project, step, text, done)."""
    key = F.lower(F.trim("text"))
    done = before.filter("done").select("project", key.alias("__key"), F.lit(True).alias("__done")).distinct()
    return after.withColumn("__key", key).join(done, ["project", "__key"], "left").select("project", "step", "text", F.coalesce("__done", "done").alias("done"))


def expanded_links(notes: DataFrame, links: DataFrame, most: int = LINKED_NOTES) -> DataFrame:
    """Each note's own body and those of its linked notes one hop away, in the order of mention (links: src, place, dst), at most so many.

    The limit is the feature: what a generator is given to read. Ties in place go by note.
    """
    first = links.filter("src <> dst").groupBy("src", "dst").agg(F.min("place").alias("place"))
    ranked = first.join(notes.select(F.col("note").alias("dst")), "dst").withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("place", "dst"))).filter(F.col("rank") <= most)
    bodies = ranked.join(notes.select(F.col("note").alias("dst"), "body"), "dst")
    joined = bodies.groupBy(F.col("src").alias("note")).agg(F.array_sort(F.collect_list(F.struct("rank", "body"))).alias("more"))  # most entries at most
    whole = F.concat(F.col("body"), F.array_join(F.transform("more", lambda x: F.concat(F.lit("\n\n"), x["body"])), ""))
    return notes.join(joined, "note", "left").select("note", F.coalesce(whole, "body").alias("text"), F.coalesce(F.size("more"), F.lit(0)).alias("linked"))


def filled(template: DataFrame, values: DataFrame, empty: str = "") -> DataFrame:
    """Bodies in the template's order (template: kind, place, heading; values: note, kind, heading, text); headings without a value stay."""
    notes = values.select("note", "kind").distinct().join(F.broadcast(template), "kind")  # a template has a few headings
    rows = notes.join(values, ["note", "kind", "heading"], "left")
    part = F.concat(F.lit("## "), "heading", F.lit("\n\n"), F.coalesce("text", F.lit(empty)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]), "\n\n")
    return rows.groupBy("note").agg(body.alias("body"), F.count("text").alias("filled"))


def remote_completions(tasks: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that a ticked remote task (uid "note-<id>") names and that aren't done."""
    ticked = tasks.filter("status = 'completed'").select(F.regexp_extract("uid", r"^note-(\d+)$", 1).try_cast("long").alias("note")).filter("note is not null").distinct()
    return ticked.join(notes.filter("status <> 'done'"), "note").select("note", "title", F.when(F.col("learning"), "active").otherwise("done").alias("status"))


def first_clash(blocks: DataFrame, busy: DataFrame, bin_minutes: int = BIN_MINUTES) -> DataFrame:
    """For each block (owner, block, start, stop in minutes) the earliest end of a busy time (owner, start, stop) that overlaps it; null without one.

    Both are dealt by the bins of time that they touch, so a range join is an equi-join; a pair counts in
    the first bin that both touch.
    """
    def binned(rows: DataFrame, a: str, b: str) -> DataFrame:
        upto = F.greatest(F.floor((F.col(b) - 1) / bin_minutes), F.floor(F.col(a) / bin_minutes))
        return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / bin_minutes), upto)))

    other = binned(busy.select("owner", F.col("start").alias("b_start"), F.col("stop").alias("b_stop")), "b_start", "b_stop")
    hits = binned(blocks, "start", "stop").join(other, ["owner", "bin"]).filter("b_start < stop and start < b_stop")
    ends = hits.groupBy("owner", "block").agg(F.min("b_stop").alias("clear_at"))
    return blocks.join(ends, ["owner", "block"], "left").select("owner", "block", "start", "stop", "clear_at")


def estimate_summary(timed: DataFrame, k: int = 5) -> DataFrame:
    """A top-k report: the steps (project, step, level, minutes, actual) furthest from their estimate, outliers aside."""
    ratio = F.col("actual") / F.col("minutes")
    rows = timed.filter("minutes > 0").withColumn("ratio", ratio).filter((F.col("ratio") > 0) & (F.col("ratio") < OUTLIER))
    return rows.select("project", "step", "minutes", "actual", F.round("ratio", 2).alias("ratio"), F.round(F.abs(F.col("ratio") - 1), 6).alias("off")).orderBy(F.desc("off"), "project", "step", "minutes", "actual").limit(k)


def outliers(timed: DataFrame) -> DataFrame:
    return timed.filter("minutes > 0").agg(F.count_if(F.col("actual") / F.col("minutes") >= OUTLIER).alias("outliers"), F.count(F.lit(1)).alias("n"))


def collected(notes: DataFrame, decks: DataFrame, today: str) -> DataFrame:
    """Each note: eligible (an old, long resource that is no term), used (restated, or a card answered), its age. notes have restated; decks: note, cards, answered."""
    age = F.date_diff(F.to_date(F.lit(today)), F.col("created"))
    eligible = (F.col("bucket") == "resource") & (F.col("words") >= MIN_WORDS) & (age >= GRACE_DAYS) & ~F.array_contains("tags", TERM)
    rows = notes.join(decks, "note", "left")
    answered = F.coalesce("answered", F.lit(0))
    return rows.select("note", "title", age.alias("age_days"), F.coalesce(eligible, F.lit(False)).alias("eligible"), (F.col("restated") | (answered > 0)).alias("used"), (F.coalesce("cards", F.lit(0)) > 0).alias("has_cards"), answered.alias("answered"))


def collected_summary(rows: DataFrame) -> DataFrame:
    kept = F.col("eligible") & ~F.col("used")
    return rows.agg(
        F.count_if("eligible").alias("eligible"),
        F.count_if(F.col("eligible") & F.col("used")).alias("used"),
        F.count_if(kept).alias("collected"),
        F.round(F.count_if(F.col("eligible") & F.col("used")) / F.nullif(F.count_if("eligible"), F.lit(0)), 3).alias("ratio"),
        F.coalesce(F.max(F.when(kept, F.col("age_days"))), F.lit(0)).alias("oldest_days"),
        F.count_if(kept & F.col("has_cards") & (F.col("answered") == 0)).alias("carded_but_unreviewed"),
    )


def oldest_collected(rows: DataFrame, k: int = 5) -> DataFrame:
    """A top-k report."""
    return rows.filter("eligible and not used").select("note", "title", "age_days").orderBy(F.desc("age_days"), "note").limit(k)


def newest(notes: DataFrame, bucket: str, by: str, k: int = 25) -> DataFrame:
    """A top-k panel: a bucket's notes, the latest first, with the number of all."""
    rows = notes.filter(F.col("bucket") == bucket)
    top = rows.select("note", "title", F.col(by).alias("on")).orderBy(F.desc("on"), "note").limit(k)
    return top.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row


def reviews_due(notes: DataFrame, cards: DataFrame, today: str) -> DataFrame:
    """Resources whose next review is due (notes: next_review), with overdue days and active cards."""
    now = F.to_date(F.lit(today))
    active = cards.filter("status = 'active'").groupBy("note").agg(F.count(F.lit(1)).alias("cards"))
    rows = notes.filter((F.col("bucket") == "resource") & (F.col("next_review") <= now)).join(active, "note", "left")
    return rows.select("note", "title", F.col("next_review").alias("due"), F.date_diff(now, F.col("next_review")).alias("overdue_days"), F.coalesce("cards", F.lit(0)).alias("cards"))


def card_queue(requests: DataFrame) -> DataFrame:
    """One entry a note (requests: note, at, ord, most, source): the newest request, with the time of the first and how often it was asked."""
    latest = F.max(F.struct("at", "ord", "most", "source")).alias("x")
    return requests.groupBy("note").agg(F.min("at").alias("queued_at"), latest, F.count(F.lit(1)).alias("requests")).select("note", "queued_at", F.col("x.at").alias("requested_at"), F.col("x.most").alias("most"), F.col("x.source").alias("source"), "requests")


def once_each(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """rows with place: 1 for the first of each key by order, 2 for the next and so on."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def term_summary(terms: DataFrame, k: int = 12) -> DataFrame:
    """A top-k report: the k heaviest terms (term, weight, ord), once each whatever their case."""
    best = terms.groupBy(F.lower("term").alias("key")).agg(F.max(F.struct("weight", (-F.col("ord")).alias("first"), "term")).alias("x"))
    return best.select("x.term", "x.weight", (-F.col("x.first")).alias("ord")).orderBy(F.desc("weight"), "ord").limit(k)


def glossary_duplicates(entries: DataFrame) -> DataFrame:
    """Entries (ord, term, definition) after a term's first one."""
    place = F.row_number().over(W.partitionBy(F.lower(F.trim("term"))).orderBy("ord"))
    return entries.withColumn("place", place).filter("place > 1").drop("place")


def asset_sets(referenced: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(asset, state): used, unreferenced or missing."""
    a, b = referenced.select("asset", F.lit(1).alias("r")).distinct(), on_disk.select("asset", F.lit(1).alias("d")).distinct()
    return a.join(b, "asset", "full_outer").select("asset", F.when(F.col("r").isNull(), "unreferenced").when(F.col("d").isNull(), "missing").otherwise("used").alias("state"))


def sink_changes(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(uid, change) that make existing equal to wanted (both: uid, payload): create, update or delete; equal ones are left out."""
    rows = wanted.withColumnRenamed("payload", "w").join(existing.withColumnRenamed("payload", "e"), "uid", "full_outer")
    change = F.when(F.col("e").isNull(), "create").when(F.col("w").isNull(), "delete").when(F.col("w") != F.col("e"), "update")
    return rows.select("uid", change.alias("change")).filter("change is not null")


def bucket_counts(notes: DataFrame) -> DataFrame:
    """Notes of each bucket, zeros kept."""
    every = notes.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    found = notes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(every).join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("notes"))


def exam_deadlines(notes: DataFrame, today: str) -> DataFrame:
    """Projects that aren't done, with a deadline strictly ahead."""
    return notes.filter((F.col("bucket") == "project") & (F.col("status") != "done") & (F.col("deadline") > F.to_date(F.lit(today)))).select("note", "deadline")


def last_review_on(reviews: DataFrame, day: str) -> DataFrame:
    rows = reviews.filter(F.col("day") == F.to_date(F.lit(day)))
    return rows.groupBy("card").agg(F.max_by("grade", F.struct("at", "ord")).alias("grade"), F.max("at").alias("at"))


def reminder(at: Column, due: Column, answered: Column, starts: Column, snoozed_until: Column, fired_at: Column, snoozed_since: Column) -> Column:
    """Why a reminder at a time is held back, or "fire": times are in minutes since an epoch, starts in minutes of the day."""
    minute, day = F.pmod(at, F.lit(1440)), F.floor(at / 1440)
    return (
        F.when(due <= 0, "nothing due")
        .when(answered > 0, "already started")
        .when(minute < starts, "too early")
        .when(snoozed_until.isNotNull() & (at < snoozed_until), "snoozed")
        .when(fired_at.isNotNull() & (at - fired_at < 60), "within an hour")
        .when(fired_at.isNotNull() & (F.floor(fired_at / 1440) == day) & ~snoozed_since, "already today")
        .otherwise("fire")
    )


def spread_rank(place: Column, n: Column) -> Column:
    """The place of passage number place among n in bisection order, without a table: by the first round that reaches it, then by its place there."""
    rounds = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda j: F.pow(F.lit(2.0), j).cast("long"))
    # in the round of m parts, part k starts at k * n / m: passage p is reached by k = ceil(p * m / n) if it starts there
    reached = F.filter(rounds, lambda m: (m <= 4 * n) & (F.floor(F.ceil(place * m / n) * n / m) == place) & (F.ceil(place * m / n) < m))
    first = F.coalesce(F.get(reached, F.lit(0)), F.lit(1 << 41))
    return F.struct(first.alias("round"), F.ceil(place * first / n).alias("part"))


def visit_plan(passages: DataFrame) -> DataFrame:
    """Passages (note, passage, n, weight, covered) with the order to visit them: uncovered ones first, then the heavier, then spread over the note."""
    urgency = F.col("weight") + F.when(F.col("covered") > 0, 0.0).otherwise(10.0)
    order = W.partitionBy("note").orderBy(urgency.desc(), spread_rank(F.col("passage"), F.col("n")))
    return passages.withColumn("visit", F.row_number().over(order)).select("note", "passage", "visit")


def new_ids(rows: DataFrame, slug: Column, second: Column) -> DataFrame:
    """rows with id: the slug and a second; no two rows of a slug have the same.

    In the order of second and ord, a row takes its own second, or the one after its predecessor's if that
    isn't earlier. Rows of one slug and second take seconds in a row, so only the first of each is looked for,
    on a row for each distinct slug and second.
    """
    given = rows.withColumns({"__slug": slug, "__second": second})
    counts = given.groupBy("__slug", "__second").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__slug").orderBy("__second").rowsBetween(W.unboundedPreceding, -1)
    up_to = W.partitionBy("__slug").orderBy("__second").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.withColumn("__first", F.max(F.col("__second") - F.col("__ahead")).over(up_to) + F.col("__ahead"))
    same = F.col("a.__slug").eqNullSafe(F.col("b.__slug")) & (F.col("a.__second") == F.col("b.__second"))
    place = F.row_number().over(W.partitionBy("__slug", "__second").orderBy("ord")) - 1
    placed = given.withColumn("__place", place).alias("a").join(counts.select("__slug", "__second", "__first").alias("b"), same)
    return placed.select(*(F.col(f"a.`{c}`") for c in rows.columns), F.concat_ws("-", F.col("a.__slug"), (F.col("__first") + F.col("__place")).cast("string")).alias("id"))
