"""Verdicts on cards, answers, glossary lines and links; habits by cadence; the weekly panels."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates
from .passages import content_words

# fixed values: bounds of a choice card's options and of the answer's length among them, and options that give it away
OPTIONS, LENGTHS, SHORT_CHARS = (3, 5), (0.4, 1.6), 12
GIVEAWAY = r"(?i)\b(?:all|none|both|any) of (?:the )?(?:above|these|them)\b|\bboth [a-d] and [a-d]\b|\bnot (?:listed|given)\b"
# fixed values: shares of a reference's words from which an answer is good or partly so
SOUND, PARTIAL, RECALLED, HALF_RECALLED = 0.5, 0.2, 0.7, 0.4
# fixed values: the score from which a link is made without asking, the least of a suggestion
AUTO_LINK, LEAST_LINK = 0.62, 0.35
# fixed values: bounds of a glossary line
TERM_CHARS, TERM_WORDS, DEFINITION_WORDS, GLOSSARY_SHARE = 60, 8, 60, 0.75
WRAPPED_WORDS = 4  # fixed value: words of an unindented line that goes on with the one above
ALERT_AT, LOOKBACK = 2, 12


def bare_choice(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def choice_verdict(answer: Column, options: Column) -> Column:
    """"ok", or the first rule that a choice card breaks: no-answer, too-few, too-many, duplicate, not-one-answer, giveaway or length-tell."""
    clean = F.filter(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.trim(o)), lambda o: o != "")

    def judged(opts: Column) -> Column:
        keys, right = F.transform(opts, lambda o: bare_choice(o)), bare_choice(answer)
        hits = F.filter(opts, lambda o: bare_choice(o) == right)
        others = F.array_sort(F.transform(F.filter(opts, lambda o: bare_choice(o) != right), lambda o: F.length(o)))
        median = F.coalesce(F.get(others, F.floor(F.size(others) / 2).cast("int")), F.lit(0))
        own = F.length(F.get(hits, F.lit(0)))
        tell = (median > 0) & (F.greatest(own, median) >= SHORT_CHARS) & ~(own / F.nullif(median, F.lit(0))).between(*LENGTHS)
        return (
            F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", "no-answer")
            .when(F.size(opts) < OPTIONS[0], "too-few")
            .when(F.size(opts) > OPTIONS[1], "too-many")
            .when(F.size(F.array_distinct(keys)) != F.size(keys), "duplicate")
            .when(F.size(hits) != 1, "not-one-answer")
            .when(F.exists(opts, lambda o: o.rlike(GIVEAWAY)), "giveaway")
            .when(tell, "length-tell")
            .otherwise("ok")
        )

    return dates.let(clean, judged)


def overlap(reference: Column, given: Column) -> Column:
    """The share of the reference's content words that an answer has."""
    want = content_words(reference)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, content_words(given))) / F.size(want)).otherwise(0.0)


def explanation_verdict(share: Column) -> Column:
    return F.when(share >= SOUND, "sound").when(share >= PARTIAL, "partial").otherwise("off")


def recall_grade(share: Column) -> Column:
    return F.when(share >= RECALLED, 3).when(share >= HALF_RECALLED, 2).otherwise(1)


def glossary_entry(line: Column) -> Column:
    """(term, definition, explicit) of a line "term: definition" and the like; null for other lines, times, addresses and questions."""
    pattern = r"^\s*(?:[-*+]\s+)?(?:\*\*)?([^:\t=–—]{1,60}?)(?:\*\*)?\s*(::|\t+|:(?!//)|=|—|–|\s-\s)\s*(\S.*)$"
    found = F.when(line.rlike(pattern), F.array(*(F.trim(F.regexp_extract(line, pattern, i)) for i in (1, 3)), F.regexp_extract(line, pattern, 2)))

    def entry(p: Column) -> Column:
        term, definition, separator = p[0], p[1], p[2]
        words = F.size(F.split(term, r"\s+"))
        named = (F.length(term).between(1, TERM_CHARS)) & (words <= TERM_WORDS) & term.rlike(r"""^[\w(“"']""") & ~term.rlike(r"\?$|^[\d\s.,/]+$|(?i)https?|www\.")
        told = (F.length(definition) >= 2) & (F.size(F.split(definition, r"\s+")) <= DEFINITION_WORDS)
        clock = (separator == ":") & definition.rlike(r"(?i)^\d{1,2}(:\d{2})?\s*(am|pm)?$")
        return F.when(named & told & ~clock, F.struct(term.alias("term"), definition.alias("definition"), ((separator == "::") | F.startswith(separator, F.lit("\t"))).alias("explicit")))

    return dates.let(found, lambda p: F.when(p.isNotNull(), entry(p)))


def glossary(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, kind, term, definition, explicit) of the lines of notes that aren't blank: entry, again (of a term that an earlier line explains), wrapped, heading or other.

    A line that is indented, or begins with a small letter and has a few words, goes on with the entry above it,
    as long as nothing but such lines stands between; its words are added to that definition.
    """
    rows = notes.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("at", "line"))
    line = F.col("line")
    rows = rows.withColumn("found", glossary_entry(line))
    heading, blank = line.rlike(r"^\s*#{1,6}\s+\S"), F.regexp_replace(line, r"\s+", "") == ""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    goes_on = line.rlike(r"^[ \t]") | (bare.rlike(r"^\p{Ll}") & (F.size(F.split(bare, r"\s+")) >= WRAPPED_WORDS))
    shape = F.when(blank, "blank").when(heading, "heading").when(F.col("found").isNotNull(), "entry").when(goes_on, "on").otherwise("other")
    rows = rows.withColumn("shape", shape)
    nth = F.row_number().over(W.partitionBy(key, "shape", F.lower("found.term")).orderBy("at"))
    rows = rows.withColumn("shape", F.when((F.col("shape") == "entry") & (nth > 1), "again").otherwise(F.col("shape")))
    anchor = F.last(F.when(F.col("shape") != "on", F.struct("shape", "at")), ignorenulls=True).over(W.partitionBy(key).orderBy("at"))
    rows = rows.withColumn("anchor", anchor).filter("shape <> 'blank'")
    wrapped = (F.col("shape") == "on") & F.coalesce(F.col("anchor.shape") == "entry", F.lit(False))
    kind = F.when(wrapped, "wrapped").when(F.col("shape") == "on", "other").otherwise(F.col("shape"))
    of = F.when(F.col("shape").isin("entry") | wrapped, F.col("anchor.at")).otherwise(F.col("at"))
    rows = rows.withColumns({"kind": kind, "of": of})
    more = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "wrapped", F.struct("at", bare.alias("t"))))), lambda x: x["t"]), " ")
    told = rows.groupBy(key, "of").agg(more.alias("more"))
    rows = rows.join(told, [key, "of"])
    definition = F.when(F.col("kind") == "entry", F.trim(F.concat_ws(" ", "found.definition", "more"))).when(F.col("kind") == "again", F.col("found.definition"))
    return rows.select(key, "at", "kind", F.when(F.col("kind").isin("entry", "again"), F.col("found.term")).alias("term"), definition.alias("definition"), F.when(F.col("kind").isin("entry", "again"), F.col("found.explicit")).alias("explicit"))


def glossary_shares(lines: DataFrame, key: str) -> DataFrame:
    """Of each note's lines (as `glossary` gives them) how many are entries, and whether that makes it a glossary; wrapped lines and headings don't count."""
    counts = lines.filter("kind not in ('wrapped', 'heading')").groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind").isin("entry", "again")).alias("entries"))
    return counts.select(key, "lines", "entries", F.round(F.col("entries") / F.col("lines"), 3).alias("share"), (F.col("entries") / F.col("lines") >= GLOSSARY_SHARE).alias("glossary"))


def glossaries(notes: DataFrame, key: str, text: str) -> DataFrame:
    """Notes whose lines are mostly glossary entries: their entries, lines and share (headings and empty lines aside)."""
    lines = notes.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).filter("trim(line) <> ''").filter(~F.col("line").rlike(r"^\s*#{1,6}\s"))
    counts = lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.count(glossary_entry(F.col("line"))).alias("entries"))
    share = F.round(F.col("entries") / F.col("lines"), 3)
    return counts.select(key, "lines", "entries", share.alias("share"), (F.col("entries") / F.col("lines") >= GLOSSARY_SHARE).alias("glossary"))


def suggested_links(scored: DataFrame, made: DataFrame, k: int = 5) -> DataFrame:
    """(note, target, tier): the k best of scored (note, target, score) that aren't made yet; sure ones are linked, others asked about."""
    rows = scored.filter((F.col("score") >= LEAST_LINK) & (F.col("note") != F.col("target"))).join(made.select("note", "target").distinct(), ["note", "target"], "left_anti")
    place = F.row_number().over(W.partitionBy("note").orderBy(F.desc("score"), "target"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("note", "target", F.when(F.col("score") >= AUTO_LINK, "sure").otherwise("ask").alias("tier"))


def link_tiers(links: DataFrame) -> DataFrame:
    return links.groupBy("tier").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("note").alias("notes"))


def habit_misses(log: DataFrame, habits: DataFrame, today: str) -> DataFrame:
    """For habits (note, cadence, target) the whole periods since the first entry (log: note, on), at most 12: hits and misses in a row up to now."""
    now = F.to_date(F.lit(today))
    entries = log.join(habits, "note").select("note", "cadence", "target", dates.period_start(F.col("on"), F.col("cadence")).alias("period"))
    counts = entries.groupBy("note", "cadence", "target", "period").agg(F.count(F.lit(1)).alias("n"))
    first = counts.groupBy("note", "cadence", "target").agg(F.min("period").alias("first"))
    every = dates.periods_between(F.col("first"), now, F.col("cadence"))
    past = F.filter(every, lambda p: p < dates.period_start(now, F.col("cadence")))
    back = F.slice(F.reverse(past), 1, LOOKBACK)
    rows = first.select("note", "cadence", "target", F.posexplode_outer(back).alias("back", "period")).join(counts.select("note", "period", "n"), ["note", "period"], "left")
    hit = F.coalesce("n", F.lit(0)) >= F.col("target")
    out = rows.groupBy("note", "cadence").agg(F.count("period").alias("periods"), F.count_if(F.col("period").isNotNull() & hit).alias("hits"), F.min(F.when(hit & F.col("period").isNotNull(), F.col("back"))).alias("last"))
    run = F.coalesce(F.col("last").cast("long"), F.col("periods"))
    return out.select("note", "cadence", "periods", "hits", run.alias("misses_in_row"), (run >= ALERT_AT).alias("alert"))


def intention(cue: Column, behaviour: Column, place: Column, anchor: Column) -> Column:
    """The sentence of a reminder: the whole plan, else what follows an anchor, else the cue or anchor alone, else ''."""
    text = lambda x: F.nullif(F.rtrim(F.trim(x), F.lit(".,")), F.lit(""))
    c, b, a, p = text(cue), text(behaviour), text(anchor), F.nullif(F.trim(place), F.lit(""))
    tail = F.coalesce(F.concat(F.lit(" at "), p), F.lit(""))
    return F.coalesce(
        F.when(c.isNotNull() & b.isNotNull(), F.concat(F.lit("When "), c, F.lit(", I will "), b, tail, F.lit("."))),
        F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("Right after "), a, F.lit(", I will "), b, tail, F.lit("."))),
        F.when(c.isNotNull() & b.isNull(), F.concat(F.lit("When "), c, F.lit(" — this is the cue."))),
        F.when(a.isNotNull() & b.isNull(), F.concat(F.lit("Right after "), a, F.lit(" — this is the cue."))),
        F.lit(""),
    )


def panels(counted: dict[str, DataFrame]) -> DataFrame:
    """One row for each named panel: how many rows it has, and whether it is empty."""
    return functools.reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("panel"), "rows", (F.col("rows") == 0).alias("empty")) for name, df in counted.items()))
