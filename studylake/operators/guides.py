"""What a note is about: the terms that its author marks, how they spread, and the heading over each passage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType

from ..functions.dates import let
from . import segments
from .passages import STOP, norm
from .tasks import words

# fixed values: weights of the kinds of evidence, words of a term and of a defined one at most, a passage's own weight and what terms add at most
BOLD, DEFINED, LISTED, ACRONYM = 2.0, 3.0, 2.5, 2.0
TERM_WORDS, DEFINED_WORDS, TERM_CHARS = 6, 4, 3
OWN_WEIGHT, MOST_EXTRA, SPREAD_STEP, MOST_SPREAD = 1.0, 9.0, 0.5, 1.5
PROBE = 40  # fixed value: characters by which a passage is found in its note
# fixed values: how terms are written (each pattern first asks for the letters that begin it, as most places have others), what isn't one, and the system's own labels
WRITTEN = (
    ("bold", BOLD, False, 1, r"(?=[*_])(?:\*\*|__)([^*_\n]{2,80}?)(?:\*\*|__)"),
    ("definition", DEFINED, True, 1, r"(?=[A-Z])(?:^|(?<=[.!?]\s))([A-Z][A-Za-z0-9'’\- ]{1,60}?)\s+(?:is|are|means|refers to|stands for|is defined as|may be defined as)\s+\S"),
    ("called", DEFINED, True, 1, r"(?=[aiw])\b(?:is|are|was|were)\s+(?:called|known as|termed|referred to as)\s+([A-Za-z][A-Za-z0-9'’\- ]{2,40}?)(?=[.,;:)]|$)"),
    ("glossary", LISTED, False, 1, r"(?m)^\s*(?:[-*+]\s+)?(?:\*\*)?([A-Za-z][A-Za-z0-9'’\- ]{1,50}?)(?:\*\*)?\s*(?::|—|–|\s-\s)\s+\S"),
    ("acronym", ACRONYM, False, 0, r"(?=[(A-Z])(?:\(\s*[A-Z]{2,7}\s*\)|\b[A-Z]{2,7}\s*\()"),
)
# what each match of WRITTEN holds, where spaces are single
HELD = {
    "bold": ("**", "__"),
    "definition": (" is ", "are ", "means ", "refers to ", "stands for ", "may be defined as "),
    "called": ("called", "known as", "termed", "referred to as"),
    "glossary": (":", "—", "–", "-"),
    "acronym": ("(",),
}
NOT_A_TERM = r"(?i)^(?:anything|something|everything|nothing|this|that|these|those|it|one|there|here|what|which|who|each|every|some|many|most|all)\b|\b(?:this|that|these|those)\b"
LABELS = (
    "due note notes source from tags status date time example examples step steps q a why type mode hint worked choices created updated link links see".split()
    + ["connected to", "additional notes", "summary", "key points", "key terms", "questions", "definition", "definitions", "related", "sources", "references"]
    + ["course", "chapter", "week", "due date", "instructor", "reading", "readings", "assignment", "notes from", "takeaway", "takeaways", "action items"]
)


def clean_term(term: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(term, r"\s+", " "), r"^[ *_:\-–—.,;\"'`]+|[ *_:\-–—.,;\"'`]+$", "")
    return F.regexp_replace(flat, r"(?i)^(?:the|an|a)\s+", "")


def together(passages: DataFrame) -> DataFrame:
    """(note, passages): the passages (note, place, text) of each note as one row, in order."""
    return passages.groupBy("note").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("passages"))


def flat(text: Column) -> Column:
    """A text with single spaces for its white space."""
    spaced = reduce(or_, (F.contains(text, F.lit(x)) for x in ("  ", "\n", "\t", "\r", "\f", "\v")))
    return F.when(spaced, F.regexp_replace(text, r"\s+", " ")).otherwise(text)


def marks(passage: Column) -> Column:
    """Every term that a passage (place, text, flat) marks, as (key, lighter, place, kind, at, term); kind counts WRITTEN, at the marks of a kind, lighter is the weight below zero.

    A pattern is tried where one of the pieces stands that each of its matches holds.
    """
    terms = []
    for i, (name, weight, in_line, group, pattern) in enumerate(WRITTEN):
        said = passage["flat" if in_line else "text"]
        held = reduce(or_, (F.contains(said, F.lit(x)) for x in HELD[name]))
        found = F.when(held, F.regexp_extract_all(said, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
        bare = F.transform(found, clean_term) if name != "acronym" else F.transform(found, lambda t: clean_term(F.regexp_extract(t, "[A-Z]{2,7}", 0)))
        terms.append(F.filter(F.transform(bare, _mark(passage["place"], i, weight)), _is_term(name)))
    return F.concat(*terms)


def _mark(place: Column, kind: int, weight: float):
    return lambda t, i: F.struct(F.lower(t).alias("key"), F.lit(-weight).alias("lighter"), place.alias("place"), F.lit(kind).alias("kind"), i.alias("at"), t.alias("term"))


def _is_term(name: str):
    few = lambda t: F.size(words(t)) <= (DEFINED_WORDS if name == "definition" else TERM_WORDS)
    real = lambda t: (F.length(t) >= TERM_CHARS) & few(t) & ~F.lower(t).isin(LABELS) & ~norm(t).isin(STOP)
    return lambda m: real(m["term"]) & ~m["term"].rlike(NOT_A_TERM) if name == "definition" else real(m["term"])


def _once(kind: DataType):
    """A Python helper; texts come a hundred at a time, not by the thousands as with Arrow, and the optimizer may not copy it into functions of arrays, where it can't be called."""
    return lambda f: F.udf(f, kind, useArrow=False).asNondeterministic()


@_once(ArrayType(ArrayType(IntegerType())))
def holding(said: list[str], keys: list[str]) -> list[list[int]]:
    """The numbers of the passages that hold each key, within words too."""
    return [[i for i, text in enumerate(said) if key in text] for key in keys]


def naming(key: Column, said: Column, held: Column) -> Column:
    """In how many passages (said, in small letters; those numbered held have it) a term (key, likewise) stands between word boundaries.

    In its pattern the term comes first, as letters alone, so that Java skips to it; then what is around it is asked for.
    """
    literal = F.regexp_replace(key, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    whole = F.concat(F.lit("(?U)"), literal, F.lit(r"(?<!\w"), literal, F.lit(r")(?!\w)"))
    return let(whole, lambda w: F.size(F.filter(held, lambda i: F.regexp_instr(F.get(said, i), w) > 0)))  # which, unlike rlike, keeps a pattern for the next text


def said_of(passages: str = "passages") -> Column:
    return F.transform(passages, lambda p: F.lower(F.coalesce(p["text"], F.lit(""))))


def spread(terms: DataFrame, passages: DataFrame) -> DataFrame:
    """(note, key, passages): in how many passages of its note a term (note, key: in small letters) stands between word boundaries; those in none are left out."""
    named = terms.groupBy("note").agg(F.collect_set("key").alias("keys"))
    rows = together(passages).select("note", said_of().alias("said")).join(named.hint("merge"), "note").withColumn("held", holding("said", "keys"))
    counts = F.transform("keys", lambda k, i: F.struct(k.alias("key"), naming(k, F.col("said"), F.get("held", i)).cast("bigint").alias("passages")))
    return rows.select("note", F.inline(counts)).filter("passages > 0")


def with_terms(rows: DataFrame) -> DataFrame:
    """rows (note, passages) with terms (term, place, weight, source): each term of a note once, as it is marked most strongly, then first; more weight for each further passage that names it.

    A note is read in its row: nothing is shuffled. Marks are sorted by term, and the first of each is taken.
    """
    text = lambda p: F.coalesce(p["text"], F.lit(""))
    rows = rows.withColumn("lines", F.transform("passages", lambda p: F.struct(p["place"].alias("place"), text(p).alias("text"), flat(text(p)).alias("flat"))))
    rows = rows.withColumn("marks", F.sort_array(F.flatten(F.transform("lines", marks)))).drop("lines")
    rows = rows.withColumn("first", F.filter("marks", lambda m, i: (i == 0) | (F.get("marks", i - 1)["key"] != m["key"]))).drop("marks").withColumn("said", said_of())
    rows = rows.withColumn("held", holding("said", F.col("first")["key"]))
    source = lambda kind: F.element_at(F.array(*(F.lit("definition" if k[0] == "called" else k[0]) for k in WRITTEN)), kind + 1)
    more = lambda m, held: F.when(F.size(held) > 1, F.greatest(F.lit(0), naming(m["key"], F.col("said"), held) - 1)).otherwise(0)
    extra = lambda m, i: F.least(F.lit(MOST_SPREAD), more(m, F.get("held", i)) * SPREAD_STEP)
    terms = F.transform("first", lambda m, i: F.struct(m["term"].alias("term"), m["place"].alias("place"), (extra(m, i) - m["lighter"]).alias("weight"), source(m["kind"]).alias("source")))
    return rows.withColumn("terms", terms).drop("first", "said", "held")


def key_terms(passages: DataFrame) -> DataFrame:
    """(note, term, place, weight, source): the terms of each note, as with_terms has them."""
    return terms_of(together(passages))


def terms_of(rows: DataFrame) -> DataFrame:
    """The terms of notes that have their passages in their row (note, passages)."""
    terms = F.transform("terms", lambda t: t)  # of a bare column Spark asks first whether it is empty, and so makes it twice
    return with_terms(rows.select("note", "passages")).select("note", F.inline(terms))


def led(events: str, body: Callable[[Column, Column], Column]) -> Column:
    """body of each event whose order is 0 and of those that follow it before the next such one; there is an event."""
    e = F.col(events)
    leads = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: F.get(e, i)["order"] == 0)
    return let(leads, lambda at: F.transform(at, lambda i, k: body(F.get(e, i), F.slice(e, i + 2, F.coalesce(F.get(at, k + 1), F.size(e)) - i - 1))))


@_once(ArrayType(IntegerType()))
def begins(text: str, probes: list[str | None]) -> list[int]:
    """Where each probe is found in a text, from 1: not before the one found last, else anywhere, else 0; one without characters is nowhere."""
    cursor, found = 0, []
    for probe in probes:
        at = text.find(probe, cursor) if probe else -1
        at = text.find(probe) if probe and at < 0 else at
        cursor = cursor if at < 0 else at
        found.append(at + 1)
    return found


def titles(text: Column) -> Column:
    """(pos, title): where the headings of a text stand, from 1, that have a title on their line."""
    none = F.struct(F.lit(1).alias("pos"), F.array().cast("array<struct<pos:int,title:string>>").alias("found"))
    more = lambda a, t: F.when(t != "", F.array_append(a["found"], F.struct(a["pos"].alias("pos"), t.alias("title")))).otherwise(a["found"])
    found = lambda a, line: F.when(F.startswith(line, F.lit("#")), let(F.trim(F.regexp_extract(line, segments.HEADING, 2)), lambda t: more(a, t))).otherwise(a["found"])
    step = lambda a, line: F.struct((a["pos"] + F.length(line) + 1).alias("pos"), found(a, line).alias("found"))
    return F.aggregate(F.split(text, "\n"), none, step)["found"]


def probe_of(text: Column) -> Column:
    """The first PROBE characters of a text without the white space around it; of what is behind them no more is read than that white space isn't all."""
    return F.rtrim(F.regexp_extract(text, rf"(?s)^\s*+(.{{{PROBE - 1}}}(?=\s*+\S).|.{{0,{PROBE - 2}}}\S)", 1))


def with_heading_names(rows: DataFrame) -> DataFrame:
    """rows (note, text, passages) with headings, the one over the beginning of each passage, '' above the first; a heading has its title on its line.

    A passage begins where its first characters are found, not before the beginning of the one before; one that
    isn't found has the heading of the one before. Headings and beginnings are put in one order, and each
    beginning takes the last heading ahead of it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("begins", begins(text, F.transform("passages", lambda p: probe_of(p["text"]))))
    event = lambda pos, order, at, title: F.struct(pos.alias("pos"), F.lit(order).alias("order"), at.alias("at"), title.alias("title"))
    heads = F.transform(titles(text), lambda m: event(m["pos"], 0, F.lit(-1), m["title"]))
    told = F.filter(F.transform("begins", lambda pos, i: event(pos, 1, i, F.lit(""))), lambda x: x["pos"] > 0)
    rows = rows.withColumn("by_pos", F.sort_array(F.concat(F.array(event(F.lit(0), 0, F.lit(-1), F.lit(""))), heads, told)))
    one = lambda at, order, title: F.struct(at.alias("at"), F.lit(order).alias("order"), title.alias("title"))
    known = F.flatten(led("by_pos", lambda head, tail: F.transform(tail, lambda x: one(x["at"], 0, head["title"]))))
    lost = F.filter(F.transform("begins", lambda pos, i: F.when(pos == 0, one(i, 1, F.lit("")))), lambda x: x.isNotNull())
    rows = rows.withColumn("by_at", F.sort_array(F.concat(F.array(one(F.lit(-1), 0, F.lit(""))), known, lost)))
    names = F.flatten(led("by_at", lambda head, tail: F.array_repeat(head["title"], F.size(tail) + 1)))
    return rows.withColumn("names", names).withColumn("headings", F.slice("names", 2, F.size("passages"))).drop("begins", "by_pos", "by_at", "names")


def with_headings(notes: DataFrame, passages: DataFrame) -> DataFrame:
    """(note, place, heading): the heading over the beginning of each passage (note, place, text) in its note (note, text), as with_heading_names has it."""
    rows = with_heading_names(notes.select("note", "text").join(together(passages), "note"))
    return rows.select("note", F.inline(F.zip_with("passages", "headings", lambda p, h: F.struct(p["place"].alias("place"), h.alias("heading")))))


def build(notes: DataFrame, passages: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """The guide: (note, place, heading, weight, terms) of each passage, terms by weight; proposed are a model's (note, term, place, importance).

    A proposed term counts where its passages name it; one that is marked as well gets the greater weight and a half more.
    """
    return guide(notes.select("note", "text").join(together(passages), "note"), proposed)


def guide(rows: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """The guide of notes that have their passages in their row (note, text, passages), each note once and with a passage at least."""
    if proposed is None:
        rows = with_terms(rows)
    else:
        terms = terms_of(rows)
        said = rows.select("note", F.inline("passages")).select("note", F.col("place").alias("where"), norm(F.col("text")).alias("said"))
        asked = proposed.withColumn("term", clean_term(F.col("term"))).filter((norm(F.col("term")) != "") & (F.size(words(F.col("term"))) <= TERM_WORDS))
        held = asked.join(said, "note").filter(F.contains("said", norm(F.col("term"))))
        own = held.groupBy("note", "term", "place", "importance").agg(F.min(F.struct(F.col("where") != F.col("place"), "where"))["where"].alias("where"))
        own = own.select("note", F.lower("term").alias("key"), F.col("term").alias("told"), "where", (OWN_WEIGHT + F.col("importance")).alias("heavy"))
        both = terms.withColumn("key", F.lower("term")).join(own, ["note", "key"], "full_outer")
        weight = F.when(F.col("heavy").isNull(), F.col("weight")).when(F.col("weight").isNull(), F.col("heavy")).otherwise(F.greatest("weight", "heavy") + 0.5)
        terms = both.select("note", F.coalesce("term", "told").alias("term"), F.coalesce("place", "where").alias("place"), weight.alias("weight"))
        rows = rows.join(terms.groupBy("note").agg(F.collect_list(F.struct("term", "place", "weight")).alias("terms")), "note", "left")
    rows = with_heading_names(rows)
    event = lambda place, order, heading, weight, term: F.struct(place.alias("place"), F.lit(order).alias("order"), heading.alias("heading"), (-weight).alias("lighter"), F.lower(term).alias("key"), term.alias("term"))
    own = F.zip_with("passages", "headings", lambda p, h: event(p["place"], 0, h, F.lit(0.0), F.lit("")))  # inside a function headings would be made for each passage
    listed = F.transform(F.coalesce(F.when(F.col("note").isNotNull(), F.col("terms")), F.array()), lambda t: event(t["place"], 1, F.lit(""), t["weight"], t["term"]))
    rows = rows.select("note", F.sort_array(F.concat(own, listed)).alias("events"))  # each passage, then its terms; no term is of a note without a key
    extra = lambda ts: F.aggregate(ts, F.lit(0.0), lambda a, t: a - t["lighter"])
    weigh = lambda ts: OWN_WEIGHT + F.least(F.lit(MOST_EXTRA), extra(ts))
    done = led("events", lambda p, ts: F.struct(p["place"].alias("place"), p["heading"].alias("heading"), weigh(ts).alias("weight"), F.transform(ts, lambda t: t["term"]).alias("terms")))
    return rows.select("note", F.inline(done))
