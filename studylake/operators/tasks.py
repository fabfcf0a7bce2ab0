"""One capture as several tasks: cut at lines or clauses where every part is a task of its own, else left whole.

Every way to cut a capture is tried side by side, as rows: (capture, way, place, part). Each part is judged by
itself, and a way stands only if all of its parts do. The first way that stands is taken, in the order of WAYS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import captures as C
from ..functions import dates
from ..sources.kept import kept

# fixed values: words of a task at least, of a capture that is cut at clauses and of a line in a list at most, tasks of a capture at most
LEAST_WORDS, MOST_CLAUSE_WORDS, MOST_LINE_WORDS, MOST_TASKS = 2, 40, 30, 25
# fixed values: verbs that begin a task, and words of an obligation
VERBS = (
    "add ask book build buy call cancel check clean code compare compile complete confirm cook create debug deploy design do download draft email fill "
    "find finish fix follow get go grade hand install learn look mail make meet memorize message move order organize outline pack pay phone pick plan "
    "post practice practise prep prepare print publish read record refactor register rehearse remind renew reply research return review revise rewrite run "
    "schedule send set ship shop sign start study submit summarize summarise sync take talk teach test text train update upload verify visit watch work write"
).split()
OBLIGATION = r"(?i)\b(?:need to|needs to|have to|has to|must|should|due|deadline|by tomorrow|todo|to-do)\b"
# fixed values: marks of list items, where a sentence may be cut, what a cut leaves at the head of a part, and headers without a date
BULLET = r"^\s*(?:[-*+•‣]|\d{1,3}[.)]|\(\d{1,3}\)|\[[ xX]\])\s+(?=\S)"
SEPARATORS = r"(?i)\s*;\s*|,?\s+and\s+then\s+|,?\s+then\s+|,\s+and\s+also\s+|,\s+also\s+|,\s+and\s+|,\s+plus\s+|\s+&\s+"
CONNECTIVE = r"(?i)^(?:and|then|also|plus|next|after that)\s+"
HEADERS = ("todo", "to-do", "task", "this week", "today", "tomorrow", "agenda")

WAYS = ("lines", "clauses", "model", "whole")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def stripped(text: Column, marks: str = "") -> Column:
    return F.regexp_replace(text, rf"^[\s{marks}]+|[\s{marks}]+$", "")


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), "[a-z']+", 0)


def is_actionable(text: Column) -> Column:
    """Whether a text asks for something: a verb of VERBS among its first four words, or an obligation."""
    early = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)), 1, 4)
    return F.arrays_overlap(early, F.array(*map(F.lit, VERBS))) | ((F.size(early) > 0) & text.rlike(OBLIGATION))


def bare(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), "[^a-z0-9 ]+", " "))


def really_in(part: Column, text: Column) -> Column:
    """Whether a proposed task is made of words of the text."""
    return F.contains(bare(text), bare(part)) & (F.size(words(part)) >= LEAST_WORDS)


def phrase(text: Column, today: Column) -> Column:
    """The words of the text that name a date, '' without any."""
    return F.coalesce(dates.deadline(text, today)["phrase"], F.lit(""))


def peeled(captures: DataFrame) -> DataFrame:
    """captures (capture, text, today) with preamble, its date phrase, and what is left of the text: a first line that ends with a colon, or a few words before one that name a date or a list."""
    raw = stripped(F.coalesce(F.col("text"), F.lit("")))
    rows = captures.select("capture", "today", raw.alias("raw")).filter("raw <> ''")
    line = stripped(F.regexp_extract("raw", r"^([^\n]*)", 1))
    rest = stripped(F.regexp_extract("raw", r"(?s)^[^\n]*\n(.*)$", 1))
    above = (rest != "") & F.endswith(line, F.lit(":")) & (F.size(words(line)) <= 10)
    inline = r"(?s)^([^:\n]{3,60}):\s+(.+)$"
    head = stripped(F.regexp_extract("raw", inline, 1))
    rows = rows.withColumns({"above": above, "head": F.when(above, stripped(line, ":")).otherwise(head), "body": F.when(above, rest).otherwise(stripped(F.regexp_extract("raw", inline, 2)))})
    rows = rows.withColumn("inherits", F.when(F.col("head") != "", phrase(F.col("head"), F.col("today"))).otherwise(""))
    named = (F.size(words(F.col("head"))) <= 8) & ~F.col("head").rlike(BULLET) & ((F.col("inherits") != "") | F.regexp_replace(F.lower("head"), "s+$", "").isin(*HEADERS))
    taken = F.col("above") | ((F.col("head") != "") & named)
    return rows.select("capture", "today", "raw", F.when(taken, F.col("head")).otherwise("").alias("preamble"), F.when(taken, F.col("inherits")).otherwise("").alias("inherits"), F.when(taken, F.col("body")).otherwise(F.col("raw")).alias("rest"))


def by_lines(rows: DataFrame) -> DataFrame:
    """(capture, place, part) where lines are a list: two bullets or more, or short lines of which at most one asks for nothing. Indented lines belong to the item above."""
    each = rows.select("capture", F.posexplode(F.split("rest", "\n")).alias("at", "line")).filter(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    order = W.partitionBy("capture").orderBy("at")
    bullet = F.col("line").rlike(BULLET)
    starts = bullet | ~F.col("line").rlike(r"^\s{2,}\S") | (F.row_number().over(order) == 1)
    each = each.withColumns({"bullet": bullet, "item": F.sum(starts.cast("int")).over(order)})
    bare_line = stripped(F.when(F.col("bullet"), F.regexp_replace("line", BULLET, "")).otherwise(F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", bare_line.alias("line")))), lambda x: x["line"]), "\n")
    items = each.groupBy("capture", "item").agg(joined.alias("part"), F.max(F.col("bullet").cast("int")).alias("bullets"))
    of = W.partitionBy("capture")
    items = items.withColumns({"n": F.count(F.lit(1)).over(of), "marked": F.sum("bullets").over(of), "longest": F.max(F.size(words(F.col("part")))).over(of), "asking": F.count_if(is_actionable(F.col("part"))).over(of)})
    listed = (F.col("marked") >= 2) | ((F.col("longest") <= MOST_LINE_WORDS) & (F.col("asking") >= F.greatest(F.lit(2), F.col("n") - 1)))
    return items.filter((F.col("n") >= 2) & listed).select("capture", F.col("item").alias("place"), "part")


def _at_commas(part: Column) -> Column:
    """A clause in pieces between commas if each begins with a verb, else the clause."""
    pieces = F.filter(F.transform(F.split(part, r",\s+"), lambda p: stripped(p)), lambda p: p != "")
    return F.when((F.size(pieces) > 1) & F.forall(pieces, lambda p: first_word(p).isin(*VERBS)), pieces).otherwise(F.array(part))


def by_clauses(rows: DataFrame) -> DataFrame:
    """(capture, place, part) of one sentence whose clauses each have two words or more and ask for something or name a date."""
    flat = F.array_join(words(F.col("rest")), " ")
    short = rows.filter(~F.contains("rest", F.lit("\n"))).filter(F.size(words(F.col("rest"))).between(1, MOST_CLAUSE_WORDS)).select("capture", "today", F.split(flat, SEPARATORS).alias("chunks"))
    chunks = F.filter(F.transform("chunks", lambda c: stripped(c, ",.;")), lambda c: c != "")
    parts = F.filter(F.transform(F.flatten(F.transform(chunks, _at_commas)), lambda p: stripped(F.regexp_replace(p, CONNECTIVE, ""))), lambda p: p != "")
    each = short.select("capture", "today", F.posexplode(parts).alias("place", "part"))
    task = (F.size(words(F.col("part"))) >= LEAST_WORDS) & (is_actionable(F.col("part")) | (phrase(F.col("part"), F.col("today")) != ""))
    of = W.partitionBy("capture")
    each = each.withColumns({"n": F.count(F.lit(1)).over(of), "all": F.bool_and(task).over(of)})
    return each.filter((F.col("n") >= 2) & F.col("all")).select("capture", "place", "part")


def by_proposals(rows: DataFrame, proposals: DataFrame) -> DataFrame:
    """(capture, place, part) of proposed tasks (capture, place, part) that are really in the capture, if two are."""
    own = proposals.join(rows.select("capture", "rest"), "capture").filter(really_in(F.col("part"), F.col("rest")))
    return own.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("capture"))).filter("n >= 2").select("capture", "place", "part")


def split(captures: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(capture, ordinal, way, text, title, inherits) of the tasks in captures (capture, text, today), word for word; proposals are a model's.

    Parts that repeat an earlier one but for punctuation, and those of one word, are left out. inherits is the
    date phrase of a shared header, for tasks without one of their own. A capture without text has no tasks.
    """
    rows = kept(peeled(captures))  # filters on what is left of a text would otherwise take it apart again, date phrases and all
    ways = [by_lines(rows), by_clauses(rows), *([by_proposals(rows, proposals)] if proposals is not None else [])]
    tried = ways[0].withColumn("way", F.lit(0))
    for i, way in enumerate(ways[1:], 1):
        tried = tried.unionByName(way.withColumn("way", F.lit(i)))
    whole = WAYS.index("whole")
    best = tried.withColumn("best", F.min("way").over(W.partitionBy("capture"))).filter("way = best").drop("best")
    best = best.withColumn("n", F.row_number().over(W.partitionBy("capture").orderBy("place"))).filter(F.col("n") <= MOST_TASKS)
    text = stripped(F.regexp_replace(stripped(F.col("part"), "•*-"), CONNECTIVE, ""))
    best = best.withColumn("text", text).filter(F.size(words(F.col("text"))) >= LEAST_WORDS)
    best = best.withColumn("key", stripped(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]+", "")))
    best = best.withColumn("again", F.row_number().over(W.partitionBy("capture", "key").orderBy("n"))).filter("again = 1")
    tasks = rows.join(best.select("capture", "n", "way", "text"), "capture", "left")
    tasks = tasks.withColumns({"tasks": F.count("text").over(W.partitionBy("capture")), "ordinal": F.row_number().over(W.partitionBy("capture").orderBy("n"))})
    none = F.col("text").isNull()
    way = F.when(F.col("tasks") < 2, whole).otherwise(F.col("way"))
    out = tasks.select("capture", "ordinal", "today", F.element_at(F.array(*map(F.lit, WAYS)), way + 1).alias("way"), F.when(none, F.col("raw")).otherwise(F.col("text")).alias("text"), F.when(none, "").otherwise(F.col("inherits")).alias("header"))
    inherits = F.when(F.col("header") == "", "").when(phrase(F.col("text"), F.col("today")) != "", "").otherwise(F.col("header"))
    return out.select("capture", "ordinal", "way", "text", C.title(F.col("text")).alias("title"), inherits.alias("inherits"))
