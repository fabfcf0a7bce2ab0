"""Cards drafted from notes: the passages they come from, cards by rule, and a model's cards held to the note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import markdown
from ..sources.kept import kept as once
from . import judgement, passages, repair, segments
from .tasks import stripped, words

# fixed values: characters of a drafting passage at most, of one that stands alone, and of any; headings whose text the system writes itself
MOST_CHARS, LEAST_ALONE, LEAST_CHARS = 1100, 120, 60
OWN_HEADINGS = ("steps", "materials", "hardware", "software", "skills", "check-in log", "cards")
# fixed values: bounds of a question and an answer, words of an explanation, of an answer that a blank suits better, and of a sentence
FRONT_CHARS, BACK_CHARS, EXPLAIN_WORDS, LONG_ANSWER, SENTENCE_WORDS, TERM_CHARS = (8, 320), 400, (4, 45), 8, 45, 3
ELSEWHERE = r"(?i)\b(?:the above|as mentioned|this passage|the text|the note|this (?:chapter|section|reading|lesson)|the reading)\b"
DEFINITION = r"(?s)^([A-Z][^.!?]{2,60}?)\s+(?:is|are|means|refers to|stands for)\s+(.{15,220}?[.!?])"
CLOZE = r"\{\{(.+?)\}\}"
FORMATS = {"choice": ("choice", "multiple choice", "multiple-choice", "mcq"), "short": ("short", "recall", "free recall", "term"), "explain": ("explain", "why", "explanation", "reasoning")}
#: Labels that say nothing about what a card asks.
EMPTY_TOPICS = "general concept fact misc other knowledge question recall note notes topic info information".split()

ITEM = "card, passage, subject, q, a, why, format, topic, wrong"


def material(notes: DataFrame, key: str = "note", text: str = "text") -> DataFrame:
    """(key, place, text): what cards are drafted from. Blocks are packed under their headings; short pieces join the one before; the system's own sections are left out."""
    blocks = F.filter(F.transform(F.split(stripped(markdown.body(F.col(text))), r"\n\s*\n"), lambda b: stripped(b)), lambda b: b != "")
    rows = notes.select(key, blocks.alias("b")).filter(F.size("b") > 0)
    heads = F.transform("b", lambda b: F.when(b.rlike(passages.HEADING), F.regexp_replace(F.lower(F.trim(F.regexp_extract(b, passages.HEADING, 1))), ":+$", "")))
    rows = rows.withColumn("h", heads)
    sizes = F.transform(F.arrays_zip("b", "h"), lambda z: F.when(z["h"].isNotNull(), MOST_CHARS + 1).otherwise(F.length(z["b"])))
    zipped = F.arrays_zip(F.col("b").alias("block"), F.col("h").alias("head"), segments.parts_by_size(sizes, MOST_CHARS).alias("part"))
    each = rows.select(key, F.posexplode(zipped).alias("at", "z")).select(key, "at", "z.*")
    under = F.last("head", ignorenulls=True).over(W.partitionBy(key).orderBy("at"))
    each = each.withColumn("under", F.coalesce(under, F.lit(""))).filter(F.col("head").isNull() & ~F.col("under").isin(*OWN_HEADINGS))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda x: x["block"]), "\n\n")
    parts = each.groupBy(key, "part").agg(joined.alias("text")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", F.length("text").alias("n"), "text"))).alias("p"))
    start = F.struct(F.lit(-1).alias("group"), F.lit(0).alias("room"), F.array().cast("array<int>").alias("groups"))

    def step(a: Column, x: Column) -> Column:
        joins = (x["n"] < LEAST_ALONE) & (a["group"] >= 0) & (a["room"] + x["n"] < MOST_CHARS)
        group = F.when(joins, a["group"]).otherwise(a["group"] + 1)
        return F.struct(group.alias("group"), F.when(joins, a["room"] + 2 + x["n"]).otherwise(x["n"]).alias("room"), F.array_append(a["groups"], group).alias("groups"))

    grouped = parts.select(key, F.explode(F.arrays_zip(F.col("p").alias("p"), F.aggregate("p", start, step)["groups"].alias("group"))).alias("z"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z.p.part", "z.p.text"))), lambda x: x["text"]), "\n\n")
    out = grouped.groupBy(key, F.col("z.group").alias("group")).agg(whole.alias("text")).filter(F.length("text") >= LEAST_CHARS)
    return out.select(key, (F.row_number().over(W.partitionBy(key).orderBy("group")) - 1).alias("place"), "text")


def plain(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "), "[^a-z0-9 ]+", ""))


def by_rule(rows: DataFrame, most: int = 20) -> DataFrame:
    """(note, n, front, back, source): a blank on the term of each sentence that defines one, a term once a note; rows: note, place, text."""
    said = F.transform(F.split(F.coalesce("text", F.lit("")), repair.SENTENCE_END), lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ *#>-]+|[ *#>-]+$", ""))
    each = rows.select("note", "place", F.posexplode(said).alias("at", "source")).filter(F.col("source").rlike(DEFINITION))
    each = each.withColumn("back", stripped(F.regexp_extract("source", DEFINITION, 1))).filter((F.length("back") >= TERM_CHARS) & (F.size(words(F.col("source"))) <= SENTENCE_WORDS))
    first = F.row_number().over(W.partitionBy("note", plain(F.col("back"))).orderBy("place", "at"))
    each = each.withColumn("again", first).filter("again = 1").withColumn("n", F.row_number().over(W.partitionBy("note").orderBy("place", "at"))).filter(F.col("n") <= most)
    front = F.concat(F.lit("{{"), "back", F.lit("}} "), stripped(F.substring("source", F.length("back") + 1, F.length("source"))))
    return each.select("note", "n", front.alias("front"), "back", "source")


def said(value: Column) -> Column:
    """A model's field in one line, without quotation marks around it."""
    return F.trim(F.btrim(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), F.lit('"')))


def format_of(value: Column) -> Column:
    name = F.btrim(F.lower(said(value)), F.lit("."))
    out = F.when(F.lit(False), "")
    for form, names in FORMATS.items():
        out = out.when(name.isin(*names), form)
    return out.otherwise("basic")


def topic_of(value: Column) -> Column:
    name = F.lower(F.btrim(said(value), F.lit(".")))
    return F.when((F.size(words(name)) > 4) | name.isin(EMPTY_TOPICS), "").otherwise(name)


def options_of(wrong: Column, answer: Column, most: int = judgement.OPTIONS[1] + 1) -> Column:
    """Wrong answers and the right one, each once."""
    every = F.filter(F.transform(F.concat(F.coalesce(wrong, F.array().cast("array<string>")), F.array(answer)), lambda x: said(x)), lambda x: x != "")
    keys = F.transform(every, lambda x: plain(x))
    return F.slice(F.filter(every, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1), 1, most)


def refused(front: Column, back: Column, subject: Column) -> Column:
    """The first plain rule that a drafted card breaks, '' if none."""
    return (
        F.when((front == "") | (back == ""), "empty")
        .when(~F.length(front).between(*FRONT_CHARS) | (F.length(back) > BACK_CHARS), "length")
        .when(plain(front) == plain(back), "restates-question")
        .when((F.coalesce(subject, F.lit("")) != "") & (plain(back) == plain(subject)), "title-as-answer")
        .when(front.rlike(ELSEWHERE), "not-self-contained")
        .otherwise("")
    )


def read(items: DataFrame) -> DataFrame:
    """Items (ITEM) of a model with front, back, quote, format, topic, options, and the first plain rule that they break."""
    rows = items.select("card", F.coalesce("passage", F.lit("")).alias("passage"), "subject", said(F.col("q")).alias("front"), said(F.col("a")).alias("back"), said(F.col("why")).alias("quote"), format_of(F.col("format")).alias("format"), topic_of(F.col("topic")).alias("topic"), "wrong")
    rows = rows.withColumns({"reason": refused(F.col("front"), F.col("back"), F.col("subject")), "options": options_of(F.col("wrong"), F.col("back"))})
    asked = F.when(F.col("front").rlike("[?？]$") | F.col("front").rlike(CLOZE), F.col("front")).otherwise(F.concat(F.regexp_replace("front", r"\.+$", ""), F.lit("?")))
    return rows.withColumn("front", F.when(F.col("reason") == "", asked).otherwise(F.col("front"))).drop("wrong", "subject")


def drafted(items: DataFrame, most_words: int = repair.MOST_WORDS) -> DataFrame:
    """(card, n, front, back, source, mode, topic, choices, tag) of a model's cards, one row or more for each item.

    tag is '' for a card as it was written, choice-... for one that lost its options, repaired for one made anew
    from the note's sentences; an item that gives no card has a row without front, and tag names the rule it breaks.
    items: ITEM, with a card number each.
    """
    rows = once(read(items))  # else each branch below reads all items again, and its filters repeat the rules
    fine = rows.filter("reason = ''").drop("reason")
    blank = F.col("front").rlike(CLOZE)
    asked = fine.select("card", F.when(blank, "").otherwise(F.col("front")).alias("question"), F.when(blank, F.regexp_replace("front", CLOZE, "$1")).otherwise(F.col("back")).alias("answer"), "quote", "passage", "format")
    cited = once(passages.grounded(asked, explain=F.col("format") == "explain"))  # every branch below asks for it
    held = fine.drop("quote").join(cited.select("card", "citation", "how"), "card", "left")
    n = F.size(words(F.col("back")))
    choice = F.concat(F.lit("choice-"), judgement.choice_verdict(F.col("back"), F.col("options")))
    held = held.withColumn("choice", F.when(F.col("format") == "choice", choice))
    held = held.withColumns({"lost": F.when(F.col("choice") != "choice-ok", F.col("choice")).otherwise(""), "facts": F.size(repair.facts(F.col("back")))})
    rule = repair.broken_rule(F.col("front"), F.col("back"), F.col("facts"), most_words)
    listed = F.col("front").rlike(repair.LIST_QUESTION)
    explain = F.col("format") == "explain"
    way = (
        F.when(F.coalesce(F.col("how"), F.lit("")) == "", "ungrounded")
        .when(F.col("choice") == "choice-ok", "choice")
        .when(explain & listed, "list-question")
        .when(explain & (n > EXPLAIN_WORDS[1]), "length")
        .when(explain, "plain")
        .otherwise("judged")
    )
    held = held.withColumns({"way": way, "rule": rule, "mode": F.when(explain & (n >= EXPLAIN_WORDS[0]), "explain").when(F.col("format") == "short", "recall").otherwise("")})
    judged = held.filter("way = 'judged'")
    asked_again = judged.select("card", "front", "back", F.col("citation").alias("quote"), "passage")
    blanks = repair.to_cloze(asked_again.join(judged.filter(n >= LONG_ANSWER).select("card"), "card", "left_semi")).select("card", F.lit(1).alias("n"), "front", "back", "source")
    left = judged.join(blanks.select("card"), "card", "left_anti")
    lists = left.filter(F.col("rule").isin("enumeration", "set", "list-question")).select("card")
    split = repair.split_to_cloze(asked_again.join(lists, "card", "left_semi"))
    none = F.array().cast("array<string>")
    as_written = held.filter(F.col("way").isin("choice", "plain")).unionByName(left.filter("rule = ''"))
    kept = as_written.select("card", F.lit(1).alias("n"), "front", "back", F.col("citation").alias("source"), "mode", "topic", F.when(F.col("way") == "choice", F.col("options")).otherwise(none).alias("choices"), F.col("lost").alias("tag"))
    topics = held.select("card", "topic")
    mended = blanks.unionByName(split).join(topics, "card").select("card", "n", "front", "back", "source", F.lit("").alias("mode"), "topic", none.alias("choices"), F.lit("repaired").alias("tag"))
    lost = left.filter("rule <> ''").join(split.select("card").distinct(), "card", "left_anti").select("card", F.col("rule").alias("tag"))
    dropped = rows.filter("reason <> ''").select("card", F.col("reason").alias("tag")).unionByName(held.filter(F.col("way").isin("ungrounded", "list-question", "length")).select("card", F.col("way").alias("tag"))).unionByName(lost)
    empty = dropped.select("card", F.lit(0).alias("n"), *(F.lit(None).cast("string").alias(c) for c in ("front", "back", "source", "mode", "topic")), none.alias("choices"), "tag")
    return kept.unionByName(mended).unionByName(empty)
