"""How much one card asks for, and cards that ask too much rewritten as blanks in sentences of the note.

A card is never given words of its own: what a rewritten one shows stands in its quotation or passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tasks import stripped, words

# fixed values: words of an answer at most, of one that can be mended, of an item, and of a sentence that isn't cut; items of an answer and cards from it at most
MOST_WORDS, HARD_WORDS, ITEM_WORDS, LONG_WORDS, MOST_ITEMS, MOST_CARDS = 15, 30, 8, 28, 12, 4
# fixed values: characters of an item at least, and of a sentence beside it
ITEM_CHARS, CONTEXT_CHARS = 2, 24
# fixed values: pairs that are one term, what binds two things into one, list questions, definitions, and how lists are written
IDIOMS = (
    "trial and error", "cause and effect", "supply and demand", "risk and return", "rise and fall", "black and white",
    "salt and pepper", "cost and benefit", "trial and appeal", "research and development", "terms and conditions",
)
BOUND = r"(?i)\b(?:between|both|either|neither|from)\b[^,;]{0,60}?\b(?:and|or|to)\b"
LIST_QUESTION = r"(?i)\b(?:list|enumerate|name (?:all|the \w+|three|four|five))\b"
DEFINES = r"(?i)^\s*(?:what\s+(?:is|are|was|were)\s+|what\s+does\s+.+\s+mean|define\s+|definition\s+of\s+)"
DEFINED = r"\s+(?:is|are|was|were|means|refers to|stands for)\s+"
ITEM_MARK = r"(?m)^[ \t]*(?:[-*•–]|\d+[.)])[ \t]+"
BETWEEN = r"(?i)\s*(?:;|,\s*(?:and|or|plus)\b|,|\band\b|\bor\b|\bplus\b|\bas well as\b)\s*"
JOINS = r"(?i)\b(?:and|or|plus|as well as)\b"
SENTENCE_END, DIGIT_COMMA, PIECE_END = r"(?<=[.!?])\s+", r"(?<=\d),(?=\d)", r"(?<=[,;])\s+"


def n_words(text: Column) -> Column:
    return F.size(words(text))


def _items(parts: Column) -> Column:
    """Parts of an answer without list marks and the points behind them."""
    clean = F.transform(parts, lambda p: F.regexp_replace(stripped(stripped(stripped(p), "•*-")), "[.;,]+$", ""))
    return F.filter(clean, lambda p: F.length(p) >= ITEM_CHARS)


def facts(answer: Column) -> Column:
    """The things that an answer asks for, one or more; none of an empty one. Only what punctuation or conjunctions list is taken apart."""
    text = F.regexp_replace(stripped(F.coalesce(answer, F.lit(""))), r"\.+$", "")
    marked = F.filter(F.split(text, ITEM_MARK), lambda p: stripped(p, "•*-") != "")
    probe = F.regexp_replace(text, DIGIT_COMMA, "")
    commas = F.size(F.split(probe, ",")) - 1
    joined = probe.rlike(JOINS)
    one = F.exists(F.array(*map(F.lit, IDIOMS)), lambda i: F.contains(F.lower(probe), i)) | probe.rlike(BOUND)
    listed = F.contains(probe, F.lit(";")) | (commas >= 2) | ((commas >= 1) & joined) | (joined & (n_words(probe) > 4))
    said = F.filter(F.split(text, SENTENCE_END), lambda s: n_words(s) >= 3)
    whole = F.array(text)
    apart = _items(F.split(probe, BETWEEN))
    several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(whole)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.size(marked) > 1, F.slice(_items(marked), 1, MOST_ITEMS))
        .when(one, whole)
        .when(listed, F.slice(several(apart), 1, MOST_ITEMS))
        .otherwise(several(said))
    )


def broken_rule(front: Column, back: Column, n_facts: Column, most: int = MOST_WORDS) -> Column:
    """The first rule that a card breaks: length, list-question, enumeration or set; '' if it asks for one thing."""
    long = n_words(F.coalesce(back, F.lit("")))
    return (
        F.when(long > HARD_WORDS, "length")
        .when(F.coalesce(front, F.lit("")).rlike(LIST_QUESTION), "list-question")
        .when(n_facts >= 3, "enumeration")
        .when(n_facts == 2, "set")
        .when(long > most, "length")
        .otherwise("")
    )


def assessed(cards: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """cards (card, front, back) with their facts and the rule that they break."""
    rows = cards.withColumn("facts", facts(F.col("back")))
    return rows.withColumn("rule", broken_rule(F.col("front"), F.col("back"), F.size("facts"), most))


def sentences(text: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return F.filter(F.transform(F.split(flat, SENTENCE_END), lambda s: stripped(s)), lambda s: s != "")


def _blanked(sentence: Column, at: Column, size: Column) -> Column:
    """The sentence with braces around so many characters from a place (1 is the first)."""
    return F.concat(F.substring(sentence, F.lit(1), at - 1), F.lit("{{"), F.substring(sentence, at, size), F.lit("}}"), F.substring(sentence, at + size, F.length(sentence)))


def trimmed_context(front: Column) -> Column:
    """A long list around a blank cut to its first piece, the blank's and that one's neighbours, with an ellipsis for the rest."""
    pieces = F.split(front, PIECE_END)
    n = F.size(pieces)
    at = F.array_position(F.transform(pieces, lambda p: F.contains(p, F.lit("{{"))), True).cast("int") - 1
    low, high = F.greatest(F.lit(1), at - 1), F.least(n - 1, at + 1)
    cut = F.concat(F.slice(pieces, 1, 1), F.when(low > 1, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>")), F.slice(pieces, low + 1, high - low + 1), F.when(high < n - 1, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>")))
    short = F.regexp_replace(F.array_join(cut, " "), r"\s+…", " …")
    return F.when((n_words(front) > LONG_WORDS) & (n >= 4) & (at >= 0) & (n_words(short) < n_words(front)), short).otherwise(front)


def split_to_cloze(cards: DataFrame, most: int = MOST_CARDS) -> DataFrame:
    """(card, n, front, back, source): for answers that list things, a blank for each thing that a sentence of quote or passage holds.

    cards: card, back, quote, passage. The shortest sentence counts, then the first. A card with fewer than two
    such things gives none.
    """
    said = F.concat(sentences(F.col("quote")), sentences(F.col("passage")))
    rows = cards.select("card", said.alias("said"), facts(F.col("back")).alias("facts"))
    rows = rows.select("card", "said", F.posexplode("facts").alias("at", "item")).withColumn("item", stripped(F.col("item")))
    rows = rows.filter((F.length("item") >= ITEM_CHARS) & (n_words(F.col("item")) <= ITEM_WORDS))
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy("card", F.lower("item")).orderBy("at"))).filter("again = 1")
    holding = F.filter(F.transform("said", lambda s, i: F.struct(F.length(s).alias("size"), i.alias("i"), s.alias("text"))), lambda s: F.contains(F.lower(s["text"]), F.lower(F.col("item"))))
    rows = rows.select("card", "at", "item", F.explode(F.array(F.array_min(holding)["text"])).alias("source"))  # exploded, so that filters on it don't search again
    fits = F.col("source").isNotNull() & ~F.contains("source", F.lit("{{")) & (F.length("source") - F.length("item") >= CONTEXT_CHARS)
    rows = rows.filter(fits).withColumn("begin", F.instr(F.lower("source"), F.lower("item")))
    place = W.partitionBy("card").orderBy("at")
    rows = rows.withColumns({"n": F.row_number().over(place), "all": F.count(F.lit(1)).over(W.partitionBy("card"))}).filter((F.col("all") > 1) & (F.col("n") <= most))
    front = trimmed_context(_blanked(F.col("source"), F.col("begin"), F.length("item")))
    return rows.select("card", "n", front.alias("front"), F.substring("source", F.col("begin"), F.length("item")).alias("back"), "source")


def definiendum(front: Column) -> Column:
    """The term that a question asks to define, '' for other questions and terms that are too short or long."""
    asked = F.coalesce(front, F.lit(""))
    term = F.regexp_replace(stripped(F.regexp_replace(stripped(asked), DEFINES, "")), r"(?i)^the\s+term\s+", "")
    term = stripped(F.regexp_replace(stripped(term, "?.:“”\"'"), r"(?i)^(?:an|a|the)\s+", ""))
    return F.when(asked.rlike(DEFINES) & (F.length(term) >= 3) & (n_words(term) <= 6), term).otherwise("")


def to_cloze(cards: DataFrame) -> DataFrame:
    """(card, front, back, source): a question for a definition as a blank on the term, in the first sentence of quote or passage that defines it (cards: card, front, quote, passage)."""
    rows = cards.select("card", definiendum(F.col("front")).alias("term"), F.concat(sentences(F.col("quote")), sentences(F.col("passage"))).alias("said")).filter("term <> ''")
    each = rows.select("card", "term", F.posexplode("said").alias("i", "source"))
    literal = F.regexp_replace("term", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    defines = F.rlike("source", F.concat(F.lit("(?i)"), literal, F.lit(DEFINED)))
    each = each.filter(defines & ~F.contains("source", F.lit("{{")) & (F.length("source") - F.length("term") >= CONTEXT_CHARS))
    first = each.groupBy("card").agg(F.min_by(F.struct("term", "source"), "i").alias("x")).select("card", "x.*").withColumn("begin", F.instr(F.lower("source"), F.lower("term")))
    return first.select("card", _blanked(F.col("source"), F.col("begin"), F.length("term")).alias("front"), F.substring("source", F.col("begin"), F.length("term")).alias("back"), "source")
