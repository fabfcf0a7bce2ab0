"""Queries on how much cards ask for and on cards mended as blanks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from ..sources import views


def document_cards(spark, d):
    """Cards on documents: the answer is the text's first line, its beginning, or a list of its words; the whole text is the passage."""
    docs = views.table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    word = lambda i: F.coalesce(F.get(F.regexp_extract_all(F.substring(text, 1, 400), F.lit(r"[^\s.,;]+"), F.lit(0)), F.lit(i)), F.lit("x"))
    kind = F.col("doc_id") % 6
    back = (
        F.when(kind == 0, F.split_part(text, F.lit("\n"), F.lit(1)))
        .when(kind == 1, F.substring(text, 1, 60))
        .when(kind == 2, F.concat_ws(", ", word(0), word(3), word(5)))
        .when(kind == 3, F.concat(word(1), F.lit(" and "), word(2)))
        .when(kind == 4, F.concat(F.lit("- "), word(0), F.lit("\n- "), word(4), F.lit(";\n2) "), word(6)))
        .otherwise(F.substring(text, 20, 25))
    )
    front = F.when(F.col("doc_id") % 11 == 0, F.lit("Name the parts")).otherwise(F.concat(F.lit("What is the "), word(2), F.lit("?")))
    return docs.select(F.col("doc_id").alias("card"), front.alias("front"), back.alias("back"), F.split_part(text, F.lit("\n"), F.lit(2)).alias("quote"), text.alias("passage"))


def card_facts(spark, d):
    return repair.assessed(document_cards(spark, d)).select("card", F.array_join("facts", " | ").alias("facts"), "rule")


def cloze_repairs(spark, d):
    return repair.split_to_cloze(document_cards(spark, d))


def cloze_definitions(spark, d):
    """Questions for a word of each document; its text with "means" put behind the word's first place defines it."""
    c = document_cards(spark, d)
    term = repair.definiendum(F.col("front"))
    return repair.to_cloze(c.select("card", "front", "quote", F.concat(term, F.lit(" means what is said here. "), "passage").alias("passage")))


def queries() -> dict:
    return {"card_facts": card_facts, "cloze_repairs": cloze_repairs, "cloze_definitions": cloze_definitions}


_CLEAN = r"list_filter(list_transform({}, lambda p: regexp_replace(regexp_replace(p, '^[\s•*-]+|[\s•*-]+$', '', 'g'), '[.;,]+$', '')), lambda p: length(p) >= 2)"
_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"
_MARK, _CUT = "chr(1)", r"'(?i)\s*(?:;|,\s*(?:and|or|plus)\b|,|\band\b|\bor\b|\bplus\b|\bas well as\b)\s*'"
_CARDS = r"""t as (select doc_id as card, coalesce(text, '') as text from documents), w as (select *, regexp_extract_all(substring(text, 1, 400), '[^\s.,;]+') as w from t),
  cards as (select card, text as passage, split_part(text, chr(10), 2) as quote, case when card % 11 = 0 then 'Name the parts' else 'What is the ' || coalesce(w[3], 'x') || '?' end as front, case card % 6 when 0 then split_part(text, chr(10), 1) when 1 then substring(text, 1, 60)
    when 2 then coalesce(w[1], 'x') || ', ' || coalesce(w[4], 'x') || ', ' || coalesce(w[6], 'x') when 3 then coalesce(w[2], 'x') || ' and ' || coalesce(w[3], 'x')
    when 4 then '- ' || coalesce(w[1], 'x') || chr(10) || '- ' || coalesce(w[5], 'x') || ';' || chr(10) || '2) ' || coalesce(w[7], 'x') else substring(text, 20, 25) end as back from w)"""
SQL = {
    "card_facts": rf"""with {_CARDS}, a as (select *, regexp_replace(regexp_replace(back, '^\s+|\s+$', '', 'g'), '\.+$', '') as x from cards),
        b as (select *, list_filter(string_split_regex(x, '(?m)^[ \t]*(?:[-*•–]|\d+[.)])[ \t]+'), lambda p: regexp_replace(p, '[\s•*-]+', '', 'g') <> '') as marked, regexp_replace(regexp_replace(x, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g') as p from a),
        c as (select *, length(p) - length(replace(p, ',', '')) as commas, regexp_matches(p, '(?i)\b(?:and|or|plus|as well as)\b') as joined, list_filter(string_split(regexp_replace(x, '([.!?])\s+', '\1' || {_MARK}, 'g'), {_MARK}), lambda s: {_WORDS.format("s")} >= 3) as said, {_CLEAN.format(f"string_split_regex(p, {_CUT})")} as apart,
          len(list_filter([{', '.join(repr(i) for i in repair.IDIOMS)}], lambda i: contains(lower(p), i))) > 0 or regexp_matches(p, '(?i)\b(?:between|both|either|neither|from)\b[^,;]{{0,60}}?\b(?:and|or|to)\b') as one from b),
        f as (select *, case when x = '' then [] when len(marked) > 1 then {_CLEAN.format("marked")} when one then [x] when contains(p, ';') or commas >= 2 or (commas >= 1 and joined) or (joined and {_WORDS.format("p")} > 4) then case when len(apart) > 1 then apart[1:12] else [x] end when len(said) > 1 then said else [x] end as facts from c)
        select card, coalesce(array_to_string(facts, ' | '), '') as facts, case when {_WORDS.format("back")} > 30 then 'length' when regexp_matches(front, '(?i)\b(?:list|enumerate|name (?:all|the \w+|three|four|five))\b') then 'list-question'
          when len(facts) >= 3 then 'enumeration' when len(facts) = 2 then 'set' when {_WORDS.format("back")} > 15 then 'length' else '' end as rule from f""",
}
