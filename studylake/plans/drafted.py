"""Queries on cards drafted from documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drafts
from ..sources import views


def items(spark, d):
    """What a model might say about each document: questions and answers from its text, each fourth or so of them against a rule."""
    text = F.coalesce("text", F.lit(""))
    docs = views.table(spark, d, "documents").select("doc_id", text.alias("text"), F.regexp_replace(text, r"\s+", " ").alias("flat"))
    i, text, flat = F.col("doc_id"), F.col("text"), F.col("flat")
    q = F.when(i % 10 == 0, "").when(i % 10 == 1, "Why?").when(i % 10 == 2, F.concat(F.lit("As mentioned, what of "), F.substring(flat, 1, 20))).when(i % 10 == 3, F.substring(flat, 1, 40)).otherwise(F.concat(F.lit("What about "), F.substring(flat, 1, 30)))
    a = F.when(i % 10 == 3, F.lower(F.substring(flat, 1, 40))).when(i % 10 == 4, F.lit("Own Title!")).when(i % 10 == 5, F.substring(flat, 1, 401)).when(i % 10 == 6, F.lit("nothing that stands there qqq")).otherwise(F.substring(flat, 31, 40))
    why = F.when(i % 3 == 0, F.substring(flat, 25, 60)).when(i % 3 == 1, "not a quotation of it")
    return docs.select(i.alias("card"), text.alias("passage"), F.lit("own title").alias("subject"), q.alias("q"), a.alias("a"), why.alias("why"), F.when(i % 4 == 0, "MCQ.").when(i % 4 == 1, "why").otherwise("").alias("format"), F.lit("Some Kind.").alias("topic"), F.array(F.substring(flat, 80, 30), F.substring(flat, 120, 30), F.substring(flat, 160, 30)).alias("wrong"))


def rule_cards(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("note"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "text"))
    return drafts.by_rule(docs).select("note", "n", "front", "back")


def refused_drafts(spark, d):
    return drafts.read(items(spark, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("cards"))


def drafted_cards(spark, d):
    return drafts.drafted(items(spark, d)).select("card", "n", "front", "back", "mode", "tag")


def drafting_passages(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("note"), "text")
    return drafts.material(docs).select("note", "place", F.length("text").alias("chars"))


def queries() -> dict:
    return {"rule_cards": rule_cards, "refused_drafts": refused_drafts, "drafted_cards": drafted_cards, "drafting_passages": drafting_passages}


_SAID = r"trim(trim(trim(regexp_replace({}, '\s+', ' ', 'g')), '\"'))".replace('\\"', '"')
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'))"
SQL = {
    "rule_cards": r"""with l as (select doc_id as note, i - 1 as place, ls[i] as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), lateral (select unnest(range(1, len(ls) + 1)) as i)),
        s as (select note, place, i, ss[i] as s from (select note, place, string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as ss from l), lateral (select unnest(range(1, len(ss) + 1)) as i)),
        c as (select note, place, i, regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^[ *#>-]+|[ *#>-]+$', '', 'g') as source from s),
        m as (select *, trim(regexp_extract(source, '(?s)^([A-Z][^.!?]{2,60}?)\s+(?:is|are|means|refers to|stands for)\s+(.{15,220}?[.!?])', 1)) as back from c where regexp_matches(source, '(?s)^[A-Z][^.!?]{2,60}?\s+(?:is|are|means|refers to|stands for)\s+.{15,220}?[.!?]')),
        o as (select * from m where length(back) >= 3 and len(string_split(source, ' ')) <= 45 qualify row_number() over (partition by note, trim(regexp_replace(lower(back), '[^a-z0-9 ]+', '', 'g')) order by place, i) = 1),
        n as (select *, row_number() over (partition by note order by place, i) as n from o) select note, n, '{{' || back || '}} ' || trim(substring(source, length(back) + 1)) as front, back from n where n <= 20""",
    "refused_drafts": rf"""with f as (select doc_id as i, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') as t from documents),
        q as (select i, case i % 10 when 0 then '' when 1 then 'Why?' when 2 then 'As mentioned, what of ' || substring(t, 1, 20) when 3 then substring(t, 1, 40) else 'What about ' || substring(t, 1, 30) end as q,
          case i % 10 when 3 then lower(substring(t, 1, 40)) when 4 then 'Own Title!' when 5 then substring(t, 1, 401) when 6 then 'nothing that stands there qqq' else substring(t, 31, 40) end as a from f),
        s as (select {_SAID.format("q")} as q, {_SAID.format("a")} as a from q)
        select case when q = '' or a = '' then 'empty' when length(q) not between 8 and 320 or length(a) > 400 then 'length' when {_PLAIN.format("q")} = {_PLAIN.format("a")} then 'restates-question' when {_PLAIN.format("a")} = 'own title' then 'title-as-answer'
          when regexp_matches(q, '(?i)\b(?:the above|as mentioned|this passage|the text|the note|this (?:chapter|section|reading|lesson)|the reading)\b') then 'not-self-contained' else '' end as reason, count(*) as cards from s group by 1""",
}
