"""Queries on captures that hold several tasks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tasks
from ..sources import views

TODAY = "2026-08-20"


def captures(spark, d):
    """The words of each document's beginning as captures of six shapes, and the whole text as a seventh."""
    docs = views.table(spark, d, "documents")
    w = F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), 1, 9)
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else F.coalesce(F.get("w", F.lit(y)), F.lit("it")) for y in x))
    shape = F.col("doc_id") % 7
    text = (
        F.when(shape == 0, say("- call ", 0, "\n- ", 1, " ", 2, "\n  ", 3, "\n* email ", 4))
        .when(shape == 1, say("This week:\ncall ", 0, " ", 1, "\nemail ", 2, "\n", 3, " ", 4, "\nwe should ", 5))
        .when(shape == 2, say("email ", 0, ", call ", 1, " and then visit ", 2, "; pay ", 3, " & ", 4))
        .when(shape == 3, say("email ", 0, ", ", 1, " and ", 2, ", also call ", 3))
        .when(shape == 4, say("Agenda: review ", 0, "; review ", 0, "!, plus go to ", 1))
        .when(shape == 5, say(0, " ", 1, "\n", 2, " ", 3, "\ncall ", 4))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", "text", w.alias("w")).select(F.col("doc_id").alias("capture"), text.alias("text"), F.to_date(F.lit(TODAY)).alias("today"))


def split_captures(spark, d):
    return tasks.split(captures(spark, d)).select("capture", "ordinal", "way", "text")


def really_in(spark, d):
    """Which turns of conversations repeat words of the document of their number."""
    c = views.table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 12).alias("part"))
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.coalesce("text", F.lit("")).alias("text"))
    return c.join(docs, "conv_id").select("conv_id", "turn", tasks.really_in(F.col("part"), F.col("text")).alias("really"))


def queries() -> dict:
    return {"split_captures": split_captures, "really_in": really_in}


_VERBS = f"(?:{'|'.join(tasks.VERBS)})"
_WORD = f"^{_VERBS}$"
#: The rules again, over lists; documents hold no date that the shapes could take up, so dates are those of the shapes.
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ASKS = r"(len(list_filter(regexp_extract_all(lower({0}), '[a-z'']+')[1:4], lambda w: regexp_full_match(w, '{1}'))) > 0 or regexp_matches({0}, '(?i)\b(?:need to|needs to|have to|has to|must|should|due|deadline|by tomorrow|todo|to-do)\b'))"


def _asks(x: str) -> str:
    return _ASKS.format(x, _VERBS)


SQL = {
    "split_captures": rf"""with w as (select doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}')[1:9] as x from documents),
        v as (select doc_id, text, list_transform(range(1, 10), lambda i: coalesce(x[i], 'it')) as w from w),
        c as (select doc_id as capture, {_STRIP.format("""case doc_id % 7 when 0 then '- call ' || w[1] || chr(10) || '- ' || w[2] || ' ' || w[3] || chr(10) || '  ' || w[4] || chr(10) || '* email ' || w[5]
            when 1 then 'This week:' || chr(10) || 'call ' || w[1] || ' ' || w[2] || chr(10) || 'email ' || w[3] || chr(10) || w[4] || ' ' || w[5] || chr(10) || 'we should ' || w[6]
            when 2 then 'email ' || w[1] || ', call ' || w[2] || ' and then visit ' || w[3] || '; pay ' || w[4] || ' & ' || w[5]
            when 3 then 'email ' || w[1] || ', ' || w[2] || ' and ' || w[3] || ', also call ' || w[4]
            when 4 then 'Agenda: review ' || w[1] || '; review ' || w[1] || '!, plus go to ' || w[2]
            when 5 then w[1] || ' ' || w[2] || chr(10) || w[3] || ' ' || w[4] || chr(10) || 'call ' || w[5]
            else coalesce(text, '') end""")} as raw from v),
        r as (select *, case when capture % 7 = 1 then substring(raw, 12) when capture % 7 = 4 then substring(raw, 9) else raw end as rest from c where raw <> ''),
        l as (select capture, i, ls[i] as line from (select capture, list_filter(string_split(rest, chr(10)), lambda x: regexp_matches(x, '\S')) as ls from r), lateral (select unnest(range(1, len(ls) + 1)) as i)),
        m as (select *, regexp_matches(line, '^\s*(?:[-*+•‣]|\d{{1,3}}[.)]|\(\d{{1,3}}\)|\[[ xX]\])\s+\S') as bullet, regexp_matches(line, '^\s{{2,}}\S') as further from l),
        g as (select *, sum(case when bullet or not further or i = 1 then 1 else 0 end) over (partition by capture order by i) as item from m),
        items as (select capture, item as place, max(bullet::int) as bullets, string_agg({_STRIP.format("case when bullet then regexp_replace(line, '^\\s*(?:[-*+•‣]|\\d{1,3}[.)]|\\(\\d{1,3}\\)|\\[[ xX]\\])\\s+', '') else line end")}, chr(10) order by i) as part from g group by capture, item),
        ok as (select capture from items group by capture having count(*) >= 2 and (sum(bullets) >= 2 or (max(len(string_split_regex(trim(part), '\s+'))) <= 30 and count(*) filter ({_asks("part")}) >= greatest(2, count(*) - 1)))),
        a as (select capture, list_filter(list_transform(string_split_regex(trim(regexp_replace(rest, '\s+', ' ', 'g')), '(?i)\s*;\s*|,?\s+and\s+then\s+|,?\s+then\s+|,\s+and\s+also\s+|,\s+also\s+|,\s+and\s+|,\s+plus\s+|\s+&\s+'), lambda x: trim(x, ' ,.;')), lambda x: x <> '') as chunks
          from r where not contains(rest, chr(10)) and len(string_split_regex(rest, '\s+')) <= 40),
        b as (select capture, flatten(list_transform(chunks, lambda k: case when contains(k, ',') and len(list_filter(string_split_regex(k, ',\s+'), lambda p: not regexp_full_match(regexp_extract(lower(p), '[a-z'']+'), '{_VERBS}'))) = 0 then string_split_regex(k, ',\s+') else [k] end)) as ps from a),
        d as (select capture, list_transform(ps, lambda p: trim(regexp_replace(p, '^(?i)(?:and|then|also|plus|next|after that)\s+', ''))) as ps from b),
        e as (select capture, ps from d where len(ps) >= 2 and len(list_filter(ps, lambda p: len(string_split_regex(p, '\s+')) < 2 or not {_asks("p")})) = 0 and capture not in (select capture from ok)),
        parts as (select capture, 'lines' as way, place, part from items where capture in (select capture from ok) union all select capture, 'clauses', i, ps[i] from e, lateral (select unnest(range(1, len(ps) + 1)) as i)),
        t as (select capture, way, place, regexp_replace(regexp_replace(part, '^[\s•*-]+|[\s•*-]+$', '', 'g'), '^(?i)(?:and|then|also|plus|next|after that)\s+', '') as text, row_number() over (partition by capture order by place) as n from parts),
        u as (select * from t where n <= 25 and len(string_split_regex(trim(text), '\s+')) >= 2 qualify row_number() over (partition by capture, trim(regexp_replace(lower(text), '[^a-z0-9 ]+', '', 'g')) order by n) = 1),
        k as (select *, count(*) over (partition by capture) as tasks, row_number() over (partition by capture order by n) as ordinal from u)
        select capture, cast(ordinal as bigint) as ordinal, case when tasks < 2 then 'whole' else way end as way, text from k
        union all select capture, 1, 'whole', raw from r where capture not in (select capture from k)""",
    "really_in": r"""select conv_id, turn, contains(trim(regexp_replace(regexp_replace(lower(coalesce(d.text, '')), '\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')), trim(regexp_replace(regexp_replace(lower(substring(c.text, 1, 12)), '\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')))
          and len(list_filter(string_split_regex(substring(c.text, 1, 12), '\s+'), lambda w: w <> '')) >= 2 as really from conversations c join documents d on doc_id = conv_id""",
}
