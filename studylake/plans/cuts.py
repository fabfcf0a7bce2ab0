"""Queries on cutting texts, each with its SQL: the notes are made so that every cut is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments
from ..sources import views


def texts(spark, d):
    """A note of three headings with a fence, a list, a rule and two long paragraphs; every fifth has no heading."""
    p = views.dealt(views.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    head = F.when(F.col("p_partkey") % 5 == 0, "Top\n\n").otherwise("# Top\n\nIntro of note\n\n## First\n\nalpha beta\n- item one\n\n```\n# not a heading\n\nend\n```\n\n## Second\n\n")
    return p.select(F.col("p_partkey").alias("note"), F.concat(head, F.repeat(F.lit("word "), F.col("p_size") * 12), F.lit("\n\n---\n\n"), F.repeat(F.lit("more "), F.col("p_size") * 6)).alias("text"))


def lossless(spark, d):
    """Sections without the second one: its lines are lost."""
    notes = texts(spark, d)
    cut = segments.sections(notes).filter("section <> 2")
    return segments.lost_lines(notes, cut).groupBy("line").agg(F.count(F.lit(1)).alias("notes"))


def marked_documents(spark, d):
    """Whole documents as notes; some lines are headings or rules, by their number."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("note"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    n, at = F.col("note"), F.col("at")
    mark = F.when((n % 4 == 0) & (at % 3 == 0), F.concat(F.repeat(F.lit("#"), (at % 2 + 1).cast("int")), F.lit(" "), F.substring("line", 1, 20), F.lit(" "), at)).when((n % 4 == 1) & (at % 5 == 2), F.lit("---"))
    rows = docs.select("note", "at", F.concat_ws("\n", mark, "line", F.lit("")).alias("line"))
    return rows.groupBy("note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))


def segment_plans(spark, d):
    return segments.plans(segments.block_texts(marked_documents(spark, d)))


def segmented_documents(spark, d):
    return segments.segmented(marked_documents(spark, d)).select("note", "ordinal", "boundary", "title", "words", F.sha2("body", 256).alias("body"))


def segment_losses(spark, d):
    """Lines that no segment of a document holds, counted: none."""
    notes = marked_documents(spark, d)
    cut = segments.segmented(notes).select("note", F.concat_ws("\n", "title", "path").alias("title"), "body")
    return segments.lost_lines(notes, cut).agg(F.count(F.lit(1)).alias("lost"))


def queries() -> dict:
    return {
        "segment_plans": segment_plans,
        "segmented_documents": segmented_documents,
        "segment_losses": segment_losses,
        "text_blocks": lambda k, d: segments.blocks(texts(k, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum("words").alias("words"), F.sum("lines").alias("lines")),
        "text_sections": lambda k, d: segments.sections(texts(k, d)).select("note", "section", "title", "words", F.length("body").alias("chars")),
        "text_parts": lambda k, d: segments.packed(segments.blocks(texts(k, d))),
        "merged_sections": lambda k, d: segments.merged(segments.sections(texts(k, d))),
        "lost_lines": lossless,
    }


_T = "t as (select p_partkey as note, p_partkey % 5 = 0 as bare, p_size * 12 as a, p_size * 6 as b from part)"
SQL = {
    "segment_losses": "select 0 as lost",
    "segment_plans": r"""with l as (select doc_id as note, i - 1 as k, ls[i] as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), lateral (select unnest(range(1, len(ls) + 1)) as i)),
        m as (select note, k, unnest(list_filter([case when note % 4 = 0 and k % 3 = 0 then repeat('#', cast(k % 2 + 1 as int)) || ' ' || substring(line, 1, 20) || ' ' || k when note % 4 = 1 and k % 5 = 2 then '---' end, line], lambda x: x is not null and trim(x) <> '')) as line from l),
        f as (select *, len(regexp_extract(line, '^(#{1,6})\s', 1)) as level, regexp_matches(line, '^\s{0,3}(?:-(?:\s*-){2,}|\*(?:\s*\*){2,}|_(?:\s*_){2,})\s*$') as rule, len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')) as words from m),
        h as (select note, level, count(*) as n from f where level > 0 group by all), c as (select note, coalesce(min(level) filter (n > 1), max(level)) as cut from h group by note)
        select f.note, case when max(cut) is not null then 'heading' when bool_or(rule) then 'rule' when sum(words) < 120 then 'whole' else 'size' end as plan, max(cut) as cut, cast(sum(words) as bigint) as words from f left join c on c.note = f.note group by f.note""",
    "text_blocks": f"""with {_T}, x as (select 'heading' as kind, 3 as blocks, 6 as words, 3 as lines from t where not bare union all select 'list', 1, 3, 1 from t where not bare union all select 'code', 1, 7, 5 from t where not bare
          union all select 'rule', 1, 1, 1 from t union all select 'para', case when bare then 3 else 4 end, a + b + case when bare then 1 else 5 end, case when bare then 3 else 4 end from t)
        select kind, cast(sum(blocks) as bigint) as blocks, cast(sum(words) as bigint) as words, cast(sum(lines) as bigint) as lines from x group by kind""",
    "text_sections": f"""with {_T} select note, 0 as section, null as title, a + b + 2 as words, 3 + 2 + a * 5 + 7 + b * 5 as chars from t where bare
        union all select note, 1, 'Top', 3, 13 from t where not bare union all select note, 2, 'First', 12, length('alpha beta') + 1 + length('- item one') + 2 + length('```x# not a headingxxendx```') from t where not bare
        union all select note, 3, 'Second', a + b + 1, a * 5 + 7 + b * 5 from t where not bare""",
    "text_parts": f"""with {_T}, s as (select *, case when bare then 1 else 21 end as c0, case when bare then 1 else 7 end as b0 from t),
        x as (select note, b0, c0, a, b, case when c0 + a > 400 then 1 else 0 end as pa from s), y as (select *, case when (case when pa = 1 then a else c0 + a end) + b > 400 then pa + 1 else pa end as pb from x),
        z as (select note, 0 as part, b0 as blocks, c0 as words from y union all select note, pa, 1, a from y union all select note, pb, 1, b from y)
        select note, part, cast(sum(blocks) as bigint) as blocks, cast(sum(words) as bigint) as words from z group by note, part""",
    "merged_sections": f"""with {_T} select note, 0 as place, 1 as sections, a + b + 2 as words from t where bare
        union all select note, 0, 2, 17 from t where not bare union all select note, 1, 1, a + b + 1 from t where not bare""",
    "lost_lines": f"""with {_T}, n as (select count(*) as n from t where not bare) select unnest(['alpha beta', '- item one', '```', 'not a heading', 'end', 'first']) as line, unnest([n, n, 2 * n, n, n, n]) as notes from n""",
}
