"""Queries on files from elsewhere, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports
from ..sources import views

FOLDER, BUCKET = "Drop/_Past/Accounting/Study Terms", "30-Resources"


def source_files(spark, d):
    """Documents as files: some with front matter of their own, with ids, of drawings or without a body."""
    docs = views.table(spark, d, "documents")
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    head = (
        F.when(i % 9 == 0, F.concat(F.lit("---\ntitle: Own title "), i % 5, F.lit("\ncreated: 2025-06-"), F.lpad((i % 40).cast("string"), 2, "0"), F.lit("\ntags: [x, 'Y z']\n---\n\n")))
        .when(i % 9 == 1, F.lit("---\nid: n1\n---\n\n"))
        .when(i % 9 == 2, F.lit("---\nexcalidraw-plugin: parsed\n---\n\n"))
        .when(i % 9 == 3, F.lit("---\nDate: '[[<% tp.date %>]]'\ndate: on 2024-02-03\ntag: a, b\n---\n\n"))
        .otherwise("")
    )
    body = F.when(i % 9 == 4, " \n").otherwise(text)
    name = F.when(i % 9 == 5, F.concat(F.lit("2025070514"), F.lpad((i % 70).cast("string"), 2, "0"), F.lit(".md"))).otherwise(F.concat(F.lit("Term "), i % 50, F.lit(".md")))
    return docs.select(F.concat(i.cast("string"), F.lit("/"), name).alias("source"), F.timestamp_seconds(F.lit(1_750_000_000) + i % 3).alias("modified"), F.concat(head, body).alias("text"), "doc_id")


def adopted_before(spark, d):
    """Every seventh document has been brought in; some ids are in use that new ones would have."""
    used = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("20250615T150640-term-"), F.col("doc_id") % 50)).otherwise(F.concat(F.lit("20250615T150640-term-"), F.col("doc_id") % 50, F.lit("-3")))
    return source_files(spark, d).filter("doc_id % 7 = 0").select("source", used.alias("id"))


def import_plan(spark, d):
    plan = imports.decided(source_files(spark, d).drop("doc_id"), F.lit(FOLDER), BUCKET, adopted_before(spark, d))
    return plan.select("source", "action", "reason", "id", "dest", "title", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), "created_from", "provisional", F.array_join("tags", ",").alias("tags"), "words")


def import_states(spark, d):
    """Originals after the import: every fifth has changed, every eleventh is gone."""
    files = source_files(spark, d).withColumn("sha256", F.sha2("text", 256))
    plan = imports.decided(files.drop("doc_id", "sha256"), F.lit(FOLDER), BUCKET, adopted_before(spark, d))
    later = files.filter("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("sha256")))
    return imports.verified(imports.manifest(plan, files, "first"), later).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


def queries() -> dict:
    return {"import_plan": import_plan, "import_states": import_states}


_PLAN = r"""f as (select doc_id as i, doc_id || '/' || case when doc_id % 9 = 5 then '2025070514' || lpad(cast(doc_id % 70 as varchar), 2, '0') else 'Term ' || doc_id % 50 end || '.md' as source, timestamp '1970-01-01' + to_seconds(1750000000 + doc_id % 3) as modified,
    case when doc_id % 9 = 4 then '' else coalesce(text, '') end as body from documents),
  g as (select *, try_strptime(case when i % 9 = 0 then '2025-06-' || lpad(cast(i % 40 as varchar), 2, '0') when i % 9 = 3 then '2024-02-03' end, '%Y-%m-%d') as written, case when i % 9 = 5 then try_strptime('2025070514' || lpad(cast(i % 70 as varchar), 2, '0'), '%Y%m%d%H%M') end as stamp,
    case when i % 9 = 0 then 'Own title ' || i % 5 when i % 9 = 5 then '2025070514' || lpad(cast(i % 70 as varchar), 2, '0') else 'Term ' || i % 50 end as title,
    case when trim(body, ' ' || chr(10) || chr(9) || chr(13)) = '' then 'no body' when i % 9 = 1 then 'has an id' when i % 9 = 2 then 'a drawing' when i % 7 = 0 then 'already adopted' end as reason from f),
  h as (select *, coalesce(written, stamp, modified) as created, case when written is not null then case when i % 9 = 0 then 'frontmatter:created' else 'frontmatter:date' end when stamp is not null then 'filename' else 'file-mtime' end as created_from from g),
  b as (select *, strftime(created, '%Y%m%dT%H%M%S') || '-' || replace(lower(title), ' ', '-') as base, row_number() over (partition by reason is null, strftime(created, '%Y%m%dT%H%M%S') || '-' || replace(lower(title), ' ', '-') order by source) as place from h),
  u as (select distinct '20250615T150640-term-' || i % 50 || case when i % 2 = 0 then '' else '-3' end as id from f where i % 7 = 0),
  free as (select base, n, row_number() over (partition by base order by n) as place from (select base, unnest(range(1, cast(max(place) as int) + 3)) as n from b where reason is null group by base) where base || case when n = 1 then '' else '-' || n end not in (select id from u)),
  plan as (select b.*, case when reason is null then b.base || case when n = 1 then '' else '-' || n end when reason = 'already adopted' then '20250615T150640-term-' || i % 50 || case when i % 2 = 0 then '' else '-3' end end as id from b left join free on reason is null and free.base = b.base and free.place = b.place)"""
SQL = {
    "import_plan": rf"""with {_PLAN} select source, case when reason is null then 'adopt' else 'skip' end as action, reason, id, case when reason is null then '30-Resources/Accounting/Study Terms/' || replace(lower(title), ' ', '-') || '--' || substring(id, 1, 15) || '.md' end as dest,
        case when reason is null then title end as title, case when reason is null then strftime(created, '%Y-%m-%d %H:%M:%S') end as created, case when reason is null then created_from end as created_from, reason is null and created_from = 'file-mtime' as provisional,
        case when reason is null then 'accounting,study-terms' || case i % 9 when 0 then ',x,y-z' when 3 then ',a,b' else '' end end as tags, case when reason is null then len(list_filter(string_split_regex(body, '\s+'), lambda w: w <> '')) end as words from plan""",
    "import_states": rf"""with {_PLAN} select case when i % 11 = 0 then 'missing' when i % 5 = 0 then 'changed' else 'intact' end as state, count(*) as files from plan where reason is null group by 1""",
}
