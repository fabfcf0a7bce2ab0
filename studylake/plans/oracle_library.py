"""The library's queries as SQL over the same tables. Rules on texts are held to what each sentence must mean."""

from __future__ import annotations

from ..functions.captures import AUTO_FLOOR
from .library import CAPTURES, FILED, SENTENCES
from .oracle import PROJECTS, REVIEWS, STATES, STEPS

NOTES = """notes as (select p_partkey as note, p_name || ' ' || (p_partkey % 97) as title, (['inbox', 'project', 'area', 'resource', 'archive'])[p_partkey % 5 + 1] as bucket,
  lower(p_type) || '/' || p_brand as folder, p_partkey % 6 = 0 as undefined, p_partkey % 7 = 0 as term, date '2024-01-31' - p_size * 3 as created,
  date '2024-01-31' - p_size * 3 + cast(p_partkey % 40 as int) as updated, case when p_partkey % 3 = 0 then date '2024-01-31' + cast(p_partkey % 41 as int) - 10 end as deadline,
  (['explicit', 'exact', 'ambiguous', 'llm', 'manual'])[(p_partkey // 5) % 5 + 1] as kind, case when p_partkey % 4 = 0 then 'done' else 'active' end as status,
  p_partkey % 2 = 0 as learning, p_size * 4 as words from part)"""
CARDS = """cards as (select c_custkey as card, c_nationkey as note, case c_custkey % 7 when 0 then 'draft' when 1 then 'suspended' else 'active' end as status, c_custkey % 9 as reps,
  c_custkey % 11 as lapses, case when c_custkey % 9 > 0 then round(abs(c_acctbal) / 50, 2) else 0 end as s,
  case when c_custkey % 9 > 0 then date '2024-01-31' + cast(c_custkey % 60 as int) - 30 end as due from customer)"""
SERIES = """series as (select s_suppkey as note, case s_suppkey % 3 when 0 then 'daily' when 1 then 'weekly' else 'monthly' end as cadence, [s_nationkey % 7, (s_nationkey + 3) % 7] as days,
  1 + s_suppkey % 31 as monthday, date '2024-01-10' + cast(s_suppkey % 60 as int) as start, case when s_suppkey % 4 = 0 then date '2024-02-10' + cast(s_suppkey % 50 as int) end as until,
  cast(s_nationkey * 40 as int) as minute, cast(15 + s_suppkey % 5 * 15 as int) as minutes, s_suppkey % 10 <> 9 as enabled from supplier)"""


def _cases(column: int, cast: str) -> str:
    return "case project % " + str(len(SENTENCES)) + " " + " ".join(f"when {i} then {s[column] if column == 1 else repr(s[column])}" for i, s in enumerate(SENTENCES) if s[column]) + f" end::{cast}"


def _capture_values() -> str:
    q = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(q(x) for x in c[1:])})" for i, c in enumerate(CAPTURES))



_DONE = f"{STEPS}, timed as (select project, step, minutes, actual, actual / minutes as ratio from steps where done and minutes > 0)"
_COLLECTED = f"""{NOTES}, {CARDS}, decks as (select note, count(*) as cards, count(*) filter (reps > 0) as answered from cards group by note),
  rows_ as (select note, title, date_diff('day', created, date '2024-01-31') as age_days, bucket = 'resource' and words >= 40 and date_diff('day', created, date '2024-01-31') >= 14 and not term as eligible,
    note % 9 = 0 or coalesce(answered, 0) > 0 as used, coalesce(cards, 0) > 0 as has_cards, coalesce(answered, 0) as answered from notes left join decks using (note))"""
_OLD_INDEX = """old as (select doc_id as note, case when doc_id % 7 = 0 then 'x' else 'same' end as f, doc_id % 4 + 1 as chunks, case when doc_id % 11 = 0 then 0 else doc_id % 4 + 1 end as vectors from documents where doc_id % 10 <> 0
  union all select -1 - doc_id, 'same', 1, 1 from documents where doc_id % 13 = 0), new as (select doc_id as note, 'same' as f from documents)"""
_OCCUR = """days_ as (select cast(unnest(generate_series({a}, {b}, interval 1 day)) as date) as day),
  begun as (select *, greatest(start, {today}) as day0, greatest(1, least(28, monthday)) as target from series where enabled),
  firsts as (select *, case cadence when 'daily' then day0
      when 'monthly' then case when day(day0) <= target then date_trunc('month', day0)::date else (date_trunc('month', day0) + interval 1 month)::date end + cast(target - 1 as int)
      else (select min(day0 + cast(i as int)) from range(8) t(i) where list_contains(days, isodow(day0 + cast(i as int)) - 1)) end as first from begun),
  occurring as (select f.note, d.day, f.minute, f.minutes from firsts f join days_ d on d.day >= f.first and (f.until is null or d.day <= f.until)
    where cadence = 'daily' or (cadence = 'weekly' and list_contains(days, isodow(d.day) - 1)) or (cadence = 'monthly' and day(d.day) = least(28, monthday)))"""
_RULE = """case cadence when 'daily' then 'FREQ=DAILY' when 'monthly' then 'FREQ=MONTHLY;BYMONTHDAY=' || monthday
  else 'FREQ=WEEKLY;BYDAY=' || array_to_string(list_transform(list_sort(days), lambda x: (['MO', 'TU', 'WE', 'TH', 'FR', 'SA', 'SU'])[x + 1]), ',') end || case when until is null then '' else ';UNTIL=' || strftime(until, '%Y%m%d') || 'T235959' end"""
_AREAS = f"areas as (select note || '-area@studylake' as uid, note, first as day, minute, minutes, {_RULE} as rule from firsts where until is null or first <= until)"
_TITLE_SLUG = "regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g')"

SQL = {
    "deck_states": f"""with {CARDS} select note::bigint as note, count(*) as cards, count(*) filter (status = 'active') as active, count(*) filter (status = 'draft') as drafts, count(*) filter (status = 'suspended') as suspended,
        count(*) filter (status = 'active' and reps > 0 and s > 0 and due <= date '2024-01-31') as due, count(*) filter (status = 'active' and (reps = 0 or s <= 0)) as new,
        count(*) filter (lapses >= 8) as leeches, count(*) filter (status = 'active' and s > 0) as scheduled from cards group by note""",
    "study_summary": f"""with {CARDS} select count(distinct note) as decks, count(*) filter (status = 'active' and reps > 0 and s > 0 and due <= date '2024-01-31') as due,
        count(*) filter (status = 'active' and (reps = 0 or s <= 0)) as new, count(*) filter (status = 'draft') as drafts from cards""",
    "schedule_rollup": f"""with {CARDS} select note::bigint as note, cast(sum(reps) as bigint) as reps, cast(sum(lapses) as bigint) as lapses, round(sum(s) / count(*), 2) as interval_days, min(due) as due, max(due) - 10 as last_review
        from cards where status = 'active' group by note""",
    "counted_on": f"""with {REVIEWS}, f as (select card, min(day) as first, count(*) filter (day = date '2024-01-10') as n from reviews group by card)
        select cast(coalesce(sum(n), 0) as bigint) as reviews, count(*) filter (first = date '2024-01-10') as introduced from f""",
    "pending_dates": f"with {NOTES} select note, title, deadline, kind from notes where bucket = 'project' and status <> 'done' and deadline is not null and kind in ('ambiguous', 'llm')",
    "undefined_terms": f"with {NOTES} select note, title, created from notes where undefined",
    "deckable_notes": f"""with {NOTES} select note, title, bucket, folder, bucket = 'project' and learning as learning, words from notes
        where bucket in ('project', 'resource') and not (bucket = 'project' and status = 'done') and note not in (select c_nationkey from customer)""",
    "folder_scope": f"""with {NOTES} select folder, count(*) as notes from notes where folder like 'economy/%' or folder = 'small/Brand#4' group by folder""",
    "graduation": f"""with recursive {STATES}, {NOTES}, x as (select card % 10 * 3 as deck, count(*) as active, count(*) filter (reps >= 4 and s >= 21) as mature from cards group by 1)
        select note, title, round(mature / active, 3) as mastery, mature, active from x join notes on note = deck where active >= 6 and mature / active >= 0.85 and bucket = 'project' and learning""",
    "worst_answers": f"""with {REVIEWS}, {CARDS}, w as (select card, min(grade) as worst, count(*) as answers from reviews where day >= date '2024-01-24' group by card)
        select card, worst, answers, note::bigint as note, status from w join cards using (card) where worst = 1""",
    "label_counts": f"""with {REVIEWS}, o as (select *, row_number() over (partition by card order by "at", ord) as up, row_number() over (partition by card order by "at" desc, ord desc) as down from reviews)
        select a.card, a.grade as first, round(a.confidence, 6) as confidence, b.grade as last from o a join o b on a.card = b.card where a.up = 1 and b.down = 1""",
    "index_changes": f"with {_OLD_INDEX} select case when o.note is null then 'missing' when n.note is null then 'removed' when o.f <> n.f then 'stale' else 'kept' end as change, count(*) as notes from old o full join new n on o.note = n.note group by 1",
    "index_merge": f"""with {_OLD_INDEX} select case when n.note is null then 'drop' when o.note is not null and o.f = n.f and vectors = chunks then 'keep' else 'embed' end as action, count(*) as notes
        from old o full join new n on o.note = n.note group by 1""",
    "step_carryover": f"""with {STEPS}, d as (select distinct project, minutes % 5 as text from steps where done)
        select s.project, count(*) filter (d.project is not null) as done, count(*) as steps from steps s left join d on d.project = s.project and d.text = s.step % 5 group by s.project""",
    "linked_context": f"""with {NOTES}, top as (select max(note) as m from notes)
        select n.note, n.title || case when b.title is null then '' else chr(10) || chr(10) || b.title end || case when c.title is null then '' else chr(10) || chr(10) || c.title end as text,
          (b.title is not null)::int + (c.title is not null)::int as linked from notes n left join notes b on b.note = n.note + 7 left join notes c on c.note = n.note + 3""",
    "template_fill": f"""with {NOTES} select note, case when note % 2 = 0 then '## Summary' || chr(10) || chr(10) || title || chr(10) || chr(10) || '## Quotes' || chr(10) || chr(10) || case when note % 3 = 0 then folder else '' end
          else '## Today' || chr(10) || chr(10) || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || title end as body, case when note % 2 = 0 and note % 3 = 0 then 2 else 1 end as filled from notes""",
    "remote_completions": f"""with {NOTES}, t as (select distinct o_orderkey % 3000 as note from orders where o_orderkey % 5 <> 0 and o_orderstatus = 'F')
        select note, title, case when learning then 'active' else 'done' end as status from t join notes using (note) where notes.status <> 'done'""",
    "block_clashes": """with x as (select o_custkey as owner, o_orderkey as block, date_diff('day', date '1995-01-01', cast(o_orderdate as date)) % 60 * 1440 + o_orderkey % 24 * 60 as a, 60 + o_orderkey % 8 * 60 as n from orders)
        select p.owner, p.block, p.a as start, p.a + p.n as stop, min(q.a + q.n) as clear_at from x p left join x q on q.owner = p.owner and q.block % 2 = 1 and q.a < p.a + p.n and p.a < q.a + q.n where p.block % 2 = 0 group by all""",
    "estimate_summary": f"""with {_DONE} select project, step, minutes, actual, round(ratio, 2) as ratio, round(abs(ratio - 1), 6) as off from timed where ratio > 0 and ratio < 12 order by off desc, project, step, minutes, actual limit 5""",
    "estimate_outliers": f"with {_DONE} select count(*) filter (ratio >= 12) as outliers, count(*) as n from timed",
    "collected_summary": f"""with {_COLLECTED} select count(*) filter (eligible) as eligible, count(*) filter (eligible and used) as used, count(*) filter (eligible and not used) as collected,
        round(count(*) filter (eligible and used) / nullif(count(*) filter (eligible), 0), 3) as ratio, coalesce(max(age_days) filter (eligible and not used), 0) as oldest_days,
        count(*) filter (eligible and not used and has_cards and answered = 0) as carded_but_unreviewed from rows_""",
    "oldest_collected": f"with {_COLLECTED} select note, title, age_days from rows_ where eligible and not used order by age_days desc, note limit 5",
    "inbox": f"""with {NOTES} select note, title, created as "on", (select count(*) from notes where bucket = 'inbox') as total from notes where bucket = 'inbox' order by created desc, note limit 25""",
    "archived": f"""with {NOTES} select note, title, updated as "on", (select count(*) from notes where bucket = 'archive') as total from notes where bucket = 'archive' order by updated desc, note limit 25""",
    "resources_to_review": f"""with {NOTES}, {CARDS}, a as (select note, count(*) as cards from cards where status = 'active' group by note)
        select n.note, n.title, created + 90 as due, date_diff('day', created + 90, date '2024-01-31') as overdue_days, coalesce(a.cards, 0) as cards from notes n left join a on a.note = n.note where bucket = 'resource' and created + 90 <= date '2024-01-31'""",
    "card_queue": """with x as (select user_id as note, ts, event_id, cast(trunc(value) as int) as most, regexp_extract(props, '[0-9]+') as source from events where event_type = 'click'),
        y as (select *, min(ts) over (partition by note) as queued_at, count(*) over (partition by note) as requests from x)
        select note, queued_at, ts as requested_at, most, source, requests from y qualify row_number() over (partition by note order by ts desc, event_id desc) = 1""",
    "term_summary": """with x as (select case when p_partkey % 2 = 0 then upper(p_name) else p_name end as term, round(p_retailprice % 7, 2) as weight, p_partkey as ord from part),
        y as (select * from x qualify row_number() over (partition by lower(term) order by weight desc, ord) = 1) select term, weight, ord from y order by weight desc, ord limit 12""",
    "glossary_duplicates": "select p_partkey as ord, lower(p_name) as term from part qualify row_number() over (partition by lower(p_name) order by p_partkey) > 1",
    "asset_sets": """with l as (select distinct page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as asset from pages), r as (select distinct asset from l),
        d as (select '/' || split_part(array_to_string(list_slice(string_split(url, '/'), 1, 5), '/'), '/', -1) as asset from pages union select asset from l where page_id % 3 = 0)
        select case when r.asset is null then 'unreferenced' when d.asset is null then 'missing' else 'used' end as state, count(*) as assets from r full join d on r.asset = d.asset group by 1""",
    "sink_changes": f"""with {PROJECTS} select project as uid, case when project % 5 = 0 then 'create' when project % 6 = 0 then 'delete' else 'update' end as change from projects
        where not (project % 5 = 0 and project % 6 = 0) and (project % 5 = 0 or project % 6 = 0 or project % 4 = 0)""",
    "bucket_counts": f"""with {NOTES} select b.bucket, count(n.note) as notes from (values ('inbox'), ('project'), ('area'), ('resource'), ('archive')) b(bucket) left join notes n on n.bucket = b.bucket and n.bucket <> 'area' group by 1""",
    "exam_deadlines": f"with {NOTES} select note, deadline from notes where bucket = 'project' and status <> 'done' and deadline > date '2024-01-31'",
    "last_review_on": f"""with {REVIEWS} select card, grade, "at" from reviews where day = date '2024-01-10' qualify row_number() over (partition by card order by "at" desc, ord desc) = 1""",
    "reminders": """with x as (select event_id as k, cast(date_diff('day', date '1970-01-01', cast(ts as date)) * 1440 + hour(ts) * 60 + minute(ts) as bigint) as t from events)
        select case when k % 5 <= 0 then 'nothing due' when k % 7 = 0 then 'already started' when t % 1440 < 600 then 'too early' when k % 3 = 0 and t < t + k % 2 then 'snoozed'
          when k % 4 > 0 and k % 4 * 45 < 60 then 'within an hour' when k % 4 > 0 and (t - k % 4 * 45) // 1440 = t // 1440 and k % 2 <> 0 then 'already today' else 'fire' end as reason, count(*) as n from x group by 1""",
    "new_ids": """with x as (select event_id as ord, event_type as slug, hour(ts) * 60 + minute(ts) as second from events), y as (select *, row_number() over (partition by slug order by second, ord) as i from x)
        select ord, slug || '-' || (i + max(second - i) over (partition by slug order by i)) as id from y""",
    "deadlines": f"""with x as (select o_orderkey as project, cast(o_orderdate as date) as t from orders), y as (select project, {_cases(1, "date")} as deadline, {_cases(2, "varchar")} as kind from x)
        select project, deadline, kind, coalesce(kind in ('explicit', 'exact', 'manual'), false) as confirmed from y""",
    "capture_rules": f"""with v as (select * from (values {_capture_values()}) v(i, title, level, learning, steps, skills, materials, minutes))
        select c_custkey as note, title, level, learning, steps, skills, materials, minutes from customer join v on i = c_custkey % {len(CAPTURES)}""",
    "filed_captures": f"""with v as (select * from (values {", ".join(f"({i}, {p}::double, {a}::double, {r}::double, '{b}', {c}::double)" for i, (_, p, a, r, b, c) in enumerate(FILED))}) v(i, project, area, resource, bucket, confidence))
        select o_orderkey as note, project, area, resource, bucket, confidence, confidence >= {AUTO_FLOOR} as auto from orders join v on i = o_orderkey % {len(FILED)}""",
    "duration_of_steps": """with x as (select cast(trunc(l_quantity) as int) as q from lineitem) select q, case q % 4 when 0 then q + 60 when 1 then null when 2 then q * 60 + 30 else q * 240 end as minutes, count(*) as n from x group by q""",
    "habit_periods": f"""with {SERIES}, x as (select *, start + 100 as stop from series)
        select note, case cadence when 'daily' then 101 when 'weekly' then cast(date_diff('week', date_trunc('week', start), date_trunc('week', stop)) + 1 as int) else cast(date_diff('month', start, stop) + 1 as int) end as periods,
          cast(case cadence when 'daily' then start when 'weekly' then date_trunc('week', start) else date_trunc('month', start) end as date) as first,
          cast(case cadence when 'daily' then stop when 'weekly' then date_trunc('week', stop) else date_trunc('month', stop) end as date) as last, case cadence when 'daily' then 1 when 'weekly' then 7 else 30 end as length from x""",
    "occurrences": f"with {SERIES}, {_OCCUR.format(a="date '2024-02-01'", b="date '2024-02-29'", today="date '2024-01-20'")} select note, day, minute, minutes from occurring",
    "calendar_events": f"""with {SERIES}, {STEPS}, {PROJECTS}, {NOTES}, {_OCCUR.format(a="date '2024-01-31'", b="date '2024-01-31'", today="date '2024-01-31'")}, {_AREAS}
        select project || '-' || step || '@studylake' as uid, 'block' as kind, project as note, scheduled as day, null::int as minute, minutes, null as rule from steps join projects using (project) where not done and step = 1 and status <> 'done'
        union all select uid, 'area', note, day, minute, minutes, rule from areas
        union all select note || '-review@studylake', 'review', note, created + 90, null, 0, null from notes where bucket = 'resource'
        union all select 'schedule-review@studylake', 'schedule-review', null, date '2024-02-04', 1140, 20, 'FREQ=WEEKLY;BYDAY=SU' union all select 'study-session@studylake', 'study', null, date '2024-01-31', 1170, 25, 'FREQ=DAILY'""",
    "due_tasks": f"""with {STEPS}, {PROJECTS}, l as (select project, count(*) filter (done) / count(*) as progress from steps group by project), x as (select *, date_diff('day', date '1998-08-02', deadline) as left_ from projects left join l using (project) where status <> 'done')
        select project || '-due@studylake' as uid, project, deadline as due, greatest(1, least(9, 6 - level + case when left_ <= 1 then -2 when left_ <= 3 then -1 when left_ > 21 then 1 else 0 end)) as priority,
          cast(round_even(coalesce(progress, 0) * 100, 0) as int) as percent, left_ < 0 as overdue from x""",
    "day_agenda": f"""with {SERIES}, {STEPS}, {NOTES}, {_OCCUR.format(a="date '2024-01-31'", b="date '2024-01-31'", today="date '2024-01-15'")},
        x as (select 'habit' as kind, note, minute from occurring union all select 'block', project, case when minutes % 2 = 0 then minutes * 20 end from steps where not done and step = 1
          union all select 'review', note, null from notes where created + 90 = date '2024-01-31')
        select kind, note, minute, lpad(cast(minute // 60 as varchar), 2, '0') || ':' || lpad(cast(minute % 60 as varchar), 2, '0') as time from x""",
    "event_files": f"""with {SERIES}, {_OCCUR.format(a="date '2024-01-31'", b="date '2024-01-31'", today="date '2024-01-31'")}, {_AREAS}, e as (select chr(13) || chr(10) as e)
        select uid, 'BEGIN:VEVENT' || e || 'UID:' || uid || e || 'DTSTART:' || strftime(day, '%Y%m%d') || 'T' || lpad(cast(minute // 60 as varchar), 2, '0') || lpad(cast(minute % 60 as varchar), 2, '0') || '00' || e || 'DURATION:PT' || minutes || 'M' || e
          || 'RRULE:' || rule || e || 'SUMMARY:' || s_name || '\\, again\\; or\\nnot\\\\' || e || 'END:VEVENT' as entry from areas join supplier on s_suppkey = note, e""",
    "wiki_graph": f"""with {NOTES}, p as (select *, {_TITLE_SLUG.format("title")} as slug, 'f' || lpad(cast(note as varchar), 8, '0') as path,
          {_TITLE_SLUG.format("split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2) || ' ' || ((note + 1) % 97)")} as next from notes where note % 3 <> 0), i as (select slug, min(path) as dst from p group by slug),
        l as (select note, path, unnest([next, slug]) as slug from p)
        select 'n' || note as id, count(*) as links, count(dst) as resolved, count(*) filter (dst = path) as to_itself from l left join i using (slug) group by note""",
    "note_fields": f"with {NOTES} select note, title, deadline, length('Body of ' || title || 'xx```xcode herex```xendx') as length, 2 + len(string_split(title, ' ')) + 1 as words from notes",
    "deck_cards": f"""with {NOTES} select note, unnest(['c1', 'c2']) as card, unnest(['What is ' || title || '?', 'Pick']) as q, unnest([null, 'recall']) as mode, unnest(['A […] thing' || chr(10) || 'of two lines', 'b']) as shown,
        unnest([folder, '']) as blanks, unnest(['', 'a|B.|c']) as options from notes""",
    "visit_plan": """with p as (select l_orderkey as note, max(l_linenumber) as n from lineitem group by 1), k as (select note, n, j, k, k * n // (1 << j) as passage from p, range(6) a(j), range(32) b(k) where k < (1 << j)),
        f as (select note, passage, min(j * 100 + k) as rank from k group by all)
        select note, passage, row_number() over (partition by note order by case when passage % 3 = 1 then 1 else 0 end, rank) as visit from f""",
    "graded_scores": "with x as (select value % 100 / 100 as s from events) select case when s >= 0.95 then 4 when s >= 0.7 then 3 when s >= 0.45 then 2 else 1 end as grade, count(*) as n from x group by 1",
    "citations": r"""with x as (select c_custkey as k, c_custkey % 9 as n, left(trim(regexp_replace(repeat('word  ' || c_custkey || ' ', 30), '\s+', ' ', 'g')), 39) as cut from customer)
        select k as note, case when n between 1 and 6 and n <> 2 then least(n, 2) || ',' || greatest(n, 2) else '2' end as cited, rtrim(cut) || '…' as excerpt from x""",
}
SQL["threshold_report"] = " union all ".join(
    f"""select '{name}' as name, * from (with pairs as (select least(1.0, n_chars / 4000.0) as score, {name} = 1 as correct from labels join documents using (doc_id)), t as (select count(*) as n, count(*) filter (correct) as positives from pairs where score is not null),
    c as (select round(0.30 + 0.02 * i, 2)::double as cutoff from range(35) t(i)), p as (select cutoff, count(*) filter (score >= cutoff) as accepted, count(*) filter (score >= cutoff and correct) as good from c, pairs group by cutoff)
    select n, positives, n >= 40 as enough, n >= 25 as usable, (select min(cutoff) from p where accepted > 0 and round(good / accepted, 4) >= 0.9) as recommended from t)"""
    for name in ("quality", "toxic")
)
