"""Actions, links and passages as SQL over the same tables."""

from __future__ import annotations

from ..functions.memory import WEIGHTS as w
from .actions import GROUNDED
from .oracle import CLASSES, PROJECTS, REVIEWS, STEPS
from .oracle_library import NOTES, SERIES

NORM = "trim(regexp_replace(regexp_replace(replace(lower({}), '’', ''''), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_GRAPH = f"""{NOTES}, edges as (select note as src, note * 3 + 1 as dst from notes where note % 4 = 0 union select note, note from notes where note % 8 = 0)"""

SQL = {
    "outside_view": f"""with {STEPS}, {PROJECTS}, {CLASSES}, x as (select s.project, s.minutes, coalesce((select max(multiplier) from classes c where c.level = p.level and enough), (select multiplier from classes where level is null and enough), 1.0) as m
          from steps s join projects p using (project) where not done)
        select project, cast(sum(minutes) as bigint) as before, cast(sum(case when m = 1.0 then minutes else greatest(5, round_even(minutes * m, 0)) end) as bigint) as after, count(*) as steps from x group by project""",
    "toggled_steps": f"""with {STEPS}, x as (select project, case when step = 1 then not done else done end as d, case when step = 1 then minutes * 2 else actual end as a from steps)
        select project, count(*) filter (d) as done, cast(sum(a) filter (d) as bigint) as actual, case when bool_and(d) and project % 3 <> 0 then 'done' else 'active' end as status from x group by project""",
    "resource_answers": f"""with {NOTES} select note, case when bucket = 'resource' and note % 3 = 2 then 'archive' else 'resource' end as bucket,
        case when bucket = 'resource' and note % 3 = 2 then null when bucket = 'resource' and note % 3 = 1 then date '2024-01-31' + cast(greatest(1, least(365, note % 500 - 50)) as int)
          else date '2024-01-31' + case when note % 2 = 0 then 30 else 90 end end as next from notes where bucket in ('resource', 'archive')""",
    "move_events": f"""with {NOTES}, x as (select bucket as a, (['project', 'resource', 'archive'])[(note // 5) % 3 + 1] as b from notes)
        select case when a = 'project' and b = 'resource' then 'graduated' when a = 'resource' and b = 'archive' then 'archived' when a = 'archive' and b = 'resource' then 'restored' else 'moved' end as event, count(*) as n from x group by 1""",
    "deadline_edits": f"""with {NOTES}, x as (select *, (note // 3) % 4 as a from notes) select note, case a when 1 then updated when 2 then null else deadline end as deadline, case a when 1 then 'manual' when 2 then 'none' else kind end as kind,
        case a when 0 then deadline is not null when 1 then true when 2 then false else kind in ('explicit', 'exact', 'manual') end as confirmed from x""",
    "next_card_ids": """with t as (select c_nationkey as note, max(case when c_custkey % 3 <> 0 then c_custkey % 100 end) as top from customer where c_custkey % 4 <> 0 group by 1)
        select cast(c_nationkey as bigint) as note, c_custkey as ord, 'c' || (coalesce(top, 0) + row_number() over (partition by c_nationkey order by c_custkey)) as id from customer left join t on note = c_nationkey where c_custkey % 4 = 0""",
    "habit_targets": f"with {SERIES} select note, greatest(1, least(7, monthday - 5)) as target from series",
    "habit_occurrences": """with x as (select distinct user_id as note, cast(ts as date) as d, hour(ts) * 60 + minute(ts) as m from events), y as (select *, row_number() over (partition by note order by d, m) as i, count(*) over (partition by note) as n from x)
        select a.note, a.n as occurrences, a.d as first_on, a.m as first_minute, b.d as last_on, b.m as last_minute from y a join y b on a.note = b.note and b.i = b.n where a.i = 1""",
    "once_answered": f"""with {REVIEWS}, x as (select card, grade, lag(grade) over (partition by card order by "at", ord) as g, date_diff('microsecond', lag("at") over (partition by card order by "at", ord), "at") as gap from reviews)
        select card, count(*) filter (not coalesce(grade = g and gap <= 2000000, false)) as reviews from x group by card""",
    "user_sessions": """with x as (select user_id as owner, ts, event_id, case when event_type in ('signup', 'purchase') then 'start' else 'end' end as kind from events where event_type in ('signup', 'purchase', 'error')),
        y as (select *, lead(ts) over (partition by owner order by ts, event_id) as ended from x) select owner, ts as started, ended from y where kind = 'start'""",
    "weights_in_force": f"select c_custkey as card, case when c_custkey % 3 = 0 then 1.5 when c_custkey % 2 = 0 then 2.5 else {w[0]} end::double as first from customer",
    "day_seeds": "select cast(ts as date) as day, date_diff('day', date '0001-01-01', cast(ts as date)) + 1 as seed from events group by 1",
    "backlinks": f"with {_GRAPH} select n.note, e.src from edges e join notes n on n.note = e.dst where e.src <> n.note",
    "orphans": f"with {_GRAPH} select note from notes where note not in (select src from edges) and note not in (select dst from edges where src <> dst)",
    "card_kinds": """select case when c_custkey % 5 = 0 then 'mcq' when c_custkey % 3 = 0 then 'cloze' when c_custkey % 2 = 0 then 'recall' else 'basic' end as kind, count(*) as cards from customer group by 1""",
    "missing_concepts": f"""with n as (select conv_id as note, turn as place, role, {NORM.format("text")} as said from conversations),
        c as (select note, place, array_to_string(string_split(said, ' ')[1:place % 3 + 1], ' ') as term, place % 3 as weight from n where said <> ''),
        o as (select * from c qualify row_number() over (partition by note, term order by weight desc, place) = 1),
        h as (select * from o qualify row_number() over (partition by note order by weight desc, place, term) <= 40),
        m as (select * from h where place % 4 <> 0 and not exists (select 1 from n where n.note = h.note and n.place % 2 = 0 and n.role = 'user' and contains(n.said, h.term)))
        select note, row_number() over (partition by note order by weight desc, place, term) as rank, term from m qualify rank <= 12""",
    "passage_neighbours": """select conv_id as note, turn as place, lag(length(text)) over (partition by conv_id order by turn) as before, lead(length(text)) over (partition by conv_id order by turn) as behind from conversations""",
    "word_stems": "select r_regionkey as region, 'study,box,tied,cat,42,gas,' || case lower(r_name) when 'middle east' then 'middle,east' else lower(r_name) end as words from region",
    "grounded_cards": f"""with v as (select * from (values {", ".join(f"({i}, '{c}', '{h}')" for i, (_, _, _, c, h) in enumerate(GROUNDED))}) v(i, citation, how)) select c_custkey as card, citation, how from customer join v on i = c_custkey % {len(GROUNDED)}""",
    "blended_search": """with v as (select vec_id, label, embedding::double[] as e from embeddings),
        s as (select q.vec_id as question, v.label as note, v.vec_id as place, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) as near from v q, v where q.vec_id % 100 = 0),
        n as (select * from s qualify row_number() over (partition by question order by near desc, place) <= 50),
        b as (select question, note, place, round(near + 0.15 * case when place % 3 = 0 then place % 10 / 10 else 0 end, 9) as score from n), c as (select * from b where score >= 0.28 qualify row_number() over (partition by question, note order by score desc, place) <= 2)
        select question, row_number() over (partition by question order by score desc, note, place) as rank, note, place, score from c qualify rank <= 6""",
    "index_status": "select count(*) as passages, count(distinct label) as notes, count(distinct label % 3) as buckets, bool_and(vec_id > 0) as semantic from embeddings",
}
