"""Sessions, buttons, folders, incidents and findings as SQL."""

from __future__ import annotations

from ..functions.memory import WEIGHTS as w
from ..operators import upkeep
from .oracle import _NEXT_D, PROJECTS, REVIEWS, SQL as FIRST, STATES, STEPS

CARDS = """customers as (select c_custkey as card, c_nationkey as note, lower(c_mktsegment) as topic,
  'every ' || lower(c_mktsegment) || ' account of nation ' || c_nationkey || ' in group ' || (c_custkey % 7) as key, c_custkey % 4 as reps,
  case when c_custkey % 4 > 0 then date '2024-01-31' + cast(c_custkey % 60 as int) - 30 end as due from customer)"""
_DRAW = "('0x' || substr(md5('{}' || card), 1, 8))::bigint / 4294967296.0"
_LABEL = """case when days < 1 then '<1d' when days < 31 then days || 'd' when days < 365 then replace(printf('%.1fmo', days / 30.44), '.0', '')
  else replace(printf('%.1fy', days / 365.25), '.0', '') end"""
_VAGUE = ", ".join(repr(x) for x in upkeep.VAGUE_TITLES)

SQL = {
    "study_session": f"""with {CARDS}, hot as ({FIRST['overconfident_cards']}),
        pool as (select *, reps = 0 as new, card not in (select card from hot) as cool, {_DRAW.format('2024-01-31')} as drawn from customers where reps = 0 or due <= date '2024-01-31'),
        ranked as (select *, row_number() over (order by new, case when new then false else cool end, case when not new then due end, case when not new then note end, case when new then drawn end, card) as rank from pool),
        kept as (select * from ranked qualify row_number() over (partition by note, key order by rank) = 1),
        picked as (select * from kept qualify row_number() over (partition by new order by rank) <= case when new then 20 else 100 end),
        spread as (select *, (row_number() over (partition by note, topic order by rank) - 0.5) / count(*) over (partition by note, topic) + ({_DRAW.format('2024-01-31/')} * 2 - 1) * 0.02 as slot from picked)
        select row_number() over (order by slot, note, topic, card) as place, card, note, topic, case when new then 'new' else 'due' end as reason from spread qualify place <= 60""",
    "review_buttons": f"""with recursive {STATES}, asked as (select card, s, d, last, unnest([1, 2, 3, 4]) as grade, card % 20 + 5 as exam, 19753.0 - last as e0 from cards),
        m as (select *, greatest(0, e0) as e, pow(1 + 19.0 / 81 * greatest(0, e0) / s, -0.5) as r, {_NEXT_D} as nd from asked),
        n as (select *, greatest(0.01, case when e < 1 then s * exp({w[17]} * (grade - 3 + {w[18]}))
            when grade = 1 then least(s, {w[11]} * pow(nd, {-w[12]}) * (pow(s + 1, {w[13]}) - 1) * exp({w[14]} * (1 - r)))
            else s * (1 + exp({w[8]}) * (11 - nd) * pow(s, {-w[9]}) * (exp({w[10]} * (1 - r)) - 1) * case grade when 2 then {w[15]} when 4 then {w[16]} else 1 end) end) as s1 from m),
        f as (select card, grade, exam, case when grade = 1 then 1 else greatest(1, cast(round_even(least(3650.0, s1 / (19.0 / 81) * (pow(0.9, -2) - 1)), 0) as int)) end as free from n),
        x as (select card, grade, cast(case when exam - 1 <= 0 or free <= exam - 1 then free else exam - 1 end as int) as days from f)
        select card, grade, days, {_LABEL} as label from x""",
    "folder_rollup": f"""with {CARDS}, decks as (select note, topic, count(*) filter (reps > 0 and due <= date '2024-01-31') as due, count(*) filter (reps = 0) as new, count(*) as active from customers group by all),
        placed as (select d.*, r_name, n_name from decks d join nation on note = n_nationkey join region on n_regionkey = r_regionkey),
        paths as (select *, unnest(['', r_name, r_name || '/' || n_name]) as path from placed)
        select path, case when path = '' then 'All notes' else split_part(path, '/', -1) end as label, case when path = '' then 0 else 1 + length(path) - length(replace(path, '/', '')) end as depth,
          count(*) as decks, cast(sum(due) as bigint) as due, cast(sum(new) as bigint) as new, cast(sum(active) as bigint) as cards from paths group by path""",
    "study_debrief": f"""with {REVIEWS}, x as (select card, count(*) as n, count(*) filter (grade >= 3) as ok, min(grade) as worst from reviews where day >= date '2024-01-24' group by card)
        select card % 10 as subject, cast(sum(n) as bigint) as reviewed, cast(sum(ok) as bigint) as correct, count(*) as cards, count(*) filter (worst = 1) as failed from x group by 1""",
    "incidents": """with x as (select user_id as key, ts as "at", event_id as ord, event_type = 'purchase' as ok from events where event_type in ('error', 'purchase')),
        runs as (select *, coalesce(sum(ok::int) over (partition by key order by "at", ord rows between unbounded preceding and 1 preceding), 0) as run from x),
        found as (select key, min("at") filter (not ok) as since, max("at") filter (not ok) as last_seen, count(*) filter (not ok) as count, min("at") filter (ok) as resolved_at from runs group by key, run)
        select * from found where count > 0 qualify resolved_at is null or row_number() over (partition by resolved_at is null order by resolved_at desc, key) <= 40""",
    "overdue_steps": f"""with {STEPS}, {PROJECTS} select project, step, minutes, scheduled, date_diff('day', scheduled, date '1998-08-02') as days from steps join projects using (project)
        where not done and scheduled < date '1998-08-02' and status <> 'done' order by days desc, project, step, minutes limit 12""",
    "week_closed": f"""with {STEPS}, {REVIEWS}, new as (select card from reviews group by card having min(day) >= date '2024-01-24' and min(day) < date '2024-01-31')
        select 'steps' as kind, count(*) as n, coalesce(sum(minutes), 0)::double as minutes from steps where done and scheduled >= date '1995-06-01' and scheduled < date '1995-06-08'
        union all select 'reviews', count(*), round(coalesce(sum(seconds), 0) / 60, 1) from reviews where day >= date '2024-01-24' and day < date '2024-01-31'
        union all select 'cards learned', count(*), 0.0 from new""",
    "note_findings": f"""with x as (select coalesce(text, '') as text, regexp_replace(lower(trim(split_part(coalesce(text, ''), chr(10), 1))), '\\.+$', '') as name from documents)
        select 'vague-title' as rule, count(*) filter (name in ({_VAGUE}) or length(name) < 4 or regexp_matches(name, '{upkeep.VAGUE_SHAPE}')) as notes from x
        union all select 'too-long', count(*) filter (len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) > {upkeep.LONG_WORDS}) from x
        union all select 'many-sections', count(*) filter (len(regexp_extract_all(text, '(?m)^##+ ')) >= 3) from x""",
    "stated_confidence": f"""with {REVIEWS}, x as (select r.grade, case e.event_type when 'click' then 0.9 when 'view' then 0.6 when 'signup' then null else
          (case when k > 1 then k / 100.0 else k end) end as p from (select *, cast(regexp_extract(props, '[0-9]+') as double) as k from events) e join reviews r on r.ord = e.event_id)
        select grade, count(*) as reviews, count(p) as stated, round(avg(p), 4) as confidence from x group by grade""",
    "calendar_priority": f"""with {PROJECTS}, x as (select level, date_diff('day', date '1998-08-02', deadline) as d from projects where status <> 'done')
        select greatest(1, least(9, 6 - level + case when d <= 1 then -2 when d <= 3 then -1 when d > 21 then 1 else 0 end)) as priority, count(*) as projects from x group by 1""",
}
