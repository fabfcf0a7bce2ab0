"""Categories, folders, tags and names as SQL over the same tables."""

from __future__ import annotations

from .names import NAMES
from .oracle import STEPS
from .oracle_library import CARDS, NOTES

SQL = {
    "note_categories": """with x as (select p_partkey as k, p_name as t, p_partkey % 11 = 0 as red, p_partkey % 3 = 0 as anvil from part),
        s as (select k, 20 * (t like '% bolt')::int + 10 * (t like '% anvil')::int + anvil::int as metal, 100 * red::int + 10 * (t like 'red %')::int + 10 * (t = 'blue bolt')::int as colour, 10 * (t like '% plate')::int + 10 * (t = 'red plate')::int as home from x)
        select k as note, case when k % 13 = 0 then 'home' when greatest(metal, colour, home) = 0 then 'general' when metal >= colour and metal >= home then 'metal' when colour >= home then 'colour' else 'home' end as category from s""",
    "file_names": "select c_custkey as file, case c_custkey % 4 when 0 then 'ab' || c_custkey || '.txt' when 1 then 'y .md' when 2 then 'dropped' else repeat('n', 80) || '.pdf' end as name from customer",
    "note_tags": f"""with {NOTES} select note, case when lower(split_part(folder, '/', 1)) = 'x' then '' else split_part(folder, '/', 1) end || ',' || replace(lower(split_part(folder, '/', 2)), '#', '-') || ',own-tag' as tags, note % 3 = 2 as usable from notes""",
    "measured_steps": f"""with {STEPS}, x as (select project, case when step = 1 then greatest(1, least(1440, minutes * 40)) when step < 4 and minutes * 20 - 100 > 0 then least(720, minutes * 20 - 100) end as m from steps)
        select project, count(m) as timed, cast(sum(m) as bigint) as minutes from x group by project""",
    "settled_deadlines": f"""with {NOTES}, x as (select *, case note % 4 when 0 then deadline when 1 then updated end as said from notes), y as (select *, said is not null and (deadline is null or said <> deadline) as other from x)
        select note, case when other then said else deadline end as deadline, case when other then 'llm' when deadline is not null then kind end as kind, not other and deadline is not null and kind in ('explicit', 'exact', 'manual') as confirmed from y""",
    "habit_checkins": f"""with {NOTES} select note, case note % 3 when 0 then created + 1 when 1 then created + cast(case when isodow(created) = 7 then 7 else 7 - isodow(created) end as int) else cast(date_trunc('month', created) + interval 1 month as date) end as "on" from notes""",
    "answered_status": f"with {CARDS} select status, case when lapses >= 8 then 'suspended' when status = 'draft' then 'active' else status end as after, count(*) as cards from cards group by all",
    "folder_choices": f"select c_custkey as ask, ([{', '.join(repr(h) for _, h in NAMES)}])[c_custkey % {len(NAMES)} + 1] as how from customer",
    "marked_titles": f"with {NOTES} select note, case when note % 2 = 0 or note % 5 > 0 then '* ' else '' end || title as title from notes",
}
