"""Verdicts, mentions, habits and panels as SQL over the same tables."""

from __future__ import annotations

from .oracle import PROJECTS, STEPS
from .oracle_library import NOTES
from .verdicts import CHOICES, LINES

_LINKS = """v as (select vec_id, embedding::double[] as e from embeddings),
  s as (select a.vec_id as note, b.vec_id as target, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) as score from v a, v b),
  first_ as (select * from s qualify row_number() over (partition by note order by score desc, target) <= 24),
  scored as (select * from first_ where score >= 0.35 and note <> target and not (note % 2 = 0 and target between note + 1 and note + 6)),
  near as (select * from scored qualify row_number() over (partition by note order by score desc, target) <= 12),
  placed as (select *, row_number() over (partition by note order by score desc, target) as place from near),
  linked as (select note, target, case when score >= 0.62 then 'sure' else 'ask' end as tier from placed where place <= 5)"""

SQL = {
    "choice_verdicts": f"select c_custkey as card, ([{', '.join(repr(v) for _, _, v in CHOICES)}])[c_custkey % {len(CHOICES)} + 1] as verdict from customer",
    "glossary_lines": f"""with k as (select [{', '.join(str(int(x)) for _, x in LINES)}] as k), x as (select p_partkey as note, k[p_partkey % {len(LINES)} + 1] + k[(p_partkey + 1) % {len(LINES)} + 1] + k[(p_partkey + 2) % {len(LINES)} + 1] as entries from part, k)
        select note, 3 as lines, entries, round(entries / 3, 3) as share, entries / 3 >= 0.75 as glossary from x""",
    "answer_overlap": """with x as (select (1 + (c_custkey % 2 = 0)::int + (c_custkey % 3 = 0)::int + (c_custkey % 5 = 0)::int) / 4 as share from customer)
        select share, case when share >= 0.5 then 'sound' when share >= 0.2 then 'partial' else 'off' end as verdict, case when share >= 0.7 then 3 when share >= 0.4 then 2 else 1 end as grade, count(*) as n from x group by share""",
    "related_notes": f"with {_LINKS} select note, target, score from near",
    "suggested_links": f"with {_LINKS} select note, target, tier from linked",
    "link_tiers": f"with {_LINKS} select tier, count(*) as links, count(distinct note) as notes from linked group by tier",
    "habit_streaks": """with l as (select user_id as note, cast(ts as date) as d, case user_id % 3 when 0 then 'day' when 1 then 'week' else 'month' end as unit, 1 + user_id % 3 as target from events where user_id % 7 <> 0 or cast(ts as date) < date '2024-01-12'),
        c as (select note, unit, target, cast(date_trunc(unit, d) as date) as period, count(*) as n from l group by all), f as (select note, unit, target, min(period) as first from c group by all),
        p as (select f.*, cast(unnest(generate_series(cast(first as timestamp), date '2024-02-20', case unit when 'day' then interval 1 day when 'week' then interval 7 day else interval 1 month end)) as date) as period from f),
        q as (select *, row_number() over (partition by note order by period desc) as back from p where period < date_trunc(unit, date '2024-02-20')),
        r as (select q.note, q.unit, q.back, coalesce(c.n, 0) >= q.target as hit from q left join c on c.note = q.note and c.period = q.period where back <= 12),
        s as (select note, count(*) as periods, count(*) filter (hit) as hits, min(back) filter (hit) as last from r group by note)
        select f.note, case f.unit when 'day' then 'daily' when 'week' then 'weekly' else 'monthly' end as cadence, coalesce(periods, 0) as periods, coalesce(hits, 0) as hits, coalesce(last - 1, periods, 0) as misses_in_row, coalesce(last - 1, periods, 0) >= 2 as alert from f left join s using (note)""",
    "intentions": """with x as (select c_custkey as note, c_custkey % 2 = 0 as c, c_custkey % 3 = 0 as b, case when c_custkey % 5 = 0 then ' at the park' else '' end as p, c_custkey % 7 = 0 as a from customer)
        select note, case when c and b then 'When I wake, I will run' || p || '.' when a and b then 'Right after coffee, I will run' || p || '.' when c then 'When I wake — this is the cue.' when a and not b then 'Right after coffee — this is the cue.' else '' end as line from x""",
    "weekly_panels": f"""with {STEPS}, {PROJECTS}, {NOTES}, live as (select * from projects where status <> 'done'), todo as (select distinct project from steps where not done),
        c as (select 'next' as panel, count(*) as rows from projects join todo using (project) where status = 'active'
          union all select 'upcoming', (select count(*) from live where deadline <= date '1998-08-16') + (select count(*) from steps join live using (project) where not done and scheduled between date '1998-08-02' and date '1998-08-16')
          union all select 'slipped', count(*) from steps join live using (project) where not done and scheduled < date '1998-08-02'
          union all select 'reviews', count(*) from notes where bucket = 'resource' and created + 90 <= date '2024-01-31' union all select 'inbox', count(*) from notes where bucket = 'inbox' union all select 'nothing', 0)
        select panel, rows, rows = 0 as empty from c""",
}
