"""The queries as SQL over the same tables."""

from __future__ import annotations

from ..functions.memory import WEIGHTS as w
from ..functions.text import STOP_WORDS
from ..operators import statistics, study

REVIEWS = """reviews as (select user_id as card, ts as "at", event_id as ord,
  case event_type when 'error' then 1 when 'signup' then 2 when 'purchase' then 4 else 3 end as grade,
  least(1.0, value / 200) as confidence, least(120.0, value) as seconds, cast(ts as date) as day, epoch(ts) / 86400.0 as t from events)"""
STEPS = """steps as (select l_orderkey as project, l_linenumber as step, cast(trunc(l_quantity) as int) as minutes,
  cast(round(l_quantity * (1 + 10 * l_discount + l_tax)) as int) as actual, l_linestatus = 'F' as done, cast(l_shipdate as date) as scheduled from lineitem)"""
PROJECTS = """projects as (select o_orderkey as project, cast(o_orderdate as date) + 30 as deadline, 6 - cast(substr(o_orderpriority, 1, 1) as int) as level,
  case o_orderstatus when 'F' then 'done' when 'P' then 'blocked' else 'active' end as status from orders)"""
LINKS = """links as (select distinct page_id as src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as dst from pages)"""
TERMS = f"""words as (select distinct doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{2,}}')) as term from documents),
terms as (select * from words where term not in ({', '.join(repr(x) for x in STOP_WORDS)}))"""
CLASSES = f"""timed as (select level, minutes, actual, actual / minutes as ratio from steps join projects using (project) where done and minutes > 0),
both_ as (select level, count(*) as n, round(median(ratio), 3) as median_ratio, sum(minutes) as estimated, sum(actual) as actual
  from timed where ratio > 0 and ratio < {statistics.OUTLIER} group by grouping sets ((), (level))),
classes as (select case when level is null then 'all' else 'level ' || level end as class, level, n, median_ratio, cast(estimated as bigint) as estimated, cast(actual as bigint) as actual,
  n >= 5 as enough, case when n >= 5 then greatest(0.5, least(3.0, median_ratio)) else 1.0 end as multiplier from both_)"""
_FIRST_D = f"greatest(1, least(10, {w[4]} - exp({w[5]} * (grade - 1)) + 1))"
_EASY_D = f"greatest(1, least(10, {w[4]} - exp({w[5]} * 3) + 1))"
_NEXT_D = f"greatest(1, least(10, {w[7]} * {_EASY_D} + {1 - w[7]} * (d - {w[6]} * (grade - 3) * (10 - d) / 9)))"
STATES = f"""{REVIEWS}, numbered as (select card, t, grade, row_number() over (partition by card order by t, ord) as i from reviews),
fold as (
  select card, 1 as i, t, raw, round(raw, 4) as s, round(d, 4) as d, lapses, last_grade from
    (select card, t, (case grade when 1 then {w[0]} when 2 then {w[1]} when 3 then {w[2]} else {w[3]} end)::double as raw, ({_FIRST_D})::double as d, (grade = 1)::int as lapses, grade as last_grade from numbered where i = 1)
  union all
  select card, i, t, raw, round(raw, 4), round(nd, 4), lapses, grade from (select card, i, t, greatest(0.01, case when e < 1 then s * exp({w[17]} * (grade - 3 + {w[18]}))
    when grade = 1 then least(s, {w[11]} * pow(nd, {-w[12]}) * (pow(s + 1, {w[13]}) - 1) * exp({w[14]} * (1 - r)))
    else s * (1 + exp({w[8]}) * (11 - nd) * pow(s, {-w[9]}) * (exp({w[10]} * (1 - r)) - 1) * case grade when 2 then {w[15]} when 4 then {w[16]} else 1 end) end)::double as raw, nd::double as nd, lapses + (grade = 1)::int as lapses, grade
  from (select n.card, n.i, n.t, n.grade, f.s, f.lapses, n.t - f.t as e, pow(1 + 19.0 / 81 * (n.t - f.t) / f.s, -0.5) as r, {_NEXT_D} as nd
    from fold f join numbered n on n.card = f.card and n.i = f.i + 1))),
states as (select card, i as reps, t as last, s, d, lapses, case when last_grade = 1 then 1 else greatest(1, cast(round_even(least(3650.0, raw / (19.0 / 81) * (pow(0.9, -2) - 1)), 0) as int)) end as "interval"
  from fold qualify row_number() over (partition by card order by i desc) = 1),
cards as (select *, date '1970-01-01' + cast(floor(last) as int) + "interval" as due from states)"""

SQL = {
    "study_daily": f"""with {REVIEWS} select day, count(*) as reviews, round(sum(seconds) / 60, 1) as minutes, count(*) filter (grade = 1) as again,
        count(*) filter (grade = 2) as hard, count(*) filter (grade = 3) as good, count(*) filter (grade = 4) as easy from reviews group by day""",
    "study_calendar": f"""with {REVIEWS}, days as (select cast(unnest(generate_series(date '2024-01-31' - 181, date '2024-01-31', interval 1 day)) as date) as day)
        select d.day, count(r.card) as reviews from days d left join reviews r using (day) group by d.day""",
    "study_accuracy": f"""with {REVIEWS} select count(*) as reviews, count(distinct day) as days, count(*) filter (day > date '2024-01-31' - 30) as recent,
        round(avg(case when grade >= 2 then 1.0 else 0.0 end) filter (day > date '2024-01-31' - 30), 4) as accuracy_30d from reviews""",
    "card_streaks": f"""with {REVIEWS}, d as (select distinct card, day from reviews), i as (select card, day, day - cast(row_number() over (partition by card order by day) as int) as island from d),
        runs as (select card, count(*) as n, max(day) as last from i group by card, island)
        select card, coalesce(max(n) filter (last between date '2024-01-30' and date '2024-01-31'), 0) as streak, max(n) as longest_streak from runs group by card""",
    "card_states": f"""with recursive {STATES} select card, round(s, 6) as stability, round(d, 6) as difficulty, reps, lapses, "interval", due from cards""",
    "deck_progress": f"""with recursive {STATES}, x as (select *, reps >= {study.MATURE_REPS} and s >= {study.MATURE_DAYS} as mature_,
          pow(1 + 19.0 / 81 * greatest(0, date_diff('day', date '1970-01-01', date '2024-01-31') - last) / s, -0.5) as known from cards)
        select card % 10 as deck, count(*) as active, count(*) filter (mature_) as mature, round(count(*) filter (mature_) / count(*), 3) as mastery, round(avg(known), 3) as retention,
          count(*) filter (due <= date '2024-01-31') as due, min(due) as next_due, count(*) >= 6 and count(*) filter (mature_) / count(*) >= 0.85 as ready from x group by 1""",
    "load_forecast": f"""with recursive {STATES}, days as (select cast(unnest(generate_series(date '2024-01-31', date '2024-02-13', interval 1 day)) as date) as day)
        select d.day, count(c.card) as cards from days d left join cards c on greatest(c.due, date '2024-01-31') = d.day group by d.day""",
    "seconds_per_review": f"""with {REVIEWS} select count(*) as n, case when count(*) >= 30 then round(median(seconds), 4) else 12.0 end as seconds from reviews where seconds between 1 and 120""",
    "retention_curve": f"""with recursive {STATES}, p as (select r as retention, sum(1 / (s / (19.0 / 81) * (pow(r, -2) - 1))) as per_day, count(*) * r as known
          from cards, (select unnest([{', '.join(map(str, study.RETENTION_GRID))}])::double as r) g group by r), m as (select *, per_day * 12 / 60 as minutes from p)
        select retention, round(per_day, 4) as per_day, round(minutes, 4) as minutes, round(known, 4) as known, round(known / minutes, 4) as known_per_minute,
          row_number() over (order by known / minutes desc, retention) = 1 as optimal from m""",
    "fit_log_loss": f"""with recursive {STATES}, x as (select b.s, a.t - b.t as elapsed, a.last_grade as grade from fold a join fold b on a.card = b.card and a.i = b.i + 1),
        y as (select grade, greatest(1e-9, least(1 - 1e-9, pow(1 + 19.0 / 81 * elapsed / greatest(1e-6, s), -0.5))) as p from x where elapsed > 0)
        select count(*) as n, round(avg(case when grade >= 3 then -ln(p) else -ln(1 - p) end), 6) as log_loss from y""",
    "latest_review": f"""with {REVIEWS} select card, "at", ord, grade from reviews qualify row_number() over (partition by card order by "at" desc, ord desc) = 1""",
    "calibration_bins": f"""with {REVIEWS}, bins as (select * from (values {', '.join(f'({lo}::double, {hi}::double)' for lo, hi in statistics.BINS)}) b(low, top))
        select low, least(top, 1.0::double) as high, count(card) as n, round(avg(confidence), 4) as predicted, round(avg(case when grade >= 3 then 1.0 when grade is not null then 0.0 end), 4) as actual
        from bins left join reviews on confidence >= low and confidence < top group by low, top""",
    "calibration_summary": f"""with {REVIEWS}, x as (select confidence as c, (grade >= 3)::int::double as hit from reviews where confidence is not null)
        select count(*) as n, round(avg(pow(c - hit, 2)), 4) as brier, round(avg(c), 4) as mean_confidence, round(avg(hit), 4) as mean_accuracy,
          count(*) filter (c >= 0.8 and hit = 0) as overconfident, count(*) filter (c <= 1 - 0.8::double and hit = 1) as underconfident from x""",
    "overconfident_cards": f"""with {REVIEWS} select card, count(*) as times, max("at") as last, round(max(confidence), 4) as confidence from reviews
        where confidence >= 0.8 and grade < 3 group by card order by times desc, last, card limit 25""",
    "reference_classes": f"with {STEPS}, {PROJECTS}, {CLASSES} select * from classes",
    "adjusted_estimates": f"""with {STEPS}, {PROJECTS}, {CLASSES}, open_ as (select level, minutes from steps join projects using (project) where not done),
        x as (select o.level, o.minutes, cast(round(o.minutes * coalesce(c.multiplier, (select multiplier from classes where level is null and enough), 1.0)) as int) as adjusted
          from open_ o left join classes c on c.level = o.level and c.enough)
        select level, count(*) as steps, cast(sum(minutes) as bigint) as estimated, cast(sum(adjusted) as bigint) as adjusted from x group by level""",
    "project_accuracy": f"""with {STEPS} select project, count(*) as steps, cast(sum(minutes) as bigint) as estimated, cast(sum(actual) as bigint) as actual, floor(sum(actual) / sum(minutes) * 100 + 0.5) / 100 as ratio
        from steps where done and minutes > 0 and actual > 0 group by project""",
    "threshold_sweep": """with pairs as (select least(1.0, n_chars / 4000.0) as score, quality = 1 as correct from labels join documents using (doc_id)),
        c as (select round(0.30 + 0.02 * i, 2)::double as cutoff from range(35) t(i)),
        p as (select cutoff, count(*) filter (score >= cutoff) as accepted, count(*) filter (score >= cutoff and correct) as right_, count(*) as n, count(*) filter (correct) as positives from c, pairs where score is not null group by cutoff),
        q as (select *, case when accepted > 0 then round(right_ / accepted, 4) end as precision_, case when positives > 0 then round(right_ / positives, 4) end as recall from p)
        select cutoff, accepted, right_ as right, n - accepted as asks, precision_ as precision, recall, case when precision_ > 0 and recall > 0 then round(2 * precision_ * recall / (precision_ + recall), 4) end as f1,
          coalesce(cutoff = (select min(cutoff) from q where precision_ >= 0.9), false) as recommended, n >= 40 as enough, n >= 25 as usable from q""",
    "term_frequency": f"with {TERMS} select term, count(*) as df from terms group by term",
    "search_topk": f"""with {TERMS}, total as (select count(*) as n from documents), freq as (select term, count(*) as df from terms group by term),
        asked as (select distinct item_id as question, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) as term from benchmark),
        q as (select question, term, df, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 as weight from asked left join freq using (term), total where term not in ({', '.join(repr(x) for x in STOP_WORDS)})),
        t as (select question, sum(weight) filter (df is not null) as known, sum(weight) as whole from q group by question),
        s as (select question, doc_id, round(sum(weight) / any_value(known), 9) as score, any_value(known / whole) as answerable from q join terms using (term) join t using (question) group by question, doc_id)
        select question, row_number() over (partition by question order by score desc, doc_id) as rank, doc_id, score from s where score >= 0.34 and score * answerable >= 0.19
        qualify row_number() over (partition by question order by score desc, doc_id) <= 6""",
    "vector_topk": """with v as (select vec_id, label, embedding::double[] as e from embeddings),
        s as (select q.vec_id as query, v.vec_id as id, v.label, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) as score from v q, v where q.vec_id % 100 = 0),
        c as (select * from s qualify row_number() over (partition by query, label order by score desc, id) <= 2)
        select query, row_number() over (partition by query order by score desc, id) as rank, id, score from c qualify row_number() over (partition by query order by score desc, id) <= 6""",
    "retrieval_quality": """with v as (select vec_id, label, embedding::double[] as e from embeddings),
        s as (select q.vec_id as query, q.label as own, v.vec_id as id, v.label, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) as score from v q, v where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query order by score desc, id) as rank from s),
        f as (select query, min(rank) filter (rank <= 6 and label = own and id <> query) as first from r group by query)
        select count(*) as queries, round(avg(coalesce(1.0 / first, 0)), 4) as mrr, round(avg(coalesce((first <= 1)::int, 0)), 4) as hit_1, round(avg(coalesce((first <= 3)::int, 0)), 4) as hit_3, round(avg(coalesce((first <= 5)::int, 0)), 4) as hit_5 from f""",
    "link_in_degree": f"with {LINKS} select dst, count(*) as sources, min(src) as first_source from links group by dst",
    "link_siblings": f"with {LINKS}, n as (select dst, count(*) - 1 as others from links group by dst) select src, count(*) as targets, cast(sum(others) as bigint) as shared_links from links join n using (dst) group by src",
    "duplicate_titles": r"""with x as (select doc_id, trim(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents)
        select slug, count(*) as notes, min(doc_id) as first_note from x where slug <> '' group by slug having count(*) > 1""",
    "project_urgency": f"""with {STEPS}, {PROJECTS}, load as (select project, sum(case when done then 0 else minutes end) as remaining from steps group by project),
        x as (select project, date_diff('day', date '1998-08-02', deadline) as left_, coalesce(remaining, 0) as remaining from projects left join load using (project) where status <> 'done')
        select project, case when left_ < 0 then 1.0 else round_even(least(1.0, 0.6::double * (1.0::double / (1.0::double + left_ / 3.0::double)) + 0.4::double * least(1.0, remaining / (greatest(1, left_) * 180))), 4) end as urgency from x""",
    "next_actions": f"""with {STEPS}, {PROJECTS}, load as (select project, sum(minutes) as remaining from steps where not done group by project),
        n as (select project, step, minutes, scheduled from steps where not done qualify row_number() over (partition by project order by scheduled is null, scheduled, step, minutes) = 1),
        x as (select project, deadline, step, minutes, scheduled, date_diff('day', date '1998-08-02', deadline) as left_, remaining from projects join load using (project) join n using (project) where status = 'active')
        select project, deadline, step, minutes, scheduled, case when left_ < 0 then 1.0 else round_even(least(1.0, 0.6::double * (1.0::double / (1.0::double + left_ / 3.0::double)) + 0.4::double * least(1.0, remaining / (greatest(1, left_) * 180))), 4) end as urgency
        from x order by urgency desc, project limit 10""",
    "upcoming": f"""with {STEPS}, {PROJECTS}, live as (select * from projects where status <> 'done')
        select project, 'deadline' as kind, deadline as "on", null::int as step from live where deadline <= date '1998-08-16'
        union all select project, 'block', scheduled, step from steps join live using (project) where not done and scheduled between date '1998-08-02' and date '1998-08-16'""",
    "habit_misses": """with weeks as (select user_id as note, cast(date_trunc('week', ts) as date) as week, count(*) as n from events group by all),
        f as (select note, min(week) as first, coalesce(max(n) filter (week = date '2024-01-29'), 0) as current from weeks group by note),
        b as (select f.*, back, n from f left join range(1, 13) t(back) on first <= date '2024-01-29' - cast(back * 7 as int) left join weeks w on w.note = f.note and w.week = date '2024-01-29' - cast(back * 7 as int)),
        g as (select note, max(current) as current, count(back) as periods, count(*) filter (n >= 3) as hits, min(back) filter (n >= 3) as last_hit from b group by note)
        select note, current, periods, hits, coalesce(last_hit - 1, periods) as misses_in_row, coalesce(last_hit - 1, periods) >= 2 as alert from g""",
    "habit_stability": """with x as (select user_id as note, event_id as ord, hour(ts) * 60 + minute(ts) as m, hour(ts) as h, event_type as place from events),
        hh as (select note, h, count(*) as n, min(ord) as seen from x group by note, h qualify row_number() over (partition by note order by n desc, seen) = 1),
        pp as (select note, place, count(*) as n, min(ord) as seen from x group by note, place qualify row_number() over (partition by note order by n desc, seen) = 1),
        a as (select x.note, count(*) as n, any_value(hh.h) as hour, count(*) filter (abs(m - (hh.h * 60 + 30)) <= 90) as near from x join hh using (note) group by x.note)
        select note, a.n, hour, round(near / a.n, 3) as time_share, place, round(pp.n / a.n, 3) as place_share, a.n >= 4 as enough from a join pp using (note)""",
}
