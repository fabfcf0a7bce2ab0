"""Queries on what a day asks for and what requests do, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import memory
from ..operators import doings, planning, upkeep, vault
from ..sources import views
from .library import PROJECT_TODAY, TODAY, decks_of, note_dates
from .oracle import PROJECTS, STEPS
from .oracle import SQL as FIRST
from .oracle_library import CARDS, NOTES

BUCKETS = ["inbox", "project", "area", "resource", "archive"]


def card_study(spark, d):
    """How each card is asked: its lane, what is known of it, and whether its last grade is to be explained."""
    c = views.cards(spark, d).withColumn("s", F.col("reps") * 3.5)
    now = F.unix_date(F.to_date(F.lit(TODAY)))
    gone = doings.elapsed_days(F.unix_date("last"), now)
    topic = F.when(F.col("card") % 3 == 0, F.concat(F.lit(" topic "), F.col("card") % 4, F.lit(" ")))
    known = F.when(F.col("s") > 0, F.round(memory.retrievability(F.col("s"), gone), 6)).otherwise(F.lit(0.0))
    return c.select("card", doings.lane(F.col("note"), topic).alias("lane"), gone.alias("gone"), known.alias("known"), doings.wants_explanation(F.when(F.col("card") % 5 > 0, (F.col("card") % 5).cast("int"))).alias("explain"))


def worked_examples(spark, d):
    """Conversations' turns as worked examples, line by line, at several stages of a card."""
    c = views.table(spark, d, "conversations")
    lines = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")
    shown = doings.worked_example(lines, F.col("turn") % 5, (F.col("conv_id") % 10) / 10)
    return c.select("conv_id", "turn", F.size(shown).alias("lines"), F.sha2(F.array_join(shown, " "), 256).alias("shown"))


def decks_to_make(spark, d):
    return doings.decks_to_make(views.notes(spark, d), decks_of(spark, d), []).select("note", "cards", "why")


def filed_terms(spark, d):
    """Words of documents as glossary entries, against the terms that some documents have filed before."""
    docs = views.table(spark, d, "documents")
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    entries = docs.select(F.col("doc_id").alias("ord"), F.get(w, F.lit(0)).alias("term"), F.when(F.col("doc_id") % 3 > 0, F.get(w, F.lit(5))).alias("definition"))
    known = docs.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("note"), F.get(w, F.lit(1)).alias("title"), (F.col("doc_id") % 8 == 0).alias("defined")).filter("title is not null")
    return doings.filed_terms(entries.filter("term is not null"), known).select("ord", "term", "action", "note", F.array_join("tags", ",").alias("tags"))


def filed_notes(spark, d):
    e = views.table(spark, d, "events").withColumn("note", F.col("event_id") % 700)
    held = e.filter("event_type in ('view', 'click')").select("note", F.col("event_type").alias("guess"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"))
    chosen = e.filter("event_type <> 'view'").select("note", F.col("event_type").alias("bucket"), F.col("event_id").alias("ord"))
    return doings.filed_notes(held, chosen)


def committed_rows(spark, d):
    c = views.table(spark, d, "conversations")
    bucket = F.when(F.col("turn") % 5 == 0, "nowhere").when(F.col("turn") % 2 == 0, " Project ").otherwise("area")
    due = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("2024-02-"), F.lpad((F.col("conv_id") % 35).cast("string"), 2, "0")))
    rows = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item"), F.when(F.col("turn") % 7 > 0, F.col("text")).alias("text"), bucket.alias("bucket"), due.alias("due"))
    return doings.committed(rows, BUCKETS)


def week_ahead(spark, d):
    """The panels of the coming week, each with its size, however few of its rows it shows."""
    n, p, s = views.notes(spark, d), views.projects(spark, d), views.steps(spark, d)
    habits = n.filter("bucket = 'area'").select("note", F.when(F.col("note") % 3 > 0, F.col("updated")).alias("last"))
    late = upkeep.overdue_steps(p, s, PROJECT_TODAY, None)
    parts = [
        doings.panel("actions", planning.next_actions(p, s, PROJECT_TODAY, None), "project", "deadline", 8, [-F.col("urgency")]),
        doings.panel("upcoming", planning.upcoming(p, s, PROJECT_TODAY, 7), "project", "on"),
        doings.panel("slipped", late, "project", "scheduled", 12, [-F.col("days")]),
        doings.panel("reviews", vault.reviews_due(note_dates(spark, d), views.cards(spark, d), TODAY), "note", "due"),
        doings.panel("checkins", doings.checkins(habits, TODAY), "note", "last"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("panel").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"), F.min("on").alias("first"))


def habit_advice(spark, d):
    log = views.habit_log(spark, d)
    steady = planning.habit_stability(log).select("note", "enough", "time_share")
    rows = planning.habit_misses(log, TODAY).select("note", F.col("misses_in_row").alias("misses")).join(steady, "note")
    part = lambda n, text: F.when(F.col("note") % n > 0, text)
    return doings.habit_advice(rows.withColumns({"cue": part(2, "I wake"), "behaviour": part(3, "run"), "anchor": part(5, "coffee"), "easier": part(7, " ")}))


def session_summaries(spark, d):
    c = views.table(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000)
    sessions = c.select(F.col("conv_id").alias("session"), at.alias("started"), (at + F.expr("make_interval(0, 0, 0, 0, 0, 0, conv_id % 50 * 77 - 30)")).alias("ended")).distinct()
    captured = c.filter("conv_id % 6 > 0").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.substring("text", 1, 12).alias("title"), (F.col("turn") % 2 == 0).alias("term"), (F.col("turn") % 3 == 0).alias("defined"))
    return doings.session_summary(sessions, captured)


def option_orders(spark, d):
    """Choice cards of customers: the options come in an order of their own, whatever order they were given in."""
    c = views.dealt(views.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    given = F.array(F.lit("Red"), F.col("c_name"), F.lit("blue "), F.lit("RED"))
    one, other = (doings.shuffled_options(F.col("c_custkey"), x, F.col("c_mktsegment")) for x in (given, F.reverse(F.transform(given, lambda x: F.initcap(x)))))
    return c.select("c_custkey", F.size(one).alias("options"), F.array_contains(one, F.col("c_mktsegment")).alias("holds"), (F.size(other) == F.size(one)).alias("same"))


def edited_cards(spark, d):
    """Turns of conversations as cards, and customers' edits of them."""
    c = views.table(spark, d, "conversations")
    cards = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("card"), F.substring("text", 1, 20).alias("front"), F.substring("text", 21, 20).alias("back"), F.lit(None).cast("string").alias("hint"), F.col("role").alias("source"), F.when(F.col("turn") % 2 == 0, "draft").otherwise("active").alias("status"))
    i = F.col("c_custkey")
    edits = views.table(spark, d, "customer").select((i % 40 * 100 + i % 3).alias("card"), i.alias("ord"), F.when(i % 2 == 0, F.concat(F.lit(" "), "c_name")).alias("front"), F.when(i % 5 == 0, F.col("c_mktsegment")).alias("back"), F.lit(None).cast("string").alias("hint"), F.lit(None).cast("string").alias("source"), F.when(i % 7 == 0, "suspended").when(i % 7 == 1, "lost").alias("status"), (i % 97 == 0).alias("deleted"))
    return doings.edited_cards(cards, edits)


def approved_cards(spark, d):
    c = views.cards(spark, d)
    asked = c.select("note").distinct().filter("note % 3 <> 0").select("note", F.when(F.col("note") % 3 == 1, F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: (i * 14).cast("long"))).alias("cards"))
    return doings.approved(c.select("card", "note", "status"), asked)


def graduating_notes(spark, d):
    n = views.notes(spark, d).filter("bucket = 'project'").select("note", F.when(F.col("note") % 2 == 0, "graduating").otherwise("active").alias("status"))
    stuck = views.cards(spark, d).groupBy((F.col("note") * 5 + 1).alias("note")).agg(F.round(F.count_if(F.col("reps") >= 4) / F.count(F.lit(1)), 3).alias("mastery")).filter("mastery > 0.5")
    return doings.graduating(n, stuck)


def queries() -> dict:
    return {f.__name__: f for f in (card_study, worked_examples, decks_to_make, filed_terms, filed_notes, committed_rows, week_ahead, habit_advice, session_summaries, option_orders, edited_cards, approved_cards, graduating_notes)}


_W = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')"
SQL = {
    "card_study": f"""with {CARDS}, x as (select *, case when c_custkey % 9 > 0 then due - 10 end as last, reps * 3.5::double as sd from (select *, card as c_custkey from cards))
        select card, note || case when card % 3 = 0 then '::topic ' || card % 4 else '' end as lane, case when last is null then 0.0 else greatest(0, date '2024-01-31' - last) end::double as gone,
          case when sd > 0 then round(pow(1 + 19.0 / 81 * coalesce(greatest(0, date '2024-01-31' - last), 0) / sd, -0.5), 6) else 0 end::double as known, card % 5 in (1, 2) as explain from x""",
    "worked_examples": r"""with x as (select conv_id, turn, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as ls from conversations),
        y as (select conv_id, turn, case when conv_id % 10 >= 6 or turn % 5 >= 3 then [] when turn % 5 = 0 then ls else ls[1:cast(ceil(len(ls) / 2) as int)] end as ls from x) select conv_id, turn, len(ls) as lines, sha256(coalesce(array_to_string(ls, ' '), '')) as shown from y""",
    "decks_to_make": f"""with {NOTES}, c as (select c_nationkey as note, count(*) as n from customer group by 1)
        select notes.note, coalesce(n, 0) as cards, case when bucket = 'project' and status = 'done' then 'project already done' when words < 40 then 'only ' || words || ' words' when n > 0 then 'already has ' || n || ' cards' else '' end as why from notes left join c on c.note = notes.note where bucket in ('project', 'resource')""",
    "filed_terms": f"""with e as (select doc_id as ord, {_W}[1] as term, case when doc_id % 3 > 0 then {_W}[6] end as definition from documents), k as (select lower({_W}[2]) as name, doc_id as note, doc_id % 8 = 0 as defined from documents where doc_id % 4 = 0),
        b as (select name, note, defined from k where name is not null qualify row_number() over (partition by name order by defined desc, note) = 1),
        x as (select e.*, b.note, b.defined, row_number() over (partition by lower(term) order by ord) as i, count(definition) over (partition by lower(term) order by ord) as told from e left join b on b.name = lower(term) where term is not null),
        y as (select *, case when note is null and i = 1 then 'create' when not coalesce(defined, false) and definition is not null and told = 1 then 'define' else 'skip' end as action from x)
        select ord, term, action, note, case when action = 'create' then case when definition is null then 'term,needs-definition' else 'term' end end as tags from y""",
    "filed_notes": """with e as (select *, event_id % 700 as note from events), h as (select note, min_by(event_type, event_id) as guess, min_by(value, event_id) as confidence from e where event_type in ('view', 'click') group by note),
        c as (select note, max_by(event_type, event_id) as bucket, count(distinct event_type) > 1 as changed from e where event_type <> 'view' group by note) select note, bucket, confidence, changed, bucket = guess as agreed from h join c using (note)""",
    "committed_rows": """with x as (select conv_id || '/' || turn as item, case when turn % 7 > 0 then text end as text, case when turn % 5 = 0 then 'nowhere' when turn % 2 = 0 then 'project' else 'area' end as bucket, case when conv_id % 3 = 0 then '2024-02-' || lpad(cast(conv_id % 35 as varchar), 2, '0') end as due from conversations),
        y as (select *, case when trim(coalesce(text, '')) = '' then 'no text' when bucket = 'nowhere' then 'no such bucket: nowhere' when due is not null and try_strptime(due, '%Y-%m-%d') is null then 'not a date: ' || due end as error from x)
        select item, case when error is null then bucket end as bucket, error from y""",
    "week_ahead": f"""with na as ({FIRST["next_actions"].replace(" limit 10", "")}), {STEPS}, {PROJECTS}, {NOTES}, live as (select * from projects where status <> 'done'), todo as (select distinct project from steps where not done), t as (select date '1998-08-02' as d),
        l as (select s.*, date '1998-08-02' - scheduled as days from steps s join live using (project) where not done and scheduled < date '1998-08-02'),
        r as (select note, created + 90 as due from notes where bucket = 'resource' and created + 90 <= date '2024-01-31'), h as (select case when note % 3 > 0 then updated end as last from notes where bucket = 'area' and (note % 3 = 0 or date '2024-01-31' - updated >= 7)),
        u as (select deadline as d from live where deadline <= date '1998-08-09' union all select scheduled from steps join live using (project) where not done and scheduled between date '1998-08-02' and date '1998-08-09')
        select 'upcoming' as panel, count(*) as rows, count(*) as size, min(d) as first from u union all select 'reviews', count(*), count(*), min(due) from r union all select 'checkins', count(*), count(*), min(last) from h
        union all select 'slipped', least(12, (select count(*) from l)), (select count(*) from l), (select min(scheduled) from l)
        union all select 'actions', least(8, count(*)), count(*), (select min(deadline) from (select deadline from na order by urgency desc, project limit 8)) from projects join todo using (project) where status = 'active'""",
    "habit_advice": f"""with m as ({FIRST["habit_misses"]}), s as ({FIRST["habit_stability"]}), x as (select note, unnest(list_filter([case when note % 2 = 0 or note % 3 = 0 then 'intention' end, case when note % 5 = 0 then 'anchor' end, 'easier',
          case when misses_in_row >= 2 then 'target_count' end, case when enough and coalesce(time_share, 1) < 0.6 then 'schedule' end], lambda f: f is not null)) as field, unnest(range(0, 5)) as i from m join s using (note)) select note, cast(i as int) as place, field from x where field is not null""",
    "session_summaries": """with s as (select distinct conv_id as session, cast(greatest(0, floor((conv_id % 50 * 77 - 30) / 60)) as int) as minutes from conversations), c as (select conv_id as session, turn, substring(text, 1, 12) as title, turn % 2 = 0 as term, turn % 3 = 0 as defined from conversations where conv_id % 6 > 0),
        t as (select session, string_agg('- [[' || title || ']]' || case when defined then '' else '  — no definition yet' end, chr(10) order by turn) filter (term) as terms, string_agg('- [ ] [[' || title || ']]', chr(10) order by turn) filter (term and not defined) as undefined, string_agg('- [[' || title || ']]', chr(10) order by turn) filter (not term) as notes from c group by session)
        select s.session, minutes, coalesce(terms, '') as terms, coalesce(undefined, '') as undefined, coalesce(notes, '*Nothing was captured in this session.*') as notes from s left join t on t.session = s.session""",
    "edited_cards": """with c as (select conv_id * 100 + turn as card, substring(text, 1, 20) as front, substring(text, 21, 20) as back, null::varchar as hint, role as source, case when turn % 2 = 0 then 'draft' else 'active' end as status from conversations),
        e as (select c_custkey % 40 * 100 + c_custkey % 3 as card, c_custkey as i, case when c_custkey % 2 = 0 then c_name end as front, case when c_custkey % 5 = 0 then c_mktsegment end as back, case c_custkey % 7 when 0 then 'suspended' when 1 then 'lost' end as status from customer),
        g as (select card, max_by(front, i) filter (front is not null and coalesce(status, '') <> 'lost') as f, max_by(back, i) filter (back is not null and coalesce(status, '') <> 'lost') as b, max(status) filter (status = 'suspended') as s, bool_or(i % 97 = 0) as gone, case when bool_or(status = 'lost') then 'unknown card status lost' end as error from e group by card)
        select c.card, coalesce(f, front) as front, coalesce(b, back) as back, hint, source, coalesce(s, status) as status, error from c left join g on g.card = c.card where not coalesce(gone, false)""",
    "approved_cards": f"""with {CARDS} select card, note, case when status = 'draft' and (note % 3 = 2 or (note % 3 = 1 and card % 14 = 0 and card <= 2800)) then 'active' else status end as status from cards""",
    "graduating_notes": f"""with {CARDS}, {NOTES}, m as (select note * 5 + 1 as note, round(count(*) filter (reps >= 4) / count(*), 3) as mastery from cards group by 1)
        select notes.note, 'graduating' as status, case when notes.note % 2 = 1 then 'mastered mastery=' || cast(round_even(mastery * 100, 0) as int) || '%' end as log from notes join m on m.note = notes.note where mastery > 0.5 and bucket = 'project'""",
    "option_orders": "select c_custkey, 4 as options, true as holds, true as same from customer",
}
