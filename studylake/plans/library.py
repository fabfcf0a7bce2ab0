"""Queries on notes, cards, captures, calendars and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captures, dates, scales
from ..functions import text as T
from ..operators import calendar, links, planning, statistics, study, vault
from ..sources import markdown, views

TODAY, PROJECT_TODAY = "2024-01-31", "1998-08-02"

def decks_of(spark, d):
    return views.cards(spark, d).groupBy("note").agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("reps") > 0).alias("answered"))


def series(spark, d):
    key, nation, base = F.col("s_suppkey"), F.col("s_nationkey"), F.to_date(F.lit("2024-01-10"))
    return views.table(spark, d, "supplier").select(
        key.alias("note"),
        F.when(key % 3 == 0, "daily").when(key % 3 == 1, "weekly").otherwise("monthly").alias("cadence"),
        F.array(nation % 7, (nation + 3) % 7).alias("days"),
        (1 + key % 31).cast("int").alias("monthday"),
        F.date_add(base, (key % 60).cast("int")).alias("start"),
        F.when(key % 4 == 0, F.date_add(F.to_date(F.lit("2024-02-10")), (key % 50).cast("int"))).alias("until"),
        (nation * 40).cast("int").alias("minute"),
        (15 + key % 5 * 15).cast("int").alias("minutes"),
        (key % 10 != 9).alias("enabled"),
    )


def note_dates(spark, d):
    return views.notes(spark, d).withColumn("next_review", F.date_add("created", 90))


#: Sentences and what they must mean on a day t: (text, date in SQL, kind). t is each order's date.
SENTENCES = [
    ("essay due: 2026-12-01, long one", "date '2026-12-01'", "explicit"),
    ("deadline = tomorrow", "t + 1", "explicit"),
    ("hand in 2027-02-03 in class", "date '2027-02-03'", "explicit"),
    ("finish the lab by 9/8", "case when make_date(year(t), 9, 8) >= t then make_date(year(t), 9, 8) else make_date(year(t) + 1, 9, 8) end", "explicit"),
    ("do 1/2 the chapter and pages 3/4", None, None),
    ("meet on 8/25/2030 at noon", "date '2030-08-25'", "explicit"),
    ("party Sept 8 at home", "case when make_date(year(t), 9, 8) >= t then make_date(year(t), 9, 8) else make_date(year(t) + 1, 9, 8) end", "explicit"),
    ("the 30th of march counts", "case when make_date(year(t), 3, 30) >= t then make_date(year(t), 3, 30) else make_date(year(t) + 1, 3, 30) end", "explicit"),
    ("pay rent by the 5th", "case when day(t) <= 5 then date_trunc('month', t) else date_trunc('month', t) + interval 1 month end + interval 4 day", "exact"),
    ("call in 3 days", "t + 3", "exact"),
    ("a week from today we go", "t + 7", "exact"),
    ("in 2 months the lease ends", "t + interval 2 month", "ambiguous"),
    ("in 99999999 days it is over", None, None),
    ("the day after tomorrow", "t + 2", "exact"),
    ("do it tonight", "t", "exact"),
    ("clean up this weekend", "t + cast((12 - isodow(t) + 1) % 7 as int)", "ambiguous"),
    ("next weekend trip", "t + cast((12 - isodow(t) + 1) % 7 as int) + 7", "ambiguous"),
    ("quiz on Friday", "t + case when isodow(t) = 5 then 7 else cast((12 - isodow(t)) % 7 as int) end", "exact"),
    ("by next friday", "t + 7 + case when isodow(t) = 5 then 7 else cast((12 - isodow(t)) % 7 as int) end", "ambiguous"),
    ("I sat in the sun", None, None),
    ("due sun at ten", "t + case when isodow(t) = 7 then 7 else cast(7 - isodow(t) as int) end", "exact"),
    ("report eow please", "t + cast((12 - isodow(t)) % 7 as int)", "ambiguous"),
    ("rent at the end of the month", "last_day(t)", "exact"),
    ("sometime next week", "t + cast(12 - isodow(t) as int)", "ambiguous"),
    ("maybe next month", "t + interval 1 month", "ambiguous"),
    ("just a thought", None, None),
]


def deadlines(spark, d):
    orders = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("project"), F.to_date("o_orderdate").alias("t"))
    rows = orders.withColumn("text", F.element_at(F.array(*(F.lit(s) for s, _, _ in SENTENCES)), (F.col("project") % len(SENTENCES) + 1).cast("int")))
    guess = dates.deadline(F.col("text"), F.col("t"))
    return rows.select("project", guess["date"].alias("deadline"), guess["kind"].alias("kind"), dates.confirmed(guess["kind"]).alias("confirmed"))


#: Texts, and what the rules must say: title, level, learning, steps, skills, materials, minutes.
CAPTURES = [
    ("# Todo: learn Rust generics next friday\n- [ ] read `Box` docs\n- 2) try it, about 2 hours\n3. write #notes", "Learn Rust generics", 3, True, 3, "Box|Todo|Rust", "", 120),
    ("quick intro to the basics, see https://a.org/x and \"The Book\" or [[Graph Theory]]", "Quick intro to the basics, see https://a.org/x and \"The Book\" or [[Graph Theory]", 1, False, 0, "Graph|Theory", "https://a.org/x|Graph Theory|The Book", None),
    ("Build a lamp then Paint it then sell it in 3 days", "Build a lamp then Paint it then sell it", 3, False, 3, "Paint", "", None),
    ("write essay by tomorrow, 1.5 hours and 20 min, from scratch", "Write essay", 4, False, 0, "", "", 110),
    ("  \n", "Untitled", 3, False, 0, "", "", None),
    ("deep dive: proof of internals of theory, 2 days of work", "Deep dive: proof of internals of theory, 2 days of work", 5, False, 0, "", "", 480),
    ("40000 hours, said 3 days ago", "40000 hours, said 3 days ago", 3, False, 0, "", "", 100000),
]


def capture_rules(spark, d):
    rows = views.dealt(views.table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("note"), F.element_at(F.array(*(F.lit(c[0]) for c in CAPTURES)), (F.col("c_custkey") % len(CAPTURES) + 1).cast("int")).alias("text"))
    t = F.col("text")
    return rows.select("note", captures.title(t).alias("title"), captures.level(t).alias("level"), captures.is_learning(t).alias("learning"), F.size(captures.steps(t)).alias("steps"), F.array_join(captures.skills(t), "|").alias("skills"), F.array_join(captures.materials(t), "|").alias("materials"), dates.duration_minutes(t).alias("minutes"))


#: Texts with the evidence that the bucket rules must find: (text, project, area, resource, bucket, confidence).
FILED = [
    ("submit the essay due 2026-12-01", 8.5, 0.0, 0.0, "project", 1.0),
    ("daily routine, 3x a week", 0.0, 8.0, 0.0, "area", 1.0),
    ("glossary: entropy is defined as disorder, see https://b.org", 0.0, 0.0, 5.5, "resource", 1.0),
    ("buy milk", 2.0, 0.0, 0.0, "project", 0.444),
    ("something", 0.0, 0.0, 0.0, "project", 0.0),
    ("weekly upkeep by next friday", 1.5, 5.0, 0.0, "area", 0.835),
    ("read chapter 3", 0.0, 0.0, 1.0, "resource", 0.222),
]


def filed_captures(spark, d):
    rows = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("note"), F.to_date("o_orderdate").alias("t"), F.element_at(F.array(*(F.lit(c[0]) for c in FILED)), (F.col("o_orderkey") % len(FILED) + 1).cast("int")).alias("text"))
    rows = rows.withColumn("found", captures.scores(F.col("text"), F.lit(""), F.col("t"))).withColumn("v", captures.verdict(F.col("found")))
    return rows.select("note", "found.project", "found.area", "found.resource", "v.bucket", "v.confidence", (F.col("v.confidence") >= captures.AUTO_FLOOR).alias("auto"))


def index_changes(spark, d):
    """The index of before lacks every tenth note, has other texts for every seventh, and notes that are gone."""
    new = links.fingerprints(views.table(spark, d, "documents"), "doc_id", "text")
    old = new.filter("note % 10 <> 0").select("note", F.when(F.col("note") % 7 == 0, "0" * 16).otherwise(F.col("fingerprint")).alias("fingerprint"))
    gone = new.filter("note % 13 = 0").select((-1 - F.col("note")).alias("note"), "fingerprint")
    return links.index_changes(old.unionByName(gone), new).groupBy("change").agg(F.count(F.lit(1)).alias("notes"))


def index_merge(spark, d):
    new = links.fingerprints(views.table(spark, d, "documents"), "doc_id", "text")
    old = new.filter("note % 10 <> 0").select("note", F.when(F.col("note") % 7 == 0, "0" * 16).otherwise(F.col("fingerprint")).alias("fingerprint"), (F.col("note") % 4 + 1).alias("chunks"), F.when(F.col("note") % 11 == 0, 0).otherwise(F.col("note") % 4 + 1).alias("vectors"))
    gone = new.filter("note % 13 = 0").select((-1 - F.col("note")).alias("note"), "fingerprint", F.lit(1).alias("chunks"), F.lit(1).alias("vectors"))
    return vault.merged_index(old.unionByName(gone), new).groupBy("action").agg(F.count(F.lit(1)).alias("notes"))


def step_carryover(spark, d):
    before = views.steps(spark, d).select("project", "step", "done", F.concat(F.lit("Step "), (F.col("minutes") % 5).cast("string"), F.lit(" ")).alias("text"))
    after = views.steps(spark, d).select("project", "step", F.lit(False).alias("done"), F.concat(F.lit("step "), (F.col("step") % 5).cast("string")).alias("text"))
    return vault.carried_over(before, after).groupBy("project").agg(F.count_if("done").alias("done"), F.count(F.lit(1)).alias("steps"))


def linked_context(spark, d):
    """Notes of 40 words of text; each links to the notes 7, 3 and 7 ids on, in this order."""
    notes = views.notes(spark, d).select("note", F.col("title").alias("body"))
    edges = notes.select(F.col("note").alias("src"), F.posexplode(F.array(F.col("note") + 7, F.col("note") + 3, F.col("note") + 7)).alias("place", "dst"))
    return vault.expanded_links(notes, edges)


def template_fill(spark, d):
    template = spark.createDataFrame([("book", 1, "Summary"), ("book", 2, "Quotes"), ("log", 1, "Today"), ("log", 2, "Summary")], "kind string, place int, heading string")
    notes = views.notes(spark, d).select("note", F.when(F.col("note") % 2 == 0, "book").otherwise("log").alias("kind"), "title", "folder")
    values = notes.select("note", "kind", F.lit("Summary").alias("heading"), F.col("title").alias("text")).unionByName(notes.filter("note % 3 = 0").select("note", "kind", F.lit("Quotes").alias("heading"), F.col("folder").alias("text")))
    return vault.filled(template, values)


def remote_completions(spark, d):
    key = F.col("o_orderkey")
    tasks = views.table(spark, d, "orders").select(F.when(key % 5 == 0, F.lit("other-task")).otherwise(F.concat(F.lit("note-"), (key % 3000).cast("string"))).alias("uid"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("needsAction").alias("status"))
    return vault.remote_completions(tasks, views.notes(spark, d))


def block_clashes(spark, d):
    """Orders as an owner's blocks of 1 to 8 hours, clashing with the busy times of the same customer's other day."""
    key, day = F.col("o_orderkey"), F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lit("1995-01-01")))
    rows = views.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), key.alias("block"), (day % 60 * 1440 + key % 24 * 60).alias("start"), (day % 60 * 1440 + key % 24 * 60 + 60 + key % 8 * 60).alias("stop"))
    return vault.first_clash(rows.filter("block % 2 = 0"), rows.filter("block % 2 = 1"))


def collected(spark, d):
    notes = views.notes(spark, d).withColumn("restated", F.col("note") % 9 == 0)
    return vault.collected(notes, decks_of(spark, d), TODAY)


def card_queue(spark, d):
    rows = views.table(spark, d, "events").filter("event_type = 'click'")
    return vault.card_queue(rows.select(F.col("user_id").alias("note"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.col("value").cast("int").alias("most"), F.get_json_object("props", "$.k").alias("source")))


def terms(spark, d):
    return views.table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("term"), F.round(F.col("p_retailprice") % 7, 2).alias("weight"), F.col("p_partkey").alias("ord"))


def glossary_duplicates(spark, d):
    return vault.glossary_duplicates(terms(spark, d).select("ord", "term", F.lit("d").alias("definition"))).select("ord", F.lower("term").alias("term"))


def asset_sets(spark, d):
    return vault.asset_sets(views.links(spark, d).select(F.col("dst").alias("asset")), views.table(spark, d, "pages").select(F.concat(F.lit("/"), F.substring_index(F.substring_index("url", "/", 5), "/", -1)).alias("asset")).unionByName(views.links(spark, d).filter("src % 3 = 0").select(F.col("dst").alias("asset")))).groupBy("state").agg(F.count(F.lit(1)).alias("assets"))


def sink_changes(spark, d):
    rows = views.projects(spark, d).select(F.col("project").alias("uid"), F.col("deadline").cast("string").alias("payload"))
    wanted = rows.filter("uid % 6 <> 0")
    existing = rows.filter("uid % 5 <> 0").withColumn("payload", F.when(F.col("uid") % 4 == 0, "before").otherwise(F.col("payload")))
    return vault.sink_changes(wanted, existing)


def reminders(spark, d):
    key = F.col("event_id")
    at = (F.unix_date(F.to_date("ts")).cast("long") * 1440 + F.hour("ts") * 60 + F.minute("ts")).alias("at")
    rows = views.table(spark, d, "events").select("event_id", at)
    said = vault.reminder(F.col("at"), key % 5, F.when(key % 7 == 0, 1).otherwise(0), F.lit(600), F.when(key % 3 == 0, F.col("at") + key % 2), F.when(key % 4 > 0, F.col("at") - key % 4 * 45), key % 2 == 0)
    return rows.groupBy(said.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def visit_plan(spark, d):
    """Orders' lines as passages of a note: the first by urgency, then spread."""
    p = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note")).agg(F.max("l_linenumber").alias("n"), F.min("l_quantity").alias("q"))
    p = p.withColumn("passage", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return vault.visit_plan(p.select("note", "passage", "n", F.lit(1.0).alias("weight"), F.when(F.col("passage") % 3 == 1, 1).otherwise(0).alias("covered")))


def habit_periods(spark, d):
    s = series(spark, d)
    p = dates.periods_between(F.col("start"), F.date_add("start", 100), F.col("cadence"))
    return s.select("note", F.size(p).alias("periods"), F.element_at(p, 1).alias("first"), F.element_at(p, -1).alias("last"), dates.period_length_days(F.col("cadence")).alias("length"))


def calendar_events(spark, d):
    decks = decks_of(spark, d)
    return calendar.events(views.projects(spark, d), views.steps(spark, d).filter("step = 1"), series(spark, d), note_dates(spark, d), decks, TODAY).select("uid", "kind", "note", "day", "minute", "minutes", "rule")


def due_tasks(spark, d):
    return calendar.due_tasks(views.projects(spark, d), planning.project_load(views.steps(spark, d)), PROJECT_TODAY)


def day_agenda(spark, d):
    occurring = calendar.occurrences(series(spark, d), TODAY, TODAY, "2024-01-15")
    blocks = views.steps(spark, d).filter("not done and step = 1").select(F.col("project").alias("note"), F.when(F.col("minutes") % 2 == 0, F.col("minutes") * 20).alias("minute"))
    return calendar.day_agenda(occurring, blocks, note_dates(spark, d).filter(F.col("next_review") == F.to_date(F.lit(TODAY))))


def event_files(spark, d):
    rows = calendar.area_events(series(spark, d), TODAY).join(views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("note"), F.concat("s_name", F.lit(", again; or\nnot\\")).alias("summary")), "note")
    return calendar.event_lines(rows)


def planned_steps(spark, d):
    """Undone steps of each customer's active projects from a Monday morning on; busy are two hours on each workday of the first two weeks."""
    begin = 10374 * 1440  # 1998-05-28, a Thursday
    p = views.table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("project"), F.col("o_custkey").alias("owner"))
    todo = views.steps(spark, d).filter("not done").groupBy("project", "step").agg(F.max("minutes").alias("minutes")).join(p, "project")
    todo = todo.withColumn("place", F.col("step"))
    busy = p.select("owner").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(13)))).select("owner", (begin + F.col("day") * 1440 + 600).alias("start"), (begin + F.col("day") * 1440 + 720).alias("stop"))
    return calendar.planned(todo, busy, begin)


def wiki_graph(spark, d):
    """Notes as Markdown whose links name the titles of other notes: links by title, notes without any, and backlinks."""
    p = views.notes(spark, d).filter("note % 3 <> 0")
    text = F.concat(F.lit("---\nid: n"), F.col("note").cast("string"), F.lit("\ntitle: \""), "title", F.lit("\"\ntags: [a, 'b c']\n---\n\n# Head\nSee [["), F.concat_ws(" ", F.split_part("title", F.lit(" "), F.lit(1)), F.split_part("title", F.lit(" "), F.lit(2)), ((F.col("note") + 1) % 97).cast("string")), F.lit("|label]] and [["), "title", F.lit("#part]].\n\n## In my own words\n\nKept.\n"))
    files = p.select(text.alias("text"), F.lit("p").alias("bucket"), F.lit("").alias("folder"), F.concat(F.lit("f"), F.lpad(F.col("note").cast("string"), 8, "0")).alias("path"))
    notes = markdown.notes_of(files)
    index = markdown.title_index(notes)
    edges = notes.select("id", "path", F.explode(markdown.wikilinks(F.col("body"))).alias("target")).select("id", "path", markdown.slug(F.col("target")).alias("slug"))
    found = edges.join(index.withColumnRenamed("path", "to"), "slug", "left")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.count("to").alias("resolved"), F.count_if(F.col("to") == F.col("path")).alias("to_itself"))


def note_fields(spark, d):
    """Front matter written and read back, with the body behind it."""
    p = views.notes(spark, d)
    title = F.when(F.col("note") % 4 == 0, F.concat(F.lit("'"), "title", F.lit("'"))).otherwise(F.col("title"))
    text = markdown.rendered({"id": F.col("note"), "title": title, "due": F.col("deadline")}, F.concat(F.lit("Body of "), "title", F.lit("\r\n\n```\ncode here\n```\nend\n\n")))
    t = F.col("text")
    return p.select("note", text.alias("text")).select(markdown.field(t, "id").cast("long").alias("note"), markdown.field(t, "title").alias("title"), markdown.field(t, "due").cast("date").alias("deadline"), F.length(markdown.body(t)).alias("length"), markdown.prose_words(t).alias("words"))


def deck_cards(spark, d):
    """Decks as Markdown with two cards each, read into rows."""
    p = views.notes(spark, d).select("note", F.concat(F.lit("---\nid: x\n---\n\n# Deck\n\n### Card c1\n**Q:** What is "), "title", F.lit("?\n**A:** A {{c1::"), "folder", F.lit("}} thing\nof two lines\n\n### Card c2\n**Q:** Pick\n**A:** b\n**Choices:**\n- a\n- B.\n- b\n2) c\n**Mode:** recall\n")).alias("text"))
    c = markdown.cards_of(p)
    return c.select("note", "card", "q", "mode", markdown.card_question(F.col("a")).alias("shown"), F.array_join(markdown.cloze_answers(F.col("a")), "|").alias("blanks"), F.array_join(markdown.choices(F.col("choices")), "|").alias("options"))


def duration_of_steps(spark, d):
    """Durations in words against the numbers they were made of."""
    q = F.col("l_quantity").cast("int")
    said = F.when(q % 4 == 0, F.concat(q.cast("string"), F.lit(" min and 1 hour"))).when(q % 4 == 1, F.concat(F.lit("in "), q.cast("string"), F.lit(" days"))).when(q % 4 == 2, F.concat(q.cast("string"), F.lit(".5h"))).otherwise(F.concat(q.cast("string"), F.lit(" days of work, ends 3 days later")))
    return views.table(spark, d, "lineitem").select(q.alias("q"), dates.duration_minutes(said).alias("minutes")).groupBy("q").agg(F.max("minutes").alias("minutes"), F.count(F.lit(1)).alias("n"))


def label_counts(spark, d):
    """Each note's first and last answer from the log, with its confidence at first."""
    rows = views.reviews(spark, d).select("card", "at", "ord", "grade", "confidence")
    first = vault.first_of(rows, "card", ["at", "ord"]).select("card", F.col("grade").alias("first"), F.round("confidence", 6).alias("confidence"))
    last = planning.latest(rows, "card", ["at", "ord"]).select("card", F.col("grade").alias("last"))
    return first.join(last, "card")


def threshold_report(spark, d):
    pairs = views.label_pairs(spark, d)
    toxic = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score")), "doc_id").select("score", (F.col("toxic") == 1).alias("correct"))
    return statistics.report({"quality": pairs, "toxic": toxic})


def graded_scores(spark, d):
    score = F.col("value") % 100 / 100
    return views.table(spark, d, "events").groupBy(scales.grade_of(score).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def citations(spark, d):
    """Answers that cite passages by number, and excerpts of what they cite."""
    key = F.col("c_custkey")
    text = F.concat(F.lit("As [2] says, and ["), (key % 9).cast("string"), F.lit("], [0] and [2] again"))
    return views.table(spark, d, "customer").select(key.alias("note"), F.array_join(F.transform(T.cited(text, F.lit(6)), lambda x: x.cast("string")), ",").alias("cited"), T.excerpt(F.concat("c_name", F.lit(" — Head\n\n"), F.repeat(F.concat(F.lit("word  "), key.cast("string"), F.lit(" ")), F.lit(30))), 40).alias("excerpt"))


def folder_scope(spark, d):
    raw = F.concat(F.lit("/"), F.translate("folder", "/", "\\"), F.lit("/"))
    return views.notes(spark, d).filter(vault.in_folders(raw, ["economy", "small/Brand#4/"])).groupBy(vault.normalized_folder(raw).alias("folder")).agg(F.count(F.lit(1)).alias("notes"))


def new_ids(spark, d):
    rows = views.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("slug"), (F.hour("ts") * 60 + F.minute("ts")).alias("second"))
    return vault.new_ids(rows, F.col("slug"), F.col("second")).select("ord", "id")


def queries() -> dict:
    n, c, r = views.notes, views.cards, views.reviews
    return {
        "deck_states": lambda k, d: vault.deck_states(c(k, d), TODAY),
        "study_summary": lambda k, d: vault.study_summary(c(k, d), TODAY),
        "schedule_rollup": lambda k, d: vault.schedule_rollup(c(k, d)),
        "counted_on": lambda k, d: vault.counted_on(r(k, d), "2024-01-10"),
        "pending_dates": lambda k, d: vault.pending_dates(n(k, d), dates.confirmed(F.col("kind"))),
        "undefined_terms": lambda k, d: vault.undefined_terms(n(k, d)),
        "deckable_notes": lambda k, d: vault.deckable(n(k, d), c(k, d)),
        "folder_scope": folder_scope,
        "graduation": lambda k, d: vault.graduation(study.deck_progress(study.with_due(study.card_states(r(k, d))), F.col("card") % 10 * 3, TODAY), n(k, d)),
        "worst_answers": lambda k, d: vault.worst_answers(r(k, d), c(k, d), "2024-01-24"),
        "label_counts": label_counts,
        "index_changes": index_changes,
        "index_merge": index_merge,
        "step_carryover": step_carryover,
        "linked_context": linked_context,
        "template_fill": template_fill,
        "remote_completions": remote_completions,
        "block_clashes": block_clashes,
        "estimate_summary": lambda k, d: vault.estimate_summary(views.steps(k, d).filter("done")),
        "estimate_outliers": lambda k, d: vault.outliers(views.steps(k, d).filter("done")),
        "collected_summary": lambda k, d: vault.collected_summary(collected(k, d)),
        "oldest_collected": lambda k, d: vault.oldest_collected(collected(k, d)),
        "inbox": lambda k, d: vault.newest(n(k, d), "inbox", "created"),
        "archived": lambda k, d: vault.newest(n(k, d), "archive", "updated"),
        "resources_to_review": lambda k, d: vault.reviews_due(note_dates(k, d), c(k, d), TODAY),
        "card_queue": card_queue,
        "term_summary": lambda k, d: vault.term_summary(terms(k, d)),
        "glossary_duplicates": glossary_duplicates,
        "asset_sets": asset_sets,
        "sink_changes": sink_changes,
        "bucket_counts": lambda k, d: vault.bucket_counts(n(k, d).filter("bucket <> 'area'")),
        "exam_deadlines": lambda k, d: vault.exam_deadlines(n(k, d), TODAY),
        "last_review_on": lambda k, d: vault.last_review_on(r(k, d), "2024-01-10"),
        "reminders": reminders,
        "visit_plan": visit_plan,
        "new_ids": new_ids,
        "planned_steps": planned_steps,
        "deadlines": deadlines,
        "capture_rules": capture_rules,
        "filed_captures": filed_captures,
        "duration_of_steps": duration_of_steps,
        "habit_periods": habit_periods,
        "occurrences": lambda k, d: calendar.occurrences(series(k, d), "2024-02-01", "2024-02-29", "2024-01-20"),
        "calendar_events": calendar_events,
        "due_tasks": due_tasks,
        "day_agenda": day_agenda,
        "event_files": event_files,
        "wiki_graph": wiki_graph,
        "note_fields": note_fields,
        "deck_cards": deck_cards,
        "threshold_report": threshold_report,
        "graded_scores": graded_scores,
        "citations": citations,
    }
