"""Queries on sessions, folders, incidents and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scales
from ..operators import sessions, statistics, study, upkeep
from ..sources import views

TODAY, PROJECT_TODAY = "2024-01-31", "1998-08-02"


def session_cards(spark, d):
    key, group = F.col("c_custkey"), F.lower("c_mktsegment")
    source = F.concat(F.lit("Every "), group, F.lit(" account of nation "), F.col("c_nationkey"), F.lit(", in group "), key % 7)
    due = F.date_add(F.to_date(F.lit(TODAY)), (key % 60).cast("int") - 30)
    return views.table(spark, d, "customer").select(key.alias("card"), F.col("c_nationkey").alias("note"), group.alias("topic"), source.alias("source"), (key % 4).alias("reps"), F.when(key % 4 > 0, due).alias("due"))


def study_session(spark, d):
    hot = statistics.overconfident_cards(views.reviews(spark, d))
    return sessions.session(session_cards(spark, d), hot, TODAY, 100, 20, 60)


def review_buttons(spark, d):
    exam = F.date_add(F.to_date(F.lit(TODAY)), (F.col("card") % 20 + 5).cast("int"))
    return sessions.buttons(study.card_states(views.reviews(spark, d)), exam, TODAY)


def folder_rollup(spark, d):
    due = (F.col("reps") > 0) & (F.col("due") <= F.to_date(F.lit(TODAY)))
    decks = session_cards(spark, d).groupBy("note", "topic").agg(F.count_if(due).alias("due"), F.count_if(F.col("reps") == 0).alias("new"), F.count(F.lit(1)).alias("active"))
    where = views.table(spark, d, "nation").join(views.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    where = where.select(F.col("n_nationkey").alias("note"), F.concat_ws("/", "r_name", "n_name").alias("folder"))
    return sessions.folder_rollup(decks.join(where, "note"))


def incidents(spark, d):
    log = views.table(spark, d, "events").filter(F.col("event_type").isin("error", "purchase"))
    return upkeep.incidents(log.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").alias("ok")))


def note_findings(spark, d):
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return upkeep.findings(views.table(spark, d, "documents"), title, F.col("text"))


def stated_confidence(spark, d):
    kind = F.col("event_type")
    said = F.when(kind == "click", "sure").when(kind == "view", " Think-so ").when(kind == "signup", "perhaps").otherwise(F.get_json_object("props", "$.k"))
    rows = views.table(spark, d, "events").select(views.event_grade().alias("grade"), scales.probability(said).alias("p"))
    return rows.groupBy("grade").agg(F.count(F.lit(1)).alias("reviews"), F.count("p").alias("stated"), F.round(F.avg("p"), 4).alias("confidence"))


def calendar_priority(spark, d):
    rows = views.projects(spark, d).filter("status <> 'done'")
    return rows.groupBy(scales.priority(F.col("level"), F.col("deadline"), F.to_date(F.lit(PROJECT_TODAY))).alias("priority")).agg(F.count(F.lit(1)).alias("projects"))


def queries() -> dict:
    return {
        "study_session": study_session,
        "review_buttons": review_buttons,
        "folder_rollup": folder_rollup,
        "study_debrief": lambda k, d: sessions.debrief(views.reviews(k, d), F.col("card") % 10, "2024-01-24"),
        "incidents": incidents,
        "overdue_steps": lambda k, d: upkeep.overdue_steps(views.projects(k, d), views.steps(k, d), PROJECT_TODAY),
        "week_closed": lambda k, d: upkeep.closed(views.steps(k, d), views.reviews(k, d), "1995-06-08", TODAY),
        "note_findings": note_findings,
        "stated_confidence": stated_confidence,
        "calendar_priority": calendar_priority,
    }
