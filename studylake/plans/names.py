"""Queries on categories, folders, tags and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..sources import views

#: A small table of categories, as a user would give it.
KEYWORDS = [("metal", 1, "bolt"), ("metal", 1, "anvil"), ("metal", 1, "bolt"), ("colour", 2, "red"), ("colour", 2, "blue bolt"), ("home", 3, "plate"), ("home", 3, "red-plate")]
NAMES = [("Federal Tax", "exact"), ("fed", "prefix"), ("tax law", "words"), ("st th", "initials"), ("tax", "new"), ("", "empty"), ("Chemistry", "new")]
EXISTING = ["federal tax", "The Law of Tax", "Static Theory One"]


def note_categories(spark, d):
    p = views.table(spark, d, "part")
    key = F.col("p_partkey")
    notes = p.select(key.alias("note"), F.col("p_name").alias("title"), F.when(key % 11 == 0, F.array(F.lit("Red"))).alias("tags"), F.when(key % 3 == 0, "an anvil, an anvil").alias("body"), F.when(key % 13 == 0, "home").when(key % 17 == 0, "odd").alias("manual"))
    return catalog.categories(notes, spark.createDataFrame(KEYWORDS, "category string, place int, keyword string"))


def file_names(spark, d):
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("../../a<b>"), key.cast("string"), F.lit(".TXT"))).when(key % 4 == 1, "C:\\x\\ y? .md").when(key % 4 == 2, "..").otherwise(F.concat(F.repeat(F.lit("n"), 100), F.lit(".Pdf")))
    return views.table(spark, d, "customer").select(key.alias("file"), catalog.safe_name(name).alias("name"))


def note_tags(spark, d):
    n = views.notes(spark, d)
    return n.select("note", F.array_join(catalog.folder_tags(F.col("folder"), F.array(F.lit("#Own Tag"), F.lower(F.split_part("folder", F.lit("/"), F.lit(1))))), ",").alias("tags"), catalog.is_usable(F.when(F.col("note") % 3 == 0, "<% tp.date %>").when(F.col("note") % 3 == 1, " ").otherwise("x")).alias("usable"))


def measured_steps(spark, d):
    s = views.steps(spark, d)
    took = catalog.elapsed_minutes(F.when(F.col("step") == 1, F.col("minutes") * 40), F.when(F.col("step") < 4, F.lit(0)), F.col("minutes") * 20 - 100)
    return s.groupBy("project").agg(F.count(took).alias("timed"), F.sum(took).alias("minutes"))


def settled_deadlines(spark, d):
    n = views.notes(spark, d)
    out = catalog.settled_deadline(F.col("deadline"), F.col("kind"), F.when(F.col("note") % 4 == 0, F.col("deadline")).when(F.col("note") % 4 == 1, F.col("updated")))
    return n.select("note", out["deadline"].alias("deadline"), out["kind"].alias("kind"), out["confirmed"].alias("confirmed"))


def habit_checkins(spark, d):
    n = views.notes(spark, d)
    cadence = F.when(F.col("note") % 3 == 0, "daily").when(F.col("note") % 3 == 1, "weekly").otherwise("monthly")
    return n.select("note", catalog.next_checkin(cadence, F.col("created")).alias("on"))


def answered_status(spark, d):
    return views.cards(spark, d).groupBy("status", catalog.after_answer(F.col("status"), F.col("lapses")).alias("after")).agg(F.count(F.lit(1)).alias("cards"))


def folder_choices(spark, d):
    key = F.col("c_custkey")
    asked = views.table(spark, d, "customer").select(key.alias("ask"), F.element_at(F.array(*(F.lit(n) for n, _ in NAMES)), (key % len(NAMES) + 1).cast("int")).alias("name"))
    return catalog.resolved_folders(asked, spark.createDataFrame([(f,) for f in EXISTING], "folder string")).select("ask", "how")


def marked_titles(spark, d):
    n = views.notes(spark, d)
    title = F.when(F.col("note") % 2 == 0, F.concat(F.lit("* "), "title")).otherwise(F.col("title"))
    return n.select("note", catalog.decorated(title, F.when(F.col("note") % 5 > 0, "*")).alias("title"))


def queries() -> dict:
    return {f.__name__: f for f in (note_categories, file_names, note_tags, measured_steps, settled_deadlines, habit_checkins, answered_status, folder_choices, marked_titles)}
