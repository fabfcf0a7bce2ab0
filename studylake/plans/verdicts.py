"""Queries on verdicts, mentions, habits and the weekly panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judgement, planning, upkeep, vault, vectors
from ..sources import views
from .library import PROJECT_TODAY, TODAY, note_dates

#: Choice cards and the rule that each breaks.
CHOICES = [
    ("blue", ["red", "Blue", "green"], "ok"),
    ("", ["a", "b", "c"], "no-answer"),
    ("a", ["a", "b", " "], "too-few"),
    ("a", ["a", "b", "c", "d", "e", "f"], "too-many"),
    ("a", ["a", "b", "B."], "duplicate"),
    ("x", ["a", "b", "c"], "not-one-answer"),
    ("a", ["a", "b", "None of the above"], "giveaway"),
    ("a very long and qualified answer", ["a very long and qualified answer", "short one", "other one"], "length-tell"),
    ("12%", ["12%", "8%", "100%"], "ok"),
]
#: Lines of glossaries, and whether they are entries.
LINES = [
    ("entropy: a measure of disorder", True),
    ("- **Heat** — energy in transit", True),
    ("work :: force times way", True),
    ("Starts: 10:30", False),
    ("see https://a.org/x for more", False),
    ("what is this: a question?", True),
    ("just a sentence without any mark", False),
    ("12/3: nothing", False),
    ("mass\tquantity of matter", True),
]


def choice_verdicts(spark, d):
    key = F.col("c_custkey")
    pick = F.element_at(F.array(*(F.struct(F.lit(a).alias("answer"), F.array(*map(F.lit, o)).alias("options")) for a, o, _ in CHOICES)), (key % len(CHOICES) + 1).cast("int"))
    rows = views.table(spark, d, "customer").select(key.alias("card"), pick.alias("p")).select("card", "p.*")
    return rows.select("card", judgement.choice_verdict(F.col("answer"), F.col("options")).alias("verdict"))


def glossary_lines(spark, d):
    """Notes of three lines each."""
    key, n = F.col("p_partkey"), len(LINES)
    lines = F.array(*(F.lit(x) for x, _ in LINES))
    text = F.concat_ws("\n", F.lit("# Head"), *(F.element_at(lines, ((key + i) % n + 1).cast("int")) for i in range(3)), F.lit(" "))
    return judgement.glossaries(views.table(spark, d, "part").select(key.alias("note"), text.alias("text")), "note", "text")


def answer_overlap(spark, d):
    key = F.col("c_custkey")
    given = F.concat(F.lit("the alpha"), F.when(key % 2 == 0, " betas").otherwise(""), F.when(key % 3 == 0, " gamma").otherwise(""), F.when(key % 5 == 0, " delta, truly").otherwise(""))
    rows = views.table(spark, d, "customer").select(judgement.overlap(F.lit("Alpha and beta; gamma of delta"), given).alias("share"))
    return rows.groupBy("share").agg(F.count(F.lit(1)).alias("n")).select("share", judgement.explanation_verdict(F.col("share")).alias("verdict"), judgement.recall_grade(F.col("share")).alias("grade"), "n")


def linked_vectors(spark, d):
    """Every vector as a note, and the links that notes have: each even one links to the next six."""
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("note"), F.col("embedding").alias("vector"))
    made = v.filter("note % 2 = 0").select("note", F.explode(F.sequence(F.col("note") + 1, F.col("note") + 6)).alias("target"))
    return v, made


def related_notes(spark, d):
    return vectors.related(*linked_vectors(spark, d), judgement.LEAST_LINK)


def suggested_links(spark, d):
    v, made = linked_vectors(spark, d)
    return judgement.suggested_links(vectors.related(v, made, judgement.LEAST_LINK), made)


def habit_streaks(spark, d):
    log = views.habit_log(spark, d)
    cadence = F.when(F.col("note") % 3 == 0, "daily").when(F.col("note") % 3 == 1, "weekly").otherwise("monthly")
    habits = log.select("note").distinct().select("note", cadence.alias("cadence"), (1 + F.col("note") % 3).cast("int").alias("target"))
    return judgement.habit_misses(log.filter("note % 7 <> 0 or on < date'2024-01-12'"), habits, "2024-02-20")


def intentions(spark, d):
    key = F.col("c_custkey")
    part = lambda n, text: F.when(key % n == 0, text)
    return views.table(spark, d, "customer").select(key.alias("note"), judgement.intention(part(2, "I wake, "), part(3, "run. "), part(5, "the park"), part(7, "coffee")).alias("line"))


def weekly_panels(spark, d):
    n, p, s = views.notes(spark, d), views.projects(spark, d), views.steps(spark, d)
    return judgement.panels({
        "next": planning.next_actions(p, s, PROJECT_TODAY, None),
        "upcoming": planning.upcoming(p, s, PROJECT_TODAY),
        "slipped": upkeep.overdue_steps(p, s, PROJECT_TODAY, None),
        "reviews": vault.reviews_due(note_dates(spark, d), views.cards(spark, d), TODAY),
        "inbox": n.filter("bucket = 'inbox'"),
        "nothing": n.filter("note < 0"),
    })


def queries() -> dict:
    return {
        "choice_verdicts": choice_verdicts,
        "glossary_lines": glossary_lines,
        "answer_overlap": answer_overlap,
        "related_notes": related_notes,
        "suggested_links": suggested_links,
        "link_tiers": lambda k, d: judgement.link_tiers(suggested_links(k, d)),
        "habit_streaks": habit_streaks,
        "intentions": intentions,
        "weekly_panels": weekly_panels,
    }
