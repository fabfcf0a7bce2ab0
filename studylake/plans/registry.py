"""All queries of the package with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links, planning, retrieval, statistics, study, vectors
from ..sources import views
from . import actions, captured, cuts, doings, drafted, guided, imported, library, names, oracle_actions, oracle_library, oracle_names, oracle_sessions, oracle_verdicts, quotations, repairs, sessions, timelines, verdicts
from .oracle import SQL

EVENTS_TODAY, ORDERS_TODAY = "2024-01-31", "1998-08-02"


def cards_of(spark, d):
    return study.with_due(study.card_states(views.reviews(spark, d)))


def search_topk(spark, d):
    questions = views.table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")
    return retrieval.search(views.table(spark, d, "documents"), questions, "doc_id", "text")


def vectors_of(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("group"), F.col("embedding").alias("vector"))


def asked_vectors(spark, d):
    return vectors_of(spark, d).filter("id % 100 = 0").withColumnRenamed("id", "query")


def vector_topk(spark, d):
    return vectors.nearest(vectors_of(spark, d), asked_vectors(spark, d).select("query", "vector"))


def retrieval_quality(spark, d):
    ranked = vectors.nearest(vectors_of(spark, d), asked_vectors(spark, d).select("query", "vector"), per_group=6)
    ranked = ranked.join(vectors_of(spark, d).select("id", "group"), "id").filter("id <> query")
    return retrieval.evaluation(ranked, asked_vectors(spark, d).select("query", "group"))


def timed_steps(spark, d):
    done = views.steps(spark, d).filter("done")
    return done.join(views.projects(spark, d).select("project", "level"), "project")


def classes(spark, d):
    return statistics.reference_classes(timed_steps(spark, d))


def adjusted_estimates(spark, d):
    open_ = views.steps(spark, d).filter("not done").join(views.projects(spark, d).select("project", "level"), "project")
    out = statistics.adjusted(open_.select("level", "minutes"), classes(spark, d))
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("steps"), F.sum("minutes").alias("estimated"), F.sum("adjusted").alias("adjusted"))


def duplicate_titles(spark, d):
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return links.duplicate_titles(views.table(spark, d, "documents"), title, "doc_id")


def term_frequency(spark, d):
    return retrieval.document_frequency(retrieval.term_sets(views.table(spark, d, "documents"), "doc_id", "text"))


def latest_label(spark, d):
    rows = views.reviews(spark, d).select("card", "at", "ord", "grade")
    return planning.latest(rows, "card", ["at", "ord"])


def rounded_states(spark, d):
    c = cards_of(spark, d)
    return c.select("card", F.round("s", 6).alias("stability"), F.round("d", 6).alias("difficulty"), "reps", "lapses", "interval", "due")


def project_urgency(spark, d):
    p, load = views.projects(spark, d), planning.project_load(views.steps(spark, d))
    rows = p.filter("status <> 'done'").join(load, "project", "left")
    value = planning.urgency(F.col("deadline"), F.coalesce("remaining", F.lit(0)), F.coalesce("progress", F.lit(0.0)), F.to_date(F.lit(ORDERS_TODAY)))
    return rows.select("project", value.alias("urgency"))


def queries() -> dict:
    r, p, s = views.reviews, views.projects, views.steps
    return {
        "study_daily": lambda k, d: study.daily(r(k, d)),
        "study_calendar": lambda k, d: study.dense_days(study.daily(r(k, d)), EVENTS_TODAY, 182),
        "study_accuracy": lambda k, d: study.accuracy(r(k, d), EVENTS_TODAY),
        "card_streaks": lambda k, d: study.streaks(r(k, d).select("card", "day"), "card", EVENTS_TODAY),
        "card_states": rounded_states,
        "deck_progress": lambda k, d: study.deck_progress(cards_of(k, d), F.col("card") % 10, EVENTS_TODAY),
        "load_forecast": lambda k, d: study.load_forecast(cards_of(k, d), EVENTS_TODAY),
        "seconds_per_review": lambda k, d: study.seconds_per_review(r(k, d)),
        "retention_curve": lambda k, d: study.retention_curve(cards_of(k, d)),
        "fit_log_loss": lambda k, d: study.log_loss(study.review_samples(r(k, d))),
        "latest_review": latest_label,
        "calibration_bins": lambda k, d: statistics.calibration_bins(r(k, d)),
        "calibration_summary": lambda k, d: statistics.calibration_summary(r(k, d)),
        "overconfident_cards": lambda k, d: statistics.overconfident_cards(r(k, d)),
        "reference_classes": classes,
        "adjusted_estimates": adjusted_estimates,
        "project_accuracy": lambda k, d: statistics.project_accuracy(s(k, d)),
        "threshold_sweep": lambda k, d: statistics.sweep(views.label_pairs(k, d)),
        "term_frequency": term_frequency,
        "search_topk": search_topk,
        "vector_topk": vector_topk,
        "retrieval_quality": retrieval_quality,
        "link_in_degree": lambda k, d: links.in_degree(views.links(k, d)),
        "link_siblings": lambda k, d: links.siblings(views.links(k, d)),
        "duplicate_titles": duplicate_titles,
        "project_urgency": project_urgency,
        "next_actions": lambda k, d: planning.next_actions(p(k, d), s(k, d), ORDERS_TODAY),
        "upcoming": lambda k, d: planning.upcoming(p(k, d), s(k, d), ORDERS_TODAY),
        "habit_misses": lambda k, d: planning.habit_misses(views.habit_log(k, d), EVENTS_TODAY),
        "habit_stability": lambda k, d: planning.habit_stability(views.habit_log(k, d)),
        **sessions.queries(),
        **library.queries(),
        **actions.queries(),
        **verdicts.queries(),
        **cuts.queries(),
        **names.queries(),
        **quotations.queries(),
        **captured.queries(),
        **doings.queries(),
        **timelines.queries(),
        **drafted.queries(),
        **imported.queries(),
        **guided.queries(),
        **repairs.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return SQL | oracle_sessions.SQL | oracle_library.SQL | oracle_actions.SQL | oracle_verdicts.SQL | cuts.SQL | quotations.SQL | captured.SQL | doings.SQL | timelines.SQL | drafted.SQL | imported.SQL | guided.SQL | repairs.SQL | oracle_names.SQL
