"""Queries on actions, links and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import memory
from ..operators import links, passages, sessions, statistics, study, transitions, vectors
from ..sources import views
from .library import TODAY, series


def outside_view(spark, d):
    open_ = views.steps(spark, d).filter("not done").join(views.projects(spark, d).select("project", "level"), "project")
    timed = views.steps(spark, d).filter("done").join(views.projects(spark, d).select("project", "level"), "project")
    return transitions.outside_view(open_, statistics.reference_classes(timed))


def toggled_steps(spark, d):
    return transitions.toggled(views.steps(spark, d), F.col("step") == 1, F.col("minutes") * 2, F.col("project") % 3 == 0)


def resource_answers(spark, d):
    n = views.notes(spark, d).filter("bucket in ('resource', 'archive')")
    kind = F.when(F.col("bucket") == "archive", "restore").when(F.col("note") % 3 == 0, "keep").when(F.col("note") % 3 == 1, "snooze").otherwise("archive")
    cycle = F.when(F.col("note") % 2 == 0, F.lit(30))
    out = transitions.reviewed_resource(kind, F.to_date(F.lit(TODAY)), (F.col("note") % 500 - 50).cast("int"), cycle)
    return n.select("note", out["bucket"].alias("bucket"), out["next"].alias("next"))


def move_events(spark, d):
    n = views.notes(spark, d)
    to = F.element_at(F.array(*map(F.lit, ("project", "resource", "archive"))), (F.floor(F.col("note") / 5) % 3 + 1).cast("int"))
    return n.groupBy(transitions.move_event(F.col("bucket"), to).alias("event")).agg(F.count(F.lit(1)).alias("n"))


def deadline_edits(spark, d):
    n = views.notes(spark, d)
    action = F.element_at(F.array(*map(F.lit, ("confirm", "replace", "clear", "leave"))), (F.floor(F.col("note") / 3) % 4 + 1).cast("int"))
    out = transitions.edited_deadline(F.col("deadline"), F.col("kind"), action, F.col("updated"))
    return n.select("note", out["deadline"].alias("deadline"), out["kind"].alias("kind"), out["confirmed"].alias("confirmed"))


def next_card_ids(spark, d):
    c = views.cards(spark, d)
    have = c.filter("card % 4 <> 0").select("note", F.concat(F.when(F.col("card") % 3 == 0, "x").otherwise("c"), (F.col("card") % 100).cast("string")).alias("id"))
    return transitions.next_card_ids(have, c.filter("card % 4 = 0").select("note", F.col("card").alias("ord")))


def habit_targets(spark, d):
    return series(spark, d).select("note", transitions.habit_target(F.col("monthday") - 5).alias("target"))


def sessions_of_users(spark, d):
    e = views.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "start").when(F.col("event_type") == "error", "end")
    return transitions.sessions(e.select(F.col("user_id").alias("owner"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), kind.alias("kind")))


def weights_in_force(spark, d):
    w = memory.WEIGHTS
    one = F.array(*(F.lit(x) for x in [1.5, *w[1:]]))
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("card"), F.when(F.col("c_custkey") % 3 == 0, one).when(F.col("c_custkey") % 3 == 1, F.array(F.lit(2.0))).alias("set"), F.when(F.col("c_custkey") % 2 == 0, F.array(*(F.lit(x) for x in [2.5, *w[1:]]))).alias("fitted"))
    return c.select("card", transitions.chosen_weights(F.col("set"), F.col("fitted"), w)[0].alias("first"))


def note_graph(spark, d):
    """Notes, their slugs, and links from every note that 4 divides to the note three times its number and one."""
    n = views.notes(spark, d).select("note", F.concat(F.lit("n"), F.col("note").cast("string")).alias("slug"))
    e = n.filter("note % 4 = 0").select(F.col("note").alias("src"), F.concat(F.lit("n"), (F.col("note") * 3 + 1).cast("string")).alias("dst"))
    return n, e.unionByName(n.filter("note % 8 = 0").select(F.col("note").alias("src"), F.col("slug").alias("dst")))


def backlinks(spark, d):
    n, e = note_graph(spark, d)
    return links.backlinks(e, n)


def orphans(spark, d):
    n, e = note_graph(spark, d)
    return links.orphans(n, e).select("note")


def card_kinds(spark, d):
    key = F.col("c_custkey")
    front = F.when(key % 3 == 0, "a {{c1::blank}} here").when(key % 3 == 1, "plain {{}}")
    options = F.when(key % 5 == 0, F.array(F.lit("x"), F.lit("y"))).when(key % 5 == 1, F.array().cast("array<string>"))
    mode = F.when(key % 2 == 0, "recall").when(key % 7 == 0, "odd")
    return views.table(spark, d, "customer").groupBy(sessions.card_kind(front, options, mode).alias("kind")).agg(F.count(F.lit(1)).alias("cards"))


def passage_sizes(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("note"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"))
    return passages.passages(docs).groupBy("note").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("text")).alias("chars"), F.max("place").alias("last"))


def chunks_of(spark, d):
    """Turns of conversations as passages of a note."""
    return views.table(spark, d, "conversations").select(F.col("conv_id").alias("note"), F.col("turn").alias("place"), "role", "text")


def missing_concepts(spark, d):
    """Terms are the first words of turns, one to three of them; cards are every other turn of a conversation's user."""
    c = chunks_of(spark, d)
    words = F.split(passages.norm(F.col("text")), " ")
    concepts = c.select("note", "place", F.array_join(F.slice(words, F.lit(1), F.col("place") % 3 + 1), " ").alias("term"), (F.col("place") % 3).cast("double").alias("weight")).filter("term <> ''")
    placed = c.filter("place % 4 = 0").select("note", "place")
    return passages.missing_concepts(concepts, placed, c.filter("place % 2 = 0 and role = 'user'").select("note", "text"))


def passage_neighbours(spark, d):
    return passages.neighbours(chunks_of(spark, d))


def word_stems(spark, d):
    said = F.array(*map(F.lit, ("studying", "studies", "boxes", "tied", "cats", "is", "42", "gas")))
    return views.table(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.array_join(passages.content_words(F.concat(F.array_join(said, " "), F.lit("’s "), F.lower("r_name"))), ",").alias("words"))


#: Cards and the sentence that must carry each: (question, answer, quote, citation, how).
GROUNDED = [
    ("What is heat?", "energy in transit", "Heat is energy in transit", "Heat is energy in transit", "verbatim"),
    ("What does entropy measure?", "disorder of systems", "not there at all, really", "Entropy measures the disorder of a system.", "recovered"),
    ("When?", "1850", "", "In 1850 it was named.", "recovered"),
    ("Why?", "because cows fly", "", "", ""),
]
PASSAGE = "Heat is energy in transit. Entropy measures the disorder of a system.\nIn 1850 it was named."


def grounded_cards(spark, d):
    key = F.col("c_custkey")
    pick = F.element_at(F.array(*(F.struct(F.lit(q).alias("question"), F.lit(a).alias("answer"), F.lit(x).alias("quote")) for q, a, x, _, _ in GROUNDED)), (key % len(GROUNDED) + 1).cast("int"))
    rows = views.table(spark, d, "customer").select(key.alias("card"), pick.alias("p"), F.lit(PASSAGE).alias("passage")).select("card", "p.*", "passage")
    return passages.grounded(rows)


def blended_search(spark, d):
    """Vectors near each asked one, with a keyword score for every third of them."""
    v = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("group"), F.col("embedding").alias("vector"))
    near = vectors.nearest(v, v.filter("id % 100 = 0").select(F.col("id").alias("query"), "vector"), 50, 50)
    near = near.join(v.select("id", "group"), "id").select(F.col("query").alias("question"), F.col("group").alias("note"), F.col("id").alias("place"), "score")
    words = near.filter("place % 3 = 0").select("question", "note", "place", (F.col("place") % 10 / 10).alias("score"))
    return passages.blended(words, near)


def index_status(spark, d):
    rows = views.table(spark, d, "embeddings")
    return passages.status(rows.select(F.col("label").alias("note"), (F.col("label") % 3).alias("bucket"), F.when(F.col("vec_id") > 0, F.col("embedding")).alias("vector")))


def queries() -> dict:
    r = views.reviews
    return {
        "outside_view": outside_view,
        "toggled_steps": toggled_steps,
        "resource_answers": resource_answers,
        "move_events": move_events,
        "deadline_edits": deadline_edits,
        "next_card_ids": next_card_ids,
        "habit_targets": habit_targets,
        "habit_occurrences": lambda k, d: transitions.logged_occurrences(views.habit_log(k, d)),
        "once_answered": lambda k, d: transitions.once_answered(r(k, d)).groupBy("card").agg(F.count(F.lit(1)).alias("reviews")),
        "user_sessions": sessions_of_users,
        "weights_in_force": weights_in_force,
        "day_seeds": lambda k, d: r(k, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")).select("day", transitions.day_seed(F.col("day")).alias("seed")),
        "backlinks": backlinks,
        "orphans": orphans,
        "card_kinds": card_kinds,
        "passage_sizes": passage_sizes,
        "missing_concepts": missing_concepts,
        "passage_neighbours": passage_neighbours,
        "word_stems": word_stems,
        "grounded_cards": grounded_cards,
        "blended_search": blended_search,
        "index_status": index_status,
        "fitted_weights": lambda k, d: study.fit(study.review_samples(r(k, d))),
    }
