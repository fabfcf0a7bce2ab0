"""Ranked retrieval by words weighted by rarity, and how good a ranking is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

KEYWORD_FLOOR, ANSWERABLE_FLOOR = 0.34, 0.19  # fixed values: the least score and the least share of the whole question
DIGITS = 9  # scores are compared to so many places
UNIT = 1e13  # weights are added in so many parts of one
MOST_BROADCAST = 200_000  # words of all questions that may be broadcast


def term_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, T.terms(F.col(text)).alias("terms"))


def document_frequency(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def question_weights(questions: DataFrame, frequency: DataFrame, passages: int) -> DataFrame:
    """(question, term, weight, heavy, whole): words that the corpus knows, their weights, and whether a word is needed to find candidates.

    A passage must cover KEYWORD_FLOOR of the known weight. So the most frequent words of a question, as long
    as they weigh less than that together, can't make a passage pass alone: candidates come from the others.
    """
    rows = questions.select("question", F.explode("terms").alias("term")).join(frequency, "term", "left")
    idf = F.log((passages + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    rows = rows.withColumn("weight", F.when(F.col("df").isNotNull(), idf)).withColumn("any", idf)
    of = W.partitionBy("question")
    rows = rows.withColumns({"known": F.sum("weight").over(of), "whole": F.sum("any").over(of)}).filter("weight is not null")
    below = F.sum("weight").over(of.orderBy("weight", "term").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("question", "term", "weight", "known", "whole", (below >= KEYWORD_FLOOR * F.col("known") * (1 - 1e-9)).alias("seeks"))


def search(docs: DataFrame, questions: DataFrame, key: str, text: str, k: int = 6) -> DataFrame:
    """(question, rank, key, score): the k best passages of each question (question, text).

    The words of a passage meet the questions' weights and are added up by passage and question, before anything
    is shuffled where the questions' words are few enough to be broadcast. Weights are added as whole numbers, so
    the order of a sum doesn't matter.
    """
    sets = term_sets(docs, key, text)
    frequency = document_frequency(sets)
    asked = questions.select("question", T.terms(F.col("text")).alias("terms"))
    weights = question_weights(asked, frequency, docs.count())
    posted = weights.select("question", "term", "known", "whole", "seeks", F.round(F.col("weight") * UNIT).cast("long").alias("weight"))
    few = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] <= MOST_BROADCAST
    words = sets.select(key, F.explode("terms").alias("term"))
    pairs = words.join(F.broadcast(posted) if few else posted, "term").groupBy(key, "question")
    pairs = pairs.agg(F.sum("weight").alias("matched"), F.bool_or("seeks").alias("seeks"), F.max("known").alias("known"), F.max("whole").alias("whole")).filter("seeks")
    scored = pairs.withColumn("score", F.round(F.col("matched") / UNIT / F.col("known"), DIGITS)).withColumn("answerable", F.col("known") / F.col("whole"))
    admitted = scored.filter((F.col("score") >= KEYWORD_FLOOR) & (F.col("score") * F.col("answerable") >= ANSWERABLE_FLOOR))
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), key))
    return admitted.withColumn("rank", rank).filter(F.col("rank") <= k).select("question", "rank", key, "score")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, kind, text, expect) of a set of questions in JSON: an object with a list of questions."""
    schema = "questions array<struct<id: string, kind: string, question: string, expect: array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("questions").alias("q"))
    return rows.select(F.col("q.id").alias("question"), F.coalesce("q.kind", F.lit("answerable")).alias("kind"), F.col("q.question").alias("text"), F.coalesce("q.expect", F.array().cast("array<string>")).alias("expect"))


def judged(questions: DataFrame, ranked: DataFrame, indexed: DataFrame) -> DataFrame:
    """(question, kind, rank, returned, verdict): questions (question, kind, expect) against what was found for them (ranked: question, rank, note).

    rank is that of the first expected note. A question that expects a note which isn't indexed (indexed: note) is
    broken, and says nothing about the search; one that can't be answered is right where nothing was found.
    """
    wanted = questions.select("question", F.explode("expect").alias("note"))
    broken = wanted.join(indexed.select("note").distinct(), "note", "left_anti").select("question", F.lit(True).alias("broken")).distinct()
    first = ranked.join(wanted.distinct(), ["question", "note"]).groupBy("question").agg(F.min("rank").alias("rank"))
    returned = ranked.groupBy("question").agg(F.count(F.lit(1)).alias("returned"))
    rows = questions.select("question", "kind").join(broken, "question", "left").join(first, "question", "left").join(returned, "question", "left")
    some = F.coalesce("returned", F.lit(0))
    verdict = F.when(F.col("broken"), "broken").when(F.col("kind") == "unanswerable", F.when(some == 0, "restrained").otherwise("false positive")).when(F.col("rank").isNull(), "missed").otherwise("found")
    return rows.select("question", "kind", "rank", some.alias("returned"), verdict.alias("verdict"))


def report(rows: DataFrame) -> DataFrame:
    """One row about judged questions: hit shares and mean reciprocal rank of those that can be answered, and how often the search was restrained where it had to be."""
    fair = F.col("verdict") != "broken"
    asked = fair & (F.col("kind") != "unanswerable")
    share = lambda hit, of: F.round(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), 4)
    none = fair & (F.col("kind") == "unanswerable")
    hits = [share(F.coalesce(F.col("rank") <= n, F.lit(False)), asked).alias(f"hit_{n}") for n in (1, 3, 5)]
    mrr = F.round(F.avg(F.when(asked, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 4).alias("mrr")
    return rows.agg(F.count_if(asked).alias("answerable"), mrr, *hits, F.count_if(none).alias("unanswerable"), share(F.col("verdict") == "restrained", none).alias("restraint"), F.count_if(~fair).alias("broken"))


def evaluation(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Hit shares and mean reciprocal rank of ranked (query, rank, group) against expected (query, group)."""
    first = ranked.join(expected, ["query", "group"]).groupBy("query").agg(F.min("rank").alias("first"))
    rows = expected.select("query").distinct().join(first, "query", "left")
    hit = lambda n: F.round(F.avg(F.coalesce((F.col("first") <= n).cast("double"), F.lit(0.0))), 4).alias(f"hit_{n}")
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), hit(1), hit(3), hit(5))
