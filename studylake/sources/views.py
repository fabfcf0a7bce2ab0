"""Tables of a folder as the records of the study system: reviews, habit log, notes, steps, projects, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a file that is small for the work that each row makes, dealt to all tasks; their number is given, as by their size they would be put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def day_number(ts: str):
    """A time without zone as days since 1970, whatever the session's zone."""
    return F.unix_date(F.to_date(ts)) + (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), F.col(ts)).cast("double")) / 86400.0


def event_grade():
    """The grade that an event stands for."""
    kind = F.col("event_type")
    return F.when(kind == "error", 1).when(kind == "signup", 2).when(kind == "purchase", 4).otherwise(3)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("card"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("ord"),
        event_grade().alias("grade"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("confidence"),
        F.least(F.lit(120.0), F.col("value")).alias("seconds"),
        F.to_date("ts").alias("day"),
    )


def habit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("note"), F.to_date("ts").alias("on"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), F.col("event_type").alias("place"), F.col("event_id").alias("ord"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project"),
        F.col("l_linenumber").alias("step"),
        q.cast("int").alias("minutes"),
        F.round(q * (1 + 10 * F.col("l_discount") + F.col("l_tax"))).cast("int").alias("actual"),
        (F.col("l_linestatus") == "F").alias("done"),
        F.to_date("l_shipdate").alias("scheduled"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "blocked").otherwise("active")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("project"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("deadline"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("level"),
        status.alias("status"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.explode(found).alias("dst"))


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "score", (F.col("quality") == 1).alias("correct"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes: parts, with bucket, folder, tags, dates and status from their key and size."""
    key, size, today = F.col("p_partkey"), F.col("p_size"), F.to_date(F.lit("2024-01-31"))
    tags = F.array_compact(F.array(F.when(key % 6 == 0, "needs-definition"), F.when(key % 7 == 0, "term")))
    return table(spark, sf_dir, "part").select(
        key.alias("note"),
        F.concat_ws(" ", "p_name", (key % 97).cast("string")).alias("title"),
        F.element_at(F.array(*map(F.lit, ("inbox", "project", "area", "resource", "archive"))), (key % 5 + 1).cast("int")).alias("bucket"),
        F.concat_ws("/", F.lower("p_type"), "p_brand").alias("folder"),
        tags.alias("tags"),
        F.date_sub(today, size * 3).alias("created"),
        F.date_add(F.date_sub(today, size * 3), (key % 40).cast("int")).alias("updated"),
        F.when(key % 3 == 0, F.date_add(today, (key % 41).cast("int") - 10)).alias("deadline"),
        F.element_at(F.array(*map(F.lit, ("explicit", "exact", "ambiguous", "llm", "manual"))), (F.floor(key / 5) % 5 + 1).cast("int")).alias("kind"),
        F.when(key % 4 == 0, "done").otherwise("active").alias("status"),
        (key % 2 == 0).alias("learning"),
        (size * 4).alias("words"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards: customers, in the decks of notes 0 to 24."""
    key, today = F.col("c_custkey"), F.to_date(F.lit("2024-01-31"))
    reps = (key % 9).cast("int")
    due = F.when(reps > 0, F.date_add(today, (key % 60).cast("int") - 30))
    return table(spark, sf_dir, "customer").select(
        key.alias("card"),
        F.col("c_nationkey").cast("long").alias("note"),
        F.when(key % 7 == 0, "draft").when(key % 7 == 1, "suspended").otherwise("active").alias("status"),
        reps.alias("reps"),
        (key % 11).cast("int").alias("lapses"),
        F.when(reps > 0, F.round(F.abs("c_acctbal") / 50, 2)).otherwise(0.0).alias("s"),
        due.alias("due"),
        F.date_sub(due, 10).alias("last"),
    )
