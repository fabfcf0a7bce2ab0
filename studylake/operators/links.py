"""The link graph, duplicate titles, and what an index must renew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def in_degree(links: DataFrame) -> DataFrame:
    return links.distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("sources"), F.min("src").alias("first_source"))


def backlinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(note, src): which notes link to a note; notes are (note, slug), links (src, dst), dst a slug."""
    return links.distinct().join(notes.select("note", F.col("slug").alias("dst")), "dst").filter("src <> note").select("note", "src")


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes that neither link nor are linked to."""
    out = notes.join(links.select(F.col("src").alias("note")).distinct(), "note", "left_anti")
    return out.join(backlinks(links, notes).select("note").distinct(), "note", "left_anti")


def siblings(links: DataFrame) -> DataFrame:
    """How many other pages share a target with each page, counted by target: pairs aren't made."""
    edges = links.distinct()
    shared = edges.groupBy("dst").agg((F.count(F.lit(1)) - 1).alias("others"))
    return edges.join(shared, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("targets"), F.sum("others").alias("shared_links"))


def duplicate_titles(notes: DataFrame, title: Column, key: str) -> DataFrame:
    """Slugs that more than one note has, with their number and the first of them."""
    slug = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return notes.select(key, slug.alias("slug")).filter("slug <> ''").groupBy("slug").agg(F.count(F.lit(1)).alias("notes"), F.min(key).alias("first_note")).filter("notes > 1")


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(note, change): missing from the index, stale there, removed since, or kept; both are (note, fingerprint)."""
    a, b = old.withColumnRenamed("fingerprint", "f_old"), new.withColumnRenamed("fingerprint", "f_new")
    change = F.when(F.col("f_old").isNull(), "missing").when(F.col("f_new").isNull(), "removed").when(F.col("f_old") != F.col("f_new"), "stale").otherwise("kept")
    return a.join(b, "note", "full_outer").select("note", change.alias("change"))


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    lines = F.split_part(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(1))
    return docs.select(F.col(key).alias("note"), T.fingerprint(lines, F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))
