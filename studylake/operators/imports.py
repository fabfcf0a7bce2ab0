"""Files from elsewhere as notes: what each would become and why, what was brought in, and whether its original is still there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import markdown
from .catalog import folder_tags, is_usable

# fixed values: keys that may hold a note's date, in order, files that a note may show, and the mark of a drawing
DATE_KEYS = ("created", "Created", "date", "Date")
ASSETS = ("png", "jpg", "jpeg", "gif", "pdf", "canvas", "webp", "svg")
DRAWING = r"(?m)^excalidraw-plugin[ \t]*:"
TITLE_CHARS, SLUG_CHARS, STAMP = 120, 40, "yyyyMMdd'T'HHmmss"

#: Why a file isn't brought in, the first that holds.
SKIPS = ("no body", "has an id", "a drawing", "already adopted")


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """source (path below the folder), modified, sha256 and text of each Markdown file right in a folder; Spark gives no row for one of no bytes, which holds no note."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("source"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), markdown.decoded(F.col("content")).alias("text"))


def subject(folder: Column) -> Column:
    """The folders of a path below the staging ones: "Drop" and what begins with an underscore, at the head."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    staged = lambda p: (p == "Drop") | F.startswith(p, F.lit("_"))
    first = F.array_position(F.transform(parts, lambda p: ~staged(p)), True).cast("int")
    return F.when(first > 0, F.slice(parts, F.greatest(first, F.lit(1)), F.size(parts))).otherwise(F.array().cast("array<string>"))


def _written_date(text: Column) -> Column:
    """(created, key): the first date that the front matter gives under one of the known keys."""
    out = F.lit(None).cast("struct<created:timestamp,key:string>")
    for key in reversed(DATE_KEYS):
        value = markdown.field(text, key)
        day = F.try_to_timestamp(F.nullif(F.regexp_extract(value, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), F.lit("yyyy-MM-dd"))
        out = F.when(value.isNotNull() & is_usable(value) & day.isNotNull(), F.struct(day.alias("created"), F.lit(f"frontmatter:{key}").alias("key"))).otherwise(out)
    return out


def decided(files: DataFrame, folder: Column, bucket: str, adopted: DataFrame) -> DataFrame:
    """What each file (source, modified, text) would become: action, reason, title, id, dest, created, created_from, provisional, tags, words.

    adopted: (source, id) of notes that were brought in before: their files are skipped, so a second run proposes
    nothing. Every field comes from something in the file: its name or front matter, its own date as a last
    resort, which is provisional. Ids are made of date and title; a repeated one is numbered, past those in use.
    """
    t = F.col("text")
    rows = files.join(adopted.select("source", F.col("id").alias("known")), "source", "left")
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", "")
    own = markdown.field(t, "title")
    title = F.when(own.isNotNull() & is_usable(own), F.substring(F.trim(own), 1, TITLE_CHARS)).otherwise(F.coalesce(F.nullif(F.substring(F.trim(stem), 1, TITLE_CHARS), F.lit("")), F.lit("Untitled")))
    stamp = F.when(stem.rlike(r"^\d{12}$"), F.try_to_timestamp(stem, F.lit("yyyyMMddHHmm")))
    rows = rows.withColumns({"body": markdown.body(t), "written": _written_date(t), "stamp": stamp, "title": title})
    empty = F.regexp_replace("body", r"\s+", "") == ""
    drawn = markdown.header(t).rlike(DRAWING)
    reason = F.when(empty, SKIPS[0]).when(markdown.field(t, "id").isNotNull(), SKIPS[1]).when(drawn, SKIPS[2]).when(F.col("known").isNotNull(), SKIPS[3])
    inline = F.filter(markdown.list_field(t, "tags"), lambda x: (x != "") & is_usable(x))
    alone = F.filter(F.split(F.coalesce(markdown.field(t, "tag"), F.lit("")), r"[,\s]+"), lambda x: x != "")
    subjects = subject(folder)
    rows = rows.withColumns(
        {
            "reason": reason,
            "created": F.coalesce("written.created", "stamp", F.date_trunc("second", "modified")),
            "created_from": F.coalesce("written.key", F.when(F.col("stamp").isNotNull(), "filename"), F.lit("file-mtime")),
            "tags": folder_tags(F.array_join(subjects, "/"), F.when(F.size(inline) > 0, inline).otherwise(alone)),
            "words": F.size(F.filter(F.split("body", r"\s+"), lambda w: w != "")),
            "base": F.concat(F.date_format("created", STAMP), F.lit("-"), markdown.slug(F.col("title"), SLUG_CHARS)),
        }
    )
    keep = F.col("reason").isNull()
    named = _numbered(rows.filter(keep).select("source", "base"), adopted.select("id"))
    rows = rows.drop("base").join(named, "source", "left")
    target = F.concat_ws("/", F.lit(bucket), F.array_join(subjects, "/"))
    dest = F.concat(F.regexp_replace(target, "/+$", ""), F.lit("/"), markdown.slug(F.col("title")), F.lit("--"), F.substring("id", 1, 15), F.lit(".md"))
    fields = [F.when(keep, F.col(c)).alias(c) for c in ("title", "created", "created_from", "tags", "words")]
    return rows.select("source", F.when(keep, "adopt").otherwise("skip").alias("action"), "reason", F.coalesce("id", F.when(F.col("reason") == SKIPS[3], F.col("known"))).alias("id"), F.when(keep, dest).alias("dest"), *fields, (keep & (F.col("created_from") == "file-mtime")).alias("provisional"))


def _numbered(rows: DataFrame, used: DataFrame) -> DataFrame:
    """(source, id): the base, or the base with the next free number from 2 on, in the order of sources."""
    taken = used.filter("id is not null").select(F.regexp_replace("id", r"-(\d{1,9})$", "").alias("head"), "id")
    whole = used.filter("id is not null").select(F.col("id").alias("base"), F.lit(1).alias("n"))
    suffixed = taken.filter("head <> id").select(F.col("head").alias("base"), F.regexp_extract("id", r"-(\d{1,9})$", 1).cast("int").alias("n"))
    busy = whole.unionByName(suffixed).distinct().groupBy("base").agg(F.array_sort(F.collect_list("n")).alias("busy"))
    asked = rows.withColumn("place", F.row_number().over(W.partitionBy("base").orderBy("source"))).join(busy, "base", "left")
    busy_ = F.coalesce("busy", F.array().cast("array<int>"))
    # each number in use up to the place moves it on by one
    moved = F.aggregate(busy_, F.col("place"), lambda n, b: F.when(b <= n, n + 1).otherwise(n))
    return asked.select("source", F.when(moved == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), moved.cast("string"))).alias("id"))


def manifest(plan: DataFrame, files: DataFrame, run: str) -> DataFrame:
    """(run, source, sha256, id, dest) of what a plan brings in: written beside the notes, it says later what came from where."""
    return plan.filter("action = 'adopt'").join(files.select("source", "sha256"), "source").select(F.lit(run).alias("run"), "source", "sha256", "id", "dest")


def verified(manifest_: DataFrame, files: DataFrame) -> DataFrame:
    """(source, state): whether each original of a manifest is intact, changed or missing; files: source, sha256."""
    now = files.select("source", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed").otherwise("intact")
    return manifest_.select("source", "sha256").join(now, "source", "left").select("source", state.alias("state"))


def shown_assets(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The distinct names of pictures and the like that notes to be brought in show."""
    texts = files.join(plan.filter("action = 'adopt'").select("source"), "source", "left_semi")
    names = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#\n]+)"), F.lit(1))).alias("name"))
    bare = F.element_at(F.split(F.trim("name"), "/"), -1)
    return names.select(bare.alias("asset")).filter(F.lower(F.element_at(F.split("asset", r"\."), -1)).isin(*ASSETS)).distinct()
