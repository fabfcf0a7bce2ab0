"""Notes and decks kept as Markdown files: front matter, headings, links, cards and logs, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the fence of front matter, labels of a card's fields, and headings that the system itself renders
FENCE = "---"
FIELDS = ("Q", "A", "Hint", "Why", "Type", "Worked", "Choices", "Mode")
HEADER = r"(?s)^\ufeff?---[ \t]*\r?\n(.*?\n)??[ \t]*---[ \t]*(?:\r?\n|$)"


def vault_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, bucket (first folder below), folder, stamp, modified and text of each Markdown file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    root = F.lit(folder.rstrip("/").split("/")[-1])
    inside = F.element_at(F.split("path", F.concat(F.lit("/"), root, F.lit("/"))), -1)
    where = F.regexp_extract(inside, r"^(.*)/[^/]*$", 1)
    return rows.select("path", F.split_part(inside, F.lit("/"), F.lit(1)).alias("bucket"), where.alias("folder"), stamp(F.col("path")).alias("stamp"), F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("text"))


def stamp(path: Column) -> Column:
    """The second-stamp of a file's name, null without one."""
    return F.nullif(F.regexp_extract(path, r"--(\d{8}T\d{6})\.md$", 1), F.lit(""))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 with its mark, else UTF-8 without one, else Windows-1252; line ends are \\n."""
    mark, empty = F.hex(F.substring(content, 1, 2)), F.lit(b"")
    utf8 = F.try_validate_utf8(content.cast("string"))
    high = bytes(range(0x80, 0xA0))  # where Windows-1252 differs from Latin-1
    latin = F.translate(F.decode(F.when(utf8.isNull(), content).otherwise(empty), "ISO-8859-1"), high.decode("latin-1"), high.decode("cp1252", "replace"))
    wide = mark.isin("FFFE", "FEFF")
    text = F.when(wide, F.decode(F.when(wide, content).otherwise(empty), "UTF-16")).otherwise(F.coalesce(utf8, latin))
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n")


def header(text: Column) -> Column:
    """The lines between the fences, '' without front matter."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), HEADER, 1), F.lit(""))


def body(text: Column) -> Column:
    """The text without its front matter, which has fields or is empty; a rule at the top is no front matter."""
    t = F.coalesce(text, F.lit(""))
    fenced = t.rlike(HEADER) & ((F.trim(header(t)) == "") | header(t).rlike(r"(?m)^[A-Za-z_][\w-]*:"))
    return F.when(fenced, F.regexp_replace(F.regexp_replace(t, HEADER, ""), r"^\n+", "")).otherwise(t)


def field(text: Column, name: str) -> Column:
    """A scalar field of the front matter without quotes; null if it is missing or blank."""
    raw = F.trim(F.regexp_extract(header(text), rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1))
    return F.nullif(F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))


def list_field(text: Column, name: str) -> Column:
    """A list of the front matter, in brackets or a line for each entry."""
    inline = F.regexp_extract(header(text), rf"(?m)^{name}:[ \t]*\[(.*)\]", 1)
    block = F.regexp_extract_all(F.regexp_extract(header(text), rf"(?m)^{name}:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1), F.lit(r"(?m)^[ \t]*- [ \t]*(.*?)[ \t]*$"), 1)
    items = F.when(inline != "", F.split(inline, r"\s*,\s*")).otherwise(block)
    return F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", ""))


def rendered(fields: dict[str, Column], text: Column) -> Column:
    """Front matter and body as one text; fields that are null are left out, and the text ends with one line end."""
    lines = F.concat_ws("\n", F.lit(FENCE), *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()), F.lit(FENCE))
    return F.concat(lines, F.lit("\n\n"), F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n+$", ""), F.lit("\n"))


def notes_of(files: DataFrame) -> DataFrame:
    """Notes with an id, from files (path, bucket, folder, text)."""
    t = F.col("text")
    return files.select(field(t, "id").alias("id"), field(t, "title").alias("title"), "bucket", "folder", list_field(t, "tags").alias("tags"), field(t, "created").alias("created"), body(t).alias("body"), "path").filter("id is not null")


def wikilinks(text: Column) -> Column:
    """The titles in [[...]], without labels or headings."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), 1)
    return F.transform(found, lambda x: F.trim(x))


def slug(title: Column, most: int = 60) -> Column:
    """Lower-case letters and digits joined by dashes; accents are dropped where a letter has a plain form."""
    folded = F.translate(F.lower(title), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    whole = F.trim(F.regexp_replace(folded, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(whole, 1, most), F.lit("-"))


def title_index(notes: DataFrame) -> DataFrame:
    """(slug, path): of notes (title, path) with one slug the first path counts."""
    return notes.select(slug(F.col("title")).alias("slug"), "path").filter("slug <> ''").groupBy("slug").agg(F.min("path").alias("path"))


def section(text: Column, heading: str) -> Column:
    """What stands under a heading, up to the next one of any level; '' without it."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?ims)^#{{1,6}}[ \t]+{heading}[ \t]*:?[ \t]*$(.*?)(?=^#{{1,6}}[ \t]|\z)", 1), F.lit(" \n\t"))


def without_section(text: Column, heading: str = "Related") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?ims)^#{{1,6}}[ \t]+{heading}[ \t]*:?[ \t]*$.*?(?=^#{{1,6}}[ \t]|\z)", "")


def prose_words(text: Column) -> Column:
    """Words outside front matter and fenced code."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?ms)^---.*?^---", ""), r"(?s)```.*?```", "")
    return F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))


def headings(text: Column) -> Column:
    """The text of each heading of the second level or deeper."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^##+[ \t]+(.*?)[ \t]*$"), 1), lambda x: F.trim(x))


def cards_of(decks: DataFrame, text: str = "text") -> DataFrame:
    """A row for each "### Card <id>" of the decks, with its labelled fields; the decks' other columns stay."""
    pieces = F.slice(F.split(body(F.col(text)), r"(?m)^###[ \t]+Card[ \t]+"), F.lit(2), F.lit(1 << 30))
    rows = decks.withColumn("__card", F.explode(pieces))
    card = F.col("__card")
    labels = "|".join(FIELDS)
    value = lambda name: F.nullif(F.trim(F.regexp_extract(card, rf"(?ms)^\*\*{name}:?\*\*:?[ \t]*(.*?)(?=^\*\*(?:{labels}):?\*\*|\z)", 1), F.lit(" \n\t")), F.lit(""))
    return rows.select(*(c for c in decks.columns if c != text), F.trim(F.split_part(card, F.lit("\n"), F.lit(1))).alias("card"), *(value(n).alias(n.lower()) for n in FIELDS))


def choices(text: Column) -> Column:
    """Options of a choice card: list marks are dropped, and options that differ in case or punctuation alone count once."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:[-*+]|\(?[A-Za-z0-9][.)])\s+", ""))), lambda x: x != "")
    keys = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return F.filter(lines, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def log_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are no object of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def card_question(front: Column) -> Column:
    """A cloze card's front with its blanks hidden."""
    return F.regexp_replace(front, r"\{\{(?:c\d+::)?(.+?)(?:::[^}]*)?\}\}", "[…]")


def cloze_answers(front: Column) -> Column:
    return F.transform(F.regexp_extract_all(front, F.lit(r"\{\{(?:c\d+::)?(.+?)(?:::[^}]*)?\}\}"), 1), lambda x: F.trim(x))
