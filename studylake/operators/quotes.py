"""Where quotations stand: an index of short pieces of passages, and titles that texts name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType

from ..sources import markdown
from ..sources.kept import kept
from .passages import LEAST_QUOTE, norm

# fixed values: characters of the shortest answer that is looked for and of the shortest piece of a cut cloze, and how much of a cloze is looked for
LEAST_ANSWER, LEAST_PIECE, CLOZE_CHARS = 6, 20, 120
TITLE_CHARS = 5  # fixed value: the shortest title that is looked for
FIRST_WORDS = 3  # fixed value: by how many of its first words a title is looked up before it is compared
GRAM, SPAN = 4, 3  # of SPAN neighbouring grams of GRAM characters one is kept, so any GRAM + SPAN - 1 characters hold a kept one
FENCED, LINKED = r"(?s)```.*?```", r"\[\[[^\]|#]+(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
MARKER = "<!-- suggested links, renewed by each run -->"


@F.pandas_udf(ArrayType(IntegerType()))
def _kept_grams(texts: pd.Series) -> pd.Series:
    return pd.Series([kept_grams(t) for t in texts])


def kept_grams(text: str | None) -> list[int]:
    """The grams of a plain (ASCII) text that its neighbourhood keeps: of SPAN in a row the one with the least hash."""
    raw = np.frombuffer((text or "").encode("ascii", "replace"), dtype=np.uint8).astype(np.uint32)
    n = len(raw) - GRAM + 1
    if n < SPAN:
        return []
    grams = sum(raw[i : i + n] << np.uint32(8 * i) for i in range(GRAM))
    order = (grams.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
    spans = np.lib.stride_tricks.sliding_window_view(order, SPAN)
    return np.unique(grams[spans.argmin(axis=1) + np.arange(len(spans))]).astype(np.int64).tolist()


def containing(probes: DataFrame, passages: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Every (probe, place) where a passage contains a probe, as characters of normed text, of probes of 6 characters or more.

    probes: probe, text and the columns of within; passages: place, text and the columns of within, which must
    be equal (a probe is looked for in its own note, or everywhere without). Each passage is posted under the
    grams that it keeps. A probe is looked up under the one of its own kept grams that the fewest passages
    have; only those are searched. What a probe is long enough for it keeps, wherever it stands, so none is lost.
    """
    within = within or []
    said = passages.select(*within, "place", norm(F.col("text")).alias("said"))
    have = kept(said.withColumn("grams", _kept_grams("said")))  # read for counts, postings and texts
    posted = have.select(*within, "place", F.explode("grams").alias("gram"))
    counts = posted.groupBy(*within, "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = probes.select(*within, "probe", norm(F.col("text")).alias("sought")).filter(F.length("sought") >= GRAM + SPAN - 1)
    grams = asked.select(*within, "probe", "sought", F.explode(_kept_grams("sought")).alias("gram")).join(counts, [*within, "gram"], "left")
    # a gram that no passage has rules the probe out
    rarest = grams.groupBy(*within, "probe", "sought").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
    found = rarest.drop("n").join(posted, [*within, "gram"]).join(have.drop("grams"), [*within, "place"])
    return found.filter(F.contains("said", F.col("sought"))).select(*within, "probe", "place").distinct()


def card_probes(cards: DataFrame) -> DataFrame:
    """(note, card, turn, text): what a card is looked for by, in turn: its quotation, its cloze sentence, its answer, the long pieces of a cut cloze."""
    front, source, back = (F.coalesce(c, F.lit("")) for c in ("front", "source", "back"))
    cloze = F.contains(front, F.lit("{{"))
    filled = F.regexp_replace(front, r"\{\{|\}\}", "")
    pieces = F.filter(F.transform(F.split(filled, r"…|\.\.\."), norm), lambda p: F.length(p) >= LEAST_PIECE)
    by_length = F.transform(F.array_sort(F.transform(pieces, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    named = [F.when(F.length(norm(source)) >= LEAST_QUOTE, norm(source)), F.when(cloze, F.substring(norm(filled), 1, CLOZE_CHARS)), F.when(F.length(norm(back)) >= LEAST_ANSWER, norm(back))]
    turns = F.concat(F.array(*named), F.when(cloze, by_length).otherwise(F.array().cast("array<string>")))
    return cards.select("note", "card", F.posexplode(turns).alias("turn", "text")).filter("text is not null and text <> ''")


def placed_cards(cards: DataFrame, passages: DataFrame) -> DataFrame:
    """(note, card, place): the passage that each card was drawn from, null where none holds it.

    cards: note, card, front, back, source; passages: note, place, text. The first probe of a card that any
    passage of its note contains decides, and there the first passage.
    """
    probes = card_probes(cards).select("note", F.struct("card", "turn").alias("probe"), "text")
    found = containing(probes, passages, ["note"]).groupBy("note", F.col("probe.card").alias("card")).agg(F.min_by("place", F.struct("probe.turn", "place")).alias("place"))
    return cards.select("note", "card").join(found, ["note", "card"], "left")


def prose(text: Column) -> Column:
    """A text without fenced code, without linked titles, and without the section of links that the system has written itself."""
    own = markdown.without_section(text, "Related")
    bare = F.when(F.contains(text, F.lit(MARKER)), own).otherwise(text)
    cut = F.regexp_replace(F.regexp_replace(bare, FENCED, " "), LINKED, " ")
    return F.when(F.contains(text, F.lit(MARKER)) | F.contains(text, F.lit("```")) | F.contains(text, F.lit("[[")), cut).otherwise(text)


def is_matchable(title: Column) -> Column:
    return (F.length(F.trim(title)) >= TITLE_CHARS) & title.rlike("[A-Za-z]")


def start_key(words: Column, at: Column, n: int) -> Column:
    """A hash of n words from at on, or of those that are left."""
    return F.xxhash64(*(F.get(words, at + i) for i in range(n)))


def title_starts(notes: DataFrame, names: DataFrame, lengths: list[int]) -> DataFrame:
    """(note, at): the numbers of the words, from 0, where a note's first words are those of a name; few others share a hash.

    notes: note, said; names: key; lengths: how many words the keys are of. Rows are hashes of places, without texts,
    and each text is read as words once: an inner explode would read it again to drop texts without words.
    """
    words = notes.select("note", F.regexp_extract_all("said", F.lit(r"(?U)[a-z\w]+"), F.lit(0)).alias("words"))  # a-z, which \w holds, is tried first
    places = words.select("note", "words", F.posexplode_outer("words").alias("at", "word"))
    keys = places.select("note", "at", F.explode(F.array(*(start_key(F.col("words"), F.col("at"), n) for n in lengths))).alias("key"))
    return keys.join(names.select("key").distinct(), "key", "left_semi").groupBy("note").agg(F.collect_set("at").alias("at"))


def mentions(notes: DataFrame, titles: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(note, target) for each title that a note's prose names letter for letter, case aside, the longest at each place.

    notes: note, text; titles: note, title (that begin and end with a word's letter); known: note, text of links
    that a note has already, by default those of notes. Of names that overlap, the first and there the longest
    counts. Places whose first words are those of a title are found by hashes. From there alone texts are read as words
    and what stands between; runs of as many words as any title has are joined with the titles by equality. The
    numbers of words that titles have are collected: a row for each.
    """
    said = F.lower(prose(F.coalesce(F.col("text"), F.lit("")))).alias("said")
    name = F.lower(F.trim("title"))
    listed = titles.filter(is_matchable(F.col("title")) & name.rlike(r"(?U)^\w(?:.*\w)?$")).select("note", name.alias("name"), markdown.slug(F.col("title")).alias("slug"))
    owner = listed.groupBy("slug").agg(F.min("note").alias("target"))
    words = F.regexp_extract_all("name", F.lit(r"(?U)\w+"), F.lit(0))
    named = listed.select("name", "slug").distinct().join(owner, "slug").withColumn("w", words)
    names = kept(named.select("name", "slug", "target", F.size("w").alias("words"), start_key(F.col("w"), F.lit(0), FIRST_WORDS).alias("key")))  # read for sizes, keys and names
    sizes = sorted(r["words"] for r in names.select("words").distinct().collect())
    if not sizes:
        return notes.select("note", F.col("note").alias("target")).limit(0)
    starts = kept(title_starts(notes.select("note", said), names, sorted({min(n, FIRST_WORDS) for n in sizes})))  # of known size: few of them don't move the texts
    pieces = F.regexp_extract_all("said", F.lit(r"(?U)\w+|[^\w]+"), F.lit(0))
    rows = notes.select("note", "text").join(starts, "note").select("note", "at", said).select("note", "at", pieces.alias("p")).select("note", "at", "p", F.when(F.get("p", F.lit(0)).rlike(r"(?U)^\w"), 0).otherwise(1).alias("lead"))
    begin = F.transform("at", lambda a: F.col("lead") + 2 * a)
    runs = F.flatten(F.transform(begin, lambda i: F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: i + 2 * n - 1 <= F.size("p")), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("p", i + 1, 2 * n - 1), "").alias("name")))))
    grams = rows.select("note", F.explode(runs).alias("g")).select("note", "g.*")
    hits = grams.join(names.select("name", "slug", "target"), "name").groupBy("note").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("shorter"), "slug", "target"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<slug:string,target:bigint>>").alias("found"))
    taken = F.aggregate("hits", start, lambda a, h: F.when(h["at"] >= a["end"], F.struct((h["at"] - 2 * h["shorter"] - 1).alias("end"), F.array_append(a["found"], F.struct(h["slug"], h["target"])).alias("found"))).otherwise(a))
    found = hits.select("note", F.explode(F.array_distinct(taken["found"])).alias("x")).select("note", "x.*").filter("note <> target")
    links = (known if known is not None else notes).select("note", F.explode(F.transform(markdown.wikilinks(F.when(F.contains(F.col("text"), F.lit(MARKER)), markdown.without_section(F.col("text"))).otherwise(F.col("text"))), lambda t: markdown.slug(t))).alias("slug")).distinct()
    own = titles.select("note", markdown.slug(F.col("title")).alias("slug"))
    return found.join(links.unionByName(own).distinct(), ["note", "slug"], "left_anti").select("note", "target").distinct()
