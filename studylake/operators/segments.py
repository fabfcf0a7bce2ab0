"""Long texts cut into notes: lines, blocks, sections by headings, parts by size, and what a cut has lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import captures
from ..functions.dates import let

# fixed values: words of a part at most, and of a fragment under a heading or elsewhere that joins the part before it
MOST_WORDS, LEAST_UNDER_HEADING, LEAST_WORDS = 400, 12, 30
SPLIT_FLOOR = 120  # fixed value: words from which a text without marks is cut
FENCE, HEADING, RULE = r"^\s{0,3}(```|~~~)", r"^(#{1,6})\s+(.*?)\s*#*\s*$", r"^\s{0,3}([-*_])(?:\s*\1){2,}\s*$"
BULLET, TABLE = r"^\s*(?:[-*+]|\d+[.)])\s+", r"^\s*\|.*\|\s*$"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def _lines(text: Column) -> Column:
    """A text's lines in order, as structs of at, line, kind and level (see `lines`)."""

    def open_at(ls: Column) -> Column:
        # up to a line stand as many marks of fences as up to the mark behind it: each stretch between two marks is open or not as a whole
        marks = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(FENCE), i)), lambda i: i.isNotNull())
        stretch = lambda edges: F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda k: F.array_repeat(k % 2 == 1, F.get(edges, k + 1) - F.get(edges, k)))
        return let(F.concat(F.array(F.lit(-1)), marks, F.array(F.size(ls) - 1)), lambda edges: F.flatten(stretch(edges)))

    def kind(line: Column, open_: Column) -> Column:
        return F.when(open_ | line.rlike(FENCE), "code").when(F.trim(line) == "", "blank").when(line.rlike(HEADING), "heading").when(line.rlike(RULE), "rule").when(line.rlike(TABLE), "table").when(line.rlike(BULLET), "list").otherwise("para")

    def told(ls: Column) -> Column:
        kinds = let(open_at(ls), lambda opens: F.transform(ls, lambda x, i: F.struct(i.alias("at"), x.alias("line"), kind(x, F.get(opens, i)).alias("kind"))))
        return F.transform(kinds, lambda z: F.struct(z["at"], z["line"], z["kind"], F.when(z["kind"] == "heading", F.length(F.regexp_extract(z["line"], HEADING, 1))).alias("level")))

    return let(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), told)


def _said(lines_: Column) -> Column:
    return F.array_join(F.transform(lines_, lambda z: z["line"]), "\n")


def _stretches(rows: Column, starts: Column, skipped: int = 0) -> Column:
    """The rows from each start (places, in order) to the next one, without the first ones."""
    ends = F.array_append(F.slice(starts, F.lit(2), F.size(starts)), F.size(rows))
    return let(ends, lambda ends_: F.transform(starts, lambda b, k: F.slice(rows, b + 1 + skipped, F.get(ends_, k) - b - skipped)))


def _block_starts(rows: Column) -> Column:
    """Where a block begins among lines that aren't blank."""

    def apart(z: Column, before: Column) -> Column:
        return before.isNull() | (before["kind"] != z["kind"]) | ((z["at"] - before["at"] > 1) & (z["kind"] != "code")) | z["kind"].isin("heading", "rule")

    return F.filter(F.transform(rows, lambda z, i: F.when(apart(z, F.get(rows, i - 1)), i)), lambda i: i.isNotNull())


def _blocks(text: Column) -> Column:
    """A text's blocks in order, each as its lines."""
    solid = F.filter(_lines(text), lambda z: z["kind"] != "blank")
    return let(solid, lambda rows: let(_block_starts(rows), lambda starts: _stretches(rows, starts)))


def _block_structs(text: Column) -> Column:
    """A text's blocks in order, as structs of block, kind, level, title, text and words."""

    def told(b: Column, k: Column) -> Column:
        first = F.get(b, F.lit(0))
        title = F.when(first["kind"] == "heading", F.regexp_extract(first["line"], HEADING, 2))
        return F.struct(k.cast("long").alias("block"), first["kind"].alias("kind"), first["level"].alias("level"), title.alias("title"), _said(b).alias("text"))

    each = F.transform(_blocks(text), told)
    return F.transform(each, lambda z: F.struct(*(z[c] for c in ("block", "kind", "level", "title", "text")), word_count(z["text"]).cast("long").alias("words")))


def _cut_level(levels: Column) -> Column:
    """The shallowest level that repeats, or the deepest if none does; null without headings."""
    again = F.filter(F.array(*map(F.lit, range(1, 7))), lambda n: F.size(F.filter(levels, lambda x: x == n)) > 1)
    return F.coalesce(F.array_min(again), F.array_max(levels))


def lines(notes: DataFrame, key: str = "note", text: str = "text") -> DataFrame:
    """(key, line number, line, kind, level): kind is heading, rule, code, blank, list, table or para; marks within fences are code."""
    return notes.select(key, F.explode(_lines(F.col(text))).alias("z")).select(key, "z.*")


def blocks(notes: DataFrame, key: str = "note", text: str = "text") -> DataFrame:
    """(key, block, kind, words, lines): runs of lines of one kind; headings and rules stand alone, fences stay whole with their empty lines."""
    rows = notes.select(key, F.posexplode(_blocks(F.col(text))).alias("block", "b"))
    return rows.select(key, F.col("block").cast("long").alias("block"), F.get("b", F.lit(0))["kind"].alias("kind"), word_count(_said(F.col("b"))).cast("long").alias("words"), F.size("b").cast("long").alias("lines"))


def sections(notes: DataFrame, key: str = "note", text: str = "text") -> DataFrame:
    """(key, section, title, words, body): cut at headings up to the shallowest level that repeats, or the deepest if none does; without headings a note is one section.

    A note's lines stay in its row, so nothing is shuffled or sorted.
    """

    def cut(rows: Column) -> Column:
        level = _cut_level(F.transform(F.filter(rows, lambda z: z["kind"] == "heading"), lambda z: z["level"]))
        heads = let(level, lambda most: F.filter(F.transform(rows, lambda z, i: F.when((z["kind"] == "heading") & (z["level"] <= most), i)), lambda i: i.isNotNull()))
        # the first section has no heading: it begins where one would stand before the first line
        return let(F.array_prepend(heads, F.lit(-1)), lambda starts: F.transform(F.arrays_zip(starts.alias("b"), _stretches(rows, starts, 1).alias("body")), lambda z: F.struct(F.when(z["b"] >= 0, F.regexp_extract(F.get(rows, z["b"])["line"], HEADING, 2)).alias("title"), _said(z["body"]).alias("body"))))

    each = notes.select(key, F.posexplode(let(_lines(F.col(text)), cut)).alias("section", "z"))
    out = each.select(key, F.col("section").cast("long").alias("section"), "z.title", word_count(F.col("z.body")).cast("long").alias("words"), F.btrim("z.body", F.lit("\n")).alias("body"))
    return out.filter(F.col("words") > 0)


def parts_by_size(sizes: Column, most: int = MOST_WORDS) -> Column:
    """The number of the part of each of an array of sizes, packed in order up to most; one that is larger stands alone."""
    start = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & (a["n"] + x > most)
        part = F.when(full, a["part"] + 1).otherwise(a["part"])
        return F.struct(part.alias("part"), F.when(full, x.cast("long")).otherwise(a["n"] + x).alias("n"), F.array_append(a["parts"], part).alias("parts"))

    return F.aggregate(sizes, start, step)["parts"]


def packed(blocks_: DataFrame, key: str = "note", most: int = MOST_WORDS) -> DataFrame:
    """(key, part, blocks, words) of blocks (key, block, kind, words) packed in order; rules are left out."""
    rows = blocks_.filter("kind <> 'rule'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "words"))).alias("b"))
    rows = rows.select(key, F.arrays_zip(F.col("b").alias("b"), parts_by_size(F.transform("b", lambda x: x["words"]), most).alias("part")).alias("z")).select(key, F.explode("z").alias("z"))
    return rows.groupBy(key, F.col("z.part").alias("part")).agg(F.count(F.lit(1)).alias("blocks"), F.sum("z.b.words").alias("words"))


def merged(sections_: DataFrame, key: str = "note", most: int = MOST_WORDS) -> DataFrame:
    """(key, place, sections, words): fragments join the section before them where both have room, a first one the section behind it; a joined section brings its heading along (sections: key, section, title, words)."""
    head = F.when(F.col("title").isNull(), 0).otherwise(1 + word_count(F.col("title")))
    least = F.when(F.col("title").isNull(), LEAST_WORDS).otherwise(LEAST_UNDER_HEADING)
    rows = sections_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "words", head.alias("head"), least.alias("least")))).alias("s"))
    start = F.array().cast("array<struct<sections:int,words:bigint,head:int,least:int>>")

    def joined(x: Column, more: Column) -> Column:
        return F.struct((x["sections"] + 1).alias("sections"), (x["words"] + more).cast("long").alias("words"), x["head"].alias("head"), x["least"].alias("least"))

    def step(a: Column, x: Column) -> Column:
        n = F.size(a)
        last = F.get(a, n - 1)
        small = (n > 0) & (x["words"] < x["least"]) & (last["words"] + x["words"] <= most)
        one = F.struct(F.lit(1).alias("sections"), x["words"].cast("long").alias("words"), x["head"].alias("head"), x["least"].alias("least"))
        return F.when(small, F.array_append(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), joined(last, x["words"] + x["head"]))).otherwise(F.array_append(a, one))

    rows = rows.select(key, F.aggregate("s", start, step).alias("p"))
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    early = (F.size("p") > 1) & (first["words"] < first["least"]) & (first["words"] + second["words"] <= most)
    both = F.array_prepend(F.slice("p", F.lit(3), F.size("p")), joined(second, first["words"] + first["head"]))
    rows = rows.select(key, F.posexplode(F.when(early, both).otherwise(F.col("p"))).alias("place", "p"))
    return rows.select(key, "place", "p.sections", "p.words")


def comparable(text: Column) -> Column:
    """A text's lines for comparison: small letters, single spaces, without heading marks; rules and empty lines are left out."""
    flat = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    bare = F.transform(flat, lambda x: F.lower(F.regexp_replace(x, r"^#{1,6}\s+|\s*#+$", "")))
    return F.filter(bare, lambda x: (x != "") & ~x.rlike(RULE) & ~x.rlike("^[=-]+$"))


def lost_lines(notes: DataFrame, cut: DataFrame, key: str = "note", text: str = "text") -> DataFrame:
    """Lines of notes that neither bodies nor titles of their sections (cut: key, title, body) have.

    A note meets the lines of its sections as one row. The join is sorted: what a table's file tells of its size
    says nothing of the texts that were made of it, so neither side may be broadcast.
    """
    none = F.array().cast("array<string>")
    have = cut.select(key, comparable(F.concat_ws("\n", "title", "body")).alias("have")).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("have"))).alias("have"))
    rows = notes.select(key, comparable(F.col(text)).alias("said")).join(have.hint("merge"), key, "left").select(key, "said", F.array_except("said", F.coalesce("have", none)).alias("lost"))
    return rows.filter(F.size("lost") > 0).select(key, F.explode(F.filter("said", lambda x: F.array_contains("lost", x))).alias("line"))


def block_texts(notes: DataFrame, key: str = "note", text: str = "text") -> DataFrame:
    """The blocks of notes with their text, and of headings level and title."""
    return notes.select(key, F.explode(_block_structs(F.col(text))).alias("z")).select(key, "z.*")


def plans(blocks_: DataFrame, key: str = "note", topics: DataFrame | None = None) -> DataFrame:
    """(key, plan, cut, words): how each note is cut, the first that its blocks allow: whole, heading (at levels up to cut), rule, topic (if a model has named two) or size."""
    heads = blocks_.filter("kind = 'heading'").groupBy(key, "level").agg(F.count(F.lit(1)).alias("n"))
    cut = heads.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("n") > 1, F.col("level"))), F.max("level")).alias("cut"))
    rows = blocks_.groupBy(key).agg(F.sum("words").alias("words"), F.bool_or(F.col("kind") == "rule").alias("ruled")).join(cut, key, "left")
    named = F.lit(False)
    if topics is not None:
        rows = rows.join(topics.groupBy(key).agg(F.countDistinct("block").alias("topics")), key, "left")
        named = F.coalesce(F.col("topics") >= 2, F.lit(False))
    return rows.select(key, _plan(F.col("words"), named).alias("plan"), "cut", "words")


def _plan(words: Column, named: Column) -> Column:
    return F.when(F.col("cut").isNotNull(), "heading").when(F.col("ruled"), "rule").when(words < SPLIT_FLOOR, "whole").when(named, "topic").otherwise("size")


def segmented(notes: DataFrame, key: str = "note", text: str = "text", topics: DataFrame | None = None, most: int = MOST_WORDS) -> DataFrame:
    """(key, ordinal, plan, boundary, title, path, body, words): the notes that each text (key, text) is made of, without losing a line.

    Each text is cut by its own plan (see `plans`; topics: key, block, title, where a model sees one begin). What
    is larger than most is packed again, block by block; then a fragment joins the segment before it where both
    have room, and a first one the segment behind it; a joined one brings its heading along.
    """
    whole = notes.select(key, _block_structs(F.col(text)).alias("b")).filter(F.size("b") > 0)
    if topics is not None:
        whole = whole.join(topics.groupBy(key).agg(F.countDistinct("block").alias("topics")), key, "left")
    heads = F.transform(F.filter("b", lambda z: z["kind"] == "heading"), lambda z: z["level"])
    whole = whole.withColumns({"cut": let(heads, _cut_level), "ruled": F.exists("b", lambda z: z["kind"] == "rule"), "all": F.aggregate("b", F.lit(0).cast("long"), lambda n, z: n + z["words"])})
    whole = whole.withColumn("plan", _plan(F.col("all"), F.coalesce(F.col("topics") >= 2, F.lit(False)) if topics is not None else F.lit(False)))
    each = whole.select(key, "plan", "cut", F.explode("b").alias("z")).select(key, "plan", "cut", "z.*")
    order = W.partitionBy(key).orderBy("block")
    head = (F.col("plan") == "heading") & (F.col("kind") == "heading") & (F.col("level") <= F.col("cut"))
    rule = (F.col("plan") == "rule") & (F.col("kind") == "rule")
    topic = F.lit(False)
    each = each.withColumn("named", F.lit(None).cast("string"))
    if topics is not None:
        marks = topics.select(key, "block", F.col("title").alias("__named"))
        each = each.join(marks, [key, "block"], "left").withColumn("named", F.col("__named")).drop("__named")
        topic = (F.col("plan") == "topic") & F.col("named").isNotNull()
    each = each.withColumns({"head": F.coalesce(head, F.lit(False)), "segment": F.sum(F.coalesce(head | rule | topic, F.lit(False)).cast("int")).over(order)})
    name = F.max(F.coalesce(F.when(F.col("head"), F.col("title")), F.col("named"))).over(W.partitionBy(key, "segment"))
    # the headings in force above a cut: of each level the last one, as far as nothing shallower has come since
    above = [F.last(F.when(F.col("head") & (F.col("level") <= n), F.when(F.col("level") == n, F.col("title")).otherwise(F.lit(""))), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)) for n in range(1, 6)]
    path = F.filter(F.array(*(F.when(F.col("level") > n + 1, x) for n, x in enumerate(above))), lambda x: x.isNotNull() & (x != ""))
    each = each.withColumns({"name": name, "path": F.first(F.when(F.col("head"), path), ignorenulls=True).over(W.partitionBy(key, "segment"))})
    # a mark is no part of a body; a rule that begins one, and any rule in other plans, is left out
    solid = F.count_if(~F.col("head") & (F.col("kind") != "rule")).over(W.partitionBy(key, "segment").orderBy("block"))
    each = each.withColumn("solid", solid)
    body = each.filter(~F.col("head") & ~((F.col("kind") == "rule") & ((F.col("plan") != "heading") | (F.col("solid") == 0))))
    whole = body.groupBy(key, "segment").agg(F.first("plan").alias("plan"), F.first("name").alias("name"), F.first("path").alias("path"), F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("block", "words", "text"))).alias("b"))
    large = F.col("words") > most
    parts = F.when(large, parts_by_size(F.transform("b", lambda x: x["words"]), most)).otherwise(F.transform("b", lambda x: F.lit(0)))
    whole = whole.withColumn("parts", parts).withColumn("n_parts", F.array_max("parts") + 1)
    pieces = whole.select(key, "segment", "plan", "name", "path", "n_parts", F.explode(F.arrays_zip(F.col("b").alias("b"), F.col("parts").alias("part"))).alias("z"))
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z.b.block", "z.b.text"))), lambda x: x["text"]), "\n\n")
    cut = pieces.groupBy(key, "segment", F.col("z.part").alias("part")).agg(*(F.first(c).alias(c) for c in ("plan", "name", "path", "n_parts")), F.sum("z.b.words").alias("words"), text_.alias("body"))
    split = (F.col("n_parts") > 1) & (F.col("plan") != "size")
    numbered = F.concat("name", F.lit(" ("), F.col("part") + 1, F.lit("/"), "n_parts", F.lit(")"))
    own = F.coalesce("path", F.array().cast("array<string>"))
    cut = cut.select(key, "segment", "part", "plan", "words", "body", F.when(split, numbered).otherwise(F.col("name")).alias("title"), F.when(split & F.col("name").isNotNull(), F.array_append(own, F.col("name"))).otherwise(own).alias("path"), F.concat("plan", F.when(split, "+size").otherwise("")).alias("boundary"))
    return _without_fragments(cut, key, most)


def _without_fragments(cut: DataFrame, key: str, most: int) -> DataFrame:
    """Segments (key, segment, part, plan, boundary, title, path, body, words) with fragments joined to a neighbour, numbered."""
    least = F.when(F.col("plan") == "heading", LEAST_UNDER_HEADING).otherwise(LEAST_WORDS)
    carried = F.when(F.col("title").isNull(), 0).otherwise(1 + word_count(F.col("title")))
    held = ("segment", "part", F.col("words").cast("long").alias("words"), least.alias("least"), carried.alias("carried"), "plan", "boundary", "title", "path", "body")
    sizes = cut.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("s"))
    start = F.struct(F.lit(-1).alias("group"), F.lit(0).cast("long").alias("room"), F.array().cast("array<int>").alias("groups"))

    def step(a: Column, x: Column) -> Column:
        joins = (a["group"] >= 0) & (x["words"] < x["least"]) & (a["room"] + x["words"] <= most)
        group = F.when(joins, a["group"]).otherwise(a["group"] + 1)
        return F.struct(group.alias("group"), F.when(joins, a["room"] + x["words"] + x["carried"]).otherwise(x["words"]).alias("room"), F.array_append(a["groups"], group).alias("groups"))

    rows = sizes.select(key, F.posexplode(F.arrays_zip("s", F.aggregate("s", start, step)["groups"].alias("group"))).alias("at", "z")).select(key, "at", "z.s.*", "z.group")
    lead = F.row_number().over(W.partitionBy(key, "group").orderBy("at")) == 1
    rows = rows.withColumn("lead", lead).withColumn("all", F.sum(F.col("words") + F.when(F.col("lead"), 0).otherwise(F.col("carried"))).over(W.partitionBy(key, "group")))
    of = W.partitionBy(key)
    first, second = (F.max(F.when(F.col("group") == g, F.col("all"))).over(of) for g in (0, 1))
    floor = F.max(F.when(F.col("at") == 0, F.col("least"))).over(of)
    rows = rows.withColumn("forward", F.coalesce((first < floor) & (first + second <= most), F.lit(False)))
    moved = F.col("forward") & (F.col("group") == 0)
    rows = rows.withColumns({"lead": F.col("lead") & ~moved, "group": F.when(moved, 1).otherwise(F.col("group"))})
    told = F.when(F.col("lead") | F.col("title").isNull(), F.col("body")).otherwise(F.concat(F.lit("## "), "title", F.lit("\n\n"), "body"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", told.alias("t")))), lambda x: x["t"]), "\n\n")
    out = rows.groupBy(key, "group").agg(*(F.max(F.when(F.col("lead"), F.col(c))).alias(c) for c in ("plan", "boundary", "title", "path")), F.btrim(joined, F.lit("\n")).alias("body"))
    ordinal = F.row_number().over(W.partitionBy(key).orderBy("group"))
    return out.select(key, ordinal.alias("ordinal"), "plan", "boundary", F.coalesce("title", captures.title(F.col("body"))).alias("title"), "path", "body", word_count(F.col("body")).alias("words"))
