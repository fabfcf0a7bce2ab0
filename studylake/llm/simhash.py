"""Document fingerprints (SimHash) with built-in functions alone.

Terms are pairs of neighbouring lower-case words (the last word stands alone). Each term hash votes on
128 signed bits with the term's length in bytes as weight, once per occurrence. A bit is 1 where the
ones outweigh half of all weight. Permuted block tables find all fingerprints within a Hamming radius:
with radius + 1 blocks, two fingerprints within the radius agree on one block at least.

Defined results: a null text is an empty one; an empty text has no votes and all bits 0; equal texts
have equal fingerprints; rows that repeat both key and text have one next document and give a row each,
and rows with the same key and other texts are documents of their own, in the order of their hashes; a null key sorts last; an empty table gives an empty table.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, join_on, parts, written

BITS = 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1
LANES = 0x1_0000_0001  # bits i and i + 32 of a hash are counted in the two halves of one long


def _terms(text: Column) -> Column:
    words = F.split(F.lower(text), r"\s+")
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))


def _votes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: 64 sums that hold two counts each, and the whole weight."""
    a, b = F.col("__t")["a"], F.col("__t")["b"]
    rows = df.select(*keys, F.explode(_terms(F.col("text"))).alias("__t")).select(
        *keys,
        F.xxhash64(a, b).alias("__h0"),
        F.xxhash64(a, b, F.lit(1)).alias("__h1"),
        (F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0))).cast("long").alias("__w"),
    )
    sums = [F.sum(F.shiftrightunsigned(f"__h{h}", i).bitwiseAND(F.lit(LANES)) * F.col("__w")).alias(f"__s{h}_{i}") for h in (0, 1) for i in range(32)]
    return rows.groupBy(*keys).agg(F.sum("__w").alias("__all"), *sums)


def _signs(half: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(32):
        s = F.col(f"__s{half}_{i}")
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        for lane, bit in ((low, i), (high, i + 32)):
            out = out.bitwiseOR(F.shiftleft((lane * 2 > F.col("__all")).cast("long"), bit))
    return out


def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f0 and f1 (the fingerprint as two longs) for each row of df, which has keys and a text without nulls."""
    return _votes(df, keys).select(*keys, _signs(0).alias("f0"), _signs(1).alias("f1"))


def hex_of(f0: Column, f1: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (f0, f1)))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return 1.0 - distance(a0, a1, b0, b1) / F.lit(float(BITS))


def _ranges(cuts: list[int], nulls: int) -> list[tuple[int | None, int | None, int, int]]:
    """(from, up to, place, parts) of ranges of keys in descending order, null keys last; a key that several cuts name is a range of so many parts."""
    counts = Counter(cuts)
    known = sorted(counts)
    bounds: list[tuple[int, int, int]] = []
    for lo, hi in zip([LEAST, *known], [*known, MOST], strict=True):
        m = counts.get(lo, 1)
        if m > 1:
            bounds.append((lo, lo + 1, m))
            lo += 1
        if lo < hi:
            bounds.append((lo, hi, 1))
    bounds.reverse()
    return [(lo, hi, i, m) for i, (lo, hi, m) in enumerate(bounds)] + [(None, None, len(bounds), nulls)]


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each distinct (key, text) beside the next one by descending key; the first follows the last.

    Keys are cut into as many ranges as there are partitions, at approximate quantiles, of which only
    the bounds and first keys reach the driver; they come back as small tables (a few rows for each
    partition) that are broadcast. A key with many rows, or many null ones, is a range that is cut
    further by the hash of the text. The head of a range is dealt to the range before it as well, so one
    shuffle of the texts suffices.
    """
    spark = df.sparkSession
    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("hash", F.xxhash64("text"))
    n = 2 * parts(spark)
    seen = src.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n).alias("cuts"), F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("key").isNull()).alias("nulls")).first()
    least, most = seen["least"] or 0, seen["most"] or 0
    ranges = _ranges(seen["cuts"] or [], 1 + n * seen["nulls"] // max(1, seen["rows"]))
    width = (most - least) // (4 * n) + 1
    # keys meet their range in the cells of equal width that it touches
    cells = [(c, lo, hi, i, m) for lo, hi, i, m in ranges[:-1] for c in range((max(lo, least) - least) // width, (min(hi - 1, most) - least) // width + 1) if max(lo, least) <= min(hi - 1, most)]
    table = F.broadcast(spark.createDataFrame(cells or [(0, 0, 0, 0, 1)], "cell bigint, lo bigint, hi bigint, place int, parts int"))
    src = src.withColumn("cell", F.expr(f"(key - {least}L) div {width}L"))
    src = src.join(table, (src["cell"] == table["cell"]) & (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")), "left").drop("cell", "lo", "hi")
    _, _, last, m = ranges[-1]
    src = src.withColumns({"place": F.coalesce("place", F.lit(last)), "parts": F.coalesce("parts", F.lit(m))})
    part = F.least(F.floor((F.col("hash") / float(1 << 64) + 0.5) * F.col("parts")), F.col("parts") - 1).cast("int")
    src = src.withColumn("part", part).drop("parts")
    first = F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", F.bitwise_not("hash").alias("flipped"))).alias("x")
    heads = sorted((r["place"], r["part"], r["x"]["key"], ~r["x"]["flipped"]) for r in src.groupBy("place", "part").agg(first).collect())  # a row for each range
    before = [(k, h, *heads[i - 1][:2]) for i, (_, _, k, h) in enumerate(heads)]  # the first range follows the last
    to = F.broadcast(spark.createDataFrame(before, "h_key bigint, h_hash bigint, to_place int, to_part int"))
    extra = src.join(to, F.col("key").eqNullSafe(F.col("h_key")) & (F.col("hash") == F.col("h_hash"))).select("key", "text", "hash", F.col("to_place").alias("place"), F.col("to_part").alias("part"), F.lit(1).alias("extra"))
    own = src.select("key", "text", "hash", "place", "part", F.lit(0).alias("extra"))
    w = W.partitionBy("place", "part").orderBy("extra", F.col("key").desc_nulls_last(), "hash")
    rows = own.unionByName(extra).withColumns({"last_key": F.lag("key").over(w), "last_hash": F.lag("hash").over(w), "last_extra": F.lag("extra").over(w)})
    rows = rows.filter(~(F.col("last_extra").eqNullSafe(F.col("extra")) & F.col("last_key").eqNullSafe(F.col("key")) & F.col("last_hash").eqNullSafe(F.col("hash"))))
    rows = rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("key", "hash", "text")))
    return rows.filter("extra = 0").drop("place", "part", "extra", "last_key", "last_hash", "last_extra")


def edited(n: Column, text: Column, following: Column) -> Column:
    """The last half of the text gives way to as many code points of the following one."""
    k = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def within_radius(index: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """For each distinct (f0, f1) of queries: how many rows of index lie within the Hamming radius.

    index and queries have f0 and f1. Equal fingerprints are counted before anything is shuffled on
    blocks. Table t holds the fingerprints by their block t; a pair is counted in the first table only
    where its blocks agree.
    """
    cuts = [round(BITS * i / (radius + 1)) for i in range(radius + 2)]

    def block(f0: Column, f1: Column, t: int) -> Column:
        lo, hi, out = cuts[t], cuts[t + 1], F.lit("")
        for half, f in ((0, f0), (1, f1)):
            a, b = max(lo, 64 * half) - 64 * half, min(hi, 64 * half + 64) - 64 * half
            if a < b:
                mask = (1 << (b - a)) - 1
                part = f if mask >> 63 else F.shiftrightunsigned(f, a).bitwiseAND(F.lit(mask))
                out = F.concat(out, F.hex(part), F.lit("/"))
        return out

    def tables(df: DataFrame, names: tuple[str, str], *more: str) -> DataFrame:
        blocks = F.array(*(block(F.col(names[0]), F.col(names[1]), t) for t in range(radius + 1)))
        return df.select(*names, *more, blocks.alias(f"{names[0]}_blocks"), F.posexplode(blocks).alias("t", "block"))

    counted = index.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("rows"))
    asked = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    hits = tables(asked, ("q0", "q1")).join(tables(counted, ("f0", "f1"), "rows"), ["t", "block"])
    agree = F.array_position(F.zip_with("q0_blocks", "f0_blocks", lambda a, b: a == b), True) - 1
    hits = hits.filter((agree == F.col("t")) & (distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1")) <= radius))
    return hits.groupBy("q0", "q1").agg(F.sum("rows").alias("n_within"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, rows) of rows that repeat both key and text."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    return written(rows.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "repeated")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; n_within: for keys divisible by 100, the documents within 3 bits, itself included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", edited(F.col("n_chars"), F.col("text"), F.col("next_text")))
    keys = ["key", "hash", "next_key", "next_hash", "n_chars", "sha", "which"]
    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))))
    flat = rows.select("key", "hash", "next_key", "next_hash", "n_chars", F.sha2("edited", 256).alias("sha"), both.alias("v")).select(*keys[:-1], "v.which", "v.text")
    prints = fingerprints(flat, keys)
    one = [F.max(F.when(F.col("which") == w, F.col(f))).alias(f"{f}{'e' * w}") for w in (0, 1) for f in ("f0", "f1")]
    done = written(prints.groupBy(*keys[:-1]).agg(*one), "fingerprints")
    following = done.select(F.col("key").alias("k"), F.col("hash").alias("h"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    asked = done.filter(F.col("key") % 100 == 0)
    found = join_on(asked, within_radius(done, asked), {"f0": "q0", "f1": "q1"}, "inner")
    out = join_on(done, following, {"next_key": "k", "next_hash": "h"})
    out = join_on(out, found.select("key", "hash", "n_within"), ["key", "hash"])
    again = repeated(docs)
    out = join_on(out, F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, ["key", "hash"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1)).cast("int"))))
    c = F.col
    return out.select(
        c("key").alias("doc_id"),
        "n_chars",
        c("sha").alias("edited_sha256"),
        hex_of(c("f0"), c("f1")).alias("fingerprint"),
        hex_of(c("f0e"), c("f1e")).alias("edited_fingerprint"),
        likeness(c("f0"), c("f1"), c("f0e"), c("f1e")).alias("near_edited"),
        likeness(c("f0"), c("f1"), c("n0"), c("n1")).alias("near_next"),
        "n_within",
    )
