"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the point frac(i * golden ratio), in 32-bit integers, which falls into one
source's part of the unit interval; parts are as wide as the slots that the source needs. The r-th slot of
a source takes its block r mod n: blocks are equal runs of words of the source's documents in an order
shuffled by hash. At most three rounds of a source are taken. A block has 64 words; where that would make
over 2**28 blocks, they grow with the sum of all words, so the schedule's length stays bounded.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating; together they share all words.
A target stops at 3 times its source's size and the excess goes to the others by weight until none is
above. Solved in closed form: with sources by size over weight, the capped ones come first.

Defined results: a null text has size 0; documents without words are never taken and stay in the result;
repeated rows are documents of their own; a null id is hashed as an empty one; an empty table gives an
empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_on, running_sum, written

BLOCK, MOST_BLOCKS = 64, 1 << 28  # words of a block at least; blocks of all sources at most, about
ROUNDS = 3
GOLDEN = 2654435769  # 2**32 / golden ratio
CELLS = 4096
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source: ord, source_size, target, blocks and the slots that it needs. Windows run over sources, not documents."""
    every, by_ratio = W.partitionBy(), W.partitionBy().orderBy("ratio", "ord")
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("ord", F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last())).cast("long"))
    rows = rows.withColumn("weight", (F.col("ord") - 1) % 3 + 1).withColumns({"total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every), "ratio": ROUNDS * F.col("source_size") / F.col("weight")})
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({c: F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in (("capped", "source_size"), ("used", "weight"))})
    rows = rows.withColumn("level", (F.col("total") - ROUNDS * F.col("capped")) / (F.col("weights") - F.col("used")))
    rows = rows.withColumn("full", F.col("ratio") <= F.col("level"))
    rows = rows.withColumn("water", F.min(F.when(~F.col("full"), F.struct("ratio", "ord", "level"))).over(every)["level"])
    target = F.when(F.col("full"), (ROUNDS * F.col("source_size")).cast("double")).otherwise(F.col("water") * F.col("weight"))
    rows = rows.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    need = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    return rows.withColumn("need", need).select("source", "ord", "source_size", "target", "blocks", "need")


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2**32, exactly, for any slot: in two halves of GOLDEN, so no product leaves a long."""
    x = F.pmod(slot, F.lit(1 << 32))
    return F.pmod(F.pmod(x * (GOLDEN >> 16), F.lit(1 << 16)) * (1 << 16) + x * (GOLDEN & 0xFFFF), F.lit(1 << 32))


def block_words(total: int) -> int:
    """Words of a block: BLOCK, or more where all sources together would have over MOST_BLOCKS of them."""
    return max(BLOCK, -(-total // MOST_BLOCKS))


def schedule(sources: DataFrame) -> DataFrame:
    """The slots: (slot, ord, rank, block). Slots meet sources in the cells of the unit interval that both touch."""
    spark = sources.sparkSession
    upto = F.sum("need").over(W.partitionBy().orderBy("ord"))
    total = F.sum("need").over(W.partitionBy())
    parts_ = sources.withColumns({"high": upto / total, "all": total}).withColumn("low", F.coalesce(F.lag("high").over(W.partitionBy().orderBy("ord")), F.lit(0.0)))
    last = F.max(F.when(F.col("need") > 0, F.col("ord"))).over(W.partitionBy())
    parts_ = parts_.withColumn("high", F.when(F.col("ord") >= last, 1.0).otherwise(F.col("high"))).filter("high > low")
    n = sources.agg(F.round(F.sum("need"))).first()[0]
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))
    parts_ = parts_.select("ord", "blocks", "low", "high", F.explode(cells).alias("cell"))
    slots = spark.range(1, int(n or 0) + 1).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", golden_point(F.col("slot")) / F.lit(float(1 << 32))).withColumn("cell", F.floor(F.col("point") * CELLS))
    slots = slots.join(parts_, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "ord", "blocks", F.lit(1).alias("one"))
    ranked = running_sum(slots, [F.col("ord"), F.col("slot")], "one", "rank", ["ord"])
    ranked = ranked.filter(F.col("rank") < ROUNDS * F.col("blocks"))
    return ranked.select("slot", "ord", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Each document with its size, source_size, target, taken (words) and starts (how often its first word is taken)."""
    keep = keep or [key]
    rows = docs.select(*(docs[c].alias(f"k_{c}") for c in keep), docs[source].cast("string").alias("source"), word_count(docs[text]).alias("size"), F.md5(F.coalesce(docs[key].cast("string"), F.lit(""))).alias("shuffled"))
    narrow = rows.select("source", "size", "shuffled", f"k_{key}") if keep == [key] else rows
    narrow = written(narrow, "sizes")
    block = block or block_words(narrow.agg(F.sum("size")).first()[0] or 0)
    sources = written(targets(narrow, block).coalesce(1), "targets")
    placed = join_on(narrow, sources.select("source", "ord", "source_size", "target", "blocks"), ["source"], "inner")
    placed = running_sum(placed, [F.col("ord"), F.col("shuffled"), F.col(f"k_{key}"), F.col("size")], "size", "offset", ["ord"])
    placed = written(placed, "placed")
    times = schedule(sources).groupBy("ord", "block").agg(F.count(F.lit(1)).alias("times"))
    first, last = F.floor(F.col("offset") / block).cast("long"), F.floor((F.col("offset") + F.col("size") - 1) / block).cast("long")
    pieces = placed.filter("size > 0").select("ord", "offset", "size", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("offset"), F.col("block") * block)
    pieces = pieces.withColumns({"words": words, "first": F.col("block") == first})
    taken = pieces.join(times, ["ord", "block"]).groupBy("ord", "offset").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.max(F.when(F.col("first"), F.col("times"))).alias("starts"))
    nonempty = placed.withColumn("at", F.when(F.col("size") > 0, F.col("offset")).otherwise(-1 - F.pmod(F.xxhash64(f"k_{key}"), F.lit(1 << 40))))
    taken = taken.withColumnRenamed("offset", "at")
    out = nonempty.join(taken, ["ord", "at"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "starts")})
    return out.select(*(F.col(f"k_{c}").alias(c) for c in keep), "size", "source_size", "target", "taken", "starts")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times (0 to 3) as the schedule takes its first word."""
    narrow = mixed(docs)
    times = narrow.filter("starts > 0").groupBy("doc_id").agg(F.sum("starts").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    rows = join_on(docs, times, ["doc_id"], "inner")
    copies = F.sequence(F.lit(1), F.ceil(F.col("__sum") / F.col("__n")).cast("int"))
    return rows.withColumn("__copy", F.explode(copies)).select(*docs.columns)


def op6_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("starts")
