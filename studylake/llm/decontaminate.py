"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by k = m // BUDGET edits. Cut into k + 1 pieces, one
piece at least must stand unchanged in every such passage. All pieces are found in one pass over the text
(Aho-Corasick); around each hit, Myers' bit-parallel distance decides whether the whole item lies there
within k edits. Texts and items are lower-cased, and runs of white space count as one space.

The items are the stated query set against all documents. They are read in blocks of at most about
block_bytes of text, so what a task holds is bounded however many items there are.

An item shorter than BUDGET characters has no edits and counts only as whole words: "yes" isn't in "the eyes".

Defined results: null or blank items match nothing; null texts have no matches; repeated items with one id
count once, and repeated documents give their rows each; empty tables give no matches. Extra columns are
ignored. A row is (doc_id, item_id, distance, start, length), the best match of the item, in code points
of the normalised text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

BUDGET = 16  # characters of an item for each allowed edit
BLOCK_BYTES = 16 << 20
_SPACE = re.compile(r"\s+")


def normalised(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip().lower()


def pieces(item: str, budget: int = BUDGET) -> list[tuple[int, str]]:
    """The error-budget-plus-one pieces of an item with their offsets."""
    n = len(item) // budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def best_match(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of item within text, by Myers' bit vectors; None beyond most."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (most + 1, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


class Matcher:
    """All items of a block; find() gives the matches of a text."""

    def __init__(self, items: list[tuple[int, str]], budget: int = BUDGET):
        import ahocorasick

        self.items, self.budget = items, budget
        self.trie = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for offset, piece in pieces(text, budget):
                at.setdefault(piece, []).append((i, offset))
        for piece, places in at.items():
            self.trie.add_word(piece, (len(piece), places))
        self.trie.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, start, length of the window's match)."""
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for end, (size, places) in self.trie.iter(text):
            for i, offset in places:
                m, k = len(self.items[i][1]), len(self.items[i][1]) // self.budget
                start = end + 1 - size - offset
                if not k:  # the piece is the whole item
                    if i not in exact and bordered(text, start, start + m):
                        exact[i] = start
                    continue
                a, b = max(0, start - k), min(len(text), start + m + k)
                kept = windows.setdefault(i, [])
                if kept and a <= kept[-1][1] and a >= kept[-1][0]:
                    kept[-1][1] = max(b, kept[-1][1])
                else:
                    kept.append([a, b])
        for i, start in exact.items():
            yield self.items[i][0], 0, start, len(self.items[i][1])
        for i, kept in windows.items():
            item_id, item = self.items[i]
            k, best = len(item) // self.budget, None
            for a, b in kept:
                place = text.find(item, a, b)
                if place >= 0:
                    best = (0, place, len(item))
                    break
                hit = best_match(item, text[a:b], k)
                if hit and (best is None or hit[0] < best[0]):
                    start = a + start_of(item, text[a : a + hit[1]], hit[0])
                    best = (hit[0], start, a + hit[1] - start)
            if best:
                yield item_id, *best


def bordered(text: str, start: int, end: int) -> bool:
    """Whether no word goes on before start or after end."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def start_of(item: str, text: str, distance: int) -> int:
    """Where a match of that distance that ends with text begins: the same search from right to left."""
    hit = best_match(item[::-1], text[: -len(item) - distance - 1 : -1], distance)
    return len(text) - hit[1] if hit else 0


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(broadcast items, whether it is the only block) of about block_bytes of text each: a size that the number of blocks ensures.

    The items are read once for their size and once for each block; a block is taken when it is asked for.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null").distinct()
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield spark.sparkContext.broadcast(sorted((r["item_id"], t) for r in rows if (t := normalised(r["text"])))), blocks == 1


@functools.lru_cache(maxsize=2)
def _matcher(items: tuple, budget: int) -> Matcher:
    return Matcher(list(items), budget)


def hits_column(text: Column, known, budget: int = BUDGET) -> Column:
    """The matches of a text with a block of items."""

    @F.pandas_udf("array<struct<item_id: bigint, distance: int, start: int, length: int>>")
    def search(texts: pd.Series) -> pd.Series:
        if not known.value:
            return pd.Series([[] for _ in texts])
        matcher = _matcher(tuple(known.value), budget)
        names = ("item_id", "distance", "start", "length")
        return pd.Series([[dict(zip(names, hit, strict=True)) for hit in best_of(matcher.find(normalised(t)))] for t in texts])

    return search(text)


def best_of(hits: Iterator[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """One match per item id."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for hit in hits:
        if hit[0] not in best or hit[1:] < best[hit[0]][1:]:
            best[hit[0]] = hit
    return [best[i] for i in sorted(best)]


def matches(docs: DataFrame, items: DataFrame, budget: int = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every (document, item) with the item's best passage in the document.

    With several blocks, each one's matches are written before the next block is collected, so driver and
    executors hold one block at a time and the plan doesn't grow with their number.
    """
    path = new_path(docs.sparkSession, "matches")
    for known, alone in item_blocks(items, block_bytes):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(hits_column(docs["text"], known, budget)).alias("hit")).select("doc_id", "hit.*")
        if alone:
            return found
        found.write.mode("append").parquet(path)
        known.destroy()
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def clean_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go. With several blocks of items, what a block leaves is written for the next."""
    for known, alone in item_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        docs = docs.filter(F.size(hits_column(docs["text"], known)) == 0)
        if not alone:
            docs = written(docs, "clean")
            known.destroy()
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
