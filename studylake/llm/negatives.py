"""Hard negatives by product quantisation: rigorous bounds from codes first, exact integers for what they leave.

Vectors are integers, floor(256 * x) for each component x. Every pair of neighbouring components has a
codebook of at most 256 centres, fitted on a bounded sample; a row keeps one byte for each pair, and the
norm of what its centres leave of it. A table of an anchor's products with all centres gives the row's score
by looking up its codes, and the true score lies within the norm of the anchor times the row's residual norm
of it. So a row whose upper bound is below the k-th lower bound can't be among the first k, and a row whose
bounds miss a window of scores isn't in it. All other rows are scored anew in integers; the results are those
of a full search, whatever the codebooks are worth.

Work is dealt in blocks: rows fall into blocks of bounded size by their hash, and the anchors go to each block.
A task holds one block in memory and lets the anchors stream past; it gives the few best of the block for each
anchor, and those of all blocks are ranked by anchor. The blocks' number follows the number of rows.

Defined results: rows with a null key, label or vector, or a null, infinite or NaN component, take no part.
Components beyond +-2**25 count as that, so that sums fit a long. Shorter vectors are filled with zeros. Rows that
repeat key, label and vector count once; others that share a key are rows of their own, and an anchor's positives
may have its key. Equal scores go by the smaller key. An anchor without other rows of its label, and a positive
without a row in its window, give nothing, as does an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_on, table, written

SCALE, MOST = 256, 1 << 25
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SAMPLE, CENTRES, ROUNDS = 4096, 256, 6  # rows that codebooks are fitted on, centres of each, rounds of k-means
BLOCK_ROWS, LEAST_ROWS, ANCHORS = 65_536, 4096, 64  # rows of a block at most; at least, unless there are fewer; anchors that meet a block at once

INDEX = "block int, kind int, vec_id bigint, label int, vec binary, codes binary, rest double"


def integer_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and the integer components v of the rows that take part."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))
    bad = F.exists(F.col(vector).cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    return rows.filter(whole).filter(~bad).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), x.alias("v"))


def with_noise(rows: DataFrame) -> DataFrame:
    """Every row whose key is divisible by 7 gets the next label of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def padded(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of a matrix, shorter ones filled with zeros."""
    ends = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    out = np.zeros((len(vectors), width), dtype=np.int32)
    if len(sizes):
        at = np.arange(len(flat)) - np.repeat(ends[:-1], sizes)
        out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def fitted(sample: np.ndarray, centres: int = CENTRES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each pair of neighbouring components, by k-means from spread starting points."""
    books = []
    for m in range(0, sample.shape[1], 2):
        points = np.unique(sample[:, m : m + 2].astype(np.float64), axis=0)
        book = points[np.linspace(0, len(points) - 1, min(centres, len(points))).astype(int)] if len(points) else np.zeros((1, min(2, sample.shape[1] - m)))
        given = sample[:, m : m + 2].astype(np.float64)
        for _ in range(rounds if len(points) > centres else 0):
            near = nearest_centre(given, book)
            n = np.bincount(near, minlength=len(book))
            sums = np.stack([np.bincount(near, weights=given[:, c], minlength=len(book)) for c in range(given.shape[1])], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        books.append(book)
    return books


def nearest_centre(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1) - 2 * points @ book.T, axis=1)


def quantised(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A code for each pair of components, and the norm of what the centres leave of each row (rounded up)."""
    codes, rest = np.zeros((len(vectors), len(books)), dtype=np.uint8), np.zeros(len(vectors))
    for m, book in enumerate(books):
        part = vectors[:, 2 * m : 2 * m + 2].astype(np.float64)
        codes[:, m] = nearest_centre(part, book)
        rest += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
    return codes, np.sqrt(rest) * (1 + 1e-9) + 1e-6


class Block:
    """The rows of a block by ascending key, each once, with their codes."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, width: int):
        col = {name: rows.column(name) for name in ("vec_id", "label", "vec", "codes", "rest")}
        raw = {name: b"".join(col[name].to_pylist()) for name in ("vec", "codes")}
        n = rows.num_rows
        self.ids, self.labels, self.rest = (np.asarray(col[c].to_numpy()) for c in ("vec_id", "label", "rest"))
        self.vectors = np.frombuffer(raw["vec"], dtype="<i4").reshape(n, width)
        self.codes = np.frombuffer(raw["codes"], dtype=np.uint8).reshape(n, (width + 1) // 2)
        if len(np.unique(self.ids)) < n:
            first, seen = [], set()
            for i, one in enumerate(zip(self.ids.tolist(), self.labels.tolist(), col["vec"].to_pylist(), strict=True)):
                if one not in seen:
                    seen.add(one)
                    first.append(i)
            self.ids, self.labels, self.rest, self.vectors, self.codes = (x[first] for x in (self.ids, self.labels, self.rest, self.vectors, self.codes))

    def bounds(self, anchors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and row, what the score is at least and at most."""
        a = anchors.astype(np.float64)
        scores = np.zeros((len(self.ids), len(a)))
        for m, book in enumerate(books):
            looked_up = book @ a[:, 2 * m : 2 * m + 2].T  # a row of products for each centre
            scores += looked_up[self.codes[:, m]]
        norms = np.sqrt((a**2).sum(axis=1))
        own = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        slack = np.outer(self.rest + own * 1e-9, norms) + 1e-3  # with room for rounding
        return np.ascontiguousarray((scores - slack).T), np.ascontiguousarray((scores + slack).T)

    def exact(self, of: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[of].astype(np.int64) @ anchor.astype(np.int64)

    def first(self, of: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places within `of` of the first k by score, then key."""
        return np.lexsort((self.ids[of], -scores))[:k]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value, or what any value reaches if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


Visit = Callable[[Block, pa.RecordBatch, np.ndarray, list[np.ndarray]], pa.RecordBatch]


def met(batches: Iterator[pa.RecordBatch], width: int, books: list[np.ndarray], visit: Visit) -> Iterator[pa.RecordBatch]:
    """Lets the anchors of each block (kind 1) stream past its rows (kind 0), which come first."""
    current, parts, block = None, [], None
    for batch in batches:
        number, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
        edges = np.flatnonzero(np.diff(number) | np.diff(kind)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if s == e:
                continue
            if number[s] != current:
                current, parts, block = number[s], [], None
            if kind[s] == 0:
                parts.append(batch.slice(s, e - s))
                continue
            if block is None and parts:
                block, parts = Block(pa.Table.from_batches(parts), width), []
            for at in range(s, e, ANCHORS) if block is not None else ():
                some = batch.slice(at, min(ANCHORS, e - at))
                vectors = np.frombuffer(b"".join(some.column("vec").to_pylist()), dtype="<i4").reshape(some.num_rows, width)
                yield visit(block, some, vectors, books)


def best_positives(block: Block, anchors: pa.RecordBatch, vectors: np.ndarray, books: list[np.ndarray]) -> pa.RecordBatch:
    out: list[tuple[int, int, int, int]] = []
    low, high = block.bounds(vectors, books)
    for j, (key, mark, label) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "mark", "label")), strict=True)):
        own = np.flatnonzero(block.labels == label)
        own = own[~((block.ids[own] == key) & (block.vectors[own] == vectors[j]).all(axis=1))]
        left = own[high[j, own] >= kth(low[j, own], POSITIVES)]
        scores = block.exact(left, vectors[j])
        out += [(key, mark, int(block.ids[left[i]]), int(scores[i])) for i in block.first(left, scores, POSITIVES)]
    return as_batch(out, ("anchor_id", "mark", "positive_id", "positive_score"))


def best_negatives(block: Block, anchors: pa.RecordBatch, vectors: np.ndarray, books: list[np.ndarray]) -> pa.RecordBatch:
    out: list[tuple[int, ...]] = []
    low, high = block.bounds(vectors, books)
    for j, (key, mark, label, positives) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "mark", "label", "positives")), strict=True)):
        other = np.flatnonzero(block.labels != label)
        lo, hi = low[j, other], high[j, other]
        for p in positives:
            s = p["score"]
            may = (100 * hi >= LOW * s) & (100 * lo <= HIGH * s)
            sure = lo[(100 * lo >= LOW * s) & (100 * hi <= HIGH * s)]
            left = other[may & (hi >= kth(sure, NEGATIVES))]
            scores = block.exact(left, vectors[j])
            inside = (100 * scores >= LOW * s) & (100 * scores <= HIGH * s)
            left, scores = left[inside], scores[inside]
            out += [(key, mark, p["place"], p["id"], s, int(block.ids[left[i]]), int(scores[i])) for i in block.first(left, scores, NEGATIVES)]
    return as_batch(out, ("anchor_id", "mark", "place", "positive_id", "positive_score", "negative_id", "negative_score"))


def as_batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=list(names))


def index(rows: DataFrame, blocks: int, width: int, books: list[np.ndarray]) -> DataFrame:
    """The rows of INDEX: every row with its block, codes and residual norm."""
    names = ("block", "kind", "vec_id", "label", "vec", "codes", "rest")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = padded(batch.column("v"), width)
            codes, rest = quantised(v, books)
            raw = [pa.array([x.tobytes() for x in m], type=pa.binary()) for m in (v.astype("<i4"), codes)]
            kind = pa.array(np.zeros(len(v), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("block"), kind, batch.column("vec_id"), batch.column("label"), *raw, pa.array(rest)], names=list(names))

    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    return rows.select(block.alias("block"), "vec_id", "label", "v").mapInArrow(encode, INDEX)


def passed(rows: DataFrame, anchors: DataFrame, blocks: int, visit: Visit, width: int, books: list[np.ndarray], schema: str) -> DataFrame:
    """What visit gives for each anchor and block. anchors: kind 1, with further columns beside INDEX's."""
    everywhere = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1)})
    both = rows.unionByName(everywhere, allowMissingColumns=True).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")
    return both.mapInArrow(lambda batches: met(batches, width, books, visit), schema)


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """For each anchor and positive the first NEGATIVES rows of other labels whose score is LOW to HIGH per cent of the positive's.

    rows: vec_id, label and integer components v, as `integer_rows` gives them.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = seen["n"], seen["width"] or 0
    blocks = max(1, -(-n // BLOCK_ROWS), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id", "v").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    books = fitted(padded(sample, width))
    coded = written(index(rows, blocks, width, books), "quantised")
    anchors = coded.filter(is_anchor).withColumn("mark", F.xxhash64("vec_id", "label", "vec")).dropDuplicates(["vec_id", "label", "vec"]).select("vec_id", "label", "vec", "mark")
    near = passed(coded, anchors, blocks, best_positives, width, books, "anchor_id bigint, mark bigint, positive_id bigint, positive_score bigint")
    by_score = W.partitionBy("anchor_id", "mark").orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= POSITIVES)
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))))  # POSITIVES at most
    positives = near.groupBy("anchor_id", "mark").agg(listed.alias("positives"))
    armed = written(join_on(anchors, positives, {"vec_id": "anchor_id", "mark": "mark"}, "inner"), "anchors")
    names = "anchor_id bigint, mark bigint, place bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = passed(coded, armed, blocks, best_negatives, width, books, names)
    within = W.partitionBy("anchor_id", "mark", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    found = found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose key is divisible by 100; keys divisible by 7 have wrong labels."""
    return hard_negatives(with_noise(integer_rows(table(spark, sf_dir, "embeddings"))), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
