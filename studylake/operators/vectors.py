"""The nearest vectors of every query, exactly, by lists around centres and the bound that a list's radius gives.

Vectors have length one. Each is dealt to the list of its nearest centre; a list knows how far its farthest member
lies from the centre, and one with many members is cut into blocks. A query first searches the few lists nearest
to it. That gives a score which any better one must reach; by the triangle inequality a list whose centre is too
far away for its radius holds none, and all others are searched as well. So nothing is lost, whatever the centres
are worth: they are fitted on a bounded sample.

Neighbouring lists are packed, so that a query is sent to as many packs as the members fill blocks, not to every list.
A task holds one block of a pack in memory and lets a share of the queries stream past, a few at a time, so neither
vectors nor queries pass through the driver, which sees the sample, the centres and a row for each list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.kept import kept

SAMPLE, MOST_LISTS, ROUNDS, FIRST_LISTS = 4096, 512, 5, 2
BLOCK, CHUNK = 131_072, 64  # members of a block at most, queries that meet it at once
PLACES, SLACK = 6, 1e-5  # of a score; what rounding may add to a bound


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of so many components as rows of length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if len(column) else np.zeros((0, width))
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres, by k-means from evenly chosen members."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        some = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(some[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centres)
    return centres


def apart(cosines: np.ndarray) -> np.ndarray:
    """Distances of points on the unit sphere."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


def _members(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, group, vec, list and how far each lies from its centre."""
    width = centres.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(batch.column("vector"), width)
            cosines = u @ centres.T
            near = cosines.argmax(axis=1) if len(u) else np.zeros(0, dtype=int)
            far = apart(cosines[np.arange(len(u)), near])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("group"), pa.array([x.tobytes() for x in u], type=pa.binary()), pa.array(near.astype(np.int32)), pa.array(far)], names=["id", "group", "vec", "list", "far"])

    return vectors.select("id", "group", "vector").mapInArrow(deal, "id bigint, group bigint, vec binary, list int, far double")


def packs_of(centres: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The pack of each list: lists in the order of their centres' main direction, packed up to so many members; one that is larger stands alone."""
    direction = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0] if len(centres) else np.zeros(0)
    packs, at, room = np.zeros(len(centres), dtype=np.int64), 0, 0
    for i in np.argsort(centres @ direction, kind="stable"):
        if room and room + sizes[i] > most:
            at, room = at + 1, 0
        packs[i], room = at, room + sizes[i]
    return packs


def _visits(queries: DataFrame, centres: np.ndarray, radius: np.ndarray, first: bool, packs: np.ndarray | None = None) -> DataFrame:
    """(query, vec, list, floor) for the packs of lists that a query searches: those of the nearest ones first, then all others that may hold better ones than floor."""
    width, some = centres.shape[1], np.flatnonzero(radius >= 0)
    of = np.arange(len(centres)) if packs is None else packs
    names, place = np.unique(of[some], return_inverse=True)
    holds = np.zeros((len(some), len(names)), dtype=np.float32)
    holds[np.arange(len(some)), place] = 1

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                yield chosen(whole.slice(at, CHUNK))

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        u = units(batch.column("vector"), width)
        gaps = apart(u @ centres[some].T)
        near = np.zeros(gaps.shape, dtype=bool)
        np.put_along_axis(near, np.argsort(gaps, axis=1, kind="stable")[:, :FIRST_LISTS], True, axis=1)
        floor = batch.column("floor").to_numpy(zero_copy_only=False)
        best = 1 - np.maximum(0.0, gaps - radius[some]) ** 2 / 2  # no member has a greater cosine
        begun = near.astype(np.float32) @ holds > 0
        rows, lists = np.nonzero(begun if first else ~begun & ((best + SLACK >= floor[:, None]).astype(np.float32) @ holds > 0))
        raw = pa.array([x.tobytes() for x in u], type=pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(rows)), raw.take(pa.array(rows)), pa.array(names[lists].astype(np.int32)), pa.array(floor[rows])], names=["query", "vec", "list", "floor"])

    return queries.select("query", "vector", "floor").mapInArrow(choose, "query bigint, vec binary, list int, floor double")


def _searched(members: DataFrame, visits: DataFrame, blocks: DataFrame, shares: int, tasks: int, width: int, k: int, per_group: int) -> DataFrame:
    """(query, id, group, score): the k best of each block for each query, at most per_group of a group. Each of so many shares of the queries meets a block in a task of its own."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "block", "share", "kind")], axis=1)
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if s == e:
                    continue
                if tuple(keys[s, :3]) != at:
                    at, parts, held = tuple(keys[s, :3]), [], None
                if keys[s, 3] == 0:
                    rows = batch.slice(s, e - s)
                    parts.append((rows.column("id").to_numpy(), rows.column("group").to_pandas().to_numpy(), np.frombuffer(b"".join(rows.column("vec").to_pylist()), dtype=np.float64).reshape(-1, width)))
                    continue
                if held is None and parts:
                    held = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                    parts = []
                for i in range(s, e, CHUNK) if held is not None else ():
                    yield meet(held, batch.slice(i, min(CHUNK, e - i)))

    def greedy(order: np.ndarray, groups: np.ndarray) -> list[int]:
        seen: dict = {}
        taken: list[int] = []
        for m in order.tolist():
            of = seen.get(groups[m], 0)
            if of < per_group:
                seen[groups[m]] = of + 1
                taken.append(m)
                if len(taken) == k:
                    break
        return taken

    def meet(held: tuple, some: pa.RecordBatch) -> pa.RecordBatch:
        ids, groups, vectors = held
        asked = np.frombuffer(b"".join(some.column("vec").to_pylist()), dtype=np.float64).reshape(-1, width)
        scores = np.round(asked @ vectors.T, PLACES)
        out: list[list] = [[], [], [], []]
        for row, query, floor in zip(scores, some.column("query").to_pylist(), some.column("floor").to_pylist(), strict=True):
            may, taken, most = np.flatnonzero(row >= floor - SLACK), [], 8 * k
            while len(may):
                # the greatest scores and all that equal the least of them; more where groups leave too few
                top = may if len(may) <= most else may[row[may] >= -np.partition(-row[may], most - 1)[most - 1]]
                taken = greedy(top[np.lexsort((ids[top], -row[top]))], groups)
                if len(taken) == k or len(top) == len(may):
                    break
                most *= 8
            for m in taken:
                for c, x in zip(out, (query, int(ids[m]), groups[m], row[m]), strict=True):
                    c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t, from_pandas=True) for c, t in zip(out, kinds, strict=True)], names=["query", "id", "group", "score"])

    split = members.join(F.broadcast(blocks), "list").withColumns({"block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))})
    left = split.select(F.col("pack").alias("list"), "block", "share", F.lit(0).alias("kind"), "id", "group", F.lit(None).cast("bigint").alias("query"), "vec", F.lit(None).cast("double").alias("floor"))
    each = visits.join(F.broadcast(blocks.select(F.col("pack").alias("list"), "blocks").distinct()), "list").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)), "share": F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int")})
    right = each.select("list", "block", "share", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("group"), "query", "vec", "floor")
    rows = left.unionByName(right).repartition(tasks, "list", "block", "share").sortWithinPartitions("list", "block", "share", "kind")
    return rows.mapInArrow(best, "query bigint, id bigint, group bigint, score double")


def _ranked(found: DataFrame, k: int, per_group: int) -> DataFrame:
    order = [F.desc("score"), "id"]
    capped = found.withColumn("place", F.row_number().over(W.partitionBy("query", "group").orderBy(*order))).filter(F.col("place") <= per_group)
    return capped.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).drop("place")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 6, per_group: int = 2, least: float = -1.0) -> DataFrame:
    """(query, rank, id, score): the k vectors (id, group, vector) with the greatest cosine to each query (query, vector), at most per_group of a group.

    Scores are rounded to six places; equal ones go by id. Vectors of another length than the longest query's,
    and null ones, aren't compared; scores below least aren't given.
    """
    spark = vectors.sparkSession
    width, n_queries = queries.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    width = width or 0
    vectors, queries = (df.filter(F.size("vector") == width) for df in (vectors, queries))
    none = spark.createDataFrame([], "query bigint, rank int, id bigint, score double")
    if width < 1:
        return none
    n = vectors.count()
    sample = units(vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks(), width)
    if not len(sample):
        return none
    centres = centres_of(sample, min(MOST_LISTS, max(1, math.isqrt(n))))
    members = _members(vectors, centres)
    lists = members.groupBy("list").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row for each of MOST_LISTS lists
    radius = np.full(len(centres), -1.0)
    radius[[r["list"] for r in lists]] = [r["radius"] for r in lists]
    wanted = 2 * spark.sparkContext.defaultParallelism
    n_packs = max(-(-n // BLOCK), min(wanted, math.isqrt(wanted * n // max(1, n_queries)) or 1))  # few queries: more packs; many: fewer, as each goes to most of them
    sizes = np.zeros(len(centres), dtype=np.int64)
    sizes[[r["list"] for r in lists]] = [r["n"] for r in lists]
    most = -(-n // n_packs)
    packs = packs_of(centres, sizes, most)
    held = np.bincount(packs, weights=sizes).astype(np.int64)
    blocks = spark.createDataFrame([(r["list"], int(packs[r["list"]]), 1 + (int(held[packs[r["list"]]]) - 1) // most) for r in lists], "list int, pack int, blocks bigint")
    shares = max(1, min(-(-wanted // (int(held.size) or 1)), -(-n_queries // (4 * CHUNK))))
    tasks = max(wanted, 2 * shares * int(sum(1 + (x - 1) // most for x in held.tolist() if x)))
    asked = queries.select("query", "vector", F.lit(float(least)).alias("floor"))
    first = kept(_searched(members, _visits(asked, centres, radius, True, packs), blocks, shares, tasks, width, k, per_group))
    reached = _ranked(first, k, per_group).filter(F.col("rank") == k).select("query", F.col("score").alias("reached"))
    raised = asked.join(reached, "query", "left").select("query", "vector", F.greatest("floor", F.coalesce("reached", "floor")).alias("floor"))
    rest = _searched(members, _visits(raised, centres, radius, False, packs), blocks, shares, tasks, width, k, per_group)
    return _ranked(first.unionByName(rest).filter(F.col("score") >= least), k, per_group).select("query", "rank", "id", "score")


def related(notes: DataFrame, linked: DataFrame, least: float, most: int = 12) -> DataFrame:
    """(note, target, score): for every note (note, vector; several vectors a note are its passages) the notes with the greatest cosine, that it doesn't link to yet (linked: note, target).

    Of each note's 2 * most nearest, one passage a note, it is left out itself, and so are those that it links to.
    """
    ids = notes.select("note", "vector", F.xxhash64("note", "vector").alias("id"))
    found = nearest(ids.select("id", F.col("note").alias("group"), "vector"), ids.select(F.col("id").alias("query"), "vector"), 2 * most, 1, least)
    names = ids.select("id", "note").distinct()
    pairs = found.join(names.withColumnRenamed("note", "target"), "id").join(names.select(F.col("id").alias("query"), "note"), "query").filter("note <> target")
    best = pairs.groupBy("note", "target").agg(F.max("score").alias("score")).join(linked.select("note", "target").distinct(), ["note", "target"], "left_anti")
    place = F.row_number().over(W.partitionBy("note").orderBy(F.desc("score"), "target"))
    return best.withColumn("place", place).filter(F.col("place") <= most).drop("place")
