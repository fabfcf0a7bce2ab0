"""MinHash near-deduplication with an LSH forest.

Each text's set of word shingles gives a signature of minima. The forest holds TREES orders of the
signatures, each starting at another place; an order is sorted over all partitions, and the neighbours
with the longest common prefixes are candidates. In dense regions (many rows with one prefix) depth
adapts: at each prefix depth a region has a few hubs, the rows nearest to its most frequent values, and its
rows are candidates of these, mostly the same ones in every tree. So a group of thousands gets a number of
candidates in proportion to its size, and rows far from one another meet through the hubs. Candidates whose signatures differ too much
(four standard deviations below the bound) go; what stays is confirmed on the full sets.

Texts with one shingle set are one node from the start, so exact copies cost a row each. Confirmation goes
in rounds: first each node's likeliest link, then links between different components alone; the last
round confirms every candidate left. Components come from alternating large-star and small-star steps on
tables in the shared folder.

The forest only saves work. What it has left apart goes through an exact join: sets that are alike enough
share a shingle among the rarest 20 percent (prefix filter), so nodes of different components that share
such a shingle are compared, first by a bound from 512-bit parities of the sets and then on the sets. So
the components are those of all links, whatever batches, partitions or hubs the forest had. Of a shingle
with many nodes both sides are dealt over several tasks, and nodes of its largest component aren't
compared with one another.

Defined results: a null text or one without words has an empty set and is linked with nothing; rows with
one id and other texts are nodes of their own; the component is the smallest id in reach, nulls aside; an
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, arrow_batches, join_on, parts, written

SHINGLE, PERCENT = 4, 80
TREES, DEPTH = 12, 4  # a signature has TREES * DEPTH values of 16 bits
NEIGHBOURS, HUBS, DENSE = 2, 2, 16  # DENSE: rows with one prefix from which hubs are sought
ROUNDS = 3
BINS, RANKED, PACKED = 1 << 24, 1_000_000, 1 << 20  # shingles are counted in bins; this orders them and decides nothing
WORDS = 8  # of 64 parity bits
LARGE = 500  # shingles of a set that has longer parities besides
SALTED = 2000  # nodes of a shingle on one side of a task
VALUES = TREES * DEPTH
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_DRAW = np.random.default_rng(20240131)
_A = (_DRAW.integers(0, 1 << 63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct n-word shingles; of shorter texts the whole sequence is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1))
    return (_mix(low) >> np.uint64(48)).astype(">u2")  # big-endian: bytes sort as the values


def described(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """key, n (shingles), the set's 128-bit name, its signature, prefix and parity bits (large sets have more of them) for each row."""
    ranks = frequency_ranks(docs, text, shingle)

    @F.pandas_udf("n bigint, name binary, sig binary, prefix array<int>, bits array<bigint>, more array<bigint>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingle_set(t, shingle)
            name = xxhash.xxh3_128_digest(s.tobytes())
            more = parities(s, long_words(len(s))) if len(s) > LARGE else None
            out.append((len(s), name, signature(s).tobytes(), prefix_of(s, ranks, percent), parities(s), more) if len(s) else (0, name, None, None, None, None))
        return pd.DataFrame(out, columns=["n", "name", "sig", "prefix", "bits", "more"])

    return docs.select(F.col(key).cast("long").alias("key"), describe(docs[text]).alias("d")).select("key", "d.*")


def _near(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alike = (sig[i] == sig[j]).mean(axis=1)
    ok = alike >= least
    return i[ok], j[ok], alike[ok]


def candidates_in_order(tree: np.ndarray, sig: np.ndarray, least: float, fresh: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places (i, j) with their likeness, of rows sorted by tree and signature; the first fresh rows have been paired before."""
    n, found = len(tree), []
    first = (tree[1:] == tree[:-1]) & (sig[1:, 0] == sig[:-1, 0])
    same = np.cumprod(np.concatenate([(sig[1:] == sig[:-1])], axis=0), axis=1).sum(axis=1) * first  # common prefix of neighbours
    for w in range(1, NEIGHBOURS + 1):
        i = np.arange(max(0, fresh - w), n - w)
        together = np.ones(len(i), dtype=bool)
        for k in range(w):
            together &= first[i + k]
        i = i[together & (i + w >= fresh)]
        found.append(_near(sig, i, i + w, least))
    for depth in (1, 2, 4, 8):
        cut = np.flatnonzero(np.concatenate([[True], same < depth, [True]]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a <= DENSE or b <= fresh:
                continue
            rows = sig[a:b]
            order = np.sort(rows, axis=0)
            run = np.ones_like(order, dtype=np.int32)
            mode, count = order[0].copy(), np.ones(order.shape[1], dtype=np.int32)
            for k in range(1, len(order)):
                run[k] = np.where(order[k] == order[k - 1], run[k - 1] + 1, 1)
                better = run[k] > count
                mode[better], count[better] = order[k][better], run[k][better]
            near = (rows == mode).mean(axis=1)
            for h in np.argsort(-near, kind="stable")[:HUBS]:
                i = np.arange(a, b)
                i = i[i != a + h]
                found.append(_near(sig, i, np.full(len(i), a + h), least))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def candidates(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with a < b of nodes (node, sig) that are neighbours or share a hub in some tree."""
    spark = nodes.sparkSession
    width = 2 * DEPTH
    rotated = F.array(*(F.concat(F.substring("sig", width * t + 1, 2 * VALUES), F.substring("sig", 1, width * t)) for t in range(TREES)))
    rows = nodes.select("node", F.posexplode(rotated).alias("tree", "sig")).select(F.col("tree").cast("byte").alias("tree"), "sig", "node")
    order = ["tree", "sig", "node"]
    rows = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs, and as rows without likeness the first and last rows of the partition, for the neighbours beyond it."""
        kept, head, part = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            part = int(batch["part"].iloc[0])
            head = batch.iloc[:NEIGHBOURS] if head is None or len(head) < NEIGHBOURS else head
            fresh = 0 if kept is None else len(kept)
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            yield linked(rows, fresh)
            kept = rows.iloc[-NEIGHBOURS:]
        if part is not None:
            edge = pd.concat([head, kept]).drop_duplicates(["tree", "node"])
            yield pd.DataFrame({"a": edge["node"], "b": edge["node"], "alike": 0.0, "tree": edge["tree"], "sig": edge["sig"], "part": part})

    def linked(rows: pd.DataFrame, fresh: int) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=">u2").reshape(len(rows), VALUES).astype(np.uint16)
        node = rows["node"].to_numpy()
        i, j, alike = candidates_in_order(rows["tree"].to_numpy(), sig, least, fresh)
        ends = np.sort(np.stack([node[i], node[j]]), axis=0)
        out = pd.DataFrame({"a": ends[0], "b": ends[1], "alike": alike})
        out = out.drop_duplicates(["a", "b"])
        return out.assign(tree=-1, sig=None, part=-1)

    def seams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        if len(rows):
            yield linked(rows, 0)[["a", "b", "alike"]]

    kind = "a bigint, b bigint, alike double, tree int, sig binary, part int"
    with arrow_batches(spark, 4000):
        found = written(rows.mapInPandas(pairs, kind), "neighbours")
    # a few rows for each partition, in one sorted run
    edges = found.filter("tree >= 0").select("tree", "sig", F.col("a").alias("node")).distinct().repartition(1).sortWithinPartitions(*order)
    across = edges.mapInPandas(seams, "a bigint, b bigint, alike double")
    every = found.filter("tree < 0").select("a", "b", "alike").unionByName(across).filter("a <> b")
    return written(every.groupBy("a", "b").agg(F.max("alike").alias("alike")), "candidates")


def sets_of(docs: DataFrame, nodes: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """The shingle sets of nodes (node, rep, name), read again from the documents that stand for them."""

    @F.pandas_udf("name binary, hashes array<bigint>")
    def build(texts: pd.Series) -> pd.DataFrame:
        out = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame({"name": [xxhash.xxh3_128_digest(s.tobytes()) for s in out], "hashes": [s.view(np.int64) for s in out]})

    small = nodes.count() <= BROADCAST_ROWS
    wanted = nodes.select("rep").distinct()
    wanted = F.broadcast(wanted) if small else wanted
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(wanted, F.col("key").eqNullSafe(F.col("rep")), "left_semi")
    rows = rows.select("key", build("text").alias("s")).select("key", "s.*")
    names = nodes.select("node", "rep", F.col("name").alias("known"))
    names = F.broadcast(names) if small else names
    # a plain equality has Spark ask all documents first whether build() gives them a name
    found = rows.join(names, F.col("key").eqNullSafe(F.col("rep")) & F.col("name").eqNullSafe(F.col("known")))
    with arrow_batches(docs.sparkSession, 256):
        return written(found.select("node", "hashes").dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("ha", "hb"))
    return both.filter(100 * inter >= percent * (F.size("ha") + F.size("hb") - inter)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node in edges (a, b): root is the smallest node in reach. Large-star and small-star steps until nothing changes."""
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    seen = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now
        # large star: what is above a node is linked to the smallest of its neighbours and itself
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what is not above a node, and itself, is linked to the smallest of these
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = written(small.filter("u <> v").distinct(), "stars")


def bin_counts(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(bin, n) of the bins that more than one of all documents' shingles fall into.

    Bins go through the shuffle packed: the low 16 bits of each, in one row for each of the 256 values of the high 8 bits.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append((shingle_set(t, shingle) & np.uint64(BINS - 1)).astype(np.uint32))
                size += len(held[-1])
                if size >= PACKED:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(held))
        cut = np.searchsorted(every, np.arange(257, dtype=np.uint64) << np.uint64(16))
        low = every.astype("<u2")  # the low 16 bits
        high = [i for i in range(256) if cut[i] < cut[i + 1]]
        return pa.RecordBatch.from_arrays([pa.array(high, pa.int32()), pa.array([low[cut[i] : cut[i + 1]].tobytes() for i in high], pa.binary())], ["high", "low"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for high, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = np.bincount(np.frombuffer(low.as_buffer(), dtype="<u2"), minlength=1 << 16)
                counts[high] = counts[high] + n if high in counts else n
        for high, n in counts.items():
            many = np.flatnonzero(n > 1)
            yield pa.RecordBatch.from_arrays([pa.array((many + (high << 16)).astype(np.int32)), pa.array(n[many].astype(np.int64))], ["bin", "n"])

    spark = docs.sparkSession
    with arrow_batches(spark, 1000):
        rows = docs.select(text).mapInArrow(packed, "high int, low binary").repartition(parts(spark), "high")
        return written(rows.mapInArrow(counted, "bin int, n bigint"), "bins")


def frequency_ranks(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of hashes in order, with a rank for each by how often the documents have it; other bins have rank 0. Any ranks give the same links.

    All documents are counted. Bins hold more than one shingle, so those count as frequent that stand out from
    the mean by four deviations.
    """
    counts = bin_counts(docs, text, shingle)
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BINS
    least = 3 + mean + 4 * mean**0.5
    often = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "bin").limit(RANKED).toPandas().sort_values("bin")  # the most frequent; two small columns
    return often["bin"].to_numpy(dtype=np.int32), np.log2(often["n"].to_numpy(dtype=np.float64)).astype(np.uint8) + np.uint8(1)


def ranks_of(hashes: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, rank = ranks
    if not len(known):
        return np.zeros(len(hashes), dtype=np.uint64)
    bins = (hashes & np.uint64(BINS - 1)).astype(np.int32)
    at = np.minimum(np.searchsorted(known, bins), len(known) - 1)
    return np.where(known[at] == bins, rank[at], 0).astype(np.uint64)


def prefix_of(hashes: np.ndarray, ranks: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The rarest shingles in order, as 32 bits of their hashes: of two sets that are alike enough, these have one in common."""
    size = len(hashes) + percent * len(hashes) // -100 + 1
    order = (ranks_of(hashes, ranks) << np.uint64(32)) | (hashes >> np.uint64(32))
    rarest = np.partition(order, size - 1)[:size] if size < len(order) else order
    return (np.unique(rarest) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def parities(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Whether an odd number of hashes falls into each of 64 * words bits: sets differ in as many hashes at least as in bits."""
    odd = np.bincount((hashes >> np.uint64(32)) % np.uint64(64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_words(n: int) -> int:
    """Words of the parities of a large set, of which sets without anything in common differ in more bits than alike ones may: a power of two, so that the longer of two can be folded."""
    return 1 << (n // 64).bit_length()


def links_apart(sigs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, rep, name, root) of different roots: all that are alike enough, and some more.

    sigs are the rows of described(). Of all prefix shingles only (shingle, node, root) is shuffled, once;
    a window over the shingle, which spills, keeps those of several roots. Of such a shingle, nodes outside
    its most frequent root are compared with all its nodes, so nodes of one large component never meet one
    another; a pair meets at its first common shingle at least, which lies early enough in both sets for the
    rest to be alike enough. Both sides are dealt over a grid of tasks where a shingle has many nodes.
    """
    bits = [f"b{i}" for i in range(WORDS)]
    names = nodes.select("node", "rep", F.col("name").alias("known"), "root")
    rows = sigs.filter("n > 0").join(names, F.col("key").eqNullSafe(F.col("rep")) & (F.col("name") == F.col("known")))
    rows = written(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("root", "n", "prefix", "bits", "more"))), "prefixes")
    of = W.partitionBy("token")
    posted = rows.select("node", "root", F.posexplode("prefix").alias("place", "token"))
    posted = posted.withColumns({"least": F.min("root").over(of), "most": F.max("root").over(of)}).filter("least <> most").select("token", "node", "root", "place")
    posted = written(posted, "postings")
    by_root = posted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    tokens = by_root.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("n"))
    tokens = tokens.select("token", "major", F.ceil((F.col("all") - F.col("n")) / SALTED).cast("int").alias("across"), F.ceil(F.col("all") / SALTED).cast("int").alias("down"))
    posted = posted.join(written(tokens, "tokens"), "token")
    wide = rows.select("node", "n", *(F.col("bits")[i].alias(b) for i, b in enumerate(bits)))
    posted = written(posted.join(wide, "node"), "wide_postings")
    spread = F.xxhash64("node")
    left = posted.filter("root <> major").withColumn("i", F.pmod(spread, F.col("across")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
    right = posted.withColumn("j", F.pmod(spread, F.col("down")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    x, y = left.alias("x"), right.alias("y")

    def c(name: str) -> tuple[Column, Column]:
        return F.col(f"x.{name}"), F.col(f"y.{name}")

    (xn, yn), (xr, yr), (xs, ys) = c("node"), c("root"), c("n")
    differ = sum((F.bit_count(p.bitwiseXOR(q)) for p, q in map(c, bits[1:])), F.bit_count(c(bits[0])[0].bitwiseXOR(c(bits[0])[1])))
    same = functools.reduce(operator.and_, (p == q for p, q in map(c, ("token", "i", "j"))))
    ahead = F.least(*(n - place for n, place in zip((xs, ys), c("place"), strict=True)))  # of the first shingle in common, how many there can be at most
    near = (xr != yr) & ((100 + percent) * ahead >= percent * (xs + ys)) & ((100 + percent) * differ <= (100 - percent) * (xs + ys))
    found = x.join(y, same & near).select(F.least(xn, yn).alias("a"), F.greatest(xn, yn).alias("b"), (-differ / (xs + ys)).alias("alike"))
    found = written(found.groupBy("a", "b").agg(F.max("alike").alias("alike")), "near_links")
    large = rows.filter("more is not null").select("node", "n", "more")
    a, b = (large.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("more").alias(f"m{c}")) for c in "ab")
    both = found.join(a, "a", "left").join(b, "b", "left")
    more = F.coalesce(_differing("ma", "mb"), F.lit(0))
    return written(both.filter(F.col("na").isNull() | F.col("nb").isNull() | ((100 + percent) * more <= (100 - percent) * (F.col("na") + F.col("nb")))).select("a", "b", "alike"), "links_apart")


def _differing(a: str, b: str) -> Column:
    """In how many bits two parities differ; the longer one is folded to the shorter one's length, which may be half of it."""
    def folded(x: str, y: str) -> Column:
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, c: n + c)


def joined(pairs: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, first: bool) -> DataFrame:
    """roots after all of pairs (a, b, alike) are confirmed or lie in one component; first: each node is its own so far."""
    for step in range(ROUNDS):
        if step or not first:
            a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
            left = written(pairs.join(a, "a").join(b, "b").filter("ra <> rb"), "apart")
        else:  # each node is a component of its own
            left = pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")})
        ask = left.select("a", "b")
        if step < ROUNDS - 1:
            best = F.max(F.struct("alike", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("x")
            ask = left.groupBy(F.col("a").alias("node")).agg(best).unionByName(left.groupBy(F.col("b").alias("node")).agg(best)).select("x.a", "x.b").distinct()
        ask = written(ask, "asked")
        links = confirmed(ask, sets, percent)
        moved = components(left.join(links, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        roots = written(roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        pairs = left.select("a", "b", "alike").join(ask, ["a", "b"], "left_anti")
    return roots


def clustered(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id and kept of each row of docs."""
    with arrow_batches(docs.sparkSession, 1000):
        sigs = written(described(docs, key, text, shingle, percent), "signatures")
    nodes = sigs.filter("n > 0").groupBy("name").agg(F.min("key").alias("rep"), F.min("sig").alias("sig"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    p = percent / 100
    least = p - 4 * (p * (1 - p) / VALUES) ** 0.5
    pairs = candidates(nodes.select("node", "sig"), least)
    nodes = nodes.drop("sig")

    def sets_for(found: DataFrame) -> DataFrame:
        ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
        return sets_of(docs, written(nodes.join(ends, "node"), "linked"), key, text, shingle)

    sets = sets_for(pairs)
    roots = joined(pairs, written(sets.select("node", F.col("node").alias("root")), "roots"), sets, percent, True)
    roots = written(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    rest = links_apart(sigs, nodes.join(roots, "node"), percent)
    if not rest.isEmpty():
        roots = joined(rest, roots, sets_for(rest), percent, False)
    whole = nodes.select("node", "name", "rep").join(roots, "node")
    names = whole.groupBy("root").agg(F.min("rep").alias("component"))
    whole = whole.join(names, "root").select("name", "component")
    out = sigs.select("key", "n", F.when(F.col("n") > 0, F.col("name")).alias("name")).join(whole, "name", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def without_keys(docs: DataFrame, keys: DataFrame, key: str, how: str = "left_anti") -> DataFrame:
    """Rows of docs whose key is not in keys; texts are shuffled only if keys are too many to broadcast."""
    keys = keys.select(F.col(key).alias("__key"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return docs.join(keys, F.col(key).eqNullSafe(F.col("__key")), how)


def one_of_each_stage(spark, docs: DataFrame, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """Pipeline stage: one document of each group stays (five-word shingles, similarity of 0.8); of rows with one id, one."""
    found = written(clustered(docs, key, "text", 5), "clusters")
    out = without_keys(docs, found.groupBy(key).agg(F.bool_or("kept").alias("kept")).filter("not kept"), key)
    again = found.groupBy(key).count().filter("count > 1")
    if again.isEmpty():
        return out
    return without_keys(out, again, key).unionByName(without_keys(out, again, key, "left_semi").dropDuplicates([key]))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
