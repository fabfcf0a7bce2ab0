"""Token counts and token-ID files.

Counts: huge documents are encoded in overlapping chunks with offsets and spliced where both encodings
have a pre-token boundary that nothing beyond the chunk can move; where there is none, the overlap is
doubled. Why that is proven: the pre-tokenizer reads left to right, looks at most a few characters ahead
and never back. So the left chunk, which starts at a true boundary, has true boundaries up to a margin
before its end; and from a boundary that the right chunk shares, its encoding is that of the whole text.

Files: ORC with the ids as an integer list (run-length encoded), row indexes and a Bloom filter on the
document ids, sorted by document id, so that readers take stripes in parallel and skip by metadata.

Defined results: a null text is an empty one (no tokens; in files the end id alone); repeated rows stay
as they are; a null id sorts last; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, new_path, parts, running_sum, written

TOKENIZER = "byte_bpe_50k.json"
CHUNK, OVERLAP = 20_000, 256  # code points
KNOWN_UNITS = 400_000  # units of which a worker remembers the ids: about so many
STEP_BYTES = 8 << 20  # of text that is encoded at once
_GAP = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file: a path, or the name of a public one."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    behind = np.cumsum(sizes)
    return np.repeat(starts - behind + sizes, sizes) + np.arange(behind[-1] if len(behind) else 0)


class Encoder:
    """One process's tokenizer. ids() gives what the library gives for the whole text.

    With a byte-level pre-tokenizer a single space between two other characters always starts a
    pre-token, so the text is cut there and the ids of each unit are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        pre = self.tokenizer.pre_tokenizer
        self.cuttable = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None and not any(a.lstrip or a.rstrip or a.single_word or re.search(r"\s", a.content) for a in added)
        self.margin = 8 + max((len(a.content) for a in added), default=0)
        space = pre.pre_tokenize_str(" ")[0][0] if self.cuttable else " "
        self.spaced = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), dtype=bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(space)]] = True
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.again = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's ids."""
        every = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
        return np.fromiter(chain.from_iterable(every), dtype="<u4", count=int(sizes.sum())), sizes

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode, of units without spaces behind a space each: joined, a few thousand at once; a unit begins where an id's text begins with a space."""
        joined = ["".join(" " + u for u in units[i : i + 4000]) for i in range(0, len(units), 4000)]
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *(np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False))])
        first = np.flatnonzero(self.spaced[ids])
        return (ids, np.diff(first, append=len(ids))) if len(first) == len(units) else self._encode([" " + u for u in units])

    def _slots(self, units: list[str]) -> np.ndarray:
        """The place in memory of the ids of each unit behind its space.

        No ids stand there where white space follows that space, which then starts no pre-token.
        What hasn't been asked for again when the memory is full is forgotten.
        """
        if len(self.sizes) > KNOWN_UNITS:
            kept = np.flatnonzero(self.again)
            kept = kept if len(kept) <= KNOWN_UNITS // 2 else kept[:0]
            names = list(self.known)
            self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
            self.flat = self.flat[_spread(self.starts[kept], self.sizes[kept])]
            self.sizes = self.sizes[kept]
            self.starts, self.again = np.cumsum(self.sizes) - self.sizes, np.zeros(len(kept), dtype=bool)
        slots = np.fromiter(map(self.known.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        new = np.flatnonzero(slots < 0)
        self.again[slots[slots >= 0]] = True
        if len(new):
            names = [units[i] for i in new.tolist()]
            plain = np.array([bool(u) and not u[0].isspace() for u in names])
            ids, sizes = self._encode_units([u for u, p in zip(names, plain.tolist(), strict=True) if p])
            every = np.zeros(len(new), dtype=np.int64)
            every[plain] = sizes
            slots[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.known.update(zip(names, slots[new].tolist(), strict=True))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(every) - every)
            self.flat, self.sizes = np.append(self.flat, ids), np.append(self.sizes, every)
            self.again = np.append(self.again, np.zeros(len(new), dtype=bool))
        return slots

    def ids(self, text: str) -> np.ndarray:
        first, *rest = _GAP.split(text) if self.cuttable else [text]
        return self._encode([first, *(" " + u for u in rest)])[0]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's ids.

        Equal units of the batch are looked up or encoded once; the rest is done on whole arrays.
        """
        if not self.cuttable:
            return self._encode(texts.to_pylist())
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        at = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        units = flat.dictionary_encode()
        slots = self._slots(units.dictionary.to_numpy(zero_copy_only=False).tolist())[units.indices.to_numpy()]
        starts, sizes = self.starts[slots], self.sizes[slots]
        wide = sizes == 0
        wide[at] = False
        own = {i: self.ids(texts[i].as_py()) for i in np.flatnonzero(np.logical_or.reduceat(wide, at)).tolist()}
        head_ids, head_sizes = self._encode(flat.take(pa.array(at)).to_pylist())
        starts[at], sizes[at] = len(self.flat) + np.cumsum(head_sizes) - head_sizes, head_sizes
        extra, begin = [head_ids], len(self.flat) + len(head_ids)
        for i, ids in own.items():
            sizes[at[i] : at[i + 1] if i + 1 < len(at) else len(sizes)] = 0
            starts[at[i]], sizes[at[i]] = begin, len(ids)
            extra.append(ids)
            begin += len(ids)
        return np.concatenate([self.flat, *extra])[_spread(starts, sizes)], np.add.reduceat(sizes, at)

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return len(self.ids(text)) if len(text) <= chunk or not self.cuttable else self.spliced(text, chunk, overlap)

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens end in the text, and the number of tokens up to there; 0 comes first."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in e.word_ids])
        last = np.flatnonzero(np.append(words[1:] != words[:-1], True)) if len(words) else np.zeros(0, dtype=np.int64)
        ends = np.array([b for _, b in e.offsets])[last] if len(words) else last
        return np.append(0, ends), np.append(0, last + 1)

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        """The number of tokens of a text in overlapping chunks."""
        total, start, size = 0, 0, chunk  # start: a true boundary; the tokens before it are counted
        ends, upto = self.boundaries(text[:size])
        at = 0  # where the left chunk's encoding starts
        while at + size < len(text):
            wide, stop = overlap, at + size
            while True:
                right_at = max(start, stop - wide)
                right, right_upto = self.boundaries(text[right_at : right_at + chunk + wide])
                sure = (ends + at >= right_at) & (ends + at > start) & (ends + at <= stop - self.margin)
                common = np.intersect1d(ends[sure] + at, right + right_at)
                if len(common) or right_at == start:
                    break
                wide *= 2
            if not len(common):  # one pre-token fills the chunk: begin again at the last true boundary with a longer one
                size = max(2 * size, chunk)
                ends, upto, at = *self.boundaries(text[start : start + size]), start
                continue
            splice = int(common[-1])
            total += int(upto[np.searchsorted(ends, splice - at)] - upto[np.searchsorted(ends, start - at)])
            start, at, ends, upto, size = splice, right_at, right, right_upto, chunk + wide
        return total + int(upto[-1] - upto[np.searchsorted(ends, start - at)])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def steps(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts without nulls, in slices of about STEP_BYTES."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(upto, STEP_BYTES + (upto[begin - 1] if begin else 0), "right")))
        yield texts[begin:end]
        begin = end


def token_count(text: Column, tokenizer: str = TOKENIZER, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """The number of tokens. Texts of more than chunk code points are encoded in overlapping chunks if the vocabulary is a byte-level one, else whole."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        e, out = encoder(vocabulary_path(tokenizer)), []
        for part in steps(texts):
            huge = pc.greater(pc.utf8_length(part), chunk).to_numpy(zero_copy_only=False) if e.cuttable else np.zeros(len(part), dtype=bool)
            n = np.zeros(len(part), dtype=np.int64)
            if not huge.all():
                n[~huge] = e.batch(part.filter(pa.array(~huge)))[1]
            for i in np.flatnonzero(huge).tolist():
                n[i] = e.count(part[i].as_py(), chunk, overlap)
            out.append(n)
        pa.default_memory_pool().release_unused()
        return pa.array(np.concatenate(out) if out else [], type=pa.int64())

    return count(text)


def token_ids(text: Column, tokenizer: str = TOKENIZER, end_id: int | None = 2) -> Column:
    tail = 0 if end_id is None else 1

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        e = encoder(vocabulary_path(tokenizer))
        flat, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(1, dtype=np.int64)]
        for part in steps(texts):
            ids, n = e.batch(part)
            if tail:
                ids = np.insert(ids, np.cumsum(n), end_id)
            flat.append(ids)
            sizes.append(n + tail)
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        pa.default_memory_pool().release_unused()
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).view("<i4")))

    return encode(text)


def ids_crc32(ids: Column) -> Column:
    @F.arrow_udf("bigint")
    def check(rows: pa.Array) -> pa.Array:
        raw, at = memoryview(rows.flatten().to_numpy().astype("<i4", copy=False)).cast("B"), (rows.offsets.to_numpy() - rows.offsets[0].as_py()) * 4 if len(rows) else []
        return pa.array([zlib.crc32(raw[a:b]) for a, b in pairwise(at)], type=pa.int64())

    return check(ids)


def write_token_orc(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 2, stripe_bytes: int = 64 << 20, stride: int = 10_000) -> None:
    """Writes (key, ids) sorted by key over all files. Texts are dealt out by key ranges before they are encoded: they are shorter than their ids."""
    order = F.col(key).asc_nulls_last()
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("__text"))
    rows = rows.repartitionByRange(parts(docs.sparkSession), order).sortWithinPartitions(order).select(key, token_ids(F.col("__text"), tokenizer, end_id).alias("ids"))
    options = {"orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_bytes), "compression": "zstd"}
    rows.write.options(**options).orc(path)


def read_token_orc(spark, path: str, key: str = "doc_id", ids: list[int] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """(key, ids) of all documents, of some ids or of a range of ids; the predicate goes to the reader, which skips files, stripes and row groups by their statistics and Bloom filters."""
    rows = spark.read.schema(f"`{key}` bigint, ids array<int>").orc(path)
    rows = rows if ids is None else rows.filter(F.col(key).isin(ids))
    return rows if between is None else rows.filter(F.col(key).between(*between))


def placed(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids_crc32 of rows read back."""
    measured = rows.select(key, F.size("ids").cast("long").alias("n_tokens"), ids_crc32(F.col("ids")).alias("ids_crc32"))
    measured = written(measured, "measured")  # the sort by ranges reads its input twice
    return running_sum(measured, [F.col(key).asc_nulls_last(), F.col("n_tokens"), F.col("ids_crc32")], "n_tokens", "start").select(key, "start", "n_tokens", "ids_crc32")


def token_file_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    with arrow_batches(spark, 2000):
        write_token_orc(docs, path)
        return placed(read_token_orc(spark, path))


def op5_token_orc(spark, sf_dir: str) -> DataFrame:
    return token_file_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_count(docs["text"]).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
