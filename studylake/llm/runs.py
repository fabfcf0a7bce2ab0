"""Periodic runs: the stretches in which a document repeats itself, at least four times over.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 * q) words that no
neighbouring word extends keeping period q. They are found by the method of Kolpakov and Kucherov:

- a suffix automaton of the words gives the factorisation: each factor is a new word, or the longest piece
  that begins further left as well (both may overlap);
- runs that cross or touch the beginning of a factor are found by Main's algorithm: the extensions to
  both sides of that place, for every period at once, come from Z functions of the words around it. A
  factor is as long as can be, so a run that goes on beyond a beginning B reaches less than one period
  over the factor before B, and a window of twice that factor suffices to the left;
- any other run lies within one factor and is copied from the factor's earlier occurrence.

A word of a run stands in it at least four times. Words that are rarer in their stretch than that part
the document into stretches, which are taken apart again; only what is left is factorised. This loses
nothing: neither a run nor a word that extends one can be parted so.

Each document is done by itself where it lies: nothing is shuffled, and a lost task is done again. The
memory is that of one batch of texts and about half a kilobyte for each word of one stretch.

Defined results: a null text is an empty one; a text without words has no runs, and both digests are of
the empty string; a null key leaves a text as it is (see `made_periodic`); rows are kept as they come,
repeated ones too; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_LENGTH, EXPONENT = 6, 4  # a run has max(LEAST_LENGTH, EXPONENT * period) words at least
SPLITS = 6  # so many times a stretch is parted at its rare words
COLUMNS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]  # begin, end (exclusive), period


class Automaton:
    """The suffix automaton of a sequence: the transitions of each state, and where its shortest words first end."""

    def __init__(self, words: Sequence[str]):
        self.next: list[dict[str, int]] = [{}]
        self.first_end = [-1]
        link, length = [-1], [0]
        steps, first_end = self.next, self.first_end
        last = 0
        for i, w in enumerate(words):
            state = len(steps)
            steps.append({})
            first_end.append(i)
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in steps[p]:
                steps[p][w] = state
                p = link[p]
            if p >= 0:
                q = steps[p][w]
                if length[q] > length[p] + 1:  # q holds longer words too, which don't end here: part it
                    half = len(steps)
                    steps.append(steps[q].copy())
                    first_end.append(first_end[q])
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = half
                    while p >= 0 and steps[p].get(w) == q:
                        steps[p][w] = half
                        p = link[p]
                    q = half
                link[state] = q
            last = state


def factors(words: Sequence[str]) -> list[tuple[int, int, int]]:
    """(begin, end, source): the piece from begin to end is the longest there that also begins at source, further left; a new word has source -1."""
    automaton = Automaton(words)
    steps, first_end = automaton.next, automaton.first_end
    out, at, n = [], 0, len(words)
    while at < n:
        state, to = 0, at
        while to < n:
            follow = steps[state][words[to]]
            if first_end[follow] >= to:  # first seen here
                break
            state, to = follow, to + 1
        if to == at:
            out.append((at, at + 1, -1))
        else:
            out.append((at, to, first_end[state] - (to - at) + 1))
        at = out[-1][1]
    return out


def z_function(s: Sequence) -> list[int]:
    """For each place, the length of the longest piece from there that s begins with (0 for place 0)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(words: Sequence[str], before: int, at: int, to: int) -> Iterator[Run]:
    """Runs that hold or touch the place `at`, end no later than `to` and begin after one period before `before`.

    before, at and to are the beginnings of the factor to the left of that place and of the one to the
    right, and the latter's end.
    """
    left, right = at - before, to - at
    if 2 * left + right < LEAST_LENGTH and left + 2 * right < LEAST_LENGTH:
        return
    n, gap = len(words), [None]
    own = words[at:to]
    # two periods or more to the left: the run's second period ends no later than `at`
    low = max(0, at - 2 * left)
    back = z_function(words[low:at][::-1])
    ahead = z_function([*own, *gap, *words[max(0, at - left) : to]])
    zero = right + 1 + at - max(0, at - left)  # of `at` in ahead
    for q in range(1, min(left, at + 1)):
        lefts = back[q] if q < len(back) else 0
        rights = ahead[zero - q]
        rights = min(rights, right)
        begin, end = at - lefts - q, at + rights
        # a run that reaches one period over the factor before ends at `at`, and was found at that factor
        if lefts >= left or end - begin < max(LEAST_LENGTH, EXPONENT * q):
            continue
        if end < n and words[end] == words[end - q]:
            continue
        yield begin, end, q
    # two periods or more to the right
    most = right // 2
    if most:
        low = max(0, at - left - most)
        mine, over = words[low:at][::-1], words[low : at + most][::-1]
        back = z_function([*mine, *gap, *over]) if mine else []
        for q in range(1, most + 1):
            lefts = back[len(mine) + 1 + most - q] if mine else 0
            rights = ahead[q]
            begin, end = at - lefts, at + q + rights
            if end - begin < max(LEAST_LENGTH, EXPONENT * q) or lefts >= left + q:
                continue
            if end < n and words[end] == words[end - q]:
                continue
            yield begin, end, q


def stretch_runs(words: Sequence[str]) -> list[Run]:
    """All runs of a sequence, by the factorisation."""
    words = [*words, None]  # ends with a word of its own, so that what ends there touches a factor's beginning
    by_begin: dict[int, dict[int, int]] = {}  # begin -> end -> the smallest period

    def add(begin: int, end: int, q: int) -> None:
        ends = by_begin.setdefault(begin, {})
        ends[end] = min(q, ends.get(end, q))

    before = 0
    for at, to, source in factors(words):
        for run in crossing(words, before, at, to):
            add(*run)
        if to - at > LEAST_LENGTH and source >= 0:
            shift = at - source
            for begin in range(at + 1, to - LEAST_LENGTH):
                known = by_begin.get(begin - shift)
                if known:
                    for end, q in list(known.items()):
                        if end + shift < to:
                            add(begin, end + shift, q)
        before = at
    return sorted((b, e, q) for b, ends in by_begin.items() for e, q in ends.items())


def stretches(words: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Stretches that hold all runs: parted at words that are too rare in their stretch to be in a run."""
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < LEAST_LENGTH:
            continue
        seen = Counter(words[lo:hi])
        rare = {w for w, n in seen.items() if n < EXPONENT}
        if not rare or depth == SPLITS:
            yield lo, hi
        elif len(rare) < len(seen):
            cuts = [lo - 1, *(i for i in range(lo, hi) if words[i] in rare), hi]
            todo += [(a + 1, b, depth + 1) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > LEAST_LENGTH]


def runs(words: Sequence[str]) -> list[Run]:
    """All runs of a document: (begin, end, period) by begin, then period."""
    found = [(lo + b, lo + e, q) for lo, hi in stretches(words) for b, e, q in stretch_runs(words[lo:hi])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length / period, exactly; of equal ones the leftmost, then the one with the smallest period."""
    best = None
    for b, e, q in found:
        if best is None or (e - b) * best[2] > (best[1] - best[0]) * q:
            best = (b, e, q)
    return best


def collapsed(words: Sequence[str], found: list[Run]) -> list[str]:
    """The words without those that a run repeats: of each run its first period stays, unless another run repeats that."""
    if not found:
        return list(words)
    edge = [0] * (len(words) + 1)
    for b, e, q in found:
        edge[b + q] += 1
        edge[e] -= 1
    return [w for w, depth in zip(words, accumulate(edge), strict=False) if not depth]


def made_periodic(words: list[str], key: int | None) -> list[str]:
    """One document of ten, by its key, repeats its own words from a place on; the others stay as they are."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def record(words: list[str]) -> tuple:
    """The values of COLUMNS for a document's words."""
    found = runs(words)
    best = strongest(found)
    b, e, q = best or (None, None, None)
    numbers = (b, e - b, q, 1000 * (e - b) // q) if best else (None,) * 4
    return len(found), *numbers, digest("".join(f"{b},{e - b},{q}\n" for b, e, q in found)), digest(" ".join(collapsed(words, found)))


def with_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", edit=None) -> DataFrame:
    """The key and COLUMNS of each row; edit(words, key) may change a text's words before."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([("key", pa.int64()), *((c.split()[0], types[c.split()[1]]) for c in COLUMNS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time is a Python string
                words = WORD.findall(t.as_py() or "")
                rows.append((k.as_py(), *record(edit(words, k.as_py()) if edit else words)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    given = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    return given.mapInArrow(run, f"key bigint, {COLUMNS}").select("key", *names).withColumnRenamed("key", key)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every whole document, one of ten of which is made to repeat itself."""
    return with_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=made_periodic)
