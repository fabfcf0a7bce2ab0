"""Secret scans: fixed patterns, and a battery of randomness tests for what they miss.

The battery looks at each run of 20 or more token characters outside the fixed patterns' spans. Runs are
cut at '=', so a value is tested without its name; a value with + or / and - or _, which no alphabet holds,
is cut at the ones and at the others, with the p-values doubled. Parts of 20 or more are tested. It infers
the encoding (hex, base32, base36, base62, base64) from the characters; decimal numbers aren't secrets.
Three statistics compare the characters with uniform draws from that alphabet: chi-squared over as many
equal cells as the length allows, the number of runs above and below the middle code, and the serial
correlation of neighbours. Their p-values for uniform draws are combined (Cauchy); what isn't random by
these is none.

What is left has to be unlike ordinary text. How the three statistics come out for ordinary text is
measured on all documents: on windows of two lengths of their characters, long runs aside, as far as the
encoding has them. Each statistic of a run gets the chance that an ordinary window of the next shorter
length (or the shortest) comes as near to random; the three are combined, and the false-discovery control
(Benjamini-Hochberg over the runs of one document) decides. Longer runs stand out more, as ordinary
windows leave uniformity the further the longer they are.

Defined results: a null text is an empty one, without spans; rows are kept as they come, repeated ones
too; places are code points of the whole text; an empty table gives an empty table. Extra columns are
ignored. Each row is done where it lies, without a shuffle.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
# fixed values: the patterns of the base kinds and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")

VALUE, NO_URL, NO_PLAIN = (re.compile(x) for x in ("[^=]+", "[^=_-]+", "[^=+/]+"))
SHORTEST = 20  # of a run for the battery; no access or hex match that counts is shorter
RANDOM_ALPHA, FDR = 0.001, 0.01
LENGTHS = (24, 48)  # of ordinary windows
LEAST_WINDOWS = 20  # with fewer, the built-in text alone stands for ordinary ones
ORDINARY = (
    "The library keeps a copy of every report that the committee has written since the spring of last year, and readers may ask for any of them at the desk. "
    "Our neighbours walked along the river until it was dark, talking about the harvest, the price of bread and whether the old bridge would hold another winter. "
    "When the meeting ended in room 12 at about 5 o'clock, nobody remembered who had promised to lock the door, so two students waited there for 40 minutes. "
    "Der Zug nach Hamburg kam erst am Abend an, weil auf der Strecke gebaut wurde. Les enfants jouaient dans la cour pendant que le professeur corrigeait les copies. "
)

_TOKEN = np.zeros(256, dtype=np.int8)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = 1
_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": _DIGIT + "abcdef",
    "HEX": _DIGIT + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGIT + _LOWER,
    "BASE36": _DIGIT + _UPPER,
    "base62": _UPPER + _LOWER + _DIGIT,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "base64url": _UPPER + _LOWER + _DIGIT + "-_",
}


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


#: Ordinary text is measured in these; encodings with other letters are near enough to one of them.
MEASURED = {"hex": "hex", "HEX": "hex", "base32": "base36", "base36": "base36", "BASE36": "base36", "base62": "base62", "base64": "base62", "base64url": "base62"}
CODES = {name: np.full(256, -1, dtype=np.int16) for name in ALPHABETS}
for _name, _letters in ALPHABETS.items():
    CODES[_name][list(_letters.encode())] = np.arange(len(_letters))


def inferred(token: str) -> str | None:
    chars = set(token)
    return None if chars <= set(_DIGIT) else next((k for k, v in ALPHABETS.items() if chars <= set(v)), None)


def battery(codes: np.ndarray, k: int) -> np.ndarray:
    """How far each row of codes is from uniform draws of an alphabet of k, in deviations: by chi-squared, by runs and by serial correlation."""
    rows, n = codes.shape
    cells = max(2, min(k, n // 5))
    cell = codes * cells // k
    seen = np.stack([(cell == c).sum(axis=1) for c in range(cells)], axis=1)
    due = n * np.bincount(np.arange(k) * cells // k, minlength=cells) / k
    chi, df = ((seen - due) ** 2 / due).sum(axis=1), cells - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = codes >= k / 2
    a = high.sum(axis=1)
    b = n - a
    runs, mean = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1), 1 + 2 * a * b / n
    z_runs = np.abs(runs - mean) / np.sqrt(np.maximum(1 / n, (mean - 1) * (mean - 2) / (n - 1)))
    z_runs = np.where((a == 0) | (b == 0), math.sqrt(n), z_runs)
    d = codes - codes.mean(axis=1, keepdims=True)
    r = (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.maximum(1e-9, (d * d).sum(axis=1))
    return np.stack([z_chi, z_runs, np.abs(r + 1 / n) * math.sqrt(n)], axis=1)


def combined(p: list[float]) -> float:
    """Cauchy's combination of p-values, which may depend on one another."""
    t = sum(math.tan((0.5 - min(1 - 1e-12, max(1e-15, x))) * math.pi) for x in p) / len(p)
    return 0.5 - math.atan(t) / math.pi


def ordinary_sums(text: str) -> np.ndarray:
    """For each measured encoding and length: the number of windows of the text's ordinary characters, and the sums and squares of log(1 + distance)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros((len(set(MEASURED.values())), len(LENGTHS), 7))
    if len(raw) < LENGTHS[0]:
        return out
    edge = np.diff(_TOKEN[raw], prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ordinary = np.ones(len(raw), dtype=bool)
    for a, b in zip(*(x[end - start >= SHORTEST].tolist() for x in (start, end)), strict=True):
        ordinary[a:b] = False
    for i, name in enumerate(sorted(set(MEASURED.values()))):
        codes = CODES[name][raw[ordinary]]
        codes = codes[codes >= 0].astype(np.int64)
        for j, n in enumerate(LENGTHS):
            if len(codes) >= n:
                u = np.log1p(np.maximum(0, battery(codes[: len(codes) // n * n].reshape(-1, n), len(ALPHABETS[name]))))
                out[i, j] += [len(u), *u.sum(axis=0), *(u * u).sum(axis=0)]
    return out


def ordinary_model(sums: np.ndarray) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of log(1 + distance) of ordinary windows by encoding and length; the built-in text counts as well."""
    base, out = ordinary_sums(ORDINARY), {}
    for i, name in enumerate(sorted(set(MEASURED.values()))):
        for j, n in enumerate(LENGTHS):
            have = base[i, j] + (sums[i, j] if sums[i, j, 0] >= LEAST_WINDOWS else 0)
            mean = have[1:4] / max(1, have[0])
            out[name, n] = mean, np.sqrt(np.maximum(0.01, have[4:7] / max(1, have[0]) - mean**2))
    return out


DEFAULT = ordinary_model(np.zeros((3, len(LENGTHS), 7)))


def token_runs(text: str, least: int) -> list[tuple[int, int]]:
    """Code point spans of the runs of token characters with at least so many."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) < least:
        return []
    edge = np.diff(_TOKEN[np.frombuffer(raw, dtype=np.uint8)], prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    out, at, chars = [], 0, 0
    for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True):
        chars += len(raw[at:s].decode("utf-8", "surrogatepass"))
        out.append((chars, chars + e - s))
        at, chars = e, chars + e - s
    return out


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; access and hex matches that are long enough lie in long runs."""
    out = []
    small = text.lower()
    if any(k in small for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for s, e in runs:
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            out += [(s + m.start(), kind, s + m.end()) for m in pattern.finditer(text[s:e]) if m.end() - m.start() >= LEAST[KINDS[kind]]]
    return sorted(out)


def random_p(token: str, model: dict = DEFAULT) -> float:
    """The chance that ordinary text looks as random as this token; 1 if no alphabet holds it or the battery rejects it."""
    name = inferred(token)
    if not name:
        return 1.0
    z = battery(CODES[name][np.frombuffer(token.encode(), dtype=np.uint8)].astype(np.int64)[None], len(ALPHABETS[name]))[0]
    if combined([_tail(z[0]), 2 * _tail(z[1]), 2 * _tail(z[2])]) < RANDOM_ALPHA:
        return 1.0
    mean, spread = model[MEASURED[name], max((n for n in LENGTHS if n <= len(token)), default=LENGTHS[0])]
    return combined([_tail(x) for x in (mean - np.log1p(np.maximum(0, z))) / spread])


def pieces(token: str) -> list[list[tuple[int, int, int]]]:
    """Parts of a run, a list for each value between '=': (start, end, ways to cut). Where no alphabet holds a value it is cut at - and _, and at + and /."""
    out = []
    for m in VALUE.finditer(token):
        cuts = (VALUE,) if inferred(m[0]) else (NO_URL, NO_PLAIN)
        out.append([(m.start() + x.start(), m.start() + x.end(), len(cuts)) for cut in cuts for x in cut.finditer(m[0]) if x.end() - x.start() >= SHORTEST])
    return out


def random_spans(text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, int]], fdr: float = FDR, model: dict = DEFAULT) -> list[tuple[int, int, int]]:
    """Spans that the battery takes for secrets; parts that overlap a base span aren't tested."""
    tried = []
    starts, ends = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
    for s, e in runs:
        for parts in pieces(text[s:e]):
            found: list[tuple[float, int, int]] = []
            for a, b, ways in parts:
                a, b = s + a, s + b
                before = bisect.bisect_left(starts, b)  # base spans that begin before the part ends
                if not before or ends[before - 1] <= a:
                    found.append((min(1.0, ways * random_p(text[a:b], model)), a, b))
            taken: list[tuple[float, int, int]] = []  # of parts that overlap, from both ways to cut, the longest that passes by itself, else the likeliest, with the least p of them
            for p, a, b in sorted(found, key=lambda f: (f[0] > fdr, f[1] - f[2] if f[0] <= fdr else f[0])):
                if all(b <= x or y <= a for _, x, y in taken):
                    taken.append((min(q for q, x, y in found if x < b and a < y), a, b))
            tried += taken
    tried.sort()
    passed = max((i for i, (p, _, _) in enumerate(tried, 1) if p <= fdr * i / len(tried)), default=0)
    return [(s, 3, e) for _, s, e in tried[:passed]]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def measured(docs: DataFrame, text: str = "text") -> dict:
    """How ordinary windows of all documents come out: sums that each task makes, of which a row for each task reaches the driver's aggregate."""
    size = 3 * len(LENGTHS) * 7

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(LENGTHS), 7))
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += ordinary_sums(t or "")
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel().tolist()], names=[f"s{i}" for i in range(size)])

    rows = docs.select(docs[text].cast("string").alias("text")).mapInArrow(add, ", ".join(f"s{i} double" for i in range(size)))
    row = rows.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(size))).first()
    return ordinary_model(np.array([x or 0.0 for x in row]).reshape(3, len(LENGTHS), 7))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, counts, digest and spans (kind:start:end, comma-joined) of each row."""
    model = measured(docs, text)

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        base, every = [], []
        for t in texts:
            t = t or ""
            runs = token_runs(t, SHORTEST)
            found = base_spans(t, runs)
            base.append(found)
            every.append(joined(found + random_spans(t, runs, found, FDR, model)))
        counts = {f"n_{name}": [sum(k == i for _, k, _ in b) for b in base] for i, name in enumerate(KINDS[:3])}
        return pd.DataFrame(counts | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": every})

    return docs.select(key, run(docs[text]).alias("found")).select(key, "found.*")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
