"""Quality classifier: Bradley-Terry scores from preference pairs.

Every pair of a document labelled 1 and one labelled 0 says that the first is preferred. The weights
minimise the logistic loss of the pairs' feature differences; features are measured on the whole text
(shares of characters, repetition of words and lines, lengths), never on labels, language, source or id.
A logistic link fitted on the same rows turns the score into 0..1, and a threshold is a quantile of the
scores of labelled good documents.

The fit reads at most about max_labelled labelled rows (by hash of the id, so reruns agree) and max_pairs
pairs on the driver; scoring covers all rows where they lie, without a shuffle.

Defined results: a null text is an empty one and is scored; labels that are null are not learnt from;
repeated labels or documents count as often as they occur; without labels of both kinds the score is the
smoothed share of label 1; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED, MAX_PAIRS = 20_000, 60_000
KEEP_GOOD = 0.95  # the share of labelled good documents above the quantile threshold: a few wrong labels can't move it

_CLASS = np.zeros(256, dtype=np.int64)  # 0: other letters and bytes
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"?-()", b"!", b"|", b"$%#*&@^~<>{}[]\\/_=+`"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9
CLASSES = 10


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    share = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=CLASSES)[:CLASSES] / max(n, 1)
    words = raw.split()
    m = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0) / m
    again = sum(map(bytes.__eq__, words, words[1:])) / m
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    lines = raw.split(b"\n")
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    base = np.array([
        *share, np.log1p(n), np.log1p(len(words)), len(counts) / m, top, again, pairs, len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), sizes.mean() / 8, np.log1p(sizes.max()), sizes.std() / 8, float(n == 0),
    ])
    return np.concatenate([base, np.sqrt(share), base[12:17] ** 2, base[12:17] * base[11] / 8])


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression of y on x by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclasses.dataclass(frozen=True)
class BradleyTerry:
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    slope: float
    shift: float
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.strength(x) + self.shift, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, keep_good: float = KEEP_GOOD) -> BradleyTerry:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            size = x.shape[1] if len(x) else len(features(""))
            p = (len(good) + 1) / (len(y) + 2)
            return cls(np.zeros(size), np.zeros(size), np.ones(size), 0.0, float(np.log(p / (1 - p))), 0.0)
        center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - center) / scale, -8, 8)
        draw = np.random.default_rng(7)
        n = min(max_pairs, len(good) * len(bad))
        a = z[draw.choice(good, n)] - z[draw.choice(bad, n)]
        weights = _newton(a, np.ones(n), np.full(z.shape[1], 1.0))
        s = z @ weights
        spread = s.std() + 1e-9
        slope, shift = _newton(np.stack([s / spread, np.ones(len(s))], axis=1), (y == 1).astype(float), np.array([0.05, 0.0]))
        model = cls(weights, center, scale, float(slope / spread), float(shift), 0.0)
        return dataclasses.replace(model, threshold=float(np.quantile(model.score(x[good]), 1 - keep_good)))


def _vectors(texts: pd.Series) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, len(features(""))))


def features_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_vectors(texts)))

    return measure(text)


def score_column(model: BradleyTerry, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_vectors(texts)))

    return score(text)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, max_pairs: int = MAX_PAIRS, keep_good: float = KEEP_GOOD) -> BradleyTerry:
    """Learns from the labelled rows that are not held out."""
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("y"))
    n = rows.count()
    if n > max_labelled:
        rows = rows.filter(F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    # about max_labelled rows of 12 bytes: the bound is the parameter
    texts = docs.select(F.col("doc_id").alias("known"), F.col("text").alias("body"))  # extra columns may have any names
    found = texts.join(F.broadcast(rows), F.col("known") == F.col("labelled")).select("labelled", "y", features_column(F.col("body")).alias("x"))
    got = found.toPandas().sort_values(["labelled", "y"], kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(features(""))))
    return BradleyTerry.fit(x, got["y"].to_numpy(), max_pairs, keep_good)


def keep_good_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents below the quantile threshold go, which counts as 0.3 where it is higher: what op2 predicts as good stays."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    cut = min(model.threshold, 0.3)
    return docs.withColumn("__score", score_column(model, F.col("text"))).filter(F.col("__score") >= cut).drop("__score")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumns({"predicted": (F.col("score") >= 0.3).cast("int"), "above_quantile": F.col("score") >= model.threshold})
