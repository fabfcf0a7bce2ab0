"""The nearest vectors against all pairs."""

import numpy as np
import pytest

from studylake.operators import vectors

SCHEMA = "id bigint, group bigint, vector array<float>"


def plain(rows, queries, k, per_group, least=-1.0):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    v = unit(np.array([r[2] for r in rows], dtype=np.float32).astype(float))
    q = unit(np.array([r[1] for r in queries], dtype=np.float32).astype(float))
    out = []
    for (name, _), scores in zip(queries, np.round(q @ v.T, 6), strict=True):
        seen, n = {}, 0
        for s, i, g in sorted((-s, r[0], r[1]) for s, r in zip(scores, rows, strict=True)):
            if -s < least or n == k:
                break
            if seen.get(g, 0) < per_group:
                seen[g], n = seen.get(g, 0) + 1, n + 1
                out.append((name, n, i, -s))
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "spread", "copies"])
def test_nearest_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(1)
    n = 600
    points = {"spread": rng.normal(size=(n, 6)), "clusters": rng.normal(size=(8, 6))[rng.integers(0, 8, n)] + rng.normal(0, 0.05, size=(n, 6)), "copies": rng.integers(-1, 2, size=(n, 6)) + 0.0}[kind]
    points[:200] = points[0]  # a third in one place
    rows = [(i, int(i % 90), [float(x) for x in np.float32(p)]) for i, p in enumerate(points)]
    queries = [(i, r[2]) for i, r in enumerate(rows) if i % 10 == 0]
    got = vectors.nearest(spark.createDataFrame([*rows, (999, 1, None), (998, 1, [1.0])], SCHEMA), spark.createDataFrame(queries, "query bigint, vector array<float>"), 7, 2, 0.1)
    got = sorted(tuple(r) for r in got.collect())
    want = plain(rows, queries, 7, 2, 0.1)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1.5e-6)
    assert np.mean([a[2] == b[2] for a, b in zip(got, want, strict=True)]) > 0.99  # sums in another order may swap ties of the last place


def test_few_lists_are_searched_where_points_cluster(spark):
    rng = np.random.default_rng(2)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    points = centres[rng.integers(0, 16, 2000)] + rng.normal(0, 0.02, size=(2000, 16))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    lists = vectors.centres_of(unit, 40)
    near = (unit @ lists.T).argmax(axis=1)
    radius = np.array([vectors.apart(unit[near == i] @ lists[i]).max(initial=-1) for i in range(len(lists))])
    frame = spark.createDataFrame([(i, [float(x) for x in p], 0.99) for i, p in enumerate(points[:50])], "query bigint, vector array<double>, floor double")
    assert vectors._visits(frame, lists, radius, False).count() < 50 * len(lists) / 4


def test_nothing_to_search(spark):
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, [1.0, 0.0])], SCHEMA)
    asked = spark.createDataFrame([(5, [1.0, 0.0])], "query bigint, vector array<float>")
    assert vectors.nearest(empty, asked).collect() == [] and vectors.nearest(some, asked.limit(0)).collect() == []
    assert [tuple(r) for r in vectors.nearest(some, asked).collect()] == [(5, 1, 1, 1.0)]


def test_a_query_goes_to_packs_and_not_to_every_list(spark):
    """Points that don't cluster: every list may hold better ones, but what is sent is a few rows a query, in small batches."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4000, 16))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    lists = vectors.centres_of(unit, 60)
    near = (unit @ lists.T).argmax(axis=1)
    radius = np.array([vectors.apart(unit[near == i] @ lists[i]).max(initial=-1) for i in range(len(lists))])
    packs = vectors.packs_of(lists, np.bincount(near, minlength=len(lists)), 1000)
    assert len(set(packs.tolist())) <= 8
    frame = spark.createDataFrame([(i, [float(x) for x in p], 0.1) for i, p in enumerate(points[:300])], "query bigint, vector array<double>, floor double").coalesce(1)
    sent = [vectors._visits(frame, lists, radius, first, packs) for first in (True, False)]
    rows = sorted((r["query"], r["list"]) for df in sent for r in df.select("query", "list").collect())
    assert len(rows) == len(set(rows)) <= 300 * 8
