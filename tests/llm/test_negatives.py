"""Hard negatives against a full search with plain integers, and the bounds that filter them."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from studylake.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, block int, score double"


def plain(rows):
    """rows: (vec_id, vector, label), each once."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, va, la in kept:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, label) for i, v, label in kept if (i, v, label) != (a, va, la)]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            s = -s
            window = [x for x in sorted(scored) if x[2] != la and 30 * s <= -100 * x[0] <= 90 * s]
            out += [(a, p, rank, i, s, -n) for rank, (n, i, _) in enumerate(window[:10], 1)]
    return sorted(out)


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, 0.5) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_op13(spark, size):
    table = pd.read_parquet(f"/root/testdata/{size}/embeddings.parquet")
    given = [(int(i), [float(x) for x in v], int(label)) for i, v, label in zip(table.vec_id, table.embedding, table.label, strict=True)]
    assert rows_of(entry.queries()["op13_hard_negatives"](spark, f"/root/testdata/{size}")) == plain(given)


@pytest.mark.parametrize("block_rows", [40, 1000])
def test_blocks_and_ties_and_copies(spark, tmp_path, monkeypatch, block_rows):
    """Any number of blocks, a third of the rows alike, few different scores."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 4, size=5) / 4] if i % 3 else [0.5, 0.25, 0.0, 0.5, 1.0], int(rng.integers(0, 3))) for i in range(500)]
    got = rows_of(negatives.op13_hard_negatives(spark, written(spark, tmp_path, rows + rows[:150])))
    assert got == plain(rows) and len(got) > 100


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 0), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, None, 2), (4, [0.5, 0.25], None), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (8, [None, 1.0], 2), (None, [0.5, 0.5], 2), (9, [0.5], 2), (10, [], 3), (100, [-1.0, -1.0], 7), (200, [0.0, 0.0], 9), (201, [0.0, 0.0], 9)]
    got = rows_of(negatives.op13_hard_negatives(spark, written(spark, tmp_path, rows)))
    assert got == plain(rows) and {r[3] for r in got if r[0] == 0} == {2, 9}


def test_empty_and_lone(spark, tmp_path):
    assert rows_of(negatives.op13_hard_negatives(spark, written(spark, tmp_path / "a", []))) == []
    assert rows_of(negatives.op13_hard_negatives(spark, written(spark, tmp_path / "b", [(0, [1.0], 1)]))) == []


def test_bounds_hold_every_score_and_filter():
    rng = np.random.default_rng(4)
    rows = rng.normal(0, 30, size=(3000, 9)).astype(int).astype(np.int32)
    books = negatives.fitted(rows[:1000], centres=64)
    codes, rest = negatives.quantised(rows, books)
    block = negatives.Block(pa.table({"vec_id": np.arange(3000), "label": np.zeros(3000, int), "vec": [x.astype("<i4").tobytes() for x in rows], "codes": [x.tobytes() for x in codes], "rest": rest}), 9)
    low, high = block.bounds(rows[:40], books)
    true = rows[:40].astype(np.int64) @ rows.T.astype(np.int64)
    assert (low <= true).all() and (true <= high).all()
    assert np.mean([(h >= negatives.kth(x, 10)).mean() for x, h in zip(low, high, strict=True)]) < 0.2


def test_great_components_count_as_the_greatest(spark):
    rows = spark.createDataFrame([(0, [1e30, -1e30], 1)], "vec_id bigint, embedding array<float>, label int")
    assert negatives.integer_rows(rows).select(F.col("v")).first()["v"] == [negatives.MOST, -negatives.MOST]


def test_the_sql_is_the_plain_search():
    import duckdb

    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    table = con.execute("select vec_id, embedding, label from embeddings").fetchall()
    assert sorted(con.execute(negatives.ORACLE).fetchall()) == plain([(i, list(v), label) for i, v, label in table])
