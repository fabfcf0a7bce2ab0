"""Links in a dense region, where the forest has few candidates for each document, against all pairs."""

import random

import numpy as np
import pytest

from studylake.llm import near_dedup


def dense_texts(n=1500, pairs=150, words=163, changes=3):
    """n texts of one template with changes of their own; of some, two share one change, and so have 0.818 of their shingles."""
    draw = random.Random(7)
    places = list(range(4, words - 4, 4))
    out = []
    for i in range(n):
        text = [f"w{k}" for k in range(words)]
        own = draw.sample(places, changes)
        for k in own:
            text[k] = f"own{i}x{k}"
        if i < 2 * pairs and i % 2:
            text = [f"w{k}" for k in range(words)]
            text[before[0]] = out[-1].split()[before[0]]
            for k in draw.sample([k for k in places if k not in before], changes - 1):
                text[k] = f"own{i}x{k}"
        before = own
        out.append(" ".join(text))
    return out


def all_links(texts):
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    place = {s: k for k, s in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(place)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    inter, size = m @ m.T, np.array(list(map(len, sets)))
    ok = 100 * inter >= 80 * (size[:, None] + size[None, :] - inter)
    root = np.arange(len(sets))
    while (root != (low := np.where(ok, root[None, :], len(sets)).min(axis=1))).any():
        root = low
    return root.tolist()


@pytest.mark.parametrize(("rows", "parts"), [(10_000, 3), (20, 8)])
def test_every_link_of_a_dense_region_is_found(spark, rows, parts):
    texts = dense_texts()
    want = all_links(texts)
    assert len(texts) - len(set(want)) >= 150
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.shuffle.partitions": parts}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.clustered(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(got[i] != w for i, w in enumerate(want)) == 0
