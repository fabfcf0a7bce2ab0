"""Licence labels and scores against a plain search of every beginning of every template."""

import collections

import pandas as pd
import pytest

from studylake.llm import licenses

SF = "/root/testdata/sf0.01"


def plain_scan(words, df):
    """(labels, score) of the further templates: each is laid at every beginning where a posted word agrees."""
    posts = collections.defaultdict(set)
    for w, places in licenses.postings(df).items():
        for t, p in places:
            posts[t].add((p, w))
    labels, best = set(), 0.0
    for t, (label, template, spans) in enumerate(licenses.templates()):
        covered, named = set(), False
        for at in range(-len(template), len(words)):
            fits = lambda p, w, at=at: 0 <= at + p < len(words) and words[at + p] == w
            if not any(fits(p, w) for p, w in posts[t]):
                continue
            covered |= {p for p, w in enumerate(template) if fits(p, w)}
            named |= any(all(fits(a + i, template[a + i]) for i in range(n)) for a, n in spans)
        share = len(covered) / len(template)
        best = max(best, share if named else share / 2)
        if named:
            labels.add(label)
    return labels, best


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    words = [licenses.plain_words(t or "") for t in texts]
    vocabulary = set(licenses.vocabulary())
    df = collections.Counter(w for ws in words for w in set(ws) & vocabulary)
    for i, ws in enumerate(words):
        labels, best = plain_scan(ws, df)
        base = set(got[i]["base_labels"].split(",")) - {""}
        assert got[i]["labels"] == ",".join(sorted(labels | base))
        assert got[i]["score"] == pytest.approx(1.0 if base else best)
    return got


def test_on_documents(spark):
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    short = [t for t in texts if t and len(t) < 3000 and "licen" in t.lower()][:60] + [t for t in texts if t and len(t) < 600][:40]
    check(spark, [*short, None, ""])


def test_whole_changed_and_cut_texts(spark):
    whole = [text for _, text, _ in licenses.TEXTS]
    mit = licenses.plain_words(licenses.TEXTS[0][1])
    changed = " ".join("changed" if i % 9 == 8 and i > 20 else w for i, w in enumerate(mit))
    inserted = " ".join([*mit[:40], "and", "more", *mit[40:]])
    cut = " ".join(mit[:25])
    got = check(spark, [*whole, changed, inserted, cut, "the software is free of charge for any person", "K under the MIT licence"])
    n = len(whole)
    for i, (label, _, _) in enumerate(licenses.TEXTS):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert [got[n + i]["labels"] for i in range(3)] == ["mit", "mit", "mit"]
    assert 0.8 < got[n]["score"] < 0.95 and got[n + 1]["score"] == 1.0 and got[n + 2]["score"] < 0.2
    assert got[n + 3]["labels"] == "" and got[n + 3]["score"] < 0.5
    assert "cc-by" not in got[n - 2]["labels"].split(",")


def test_only_ascii_letters_are_lowered(spark):
    got = check(spark, ["UNDER the MIT license", "under the KIT license ÉTÉ"])
    assert got[0]["base_labels"] == "mit" and got[1]["base_labels"] == ""


def test_a_long_text_of_one_posted_word(spark):
    """The votes of a word repeated all over are told apart in time that grows with the text."""
    import time

    from studylake.llm import licenses

    word = licenses.templates()[0][1][5]
    texts = [(n, f"{word} " * n) for n in (4000, 32_000)]
    took = []
    for n, text in texts:
        began = time.time()
        row = licenses.scan(spark.createDataFrame([(n, text)], "doc_id bigint, text string")).collect()[0]
        took.append(time.time() - began)
        assert row.n_words == n and row.n_base == 0
    assert took[1] < 8 * took[0] + 20
