"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import pandas as pd

import __spark_entry__ as entry
from studylake.llm import runs

SF = "/root/testdata/sf0.01"


def plain_runs(words):
    """For each period the longest stretches of words that equal the word one period before."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        x = q
        while x < n:
            y = x
            while y < n and words[y] == words[y - q]:
                y += 1
            if y > x and y - x + q >= max(6, 4 * q):
                found.setdefault((x - q, y), q)
            x = y + 1
    return sorted(((b, e, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_record(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for b, e, q in found for i in range(b + q, e)}
    best = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    numbers = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{b},{e - b},{q}\n" for b, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *numbers, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def test_op12(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    got = {r.doc_id: tuple(r) for r in entry.queries()["op12_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and sum(r[1] for r in got.values()) > 50
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        if t is None or len(t) < 20_000:  # the plain search takes the square of a text
            assert got[i] == plain_record(i, t), i


def test_long_documents_of_the_table(spark):
    """The longest documents too, but with periods up to 60 and the document's own edit alone."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        if len(t or "") >= 20_000:
            words = runs.made_periodic(runs.WORD.findall(t), i)
            found = runs.runs(words)
            assert all(words[b + q : e] == words[b : e - q] and (not b or words[b - 1] != words[b + q - 1]) and (e == len(words) or words[e] != words[e - q]) for b, e, q in found)
            for q in range(1, 61):
                same = "".join("1" if a == b else "0" for a, b in zip(words, words[q:], strict=False))
                for m in re.finditer("1+", same):
                    if m.end() - m.start() + q >= max(6, 4 * q):
                        assert any(b == m.start() and e == m.end() + q and p <= q for b, e, p in found)


def test_random_sequences_of_few_words():
    rng = random.Random(5)
    for _ in range(3000):
        words = [rng.choice(rng.choice(("a", "ab", "abc"))) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            if words:
                i, p = rng.randrange(len(words)), rng.randint(1, 8)
                words[i : i + p] = words[i : i + p] * rng.randint(1, 6)
        assert runs.stretch_runs(words) == runs.runs(words) == plain_runs(words)


def test_factors_are_the_longest_earlier_pieces():
    rng = random.Random(6)
    for _ in range(300):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        at = 0
        for b, e, source in runs.factors(s):
            assert b == at
            earlier = [i for i in range(b) if s[i : i + e - b] == s[b:e]]
            assert (source == -1 and not earlier and e == b + 1) or (source in earlier)
            if source >= 0 and e < len(s):
                assert not any(s[i : i + e - b + 1] == s[b : e + 1] for i in range(b))
            at = e
        assert at == len(s)


def test_a_long_text_of_one_word_and_of_one_repeated_line():
    n = 60_000
    assert runs.runs(["a"] * n) == [(0, n, 1)]
    line = [str(i) for i in range(n // 10)]
    assert runs.runs(line * 10) == [(0, n, n // 10)]
    assert runs.collapsed(line * 10, runs.runs(line * 10)) == line
    assert runs.runs([str(i % 5000) for i in range(5000 * 3)]) == []


def test_odd_rows(spark, folder):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a"), (4, "b " * 7), (4, "b " * 7), (5, "é" + " " + "x " * 5)]
    got = [tuple(r) for r in runs.op12_runs(spark, folder(documents=rows)).collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(r[:6] for r in got if r[0] in (1, 2, 3)) == [(i, 0, None, None, None, None) for i in (1, 2, 3)]
    assert all(r[6:] == (empty, empty) for r in got if r[0] in (1, 2, 3))
    assert [r for r in got if r[0] is None] == [(None, 1, 0, 6, 1, 6000, hashlib.sha256(b"0,6,1\n").hexdigest(), hashlib.sha256(b"a").hexdigest())]
    assert [r for r in got if r[0] == 4] == [plain_record(4, "b " * 7)] * 2
    assert [r for r in got if r[0] == 5] == [plain_record(5, "é " + "x " * 5)]


def test_empty_table(spark, folder):
    assert runs.op12_runs(spark, folder(documents=[])).collect() == []
