"""Personal data against the plain patterns, with Python's regular expressions over whole texts."""

import hashlib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from studylake.llm import pii

SF = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(re.sub("[ -]", "", t)) <= 19 and luhn(re.sub("[ -]", "", t))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
]


def plain_base(text):
    return sorted((m.start(), i, m.end(), name) for i, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m[0]))


def held(row, text):
    spans = plain_base(text)
    listed = [f"{name}:{s}:{e}" for s, _, e, name in spans]
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x[3] == name for x in spans) for name, _, _ in BASE], text
    assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), text
    got = row.spans.split(",") if row.spans else []
    assert [x for x in got if x.split(":")[0] in pii.BASE] == listed, text
    assert len(row.scores.split(",")) == max(1, len(got))
    return [x for x in got if x.split(":")[0] not in pii.BASE]


def test_op11(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    rows = entry.queries()["op11_pii"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs.index)
    assert sum(bool(r.spans) for r in rows) > 30
    further = [x for r in rows for x in held(r, docs.text[r.doc_id])]
    assert not further  # these documents hold the base kinds alone


def scanned(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return sorted(pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect(), key=lambda r: r.doc_id)


@pytest.mark.parametrize("letters", ["a@._ ", "1. 25", "4- 1", "+1 ()-.", "a@b.1_+ 4-é😀"])
def test_random_texts(spark, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for row, text in zip(scanned(spark, texts), texts, strict=True):
        held(row, text)


def test_checksums(spark):
    good = ["4111111111111111", "79927398713", "0", "6011000990139424"]
    df = spark.createDataFrame([(x,) for x in [*good, "4111111111111112", "79927398710"]], "d string")
    assert [r[0] for r in df.select(pii.luhn(F.col("d"))).collect()] == [True] * 4 + [False] * 2
    good = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    df = spark.createDataFrame([(x,) for x in [*good, "DE88370400440532013000", "GB82WEST12345698765423"]], "d string")
    assert [r[0] for r in df.select(pii.mod_97(F.col("d"))).collect()] == [True] * 3 + [False] * 2


def test_further_kinds_and_words_nearby(spark):
    cases = {
        "pay to DE89 3704 0044 0532 0130 00 BIC XYZ": ["iban:7:34"],
        "é GB82 WEST 1234 5698 7654 32 ABC": ["iban:2:29"],
        "GB82WEST12345698765432, ok": ["iban:0:22"],
        "DE88 3704 0044 0532 0130 00": [],
        "SSN 123-45-6789": ["ssn:4:15"],
        "123-45-6789 alone": [],
        "ssn 000-45-6789, 666-45-6789, 900-45-6789, 123-00-6789, 123-45-0000": [],
        "call (030) 901 820 now": ["local:5:18"],
        "the (030) 901 820 now": [],
        "phone of the order: 030 901 820": [],
        "call +1 (509) 555-6973": [],  # a base span
    }
    for row, (text, further) in zip(scanned(spark, list(cases)), cases.items(), strict=True):
        assert held(row, text) == further, text


def test_words_nearby_move_the_score(spark):
    with_word, without, against = (int(r.scores.split(",")[0]) for r in scanned(spark, ["visa 4111111111111111", "a 4111111111111111", "invoice 4111111111111111"]))
    assert with_word > without > against


def test_odd_rows_keep_their_places(spark, folder):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c"), (3, "x")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.spans, r.n_email) for r in pii.op11_pii(spark, folder(documents=rows)).collect())
    assert got == [(False, 1, "", 0), (False, 2, "", 0), (False, 3, "", 0), (False, 3, "email:0:5", 1), (False, 3, "email:0:5", 1), (True, 0, "email:0:5", 1)]


def test_empty_table(spark, folder):
    assert pii.op11_pii(spark, folder(documents=[])).collect() == []


def test_very_long_texts_of_one_kind(spark):
    n = 200_000
    texts = ["a" * n, "1" * n, "a@b" + ".c" * n, "1-" * n, "1.2.3.4 " * 20_000, "+1" + " " * n, "a." * n + "@", "12 34 56 78 90 1" * 20_000, "DE89 " + "A1 " * n]
    rows = scanned(spark, texts)
    assert [(r.n_email, r.n_ip) for r in rows] == [(0, 0), (0, 0), (1, 0), (0, 0), (0, 20_000), (0, 0), (0, 0), (0, 0), (0, 0)]
    assert rows[4].spans.endswith(f"ip:{8 * 19_999}:{8 * 19_999 + 7}")
