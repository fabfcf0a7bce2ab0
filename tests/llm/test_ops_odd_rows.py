"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import functools
import hashlib
import zlib

import pandas as pd
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from studylake.llm import decontaminate, quality, secrets, simhash, tokens, warc

#: Nulls, empty texts, repeated rows, one id with two texts.
ODD = [
    (1, None, None, None),
    (2, "", "en", "web"),
    (2, "", "en", "web"),
    (3, " \n ", "en", None),
    (4, "One word", None, "web"),
    (4, "another text with one id and some more words to it", None, "books"),
    (None, "a text without an id that has a few words", "en", "web"),
    (5, "long " * 30_000, "en", "hot"),
    (6, "x" * 40_000, "en", "hot"),
    (7, "été Ünïcode \U0001f600 words under the MIT License here", "fr", "hot"),
]
LABELS = [(1, 1, 0), (2, 0, None), (2, 0, None), (3, None, None), (None, 1, 1), (5, 1, 0), (6, 0, 0), (99, 1, 0)]
ITEMS = [(1, None), (2, " "), (3, "another text with one id and some more words to it"), (3, "another text with one id and some more words to it")]
PAGES = [(1, "http://a", None), (2, None, "y" * 200), (3, "http://b c", "y" * 200), (3, "http://b c", "y" * 200), (None, "http://n", "y" * 200), (4, "u", "é" * 60), (5, "u", "z" * 99), (6, "u", "z" * 99)]
OPS = ["op1_simhash", "op2_quality", "op3_secrets", "op5_token_orc", "op6_mix", "op7_token_counts", "op8_licenses", "op9_near_dedup", "op10_decontaminate", "op4_warc"]


@pytest.fixture
def odd(folder):
    return folder(documents=ODD, labels=LABELS, benchmark=ITEMS, pages=PAGES)


@pytest.fixture
def none(folder):
    return folder(documents=[], labels=[], benchmark=[], pages=[])


@pytest.mark.parametrize("name", [*OPS, "pipeline"])
def test_empty_tables(spark, none, name):
    assert entry.queries()[name](spark, none).count() == 0


def test_simhash(spark, odd):
    rows = entry.queries()["op1_simhash"](spark, odd).toPandas()
    assert len(rows) == len(ODD)  # the repeated row gives two
    zero = "0" * 32
    assert rows[rows.n_chars == 0].fingerprint.tolist() == [zero, zero, zero]
    assert rows.doc_id.isna().sum() == 1


def test_quality(spark, odd):
    rows = entry.queries()["op2_quality"](spark, odd).toPandas()
    assert len(rows) == len(ODD) and rows.score.notna().all()
    unlabelled = quality.fit(spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/labels.parquet").limit(0))
    assert unlabelled.score(quality.features("a")[None])[0] == pytest.approx(0.5)


def test_secrets(spark, odd):
    assert entry.queries()["op3_secrets"](spark, odd).count() == len(ODD)
    spans = lambda t: secrets.joined(f := secrets.base_spans(t, secrets.token_runs(t, 20))) + "|" + secrets.joined(secrets.random_spans(t, secrets.token_runs(t, 20), f))
    assert spans("é Password = 'abc123'") == "assign:2:20|"
    assert spans("AKIA" + "A1" * 8) == "access:0:20|"
    assert spans("the deadbeef" + "0123456789abcdef" * 2) == "hex:4:44|"
    assert spans("key q8Zr3TfW0xLm7VbN2yKc5HsD9jPe1GaU end").endswith("random:4:36")
    assert spans("internationalisation_of_characteristically_long_words") == "|"


def test_warc(spark, odd):
    rows = entry.queries()["op4_warc"](spark, odd).toPandas()
    got = sorted((r.page_id if r.page_id == r.page_id else -1, r.payload_bytes, r.record_type, r.refers_to if r.refers_to == r.refers_to else None) for r in rows.itertuples())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{odd}/pages.parquet/*.parquet'")
    assert got == sorted((-1 if r[0] is None else r[0], r[1], r[3], r[4]) for r in con.execute(warc.ORACLE).fetchall())
    assert got == [(-1, 200, "revisit", 2), (1, 0, "response", None), (2, 200, "response", None), (3, 200, "revisit", 2), (3, 200, "revisit", 2), (4, 120, "response", None), (5, 99, "response", None), (6, 99, "response", None)]


def test_warc_segments_and_damage():
    payload = b"0123456789" * 100
    digest = hashlib.sha256(payload).hexdigest()
    archive = b"".join(warc.members("7", "http://x", payload, digest, None, segment=300))
    (page,) = warc.read_pages(archive)
    assert (page["page_id"], page["payload"], page["payload_digest"]) == (7, payload, digest)
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_members(archive[:-20]))
    wrong = b"".join(warc.members("7", "http://x", payload, "0" * 64, None))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_pages(wrong))


def test_tokens(spark, odd):
    count = entry.queries()["op7_token_counts"](spark, odd).toPandas()
    assert len(count) == len(ODD) and count[count.n_bytes == 0].n_tokens.tolist() == [0, 0, 0]
    files = entry.queries()["op5_token_orc"](spark, odd).toPandas().sort_values("start")
    assert len(files) == len(ODD)
    assert files.start.tolist() == [0, *files.n_tokens.cumsum().tolist()[:-1]]
    assert pd.isna(files.doc_id.iloc[-1])
    empty = zlib.crc32(b"\x02\0\0\0")
    assert (files[files.n_tokens == 1].ids_crc32 == empty).all()


@pytest.mark.parametrize("text", ["word " * 900, "x" * 3000, "ab  \n\n" * 700, "été 123 <|endoftext|> it's " * 150, " " * 4000, "a" * 1500 + " b" * 900])
def test_spliced_counts(text):
    e = tokens.encoder(tokens.vocabulary_path(tokens.TOKENIZER))
    whole = len(e.tokenizer.encode(text, add_special_tokens=False).ids)
    assert e.count(text) == whole
    for chunk, overlap in ((200, 16), (333, 40), (1000, 8)):
        assert e.spliced(text, chunk, overlap) == whole


def test_mix(spark, odd):
    rows = entry.queries()["op6_mix"](spark, odd).toPandas()
    assert len(rows) == len(ODD)
    assert (rows.taken <= 3 * rows["size"]).all()
    assert rows.source_size.groupby(rows["size"] == 0).count().loc[True] == 4


def test_licenses(spark, odd):
    rows = entry.queries()["op8_licenses"](spark, odd).toPandas().set_index("doc_id")
    assert len(rows) == len(ODD)
    assert rows.loc[7, ["n_base", "first_word", "last_word", "base_labels"]].tolist() == [1, 4, 4, "mit"]
    assert rows.loc[1, "labels"] == "" and rows.loc[5, "n_words"] == 30_000


def test_near_dedup(spark, odd):
    rows = entry.queries()["op9_near_dedup"](spark, odd).toPandas()
    assert len(rows) == len(ODD)
    assert rows[rows.n_shingles == 0].kept.all()
    assert (rows.component_id.fillna(-1) == rows.doc_id.fillna(-1)).all()


def test_near_dedup_finds_copies_of_each_kind(spark, folder):
    words = [f"w{i}" for i in range(200)]
    near = [w if i != 100 else "changed" for i, w in enumerate(words)]
    far = [w if i % 10 else f"other{i}" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(words).upper().replace(" ", "\n"), " ".join(near), " ".join(far), "a b c", "A  B C", "a b d"]
    d = folder(documents=[(i + 10, t) for i, t in enumerate(texts)])
    rows = entry.queries()["op9_near_dedup"](spark, d).toPandas().sort_values("doc_id")
    assert rows.component_id.tolist() == [10, 10, 10, 13, 14, 14, 16]


def test_decontamination(spark, odd):
    rows = entry.queries()["op10_decontaminate"](spark, odd).toPandas()
    assert [(r.doc_id, r.item_id, r.distance) for r in rows.itertuples()] == [(4, 3, 0)]


def test_decontamination_in_blocks(spark, folder):
    items = [(i, f"benchmark question number {i} asks which of these words are right") for i in range(40)]
    docs = [(i, f"intro {t} outro") for i, t in items] + [(99, "a clean document about questions and words")]
    d = folder(documents=docs, benchmark=items)
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    exact = decontaminate.matches(read("documents"), read("benchmark"), block_bytes=200).filter("distance = 0")
    assert sorted((r.doc_id, r.item_id) for r in exact.collect()) == [(i, i) for i, _ in items]


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, i):
    frame = spark.read.parquet(f"{odd}/documents.parquet")
    out = corpus_pipeline.STAGES[i][1](spark, frame, odd)
    if i < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == frame.columns
    assert out.count() >= 0


def test_within_radius_is_whole(spark):
    base = 0x0123456789ABCDEF
    rows = [(base ^ (1 << a) ^ (1 << b), 5) for a in range(0, 60, 7) for b in range(0, 60, 11)] + [(base, 5)] * 3
    index = spark.createDataFrame(rows, "f0 bigint, f1 bigint")
    got = simhash.within_radius(index, index.filter(f"f0 = {base}"), 2).collect()
    near = functools.reduce(lambda n, r: n + ((r[0] ^ base).bit_count() <= 2), rows, 0)
    assert [r.n_within for r in got] == [near]
