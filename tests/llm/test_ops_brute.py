"""The queries against plain versions over whole tables."""

import collections
import hashlib
import re
import zlib
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from studylake.llm import decontaminate, licenses, mixing, tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def run(spark, name):
    return entry.queries()[name](spark, SF).toPandas()


def by_id(df, key="doc_id"):
    return df.sort_values(key).reset_index(drop=True)


def test_op1(spark, docs):
    got = by_id(run(spark, "op1_simhash"))
    texts = [t or "" for t in docs.text]
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.n_chars.tolist() == [len(t) for t in texts]
    edits = []
    for i, t in enumerate(texts):
        k = len(t) // 2
        edits.append(t[: len(t) - k] + texts[i - 1][:k])  # the next by descending id is the one before
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edits]
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    prints = got.fingerprint.tolist()
    assert np.allclose(got.near_edited, [like(a, b) for a, b in zip(prints, got.edited_fingerprint, strict=True)])
    assert np.allclose(got.near_next, [like(a, prints[i - 1]) for i, a in enumerate(prints)])
    seen = {}
    assert all(seen.setdefault(t, f) == f for t, f in zip(texts, prints, strict=True))
    asked = got[got.doc_id % 100 == 0]
    near = [sum((int(a, 16) ^ int(b, 16)).bit_count() <= 3 for b in prints) for a in asked.fingerprint]
    assert asked.n_within.tolist() == near


def test_op2_held_out_accuracy(spark, docs):
    got = by_id(run(spark, "op2_quality"))
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labelled = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = labelled[labelled.held_out]
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85, auc
    assert (held.predicted == held.quality).mean() > 0.85


def test_op3(spark, docs):
    got = by_id(run(spark, "op3_secrets"))
    patterns = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    for t, row in zip(docs.text, got.itertuples(), strict=True):
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(patterns) for m in p.finditer(t or "") if ok(m))
        base = [f"{k}:{s}:{e}" for s, _, e, k in spans]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[3] == k for s in spans) for k, _, _ in patterns]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row.spans.split(","))


def test_op4(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = by_id(run(spark, "op4_warc"), "page_id")
    data = [(h or "").encode() for h in pages.html]
    first = {}
    for i, d in sorted(zip(pages.page_id, data, strict=True)):
        first.setdefault(d, i)
    want = []
    for i, d in sorted(zip(pages.page_id, data, strict=True)):
        again = len(d) >= 100 and first[d] != i
        want.append((i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again else "response", first[d] if again else None))
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, None if pd.isna(r.refers_to) else r.refers_to) for r in got.itertuples()]
    assert rows == want


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))


def test_op5_and_op7(spark, docs):
    ids = [e.ids for e in library().encode_batch([t or "" for t in docs.text], add_special_tokens=False)]
    count = by_id(run(spark, "op7_token_counts"))
    assert count.n_tokens.tolist() == list(map(len, ids))
    assert count.n_bytes.tolist() == [len((t or "").encode()) for t in docs.text]
    assert (count.over_limit == (count.n_tokens > 512)).all()
    got = by_id(run(spark, "op5_token_orc"))
    assert got.n_tokens.tolist() == [len(x) + 1 for x in ids]
    assert got.start.tolist() == np.cumsum([0, *(len(x) + 1 for x in ids)])[:-1].tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array([*x, 2], dtype="<u4").tobytes()) for x in ids]


def plain_targets(sizes):
    """Targets by repeated capping; sizes in code point order of the sources."""
    weight = [i % 3 + 1 for i in range(len(sizes))]
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in full)
        w = sum(weight[i] for i in range(len(sizes)) if i not in full)
        target = [3 * n if i in full else rest * weight[i] / w for i, n in enumerate(sizes)]
        more = {i for i, t in enumerate(target) if t > 3 * sizes[i]}
        if not more:
            return target
        full |= more


def test_op6(spark, docs):
    got = by_id(run(spark, "op6_mix"))
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text]
    assert got["size"].tolist() == size
    source = docs.source.where(docs.source.notna(), None)
    total = collections.Counter()
    for s, n in zip(source, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, plain_targets([total[s] for s in order]), strict=True))
    assert got.source_size.tolist() == [total[s] for s in source]
    assert np.allclose(got.target, [target[s] for s in source])
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    taken = got.groupby(source.fillna("~")).taken.sum()
    for s, t in target.items():
        assert abs(taken[s or "~"] - t) <= max(0.01 * t, 3 * mixing.BLOCK)
    assert by_id(run(spark, "op6_mix")).equals(got)


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_op8(spark, docs):
    got = by_id(run(spark, "op8_licenses"))
    for t, row in zip(docs.text, got.itertuples(), strict=True):
        words = plain_words(t)
        at = lambda p: [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        base = [(i, label) for p, label in licenses.BASE.items() for i in at(p.split())]
        places = [i for i, _ in base]
        assert (row.n_words, row.n_base) == (len(words), len(base))
        assert [None if pd.isna(x) else x for x in (row.first_word, row.last_word)] == ([min(places), max(places)] if places else [None, None])
        assert row.base_labels == ",".join(sorted({x for _, x in base}))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
        assert 0 <= row.score <= 1


def plain_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def plain_components(ids, sets):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    shared = collections.Counter((a, b) for v in where.values() for k, a in enumerate(v) for b in v[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)), key=lambda i: ids[i])
            root[y] = x
    return [ids[find(i)] for i in range(len(ids))]


def test_op9(spark, docs):
    got = by_id(run(spark, "op9_near_dedup"))
    sets = plain_sets(docs.text, 4)
    assert got.n_shingles.tolist() == list(map(len, sets))
    assert got.component_id.tolist() == plain_components(docs.doc_id.tolist(), sets)
    assert (got.kept == (got.doc_id == got.component_id)).all()


def plain_distance(item, text):
    """The least edit distance of item to any part of text, by rows."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    chars = np.array(list(text))
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (chars != c))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_op10(spark, folder):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    items = pd.read_parquet("/root/testdata/sf0.001/benchmark.parquet").head(12)
    short = docs[docs.text.str.len() < 6000]
    edited = []
    for i, t in enumerate(items.text):
        cut = len(t) // 3
        edited.append((10_000 + i, "before it " + t[:cut] + "X" + t[cut + 1 : 2 * cut] + t[2 * cut + 1 :] + " and after it"))
    rows = list(zip(short.doc_id.tolist(), short.text, strict=True)) + edited
    d = folder(documents=rows, benchmark=list(items.itertuples(index=False)))
    got = entry.queries()["op10_decontaminate"](spark, d).toPandas()
    want = {}
    for i, t in rows:
        for item_id, item in items.itertuples(index=False):
            a, b = decontaminate.normalised(item), decontaminate.normalised(t)
            n = plain_distance(a, b) if a else 1e9
            if a and n <= len(a) // decontaminate.BUDGET:
                want[i, item_id] = n
    assert {(r.doc_id, r.item_id): r.distance for r in got.itertuples()} == want
    assert {10_000 + i for i in range(len(items))} <= {i for i, _ in want}


def test_pipeline(spark, docs):
    """Each stage by a plain version of its own input; files by their offsets."""
    import corpus_pipeline as cp

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    steps = []
    for i, (_, stage) in enumerate(cp.STAGES):
        frame = stage(spark, frame, SF)
        frame = spark.createDataFrame(frame.toPandas(), frame.schema)
        steps.append(frame.toPandas())
        if i < len(cp.STAGES) - 1:
            assert frame.columns == list(docs.columns)
    kept, unique, clean, mixed_, files = steps
    labelled = kept.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id", how="inner")
    every = docs.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert (labelled.quality == 1).sum() >= 0.97 * (every.quality == 1).sum()
    assert (labelled.quality == 0).sum() <= 0.15 * (every.quality == 0).sum()
    ids = kept.doc_id.tolist()
    want = {i for i, c in zip(ids, plain_components(ids, plain_sets(kept.text, 5)), strict=True) if i == c}
    assert set(unique.doc_id) == want and unique.doc_id.is_unique
    items = [decontaminate.normalised(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    assert set(clean.doc_id) <= want
    assert not any(i in decontaminate.normalised(t) for t in clean.text for i in items if i)
    times = mixed_.groupby("doc_id").size()
    assert times.max() <= 3 and set(times.index) <= set(clean.doc_id)
    assert sorted(files.doc_id) == sorted(mixed_.doc_id)
    files = files.sort_values("start")
    assert files.start.tolist() == np.cumsum([0, *files.n_tokens])[:-1].tolist()
    assert all(a <= b for a, b in pairwise(files.doc_id))




def test_op2_fit_against_a_plain_optimiser():
    """The weights minimise the pairs' logistic loss with its ridge: plain gradient steps find nothing lower."""
    from studylake.llm import quality

    draw = np.random.default_rng(1)
    a = draw.normal(0.4, 1, (300, 4))
    ridge = np.full(4, 1.0)

    def loss(w):
        return np.log1p(np.exp(-a @ w)).sum() + 0.5 * (ridge * w * w).sum()

    found = quality._newton(a, np.ones(300), ridge)
    w = np.zeros(4)
    for _ in range(4000):
        w -= 0.002 * (-(a / (1 + np.exp(a @ w))[:, None]).sum(axis=0) + ridge * w)
    assert loss(found) <= loss(w) + 1e-9 and np.allclose(found, w, atol=1e-3)


def test_op2_features_against_plain_ones():
    from studylake.llm import quality

    text = "Good words, good lines.\nGood 12!\nGood 12!"
    x = quality.features(text)
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n = len(raw)
    assert x[1] == sum(c.isupper() for c in text) / n and x[2] == sum(c.isdigit() for c in text) / n and x[4] == 2 / n
    assert x[10] == pytest.approx(np.log1p(n)) and x[11] == pytest.approx(np.log1p(len(words)))
    assert x[12] == len(set(words)) / len(words) and x[13] == max(map(words.count, words)) / len(words)
    assert x[16] == len(set(lines)) / len(lines)


def test_quantile_stands_wrong_labels():
    from studylake.llm import quality

    draw = np.random.default_rng(2)
    y = (np.arange(2000) % 5 > 0).astype(int)
    x = draw.normal(0, 1, (2000, 6)) + 3 * y[:, None]
    wrong = np.where(draw.random(2000) < 0.01, 1 - y, y)
    assert min(quality.BradleyTerry.fit(x, wrong).threshold, 0.3) == min(quality.BradleyTerry.fit(x, y).threshold, 0.3) == 0.3


def test_mix_points_are_exact_for_large_slots(spark):
    from pyspark.sql import functions as F

    slots = [1, 3_475_000_000, 2**32 - 1, 2**32, 2**40 + 7, 2**62]
    got = spark.createDataFrame([(s,) for s in slots], "slot bigint").select("slot", mixing.golden_point(F.col("slot")).alias("p")).collect()
    assert {r.slot: r.p for r in got} == {s: s * mixing.GOLDEN % 2**32 for s in slots}
    assert mixing.block_words(10**6) == 64 and mixing.block_words(10**14) == -(-(10**14) // mixing.MOST_BLOCKS)


def test_mix_stage_comes_near_the_targets(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = mixing.mixed(frame).toPandas()
    rows = mixing.mix_stage(spark, frame, SF).toPandas()
    words = rows.text.fillna("").map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).groupby(rows.source.fillna("~")).sum()
    source = frame.toPandas().set_index("doc_id").source.fillna("~")
    target = want.target.groupby(want.doc_id.map(source)).first()
    largest = want["size"].groupby(want.doc_id.map(source)).max()
    for s, t in target.items():
        assert abs(words[s] - t) <= largest[s] + mixing.BLOCK, (s, words[s], t)


def test_matches_begin_and_end_where_they_do(spark, folder):
    item = "which planet is the fourth from the sun in our system"
    inserted = item[:20] + "xy" + item[20:]
    deleted = item[:10] + item[12:]
    items = [(1, item), (2, "yes")]
    docs = [(1, f"abc {inserted} def"), (2, f"{deleted} end"), (3, "the eyes have it"), (4, "he said yes, twice"), (5, f"so {item}")]
    d = folder(documents=docs, benchmark=items)
    got = {(r.doc_id, r.item_id): (r.distance, r.start, r.length) for r in entry.queries()["op10_decontaminate"](spark, d).collect()}
    assert got == {(1, 1): (2, 4, len(inserted)), (2, 1): (2, 0, len(deleted)), (4, 2): (0, 8, 3), (5, 1): (0, 3, len(item))}


def test_archives_are_closed_after_a_bounded_size(spark, folder, tmp_path):
    from studylake.llm import warc

    tails = [bytes([i]) * 30 for i in range(1, 128)]
    pages = [(i, f"http://x/{i}", (b"p%d " % i + t).decode("latin-1") * 3) for i, t in enumerate(tails)]
    d = folder(pages=pages)
    frame = spark.read.parquet(f"{d}/pages.parquet")
    warc.write_archives(frame, str(tmp_path / "w"), archive_bytes=20_000)
    files = list((tmp_path / "w").rglob("part*"))
    assert len(files) > 8
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert got == {i: h.encode() for i, _, h in pages}


def test_a_run_of_large_pages_in_one_task_is_dealt_over_archives(spark, tmp_path):
    from studylake.llm import warc

    rng = np.random.default_rng(1)
    word = lambda n: "".join(chr(c) for c in rng.integers(33, 0x300, n))
    pages = [(i, None, word(60)) for i in range(1000)] + [(1000 + i, None, word(300_000)) for i in range(20)] + [(5000, None, word(900_000)), (5001, None, "")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "w"), archive_bytes=1 << 20)
    sizes = [sum(len(h.encode()) + warc.RECORD_BYTES for h in [p for _, p in held]) for held in grouped(spark, tmp_path)]
    assert len(sizes) >= 12 and sorted(sizes)[-2] <= 1 << 20  # the largest page stands alone
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert got == {i: h.encode() for i, _, h in pages}


def grouped(spark, tmp_path):
    """The pages of each archive."""
    from studylake.llm import warc

    return [[(p["page_id"], p["payload"].decode()) for p in warc.read_pages(f.read_bytes())] for f in (tmp_path / "w").rglob("part*")]


def test_extra_columns_with_names_used_within(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, y int, labelled bigint, known string, body string, x string, score string, ids string, words string"
    rows = [(i, f"some words of document {i} that say little " * (i + 1), "en", "web", 1, 1, 2, "k", "b", "x", "s", "i", "w") for i in range(6)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "document 3")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("op1_simhash", "op2_quality", "op3_secrets", "op5_token_orc", "op6_mix", "op7_token_counts", "op8_licenses", "op9_near_dedup", "op10_decontaminate"):
        assert entry.queries()[name](spark, str(tmp_path)).count() >= 1, name


def test_token_files_have_filters_and_are_read_by_id(spark, tmp_path):
    from pyarrow import orc

    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 9)) for i in range(4000)], "doc_id bigint, text string")
    path = str(tmp_path / "t")
    tokens.write_token_orc(docs.coalesce(1), path, stripe_bytes=1 << 14, stride=1000)
    files = [str(p) for p in (tmp_path / "t").iterdir() if p.name.endswith(".orc")]
    assert sum(orc.ORCFile(f).nrows for f in files) == 4000
    raw = b"".join(open(f, "rb").read() for f in files)
    assert max(orc.ORCFile(f).nstripes for f in files) >= 1 and raw.startswith(b"ORC")
    found = tokens.read_token_orc(spark, path, ids=[5, 3999])
    assert sorted(r.doc_id for r in found.collect()) == [5, 3999]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    one = tokens.read_token_orc(spark, path, between=(10, 12))
    assert sorted(r.doc_id for r in one.collect()) == [10, 11, 12]


def test_large_sets_are_told_apart_by_longer_parities(spark):
    from pyspark.sql import functions as F

    from studylake.llm import near_dedup

    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 1 << 63, 6000, dtype=np.uint64))
    for keep, n in ((0.95, 6000), (0.5, 6000), (0.9, 4000)):
        other = np.unique(np.concatenate([base[: int(keep * n)], draw.integers(0, 1 << 63, n - int(keep * n), dtype=np.uint64)]))
        a, b = (near_dedup.parities(s, near_dedup.long_words(len(s))).tolist() for s in (base, other))
        bits = spark.createDataFrame([(a, b)], "ma array<bigint>, mb array<bigint>").select(near_dedup._differing("ma", "mb")).first()[0]
        differ = len(np.setxor1d(base, other))
        assert bits <= differ and (differ > 3000) <= (bits > 0.111 * (len(base) + len(other)))
