"""What large tables would make a plan do: read its rows again, broadcast texts, shuffle lines, hold them by the thousands."""

import datetime
import re

from pyspark.sql import functions as F

from studylake.llm import near_dedup
from studylake.operators import drafts, guides, passages, quotes, segments, study, tasks
from studylake.plans import registry


def counted(spark, rows, schema):
    """The rows as a frame, and a count of how many were read, over all jobs."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(through, schema), seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fit_reads_its_samples_once(spark):
    samples, seen = counted(spark, [(1.0 + i % 7, 0.5 + i % 5, i % 3 > 0) for i in range(400)], "stability double, elapsed double, remembered boolean")
    assert study.fit(samples).first()["n"] == 400 and seen.value == 400


def test_drafts_read_their_items_once(spark):
    text = "Heat is energy in transit between bodies. Entropy measures the disorder of a closed system."
    items = [(i, text, "t", "What is heat in a body?", ["energy in transit", "energy, transit and bodies", "qqq zzz"][i % 3], "energy in transit between", ["", "why"][i % 2], "physics", None) for i in range(12)]
    rows, seen = counted(spark, items, "card bigint, passage string, subject string, q string, a string, why string, format string, topic string, wrong array<string>")
    assert drafts.drafted(rows).select("card").distinct().count() == 12 and seen.value == 12


NOTES = [(1, "# A\n\none two\n```\n# no\n\nend\n```\n## B\nthree\n---\n- four"), (2, None), (3, "plain")]


def test_cutting_shuffles_no_lines(spark):
    notes = spark.createDataFrame(NOTES, "note int, text string")
    for cut in (segments.lines(notes), segments.blocks(notes), segments.sections(notes), segments.block_texts(notes)):
        assert "Exchange" not in plan(cut)
    lines = [(r["at"], r["kind"], r["level"]) for r in segments.lines(notes).filter("note = 1").orderBy("at").collect()]
    assert lines == [(0, "heading", 1), (1, "blank", None), (2, "para", None), *((i, "code", None) for i in range(3, 8)), (8, "heading", 2), (9, "para", None), (10, "rule", None), (11, "list", None)]


def test_segmenting_reads_notes_once(spark):
    notes, seen = counted(spark, NOTES, "note int, text string")
    assert segments.segmented(notes).select("note").distinct().count() == 2 and seen.value == 3


def test_lost_lines_broadcast_no_texts(spark):
    notes = spark.createDataFrame([(1, "a b\nc\nc\nd"), (2, "x"), (None, "y")], "note int, text string")
    lost = segments.lost_lines(notes, spark.createDataFrame([(1, "a b", "d"), (1, None, "e"), (None, None, "y")], "note int, title string, body string"))
    assert "Broadcast" not in plan(lost)
    assert sorted((r["note"] or 0, r["line"]) for r in lost.collect()) == [(0, "y"), (1, "c"), (1, "c"), (2, "x")]


def test_terms_meet_their_note_and_not_every_run_of_words(spark):
    said = spark.createDataFrame([(1, 0, "The Cell wall, cell-wall and cell wall"), (1, 1, "a cell  wall"), (1, 2, "walls of cell"), (2, 0, "cell wall")], "note int, place int, text string")
    terms = spark.createDataFrame([(1, "cell wall"), (1, "cell"), (1, "cell-wall"), (1, "c++"), (2, "wall")], "note int, key string")
    found = guides.spread(terms, said)
    assert {tuple(r) for r in found.collect()} == {(1, "cell wall", 1), (1, "cell", 3), (1, "cell-wall", 1), (2, "wall", 1)}
    assert not re.search(r"Join \[note#\d+, key#", plan(found))


def test_long_texts_come_to_python_in_small_batches(spark):
    notes = spark.createDataFrame([(1, "t", "Some words of a sentence. " * 200)], "note int, title string, body string")
    assert "ArrowEvalPython" not in plan(passages.passages(notes)) and passages.passages(notes).count() > 4


def test_rows_of_a_small_file_are_dealt_to_all_tasks(spark):
    for name in ("option_orders", "capture_rules", "text_sections"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_ranks_of_shingles_count_all_documents(spark):
    docs = spark.range(45_000).select(F.concat(F.lit("a b c d x"), F.col("id")).alias("text"))
    bins, ranks = near_dedup.frequency_ranks(docs.unionByName(docs.select(F.concat(F.lit("a b c d "), F.col("text")).alias("text"))), "text", 4)
    known = int(near_dedup.shingle_set("a b c d")[0]) % near_dedup.BINS
    assert dict(zip(bins.tolist(), ranks.tolist(), strict=True))[known] == 17  # 90,000 lie between 2**16 and 2**17
    none = near_dedup.bin_counts(docs.limit(0).unionByName(spark.createDataFrame([(None,)], "text string")), "text", 4)
    assert none.count() == 0


def test_shingle_sets_are_made_of_wanted_documents_alone(spark, monkeypatch):
    plans = []
    written = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: plans.append((name, plan(df))) or written(df, name))
    docs = spark.createDataFrame([(i, f"a b c d {i}") for i in range(20)], "doc_id bigint, text string")
    sigs = near_dedup.described(docs, "doc_id", "text", 4, 80)
    nodes = written(sigs.filter("key < 3").select(F.col("key").alias("node"), F.col("key").alias("rep"), "name"), "nodes")
    assert near_dedup.sets_of(docs, nodes, "doc_id", "text", 4).count() == 3
    assert [p.count("ArrowEvalPython") for name, p in plans if name == "sets"] == [1]


def test_quotations_read_their_passages_once(spark):
    passages, seen = counted(spark, [(i, f"the energy in transit {i} between bodies") for i in range(20)], "place int, text string")
    probes = spark.createDataFrame([(1, "transit 7 between")], "probe int, text string")
    assert [tuple(r) for r in quotes.containing(probes, passages).collect()] == [(1, 7)] and seen.value == 20


def test_splitting_reads_captures_once(spark):
    rows = [(1, "- call Ann\n- email Bob"), (2, "email Ann, call Bob and then visit Cy"), (3, "read"), (4, None)]
    captures, seen = counted(spark, [(i, t, datetime.date(2026, 8, 20)) for i, t in rows], "capture int, text string, today date")
    assert sorted((r["capture"], r["text"]) for r in tasks.split(captures).collect())[:2] == [(1, "call Ann"), (1, "email Bob")] and seen.value == 4


def rows_generated(node):
    """How many rows the explodes of a plan that has run made."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_generated(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_generated(node.plan())
    own = node.metrics().apply("numOutputRows").value() if kind == "GenerateExec" else 0
    return own + sum(rows_generated(node.children().apply(i)) for i in range(node.children().size()))


def test_runs_of_words_are_made_where_a_title_begins_alone(spark, monkeypatch):
    plans = []
    keep = quotes.kept
    monkeypatch.setattr(quotes, "kept", lambda df: plans.append(plan(df)) or keep(df))
    said = [(i, " ".join(f"heat{i} of w{j}" for j in range(100)) + [" the heat of transit", ""][i > 0]) for i in range(20)]
    notes, _ = counted(spark, said, "note bigint, text string")
    titles = spark.createDataFrame([(100, "Heat of transit"), (101, "Transit"), (102, "one two three four five"), (103, "heat of")], "note bigint, title string")
    found = quotes.mentions(notes, titles)
    assert [tuple(r) for r in found.collect()] == [(0, 100)]
    assert rows_generated(found._jdf.queryExecution().executedPlan()) < 20  # of 6,000 words, in runs of four sizes
    assert [p.count("regexp_extract_all") for p in plans if "Generate" in p] == [1]  # each text is read as words once


def test_guides_read_notes_and_passages_once(spark):
    notes, seen = counted(spark, [(i, "## Heat\n**Heat** flows\nheat is called energy.") for i in range(5)], "note bigint, text string")
    passages, read = counted(spark, [(i, p, x) for i in range(5) for p, x in enumerate(("**Heat** flows", "heat is called energy."))], "note bigint, place int, text string")
    got = {(r["note"], r["place"]): (r["heading"], r["weight"], r["terms"]) for r in guides.build(notes, passages).collect()}
    assert got == {(i, p): ("Heat", *x) for i in range(5) for p, x in enumerate([(3.5, ["Heat"]), (4.0, ["energy"])])}
    assert (seen.value, read.value) == (5, 10)


def test_guides_shuffle_each_document_once(spark):
    for name in ("note_guides", "key_terms"):
        rows = registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert [plan(rows).count(x) for x in ("FileScan", "Exchange", "Join", "Window")] == [1, 1, 0, 0]


def test_headings_are_carried_once_a_note(spark):
    """Not once a passage, as where the optimizer puts what makes them into a function of the passages."""
    rows = registry.queries()["note_guides"](spark, "/root/testdata/sf0.001")
    made = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "array_repeat" in line]
    assert len(made) == 1 and made[0].index("zip_with") >= 0
    assert "array_repeat" not in made[0][made[0].index("zip_with") :].split("lambdafunction(struct(place")[-1]
