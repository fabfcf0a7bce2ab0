"""Facts, verdicts and mended cards: by cases, and by plain search over the documents."""

import re

import pytest
from pyspark.sql import functions as F

from studylake.operators import repair
from studylake.plans import repairs

SMALL = "/root/testdata/sf0.001"
FACTS = {
    "legislative, executive, and judicial": ["legislative", "executive", "judicial"],
    "increases pressure and lowers volume": ["increases pressure", "lowers volume"],
    "September 4, 2026": ["September 4, 2026"],
    "salt and pepper": ["salt and pepper"],
    "cost and benefit of the whole enterprise": ["cost and benefit of the whole enterprise"],
    "the gap between demand and supply over time": ["the gap between demand and supply over time"],
    "1,000 and 2,000 units": ["1,000 and 2,000 units"],
    "- one\n- two;\n3) three.": ["one", "two", "three"],
    "It rises at first. Then it falls again.": ["It rises at first.", "Then it falls again"],
    "a; bb; cc": ["bb", "cc"],
    "heat": ["heat"],
    " . ": [],
}


def test_facts(spark):
    rows = spark.createDataFrame(list(FACTS.items()), "answer string, want array<string>")
    for r in rows.select("answer", "want", repair.facts(F.col("answer")).alias("got")).collect():
        assert r["got"] == r["want"], r["answer"]
    assert spark.range(1).select(repair.facts(F.lit(None).cast("string"))).first()[0] == []


def test_rules_in_order(spark):
    word = lambda n: " ".join(["word"] * n)
    cases = [("Why?", word(31), "length"), ("List the causes", "heat", "list-question"), ("What?", "aa, bb, cc", "enumeration"), ("What?", "aa; bb", "set"), ("What?", word(16), "length"), ("What?", word(15), ""), (None, None, "")]
    got = repair.assessed(spark.createDataFrame([(i, f, b) for i, (f, b, _) in enumerate(cases)], "card int, front string, back string")).orderBy("card").collect()
    assert [r["rule"] for r in got] == [w for _, _, w in cases]


@pytest.fixture(scope="module")
def passage():
    return "The three branches of government are legislative, executive, and judicial. Opportunity cost is the value of the next best alternative you gave up when you made a choice."


def test_a_list_becomes_a_card_for_each_item(spark, passage):
    cards = [(1, "legislative, executive, and judicial", passage.split(". ")[0] + ".", ""), (2, "alpha, beta, gamma", "nothing relevant here at all", None), (3, "Judicial, EXECUTIVE", None, passage), (4, None, None, None)]
    got = repair.split_to_cloze(spark.createDataFrame(cards, "card int, back string, quote string, passage string")).orderBy("card", "n").collect()
    assert [(r["card"], r["back"]) for r in got] == [(1, "legislative"), (1, "executive"), (1, "judicial")]
    assert all(re.findall(r"\{\{(.*?)\}\}", r["front"]) == [r["back"]] and r["source"] in passage and r["front"].replace("{{", "").replace("}}", "") == r["source"] for r in got)


def test_long_lists_are_cut_around_the_blank(spark):
    items = [f"item{i} of some kind" for i in range(9)]
    source = "The parts of it are these, " + ", ".join(items) + "."
    front = source.replace("item4", "{{item4}}")
    got = spark.createDataFrame([(front,), ("a {{b}} c",), (source.replace("item8", "{{item8}}"),)], "f string").select(repair.trimmed_context(F.col("f"))).collect()
    assert [r[0] for r in got] == ["The parts of it are these, … item3 of some kind, {{item4}} of some kind, item5 of some kind, …", "a {{b}} c", "The parts of it are these, … item7 of some kind, {{item8}} of some kind."]


def test_definitions_become_blanks_on_the_term(spark, passage):
    cards = [(1, "What is opportunity cost?", "", passage), (2, "Why does it happen?", "", passage), (3, "Define the term C++ (x)", "C++ (x) means a language with many features.", ""), (4, "what does the word entropy mean", "", "entropy is a measure of many a disorder"), (5, None, None, None)]
    got = {r["card"]: r for r in repair.to_cloze(spark.createDataFrame(cards, "card int, front string, quote string, passage string")).collect()}
    assert set(got) == {1, 3} and got[1]["back"] == "Opportunity cost" and got[1]["front"].startswith("{{Opportunity cost}} is the value")
    assert got[3]["front"] == "{{C++ (x)}} means a language with many features."


def test_repairs_of_documents(spark):
    """Every blank is what a plain search over the sentences of the whole text finds."""
    cards = {r["card"]: r for r in repair.assessed(repairs.document_cards(spark, SMALL)).collect()}
    want = {}
    for c in cards.values():
        said = [s.strip() for t in (c["quote"], c["passage"]) for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", t)) if s.strip()]
        found = []
        for item in dict.fromkeys(c["facts"]):
            holding = sorted((s for s in said if item.lower() in s.lower()), key=len)
            if len(item.split()) <= 8 and holding and "{{" not in holding[0] and len(holding[0]) - len(item) >= 24 and item.lower() not in {f[0].lower() for f in found}:
                found.append((item, holding[0]))
        if len(found) > 1:
            want[c["card"]] = [(a.lower(), s) for a, s in found[:4]]
    got = {}
    for r in repair.split_to_cloze(repairs.document_cards(spark, SMALL)).orderBy("card", "n").collect():
        got.setdefault(r["card"], []).append((r["back"].lower(), r["source"]))
        assert "{{" + r["back"] + "}}" in r["front"]
    assert got == want and len(want) > 20
