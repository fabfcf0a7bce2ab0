"""Captures and the tasks that they hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from studylake.operators import tasks

DAY = dt.date(2026, 8, 20)  # a Thursday


@pytest.fixture(scope="module")
def split(spark):
    cases = {
        "clauses": "finish the marketing case by Tuesday, study for the finance midterm Friday, and call the bank about the account",
        "bullets": "- draft the cover letter\n- email Professor Ruiz about the extension\n- book a study room for Thursday",
        "header": "Due Friday:\nsubmit the accounting problem set\nfinish the group slides\nrehearse the pitch",
        "inline": "Due Friday: submit the problem set; finish the slides by Monday",
        "no header": "Note: see above; call them",
        "semicolons": "study for finance; write the marketing memo; then pack for the trip",
        "shopping": "buy eggs, milk and bread",
        "chapters": "read chapters 4 and 5",
        "one call": "call the bank and ask about the wire fees",
        "estimate": "learn Rust generics by next Friday, ~4h, start with the Book ch.10",
        "prose": "This is a long paragraph about inventory accounting that happens to contain a comma, and it continues on about perpetual systems without asking anyone to do anything at all.",
        "continued": "- call the bank\n  about the fee\n[ ] pay rent\n1) call the bank\n   about the fee!",
        "lines": "call the bank\nthe long story\npay the rent",
        "wrapped": "the long story of a bank\nthat nobody\ncall the rent",
        "one left": "- call\n- pay the rent",
        "verbs": "email Ann, call Bob, pay Cy",
        "no verb": "email Ann, Bob and Cy, call Di",
        "dated": "dinner tomorrow; call mum",
        "empty": " \n ",
        "none": None,
    }
    rows = spark.createDataFrame([(k, v, DAY) for k, v in cases.items()], "capture string, text string, today date")
    found = {}
    for r in tasks.split(rows).orderBy("capture", "ordinal").collect():
        found.setdefault(r["capture"], []).append((r["way"], r["text"], r["inherits"]))
        assert r["ordinal"] == len(found[r["capture"]]) and r["title"]
    return found, cases


def test_tasks_are_found(split):
    found, _ = split
    text = lambda k: [t for _, t, _ in found[k]]
    assert text("clauses") == ["finish the marketing case by Tuesday", "study for the finance midterm Friday", "call the bank about the account"]
    assert found["bullets"][0][0] == "lines" and len(found["bullets"]) == 3 and not any(t.startswith("-") for t in text("bullets"))
    assert found["header"] == [("lines", t, "Friday") for t in ("submit the accounting problem set", "finish the group slides", "rehearse the pitch")]
    assert found["inline"] == [("clauses", "submit the problem set", "Friday"), ("clauses", "finish the slides by Monday", "")]
    assert text("semicolons") == ["study for finance", "write the marketing memo", "pack for the trip"]
    assert text("continued") == ["call the bank\nabout the fee", "pay rent"]
    assert text("lines") == ["call the bank", "the long story", "pay the rent"]
    assert text("verbs") == ["email Ann", "call Bob", "pay Cy"]
    assert text("dated") == ["dinner tomorrow", "call mum"]


@pytest.mark.parametrize("name", ["shopping", "chapters", "one call", "estimate", "prose", "wrapped", "no verb", "no header"])
def test_captures_that_stay_whole(split, name):
    found, cases = split
    assert found[name] == [("whole", cases[name], "")]


def test_what_is_left(split):
    found, _ = split
    assert found["one left"] == [("whole", "pay the rent", "")] and not {"empty", "none"} & set(found)


def test_proposals_must_be_in_the_capture(spark):
    rows = spark.createDataFrame([(1, "there is milk to buy, and the dentist", DAY), (2, "some milk and eggs", DAY)], "capture int, text string, today date")
    made = [(1, 0, "milk to buy"), (1, 1, "THE dentist!"), (1, 2, "call the dentist"), (2, 0, "some milk"), (2, 1, "buy eggs")]
    got = tasks.split(rows, spark.createDataFrame(made, "capture int, place int, part string")).orderBy("capture", "ordinal").collect()
    assert [(r["capture"], r["way"], r["text"]) for r in got] == [(1, "model", "milk to buy"), (1, "model", "THE dentist!"), (2, "whole", "some milk and eggs")]
    said = spark.createDataFrame([("call the dentist", "buy milk and eggs"), ("buy milk", "buy milk and eggs"), ("milk", "buy milk")], "a string, b string")
    assert [r[0] for r in said.select(tasks.really_in(F.col("a"), F.col("b"))).collect()] == [False, True, False]
