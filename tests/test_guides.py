"""Guides by cases, and against plain versions."""

import random
import re

from studylake.operators import guides


def test_terms_and_their_weights(spark):
    rows = [
        (1, 0, "**Opportunity Cost** matters. Opportunity cost is the value given up."),
        (1, 1, "- entropy: a measure\n- due: tomorrow\nThis is nothing. C++ (x) and NASA (agency), called noise."),
        (1, 2, "What rises is called the noise. Anything is possible. Costs of opportunity cost; entropyx"),
        (2, 0, "A long run of words that nobody would take is this."),
        (2, 1, None),
    ]
    got = {(r["note"], r["term"]): (r["place"], r["weight"], r["source"]) for r in guides.key_terms(spark.createDataFrame(rows, "note int, place int, text string")).collect()}
    assert got == {(1, "Opportunity cost"): (0, 3.5, "definition"), (1, "entropy"): (1, 2.5, "glossary"), (1, "NASA"): (1, 2.0, "acronym"), (1, "noise"): (2, 3.5, "definition")}


def test_spread_counts_whole_terms(spark):
    rows = spark.createDataFrame([(1, 0, "Term1 and c++."), (1, 1, "term10, C++ and xc++"), (1, 2, "a term1; TERM1")], "note int, place int, text string")
    got = guides.spread(spark.createDataFrame([(1, "term1"), (1, "c++"), (1, "none")], "note int, key string"), rows)
    assert {r["key"]: r["passages"] for r in got.collect()} == {"term1": 2, "c++": 2}


def test_headings_in_force(spark):
    text = "lead\n\n# One #\nfirst passage\n## Two\nsecond\nsame\n### Three\nsame\n"
    passages = [(1, 0, "lead"), (1, 1, "first passage"), (1, 2, "not there"), (1, 3, "second"), (1, 4, "same"), (1, 5, "lead"), (1, 6, ""), (2, 0, "x")]
    got = guides.with_headings(spark.createDataFrame([(1, text), (2, None)], "note int, text string"), spark.createDataFrame(passages, "note int, place int, text string"))
    assert {(r["note"], r["place"]): r["heading"] for r in got.collect()} == {(1, 0): "", (1, 1): "One", (1, 2): "One", (1, 3): "Two", (1, 4): "Two", (1, 5): "", (1, 6): "", (2, 0): ""}


def test_proposed_terms_must_be_named(spark):
    notes = spark.createDataFrame([(1, "# H\n**Heat** flows\nentropy grows")], "note int, text string")
    passages = spark.createDataFrame([(1, 0, "**Heat** flows"), (1, 1, "entropy grows")], "note int, place int, text string")
    proposed = spark.createDataFrame([(1, "the entropy", 0, 3.0), (1, "heat", 0, 2.0), (1, "invented", 0, 3.0)], "note int, term string, place int, importance double")
    got = {r["place"]: (r["heading"], r["weight"], r["terms"]) for r in guides.build(notes, passages, proposed).collect()}
    assert got == {0: ("H", 4.5, ["Heat"]), 1: ("H", 5.0, ["entropy"])}


def plain_headings(text, passages):
    """Heading by heading: where each title stands, and the last one at or before the beginning of a passage."""
    titles, at = [], 0
    for line in text.split("\n"):
        m = re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        titles += [(at, m.group(2).strip(" "))] if m and m.group(2).strip(" ") else []
        at += len(line) + 1
    cursor, heading, out = 0, "", []
    for p in passages:
        probe = (p or "").strip(" \t\n\x0b\f\r")[:40].rstrip(" ")
        at = text.find(probe, cursor) if probe else -1
        at = text.find(probe) if probe and at < 0 else at
        if at >= 0:
            cursor, heading = at, next((t for pos, t in reversed(titles) if pos <= at), "")
        out.append(heading)
    return out


def test_headings_as_plain(spark):
    """Long notes, passages that are repeated, cut off, out of order, of white space, or not of the note."""
    draw = random.Random(4)
    words = ["heat", "of", "naïve", "Ωmega", "𝒜b", "a-b", "is", "  ", "\t", "#", "x" * 38, "end."]
    notes, passages = [], []
    for note in range(60):
        lines = [draw.choice(["", "# ", "## ", "### #", "#x ", "#"][: draw.choice([1, 6])]) + " ".join(draw.choices(words, k=draw.randrange(7))) for _ in range(draw.choice([3, 12, 300]))]
        text = "\n".join(lines)
        taken = [draw.choice(lines) if draw.random() < 0.2 else "\n".join(lines[i : i + draw.randrange(1, 4)]) for i in sorted(draw.choices(range(len(lines)), k=draw.randrange(1, 1 + len(lines))))]
        taken = [draw.choice([x, x, x, "  \n" + x + " \n", "not here", x[:41], "", None]) for x in taken]
        notes.append((note, text))
        passages += [(note, place, x) for place, x in enumerate(taken)]
    got = guides.with_headings(spark.createDataFrame(notes, "note int, text string"), spark.createDataFrame(passages, "note int, place int, text string"))
    want = {(n, i): h for n, text in notes for i, h in enumerate(plain_headings(text, [x for m, _, x in passages if m == n]))}
    assert {(r["note"], r["place"]): r["heading"] for r in got.collect()} == want and len(set(want.values())) > 50


def test_spread_as_plain(spark):
    draw = random.Random(5)
    words = ["heat", "Heat", "a", "of", "c++", "(x)", "naïve", "é", "x.y", "heat-wave", "_b", "\\d", "7", "$", "[a]"]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", " ", "", ", ", "\x1e"]) for _ in range(n))
    said = [(note, place, text(draw.randrange(12))) for note in range(40) for place in range(draw.randrange(1, 9))]
    terms = {(note, text(draw.choice([1, 1, 2])).strip(" ,").lower()) for note in range(41) for _ in range(25)}
    got = guides.spread(spark.createDataFrame(sorted(t for t in terms if t[1]), "note int, key string"), spark.createDataFrame(said, "note int, place int, text string"))
    stands = lambda key, x: re.search(rf"(?<!\w){re.escape(key)}(?!\w)", x.lower())
    counts = {(n, k): sum(m == n and bool(stands(k, x)) for m, _, x in said) for n, k in terms if k}
    assert {(r["note"], r["key"]): r["passages"] for r in got.collect()} == {t: n for t, n in counts.items() if n} and max(counts.values()) > 3


def test_marks_in_white_space_of_any_kind(spark):
    """What lets a pattern be left out must stand in each of its matches."""
    rows = ["Heat\tis\nwarm.", "It  is\n called  entropy.", "Cold\r\nmay be defined as less. Ice  refers to  x", "term\u2028- a: b", "\n- **mass** : kg", "x ( NASA\t) and EU\n(x)", "__two words__", "Force\t-\t push", "were\x0bknown as quarks"]
    got = guides.key_terms(spark.createDataFrame([(i, 0, x) for i, x in enumerate(rows)], "note int, place int, text string"))
    want = {(0, "Heat", "definition"), (1, "entropy", "definition"), (2, "Cold", "definition"), (2, "Ice", "definition"), (4, "mass", "glossary"), (5, "NASA", "acronym"), (6, "two words", "bold"), (7, "Force", "glossary"), (8, "quarks", "definition")}
    assert {(r["note"], r["term"], r["source"]) for r in got.collect()} - {(3, "a", "glossary")} == want
