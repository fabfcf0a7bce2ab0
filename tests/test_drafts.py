"""Drafted cards by cases, and drafting passages against a plain walk."""

import re

from studylake.operators import drafts

SMALL = "/root/testdata/sf0.001"
PASSAGE = (
    "The three branches of government are legislative, executive, and judicial. Opportunity cost is the value of the next best alternative you gave up when you made a choice. "
    "Prices rise because demand exceeds supply in the market for a while. Heat is energy in transit."
)


def plain_material(text):
    """(text) of passages by a walk over blocks."""
    out, now, skip = [], [], False

    def close():
        joined = "\n\n".join(now)
        now.clear()
        if not joined:
            return
        if len(joined) < 120 and out and len(out[-1]) + len(joined) < 1100:
            out[-1] += "\n\n" + joined
        else:
            out.append(joined)

    for block in filter(None, map(str.strip, re.split(r"\n\s*\n", text.strip()))):
        if m := re.match(r"#{1,6}\s+(.*)$", block):
            close()
            skip = m[1].strip().lower().rstrip(":") in drafts.OWN_HEADINGS
        elif not skip:
            if sum(map(len, now)) + len(block) > 1100:
                close()
            now.append(block)
    close()
    return [p for p in out if len(p) >= 60]


def test_drafting_passages(spark):
    rows = [(r["doc_id"], re.sub("\n", "\n\n", r["text"] or "")) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(-1, "x " * 40 + "\n\n# Steps:\n\nown words that are long enough to count but left out all the same\n\n# More\n\ntiny\n\n# End\n\n" + "y " * 200), (-2, ""), (-3, None)]
    got = {}
    for r in drafts.material(spark.createDataFrame(rows, "note bigint, text string")).orderBy("note", "place").collect():
        got.setdefault(r["note"], []).append(r["text"])
    for note, text in rows:
        assert got.get(note, []) == plain_material(text or ""), note


def test_cards_by_rule(spark):
    rows = [(1, 0, "Heat is energy in transit between bodies. It is so."), (1, 1, "# Entropy means a measure of disorder of things! heat is a lower case one. HEAT is energy in transit again here."), (2, 0, None)]
    got = [tuple(r) for r in drafts.by_rule(spark.createDataFrame(rows, "note int, place int, text string")).orderBy("n").collect()]
    assert got == [(1, 1, "{{Heat}} is energy in transit between bodies.", "Heat", "Heat is energy in transit between bodies."), (1, 2, "{{Entropy}} means a measure of disorder of things!", "Entropy", "Entropy means a measure of disorder of things!")]


def test_a_models_cards(spark):
    q = "What is said of it?"
    items = {
        1: ("What are the three branches?", "legislative, executive, and judicial", None, "", None),  # a list: a card for each
        2: ("What is opportunity cost?", "the value of the next best alternative you gave up", None, "", None),  # long: a blank
        3: ("What kind of energy is heat", "energy in transit", "Heat is energy in transit.", "short", None),
        4: ("Why do prices rise?", "because demand exceeds supply in the market", None, "Why.", None),
        5: ("Why do prices rise?", "demand exceeds supply", None, "explain", None),  # too short for an explanation
        6: (q, "energy in transit", None, "mcq", ["work in progress", "matter at rest now", "nothing at all"]),
        7: (q, "energy in transit", None, "choice", ["none of these", "matter at rest"]),
        8: (q, "what nobody wrote qqq zzz", None, "", None),
        9: ("", "x", None, "", None),
        10: ("Why", "x", None, "", None),
        11: ("Energy in transit", "energy in TRANSIT", None, "", None),
        12: (q, "my note", None, "", None),
        13: ("What does the text say?", "energy", None, "", None),
        14: ("List what heat is, please", "energy in transit", None, "explain", None),
        15: ("{{Heat}} is energy in transit", "Heat", None, "", None),
        16: (q, "demand exceeds supply and prices rise", None, "", None),  # two facts of one sentence
    }
    rows = [(k, PASSAGE, "My note!", f, b, w, fmt, '"Some Kind."', o) for k, (f, b, w, fmt, o) in items.items()]
    got = {}
    for r in drafts.drafted(spark.createDataFrame(rows, "card int, passage string, subject string, q string, a string, why string, format string, topic string, wrong array<string>")).orderBy("card", "n").collect():
        got.setdefault(r["card"], []).append(r)
    tag = {k: v[0]["tag"] for k, v in got.items()}
    assert tag == {1: "repaired", 2: "repaired", 3: "", 4: "", 5: "", 6: "", 7: "choice-giveaway", 8: "ungrounded", 9: "empty", 10: "length", 11: "restates-question", 12: "title-as-answer", 13: "not-self-contained", 14: "list-question", 15: "", 16: "repaired"}
    assert [r["back"] for r in got[1]] == ["legislative", "executive", "judicial"] and all(r["source"] in PASSAGE for r in got[1])
    assert got[2][0]["front"].startswith("{{Opportunity cost}} is")
    assert got[3][0]["front"] == "What kind of energy is heat?" and got[3][0]["mode"] == "recall" and got[3][0]["topic"] == "some kind"
    assert got[4][0]["mode"] == "explain" and got[5][0]["mode"] == "" and len(got[6][0]["choices"]) == 4 and got[7][0]["choices"] == []
    assert got[15][0]["front"] == "{{Heat}} is energy in transit" and all(len(v) == 1 for k, v in got.items() if k != 1 and k != 16)
