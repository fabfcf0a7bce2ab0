"""What SQL can't express: folds, fits, passages, plans and files, by plain versions and cases."""

import collections
import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from studylake.functions import captures, dates, memory
from studylake.operators import calendar, passages, study, transitions
from studylake.plans import library, registry
from studylake.sources import markdown, views

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def reviews_of(spark, rows):
    return spark.createDataFrame([(c, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), i, g) for i, (c, d, g) in enumerate(rows)], "card bigint, at timestamp_ntz, ord bigint, grade int")


def test_a_forgotten_card_comes_back_after_a_day(spark):
    cards = study.with_due(study.card_states(reviews_of(spark, [(1, 0, 4), (1, 20, 4), (1, 60, 1), (2, 0, 3), (None, 0, 3), (3, 0, 9)])))
    got = {r["card"]: r for r in cards.collect()}
    assert got[1]["interval"] == 1 and got[1]["due"] == dt.date(2024, 3, 2) and (got[1]["reps"], got[1]["lapses"]) == (3, 1)
    assert got[2]["interval"] == 3 and set(got) == {1, 2, None}


@pytest.mark.parametrize("name", ["card_states", "deck_progress", "load_forecast", "review_buttons", "retention_curve"])
def test_long_histories_do_not_overflow(spark, name):
    rows = registry.queries()[name](spark, LARGE).collect()
    assert rows and all(r["interval"] <= 3650 for r in rows if "interval" in r.asDict())


def test_fit_is_the_plain_coordinate_descent(spark):
    samples = study.review_samples(views.reviews(spark, SMALL))
    rows = [(r["stability"], r["elapsed"], r["remembered"]) for r in samples.collect()]

    def loss(w):
        scale, total = sum(w[:4]) / sum(memory.WEIGHTS[:4]), 0.0
        for s, e, ok in rows:
            p = min(1 - 1e-9, max(1e-9, (1 + memory.FACTOR * e / max(1e-6, s * scale)) ** memory.DECAY))
            total -= math.log(p if ok else 1 - p)
        return total / len(rows)

    best, step = list(memory.WEIGHTS), 0.35
    least = start = loss(best)
    for _ in range(40):
        moved = False
        for i in range(4):
            for sign in (1, -1):
                trial = list(best)
                trial[i] = min(100.0, max(0.001, trial[i] * (1 + sign * step)))
                if trial[i] != best[i] and loss(trial) < least - 1e-9:
                    best, least, moved = trial, loss(trial), True
        if not moved:
            step /= 2
            if step < 1e-3:
                break
    got = study.fit(samples).first()
    assert (got["n"], got["enough"]) == (len(rows), len(rows) >= 1000)
    assert got["baseline_loss"] == pytest.approx(start, abs=1e-5) and got["loss"] == pytest.approx(least, abs=1e-5)
    assert got["weights"][:4] == pytest.approx(best[:4], rel=1e-4)


def plain_passages(title, body):
    """Passages by a walk over the blocks, with a list of lists."""
    groups = [("", [[]])]
    for block in filter(None, map(str.strip, re.split(r"\n\s*\n", body.strip()))):
        if m := re.match(r"#{1,6}\s+(.*)$", block):
            groups.append((m[1].strip(), [[]]))
        elif sum(map(len, groups[-1][1][-1])) + len(block) > 900 and groups[-1][1][-1]:
            groups[-1][1].append([block])
        else:
            groups[-1][1][-1].append(block)
    out = []
    for heading, packs in groups:
        for text in ("\n\n".join(p) for p in packs if p):
            if heading or len(text) >= 40:
                out += [(heading, (f"{title} — {heading}" if heading else title) + "\n\n" + x) for x in plain_pieces(text)]
    return out or [("", title + (f"\n\n{body.strip()}" if body.strip() else ""))]


def plain_pieces(text):
    if len(text) <= 900:
        return [text]
    out, a = [], 0
    while True:
        b = min(len(text), a + 900)
        if b < len(text) and (dots := [i for i in range(a + 40, b - 1) if text[i : i + 2] == ". "]):
            b = dots[-1] + 1
        out.append(text[a:b].strip())
        if b == len(text):
            return [x for x in out if len(x) >= 40]
        a = max(a + 1, b - 150)


def passages_of(spark, notes):
    got = passages.passages(spark.createDataFrame(notes, "note bigint, title string, body string")).orderBy("note", "place").collect()
    by_note = collections.defaultdict(list)
    for r in got:
        assert r["place"] == len(by_note[r["note"]])
        by_note[r["note"]].append((r["heading"], r["text"]))
    return by_note


def test_passages(spark):
    long = "\n\n".join(f"Sentence number {i} of the block is here to be long enough. " * 6 for i in range(8))
    bodies = ["", " \n", "tiny", "tiny\n\nbits", "# Only\n\n## Heads", "# Heat\n\nA short one.\n\n" + long + "\n\n## Cold\n\nx\n\n" + "y" * 2000, "short\n\n# H\n\nb", "lead of at least forty characters, or more than that\n\n" * 30, "ab. " * 600, "No stop " * 300, "Early. " + "z" * 3000, "a" * 900, "a" * 901]
    got = passages_of(spark, [(i, "Title", b) for i, b in enumerate(bodies)] + [(99, None, None)])
    for i, b in enumerate(bodies):
        assert got[i] == plain_passages("Title", b), i
    assert got[99] == [("", "")]


def test_passages_of_documents(spark):
    rows = [(r["doc_id"], f"T{r['doc_id']}", r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = passages_of(spark, rows)
    assert all(got[i] == plain_passages(t, b) for i, t, b in rows)


def plain_plan(steps, busy, begin):
    """The first minute of each step, by trying minute after minute: a step gives way to what is taken, with a gap behind it."""
    taken, used, at, out = list(busy), collections.Counter(), begin, []
    for a, b in busy:
        used[a // 1440] += b - a
    for size in steps:
        if size > 180:
            out.append(None)
            continue
        t = at
        while True:
            day = t // 1440
            if dt.date.fromordinal(719163 + day).weekday() > 4 or used[day] + size > 180 or t % 1440 > 1080 - size:
                t = (day + 1) * 1440
            elif t % 1440 < 540:
                t = day * 1440 + 540
            elif any(a < t + size and t < b for a, b in taken):
                t = min(b for a, b in taken if a < t + size and t < b) + 15
            else:
                break
        taken.append((t, t + size))
        used[t // 1440] += size
        at = t + size + 15
        out.append(t)
    return out


def test_planned_steps_take_the_first_free_slot(spark):
    got = library.planned_steps(spark, SMALL).collect()
    begin = 10374 * 1440
    busy = [(begin + i * 1440 + 600, begin + i * 1440 + 720) for i in range(14)]
    by_owner = collections.defaultdict(list)
    for r in got:
        by_owner[r["owner"]].append(r)
    sizes = {(r["project"], r["step"]): r["minutes"] for r in views.steps(spark, SMALL).filter("not done").groupBy("project", "step").agg(F.max("minutes").alias("minutes")).collect()}
    assert got
    for rows in by_owner.values():
        rows.sort(key=lambda r: (r["step"], r["project"]))
        assert [r["start"] for r in rows] == plain_plan([sizes[r["project"], r["step"]] for r in rows], busy, begin)
        assert all(r["stop"] - r["start"] == sizes[r["project"], r["step"]] and r["stop"] % 1440 <= 1080 for r in rows)


def test_plans_around_appointments(spark):
    rng = random.Random(8)
    todo, busy, want = [], [], {}
    for owner in range(40):
        begin = 10374 * 1440
        mine = sorted((begin + d * 1440 + 480 + rng.randrange(600), rng.choice((10, 45, 90))) for d in range(5) for _ in range(rng.randrange(4)))
        steps = [rng.choice((15, 30, 60, 170, 181)) for _ in range(12)]
        busy += [(owner, a, a + n) for a, n in mine]
        todo += [(owner, 1, i, i, n) for i, n in enumerate(steps)]
        want[owner] = plain_plan(steps, [(a, a + n) for a, n in mine], begin)
    got = calendar.planned(spark.createDataFrame(todo, "owner bigint, project bigint, step int, place int, minutes int"), spark.createDataFrame(busy, "owner bigint, start bigint, stop bigint"), 10374 * 1440)
    by_owner = collections.defaultdict(dict)
    for r in got.collect():
        by_owner[r["owner"]][r["step"]] = r["start"]
    assert all([by_owner[o][i] for i in range(12)] == starts for o, starts in want.items())


def test_new_ids_are_unique_and_never_early(spark):
    rows = [(r["ord"], r["id"]) for r in registry.queries()["new_ids"](spark, SMALL).collect()]
    assert len({i for _, i in rows}) == len(rows) == 1000
    events = {r["event_id"]: (r["event_type"], r["ts"].hour * 60 + r["ts"].minute) for r in spark.read.parquet(f"{SMALL}/events.parquet").collect()}
    for o, i in rows:
        assert i.rsplit("-", 1)[0] == events[o][0] and int(i.rsplit("-", 1)[1]) >= events[o][1]


def test_missing_concepts_of_several_words(spark):
    concepts = spark.createDataFrame([(1, "Opportunity cost", 0, 2.0), (1, "sunk cost", 0, 1.0), (1, "SUNK cost", 1, 0.5), (1, "placed one", 2, 3.0)], "note bigint, term string, place int, weight double")
    placed = spark.createDataFrame([(1, 2)], "note bigint, place int")
    cards = spark.createDataFrame([(1, "What is the opportunity-cost of it?"), (2, "sunk cost")], "note bigint, text string")
    assert [tuple(r) for r in passages.missing_concepts(concepts, placed, cards).collect()] == [(1, 1, "sunk cost")]


def test_states_are_kept_at_four_places(spark):
    got = study.card_states(views.reviews(spark, SMALL)).collect()
    assert got and all(r["s"] == round(r["s"], 4) and r["d"] == round(r["d"], 4) and abs(r["raw"] - r["s"]) <= 5.1e-5 for r in got)


def test_vault_of_files(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "10-Projects" / "sub").mkdir(parents=True)
    (root / "10-Projects" / "a--20240131T101500.md").write_bytes("﻿---\r\nid: n1\r\ntitle: \"A b\"\r\ntags:\r\n  - x\r\n  - 'y z'\r\n---\r\n\r\n# A\r\n[[B|c]] [[D#e]]\r\n".encode())
    (root / "10-Projects" / "sub" / "b.md").write_bytes("---\nid: n2\ntitle: Bé\n---\nText".encode("utf-16"))
    (root / "30-Notes.txt").write_text("no")
    (root / "plain.md").write_bytes("caf\xe9 without front matter\n---\nid: no\n---\n".encode("cp1252"))
    files = markdown.vault_files(spark, str(root))
    assert {r["folder"] for r in files.collect()} == {"10-Projects", "10-Projects/sub", ""}
    notes = {r["id"]: r for r in markdown.notes_of(files).collect()}
    assert set(notes) == {"n1", "n2"} and notes["n2"]["title"] == "Bé" and notes["n2"]["body"] == "Text"
    assert notes["n1"]["tags"] == ["x", "y z"] and notes["n1"]["body"].startswith("# A\n") and notes["n1"]["bucket"] == "10-Projects"
    text = {r["path"].split("/")[-1]: r for r in files.collect()}
    assert text["plain.md"]["text"].startswith("café") and text["a--20240131T101500.md"]["stamp"] == "20240131T101500" and text["plain.md"]["stamp"] is None
    found = markdown.notes_of(files).filter("id = 'n1'").select(markdown.wikilinks(F.col("body"))).first()[0]
    assert found == ["B", "D"]


def test_log_rows_drop_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"card": 1, "grade": 3}\nnot json\n{"card": 2, "grade": 1}\n')
    assert sorted(r["card"] for r in markdown.log_rows(spark, str(tmp_path / "log.jsonl"), "card int, grade int").collect()) == [1, 2]


def test_sections_and_headers(spark):
    text = "# T\n\n## In my own words\n\nI say so.\n\n## Related\n\n- [[x]]\n\n## End\nlast"
    rows = spark.createDataFrame([(text, "---\nrule at the top\n---\nrest", "---\n---\n\nbody")], "a string, b string, c string")
    got = rows.select(markdown.section(F.col("a"), "In my own words"), markdown.without_section(F.col("a")), markdown.body(F.col("b")), markdown.body(F.col("c")), markdown.headings(F.col("a"))).first()
    assert got[0] == "I say so." and "[[x]]" not in got[1] and "last" in got[1]
    assert got[2].startswith("---\nrule") and got[3] == "body" and got[4] == ["In my own words", "Related", "End"]


def test_deadline_phrases_keep_their_case(spark):
    rows = spark.createDataFrame([("Party Sept 8 at home", dt.date(2024, 1, 1)), ("Due: Friday, or so", dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 1)), ("", None)], "text string, t date")
    got = [r[0] for r in rows.select(dates.deadline(F.col("text"), F.col("t"))).collect()]
    assert [g and (str(g["date"]), g["phrase"], g["kind"]) for g in got] == [("2024-09-08", "Sept 8", "explicit"), ("2024-01-05", "Due: Friday", "explicit"), None, None]


def test_project_prior(spark):
    rows = spark.createDataFrame([("- read\n- write\nby tomorrow", dt.date(2024, 1, 1))], "text string, t date")
    p = rows.select(captures.prior(F.col("text"), F.col("t")).alias("p")).first()["p"]
    assert (p["estimate_minutes"], p["steps"], p["deadline"], p["deadline_confirmed"]) == (90, ["read", "write"], dt.date(2024, 1, 2), True)


def test_repeated_answers_within_two_seconds_count_once(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at + dt.timedelta(seconds=s), i, g) for i, (s, g) in enumerate([(0, 3), (1, 3), (2, 1), (9, 1)])]
    got = transitions.once_answered(spark.createDataFrame(rows, "card bigint, at timestamp_ntz, ord bigint, grade int"))
    assert sorted(r["ord"] for r in got.collect()) == [0, 2, 3]


def test_calendar_text_is_escaped(spark):
    rows = spark.createDataFrame([("a,b;c\\d\r\ne",)], "s string")
    assert rows.select(calendar.escaped(F.col("s"))).first()[0] == "a\\,b\\;c\\\\d\\ne"


def test_calendar_lines_are_folded(spark):
    lines = ["a" * 75, "a" * 76, "é" * 60, "x" * 73 + "📝" * 30, "", "b" * 300]
    rows = spark.createDataFrame([("\r\n".join(lines),)], "s string")
    got = rows.select(calendar.folded(F.col("s"))).first()[0]
    assert got.replace("\r\n ", "") == "\r\n".join(lines)
    pieces = got.split("\r\n")
    assert all(len(p.encode()) <= 75 for p in pieces) and pieces[0] == "a" * 75 and pieces[1:3] == ["a" * 74, " aa"]
    assert [len(p.encode()) for p in pieces if p.startswith(" b")] == [74, 74, 74, 8]
