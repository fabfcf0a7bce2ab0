"""Texts cut into notes, against a plain walk over their blocks."""

import re

from studylake.operators import segments
from studylake.plans import cuts

SMALL = "/root/testdata/sf0.001"
size = lambda t: len(t.split())


def plain_blocks(text):
    """(kind, level, title, text) of texts without fences."""
    out = []
    for line in [*text.split("\n"), ""]:
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append(["heading", len(m[1]), m[2], line])
        elif re.match(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*$", line):
            out.append(["rule", 0, "", line])
        elif not line.strip():
            out.append(None)
        else:
            kind = "table" if re.match(r"\s*\|.*\|\s*$", line) else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s+", line) else "para"
            if out and out[-1] and out[-1][0] == kind:
                out[-1][3] += "\n" + line
            else:
                out.append([kind, 0, "", line])
    return [b for b in out if b]


def packed(blocks):
    parts = [[]]
    for b in blocks:
        if parts[-1] and sum(size(x[3]) for x in parts[-1]) + size(b[3]) > 400:
            parts.append([])
        parts[-1].append(b)
    return [p for p in parts if p]


def plain_segments(text):
    """(boundary, title or None, body)"""
    blocks = plain_blocks(text)
    levels = [b[1] for b in blocks if b[0] == "heading"]
    if levels:
        plan, cut = "heading", min((x for x in levels if levels.count(x) > 1), default=max(levels))
    else:
        plan = "rule" if any(b[0] == "rule" for b in blocks) else "whole" if sum(size(b[3]) for b in blocks) < 120 else "size"
    groups = [(None, [])]
    for b in blocks:
        if plan == "heading" and b[0] == "heading" and b[1] <= cut:
            groups.append((b[2], []))
        elif plan == "rule" and b[0] == "rule":
            groups.append((None, []))
        elif b[0] != "rule" or (plan == "heading" and groups[-1][1]):
            groups[-1][1].append(b)
    out = []
    for title, held in groups:
        parts = packed(held) if plan == "size" or sum(size(b[3]) for b in held) > 400 else [held] if held else []
        for i, p in enumerate(parts, 1):
            several = plan != "size" and len(parts) > 1
            out.append([plan + "+size" * several, f"{title} ({i}/{len(parts)})" if several and title is not None else title, "\n\n".join(b[3] for b in p)])
    least = 12 if plan == "heading" else 30
    head = lambda s: f"## {s[1]}\n\n" if s[1] is not None else ""
    kept = []
    for s in out:
        if kept and size(s[2]) < least and size(kept[-1][2]) + size(s[2]) <= 400:
            kept[-1][2] += "\n\n" + head(s) + s[2]
        else:
            kept.append(s)
    if len(kept) > 1 and size(kept[0][2]) < least and size(kept[0][2]) + size(kept[1][2]) <= 400:
        kept[1][2] = head(kept[0]) + kept[0][2] + "\n\n" + kept[1][2]
        kept.pop(0)
    return [tuple(s) for s in kept]


def cut(spark, rows):
    got = {}
    for r in segments.segmented(spark.createDataFrame(rows, "note int, text string")).orderBy("note", "ordinal").collect():
        got.setdefault(r["note"], []).append(r)
        assert r["ordinal"] == len(got[r["note"]]) and r["title"] and r["words"] == size(r["body"])
    return got


def test_segments_of_documents(spark):
    texts = {r["note"]: r["text"] for r in cuts.marked_documents(spark, SMALL).collect()}
    got = {}
    for r in segments.segmented(cuts.marked_documents(spark, SMALL)).orderBy("note", "ordinal").collect():
        got.setdefault(r["note"], []).append(r)
    assert {r["plan"] for rs in got.values() for r in rs} == {"heading", "rule", "whole", "size"}
    for note, text in texts.items():
        want = plain_segments(text)
        assert [(r["boundary"], r["body"].strip("\n")) for r in got.get(note, [])] == [(b, t.strip("\n")) for b, _, t in want], note
        assert all(r["title"] == t for r, (_, t, _) in zip(got.get(note, []), want, strict=True) if t)


def test_titles_paths_and_long_sections(spark):
    block = "word " * 150
    rows = [
        (1, f"# Big\n\n## One Section\n\n{block}\n\n{block}\n\n{block}\n\n## Next\n\n{block}"),
        (2, "# A\n\none two\n\n# B\n\n" + "x " * 20 + "\n\n# C\n\nthree"),
        (3, "  \n"),
        (4, None),
        (5, "```\n# no heading\n\nend\n```\n" + "word " * 130),
    ]
    got = cut(spark, rows)
    assert [(r["title"], r["boundary"], r["path"]) for r in got[1]] == [("One Section (1/2)", "heading+size", ["Big", "One Section"]), ("One Section (2/2)", "heading+size", ["Big", "One Section"]), ("Next", "heading", ["Big"])]
    assert [(r["title"], r["body"]) for r in got[2]] == [("B", "## A\n\none two\n\n" + "x " * 20 + "\n\n## C\n\nthree")]
    assert 3 not in got and 4 not in got and got[5][0]["plan"] == "size" and "# no heading\n\nend" in got[5][0]["body"]


def test_topics_of_a_model(spark):
    text = "\n\n".join("word " * 60 for _ in range(4))
    notes = spark.createDataFrame([(1, text), (2, text)], "note int, text string")
    topics = spark.createDataFrame([(1, 0, "First"), (1, 3, "Last"), (2, 0, "Only")], "note int, block int, title string")
    got = segments.segmented(notes, topics=topics).orderBy("note", "ordinal").collect()
    assert [(r["note"], r["plan"], r["title"], r["words"]) for r in got[:2]] == [(1, "topic", "First", 180), (1, "topic", "Last", 60)] and got[2]["plan"] == "size"
