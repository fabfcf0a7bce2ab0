"""Quotations and named titles against Python's own search."""

import random
import re

import duckdb

from studylake.operators import quotes
from studylake.plans import quotations
from studylake.sources import markdown


def test_probes_are_found_wherever_they_stand(spark):
    """Random texts of few letters: every place of every probe, also within words."""
    rng = random.Random(2)
    said = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    sought = [rng.choice(said)[rng.randint(0, 40) :][: rng.randint(4, 14)] for _ in range(300)]
    plain = lambda t: re.sub(r"\s+", " ", t).strip()
    got = quotes.containing(spark.createDataFrame(list(enumerate(sought)), "probe int, text string"), spark.createDataFrame(list(enumerate(said)), "place int, text string"))
    want = {(i, j) for i, s in enumerate(sought) for j, t in enumerate(said) if len(plain(s)) >= 6 and plain(s) in plain(t)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_kept_grams_of_a_piece_are_those_of_the_whole():
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("abc ") for _ in range(60))
        a, n = rng.randrange(50), rng.randint(6, 10)
        piece = quotes.kept_grams(t[a : a + n])
        assert set(piece) <= set(quotes.kept_grams(t)) and (piece or len(t[a : a + n]) < 6)


def test_cards_are_placed_by_the_first_probe_that_is_found(spark):
    passages = [(1, 0, "Heat is energy in transit."), (1, 1, "Entropy measures disorder, of a system."), (1, 2, "energy in transit again"), (2, 0, "Heat is energy in transit.")]
    cards = [
        (1, 1, "Q", "energy in transit", "measures disorder of a"),  # the quotation decides
        (1, 2, "Q", "energy in transit", "not said at all"),
        (1, 3, "{{Entropy}} measures disorder", "x", None),
        (1, 4, "so it says… {{Entropy}} measures disorder of", "zzzzzz", None),  # a piece of a cut cloze
        (1, 5, "Q", "short", "tiny"),
        (2, 1, None, None, None),
    ]
    got = quotes.placed_cards(spark.createDataFrame(cards, "note int, card int, front string, back string, source string"), spark.createDataFrame(passages, "note int, place int, text string"))
    assert {(r["note"], r["card"]): r["place"] for r in got.collect()} == {(1, 1): 1, (1, 2): 0, (1, 3): 1, (1, 4): 1, (1, 5): None, (2, 1): None}


def mentioned(spark, notes, titles):
    got = quotes.mentions(spark.createDataFrame(notes, "note bigint, text string"), spark.createDataFrame(titles, "note bigint, title string"))
    return sorted(tuple(r) for r in got.collect())


def test_titles_long_linked_fenced_and_accented(spark):
    titles = [(10, "Alpha Beta"), (11, "Alpha Beta Gamma"), (12, "one two three four five six seven eight"), (13, "Économie"), (14, "abc"), (15, "2024-01"), (16, "well-known fact"), (1, "My own title")]
    notes = [
        (1, "my own title and ALPHA beta, alpha beta gamma"),
        (2, "[[Alpha Beta]] and ```\nAlpha Beta Gamma\n``` alone"),
        (3, "see One Two three four five six seven eight."),
        (4, "la conomie, no; économie yes"),
        (5, "alphabeta, alpha  beta, xalpha beta, abc, 2024-01"),
        (6, "Alpha Beta is linked: [[alpha-beta|so]]"),
        (7, f"x\n\n## Related\n\n{quotes.MARKER}\n\n- [[Alpha Beta]] Alpha Beta Gamma\n\n## End\nalpha beta"),
        (8, "a well known fact is a well-known fact"),
        (9, None),
        (13, "économie"),
    ]
    assert mentioned(spark, notes, titles) == [(1, 10), (1, 11), (3, 12), (4, 13), (7, 10), (8, 16)]


def test_titles_as_one_alternation(spark):
    """Against a regular expression over all titles, the longest first."""
    rng = random.Random(4)
    words = ["lorem", "ipsum", "dolor", "é", "sit_amet", "x1"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    titles = {t: 1000 + i for i, t in enumerate(dict.fromkeys(filter(lambda t: len(t) > 4 and re.search("[A-Za-z]", t), (title() for _ in range(60)))))}
    notes = [(i, " ".join(rng.choice([*words, "-", "lorem."]) for _ in range(60))) for i in range(60)]
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(titles, key=len, reverse=True))) + r")\b", re.I)
    slugs = {r["title"]: r["slug"] for r in spark.createDataFrame([(t,) for t in titles], "title string").select("title", markdown.slug("title").alias("slug")).collect()}
    first = {}
    for t, n in titles.items():
        first[slugs[t]] = min(n, first.get(slugs[t], n))
    want = sorted({(i, first[slugs[m[1]]]) for i, t in notes for m in pattern.finditer(t)})
    assert mentioned(spark, notes, [(n, t) for t, n in titles.items()]) == want and len(want) > 200


def test_titles_that_share_their_first_words(spark):
    """Places are looked up by three words: longer titles, ends of notes, repeated words and what stands between them still decide."""
    titles = [(10, "a b c"), (11, "a b c d"), (12, "a b c d e f"), (13, "a b-c"), (14, "Alpha"), (15, "alpha beta"), (16, "a a a a a"), (17, "naïve Σίσυφος x")]
    notes = [
        (1, "a b c e, a b c d e f g"),
        (2, "a b c d e"),
        (3, "...alpha"),
        (4, "a a a a a a a a a a a a"),
        (5, "a b  c, a b\nc d"),
        (6, "a b-c d"),
        (7, ""),
        (8, "... --"),
        (9, "gamma alpha beta"),
        (20, "NAÏVE σίσυφος X"),
        (21, "alpha [[x|alpha beta]] beta"),
        (None, "a b c"),
    ]
    assert mentioned(spark, notes, titles) == [(1, 10), (1, 12), (2, 11), (3, 14), (4, 16), (6, 10), (9, 15), (20, 17), (21, 14)]


def test_definitions_that_wrap(spark):
    from studylake.operators import judgement

    text = "# Terms\nheat: energy in transit\n  between two bodies\nand from one place to another\n\nand this line stands alone here\nwork: force times way\nshort one\nHeat: again\n  lost\ncold = less of it"
    rows = judgement.glossary(spark.createDataFrame([(1, text), (2, None)], "note int, text string"), "note", "text").orderBy("at").collect()
    assert [(r["kind"], r["term"], r["definition"]) for r in rows] == [
        ("heading", None, None),
        ("entry", "heat", "energy in transit between two bodies and from one place to another"),
        ("wrapped", None, None),
        ("wrapped", None, None),
        ("other", None, None),
        ("entry", "work", "force times way"),
        ("other", None, None),
        ("again", "Heat", "again"),
        ("other", None, None),
        ("entry", "cold", "less of it"),
    ]


def test_an_evaluation_set(spark, tmp_path):
    import json

    from studylake.operators import retrieval

    questions = [{"id": "a", "question": "x", "expect": ["n1", "n2"]}, {"id": "b", "kind": "unanswerable", "question": "y"}, {"id": "c", "question": "z", "expect": ["gone"]}, {"id": "d", "kind": "unanswerable", "question": "w"}, {"id": "e", "question": "v", "expect": ["n3"]}]
    (tmp_path / "set.json").write_text(json.dumps({"name": "s", "questions": questions}, indent=1))
    asked = retrieval.evaluation_set(spark, str(tmp_path / "set.json"))
    found = spark.createDataFrame([("a", 1, "n9"), ("a", 2, "n2"), ("b", 1, "n1"), ("c", 1, "n1")], "question string, rank int, note string")
    rows = retrieval.judged(asked, found, spark.createDataFrame([("n1",), ("n2",), ("n3",)], "note string"))
    assert {r["question"]: (r["rank"], r["verdict"]) for r in rows.collect()} == {"a": (2, "found"), "b": (None, "false positive"), "c": (None, "broken"), "d": (None, "restrained"), "e": (None, "missed")}
    assert retrieval.report(rows).first().asDict() == {"answerable": 2, "mrr": 0.25, "hit_1": 0.0, "hit_3": 0.5, "hit_5": 0.5, "unanswerable": 2, "restraint": 0.5, "broken": 1}


def test_quotations_in_capitals_are_those_of_the_sql(spark, tmp_path):
    """A letter that capitals make two of; the end of the card's turn stands in an earlier one as well."""
    rows = [(1, 0, "assistant", "Vorher stand schon am Ende dass dieser Satz verbleibt."), (1, 4, "user", "Der Satz mit der Straße und dem Maß, dass dieser Satz verbleibt.")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name, columns in (("card_places", ["note", "card", "place"]), ("passage_coverage", ["note", "passages", "covered", "share", "cards", "unplaced"])):
        got = sorted(tuple(r) for r in quotations.queries()[name](spark, str(tmp_path)).select(*columns).collect())
        assert got == sorted(con.execute(f"select {', '.join(columns)} from ({quotations.SQL[name]})").fetchall())
