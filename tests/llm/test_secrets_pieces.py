"""Runs that hold a name with its value, or characters of two alphabets."""

import random
import string

from studylake.llm import secrets

PLAIN = string.ascii_letters + string.digits


def token(seed, n=40, letters=PLAIN):
    return "".join(random.Random(seed).choices(letters, k=n))


def spans(text):
    runs = secrets.token_runs(text, secrets.SHORTEST)
    return secrets.joined(secrets.random_spans(text, runs, secrets.base_spans(text, runs)))


def test_a_value_is_found_behind_its_name():
    x, y = token(1), token(2)
    assert spans(f"é client_key={x} end") == "random:13:53"
    assert spans(f"sig={x}== end") == "random:4:44"
    assert spans(f"a={x}=b={y}") == "random:2:42,random:45:85"
    assert spans(f"{x}=") == "random:0:40"


def test_a_value_of_two_alphabets_is_cut():
    x, plain, url = token(1), "A/" + token(3, 38) + "+", "A_" + token(4, 38) + "-"
    assert spans(f"sig-v1_{plain}") == f"random:7:{7 + len(plain)}"
    assert spans(f"/path/{url}/x") == f"random:6:{6 + len(url)}"
    assert spans(f"/path/some_name/{x}") == "random:11:56"  # name/ may belong to it, as / is of base64


def test_ordinary_names_and_values_are_none():
    assert spans("the_name_of_a_thing=another_quite_ordinary_long_value") == ""
    assert spans("/usr/local/share/a_directory-with/an-ordinary_name+more") == ""
    assert spans(f"my_token={token(5)} end") == ""  # within the span of a fixed pattern


def test_battery_on_tokens_and_words():
    """Random tokens of each encoding pass at nearly any length; words, paths and numbers don't."""
    for letters, least in ((PLAIN, 0.95), ("0123456789abcdef", 0.95), (string.ascii_uppercase + "234567", 0.7)):
        for n in (20, 32, 64):
            assert sum(secrets.random_p(token(i, n, letters)) <= 0.01 for i in range(100)) >= 100 * least
    ordinary = "internationalisation averyveryverylongordinaryword com/example/project/ClassNames 20240131123456789012 SomeCamelCaseIdentifierName path_to_some_file_name".split()
    assert all(secrets.random_p(w) > 0.01 for w in ordinary)
    longer = [secrets.random_p(token(7, n)) for n in (24, 48)]
    assert longer[1] <= longer[0] < 1e-3


def test_statistics_of_the_battery_against_plain_ones():
    import numpy as np

    draw = random.Random(3)
    codes = [draw.randrange(62) for _ in range(40)]
    z = secrets.battery(np.array([codes]), 62)[0]
    seen = [sum(c * 8 // 62 == i for c in codes) for i in range(8)]
    due = [40 * sum(k * 8 // 62 == i for k in range(62)) / 62 for i in range(8)]
    chi = sum((s - d) ** 2 / d for s, d in zip(seen, due, strict=True)) / 7
    assert abs(z[0] - (chi ** (1 / 3) - (1 - 2 / 63)) / (2 / 63) ** 0.5) < 1e-9
    high = [c >= 31 for c in codes]
    runs, a = 1 + sum(x != y for x, y in zip(high, high[1:])), sum(high)
    mean = 1 + 2 * a * (40 - a) / 40
    assert abs(z[1] - abs(runs - mean) / ((mean - 1) * (mean - 2) / 39) ** 0.5) < 1e-9
    m = sum(codes) / 40
    r = sum((x - m) * (y - m) for x, y in zip(codes, codes[1:])) / sum((x - m) ** 2 for x in codes)
    assert abs(z[2] - abs(r + 1 / 40) * 40**0.5) < 1e-9


def test_ordinary_sums_leave_long_runs_out(spark):
    text = "ordinary words of a text that goes on for some time and has enough letters " * 3
    long = token(1, 200)
    assert (secrets.ordinary_sums(text + " " + long) == secrets.ordinary_sums(text + " ")).all()
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    want = secrets.ordinary_model(secrets.ordinary_sums(text))
    got = secrets.measured(docs)
    assert all((abs(got[k][0] - want[k][0]) < 1e-9).all() and (abs(got[k][1] - want[k][1]) < 1e-9).all() for k in want)
