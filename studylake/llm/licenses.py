"""License scans by a positional index of rare words, with built-in functions alone.

Templates are the base phrases and public licence texts and notices. The documents' own counts say which
words of a template are rarest (highest IDF); each template is posted under RARE of them with their
positions. In a document, each place of a posted word votes for the templates that have it and for where
they would then begin. At every such beginning the template's words are compared with the document's,
position by position, and one of its key phrases must stand there word for word. A template may have
several beginnings, as a text with words inserted or left out has; the words covered at any of them count
together. So labels don't need the whole text, and changed words only lower the score.

score is the best covered share of a labelled template, 1 with a base phrase, and half of the best covered
share where no key phrase stands. Labels depend on the corpus only through which words are posted: a
template counts wherever one of its posted words and its key phrase stand in line.

Documents and templates meet within a row, so texts aren't shuffled; the counts are for template words
alone, a fixed number of rows. A-Z alone are lower-cased.

Defined results: a null text is an empty one, without words; rows stay as they are, repeated ones too; an
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

# fixed values: the base phrases and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 12  # words under which a template is posted; a key phrase always has one of them at least


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(CAPITALS, SMALL))) if w]


def templates() -> list[tuple[str, list[str], list[tuple[int, int]]]]:
    """(label, words, (position, length) of its key phrases) of each licence text."""
    out = []
    for label, text, keys in TEXTS:
        words = plain_words(text)
        spans = [(i, len(k)) for k in map(str.split, keys) for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k]
        if not spans:
            raise ValueError(f"no key phrase of {label} stands in its text")
        out.append((label, words, spans))
    return out


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), SEPARATORS), "")


def vocabulary() -> list[str]:
    return sorted({w for _, words, _ in templates() for w in words} | {w for p in BASE for w in p.split()})


def document_frequency(words: DataFrame) -> dict[str, int]:
    """In how many rows each template word stands; a row per template word reaches the driver."""
    vocab = vocabulary()
    seen = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocab)))).alias("w"))
    return {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def by_rarity(words: list[str], df: dict[str, int]) -> list[str]:
    return sorted(set(words), key=lambda w: (df.get(w, 0), -len(w), w))


def postings(df: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """(template, position) under each posted word: a template's rarest words, and the rarest of each key phrase."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, spans) in enumerate(templates()):
        posted = set(by_rarity(words, df)[:RARE]) | {by_rarity(words[a : a + n], df)[0] for a, n in spans}
        for p, w in enumerate(words):
            if w in posted:
                out.setdefault(w, []).append((t, p))
    return out


def _base_places(phrase: list[str], df: dict[str, int]) -> Column:
    rarest = by_rarity(phrase, df)[0]
    first, n = phrase.index(rarest), len(phrase)
    starts = F.transform(F.filter("hits", lambda i: F.get("words", i) == rarest), lambda i: i - first)
    return F.filter(starts, lambda s: F.when(s >= 0, F.slice("words", s + 1, F.lit(n)) == F.array(*map(F.lit, phrase))).otherwise(False))


def _packed(t: Column, at: Column) -> Column:
    """A vote as one long, which Spark tells apart by hashing: of structs it compares every pair."""
    return F.shiftleft(t.cast("long"), 34) + at + F.lit(1 << 32)


def _unpacked(vote: Column) -> tuple[Column, Column]:
    return F.shiftright(vote, 34).cast("int"), (vote.bitwiseAND(F.lit((1 << 34) - 1)) - F.lit(1 << 32)).cast("int")


def _judged(index: dict[str, list[tuple[int, int]]]) -> Column:
    """(template, covered positions, whether a key phrase stands there) for each beginning that has votes."""
    kinds = templates()
    posts = F.create_map(*(x for w, places in sorted(index.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in places)))))
    votes = F.flatten(F.transform("hits", lambda i: F.transform(F.coalesce(F.try_element_at(posts, F.get("words", i)), F.array().cast("array<struct<t:int,p:int>>")), lambda e: _packed(e["t"], i - e["p"]))))
    texts = F.array(*(F.array(*map(F.lit, words)) for _, words, _ in kinds))
    keys = F.array(*(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in spans)) for _, _, spans in kinds))

    def judged(vote: Column) -> Column:
        t, at = _unpacked(vote)
        words = F.get(texts, t)
        covered = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: F.get("words", at + p) == F.get(words, p))
        stands = F.exists(F.get(keys, t), lambda k: F.when(at + k["a"] >= 0, F.slice("words", at + k["a"] + 1, k["n"]) == F.slice(words, k["a"] + 1, k["n"])).otherwise(False))
        return F.struct(t.alias("t"), covered.alias("covered"), stands.alias("key"))

    return F.transform(F.array_distinct(votes), judged)


def _labels(found: list[tuple[Column, str]]) -> Column:
    none = F.array().cast("array<string>")
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*(F.when(is_, F.array(F.lit(label))).otherwise(none) for is_, label in found))))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    words = docs.select(key, words_of(docs[text]).alias("words"))
    df = document_frequency(words)
    index = postings(df)
    looked_up = sorted({*index, *(by_rarity(p.split(), df)[0] for p in BASE)})
    every = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    rows = words.withColumn("hits", F.filter(every, lambda i: F.get("words", i).isin(looked_up)))
    none = F.array().cast("array<int>")
    base = [F.when(F.size("hits") > 0, _base_places(p.split(), df)).otherwise(none) for p in BASE]
    rows = rows.withColumn("base", F.array(*base))
    rows = rows.withColumn("judged", F.when(F.size("hits") > 0, _judged(index)).otherwise(F.array().cast("array<struct<t:int,covered:array<int>,key:boolean>>")))
    kinds = templates()
    named = [_named(t) for t in range(len(kinds))]
    share = [F.size(F.array_distinct(F.flatten(F.transform(F.filter("judged", _of(t)), lambda c: c["covered"])))) / len(k[1]) for t, k in enumerate(kinds)]
    rows = rows.select(key, F.size("words").cast("long").alias("n_words"), "base", F.array(*named).alias("named"), F.when(F.size("judged") > 0, F.array(*share)).otherwise(F.array().cast("array<double>")).alias("share"))
    places = F.flatten("base")
    base_found = [(F.size(F.col("base")[i]) > 0, label) for i, label in enumerate(BASE.values())]
    found = [(F.col("named")[t], k[0]) for t, k in enumerate(kinds)]
    weighed = F.array_max(F.transform("share", lambda s, t: F.when(F.get("named", t), s).otherwise(s / 2)))
    return rows.select(
        key,
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        _labels(base_found).alias("base_labels"),
        _labels(base_found + found).alias("labels"),
        F.when(functools.reduce(operator.or_, (is_ for is_, _ in base_found)), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(weighed, F.lit(0.0)))).alias("score"),
    )


def _of(t: int):
    return lambda c: c["t"] == t


def _named(t: int) -> Column:
    return F.exists("judged", lambda c: (c["t"] == t) & c["key"])


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
