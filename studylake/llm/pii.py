"""Personal data with built-in functions alone: patterns propose, checksums confirm, words nearby adjust the score.

Each kind has a pattern that proposes spans from left to right. Where a checksum is known it decides: Luhn for
cards, modulo 97 for bank accounts (IBAN). Every candidate has a score from its kind, its checksum and the words
beside it: words that speak for the kind raise it, words that speak against any kind (versions, orders, amounts)
lower it. The base kinds (email, ip, card, phone) stay whatever their score. The further kinds need LEAST_SCORE:

- iban: country, two check digits and 11 to 30 letters or digits; the checksum suffices;
- ssn: 3-2-4 digits of an area that exists; needs a word nearby;
- local: a phone number without a country code, of 7 to 11 digits in groups; needs a word nearby.

An ssn or a local number that overlaps a base span is no span of its own. Words nearby are those within NEARBY
characters, as far as the next candidate of the same kind.

A text is split at a pattern's matches; what lies between gives their places. Only the lengths of candidates and
of what lies between are shuffled, by row, and added up along a row; texts never move. Patterns give back nothing
(possessive) and start only where a run of their characters starts, so they take linear time on any text.

Defined results: a null text is an empty one, without spans; rows are kept as they come, repeated ones and null
keys too; places are code points of the whole text; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, text_or_empty

NEARBY = 48
LEAST_SCORE = 0.5
FOR, AGAINST = 0.4, 0.3  # what a word nearby adds or takes

#: Words that speak against personal data, in four languages.
CONTRARY = r"\b(?:version|release|order|invoice|isbn|issn|article|chapter|section|page|line|row|total|price|usd|eur|bestellung|rechnung|commande|facture|pedido|factura)\b"


@dataclass(frozen=True)
class Kind:
    """marks: a text without these characters has no match; score: before words nearby count."""

    name: str
    pattern: str
    marks: str
    score: float
    words: str
    base: bool = False


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"\b(?:e-?mail|mail|contact|kontakt|write|courriel|correo)\b", base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", 0.6, r"\b(?:ip|address|host|server|login|client|adresse|direcci)", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.7, r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", 0.7, r"\b(?:phone|tel|call|mobile|cell|fax|telefon|t.l.phone|tel.fono)\b", base=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.8, r"\b(?:iban|account|bank|bic|konto|compte|cuenta)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.2, r"\b(?:ssn|social security|taxpayer)\b"),
    Kind("local", r"(?<![0-9+(.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}+(?![0-9.-])", "[0-9]", 0.2, r"\b(?:phone|tel|call|mobile|cell|fax|telefon|t.l.phone|tel.fono)\b"),
)
IBAN = 4
BASE = [k.name for k in KINDS if k.base]
CODES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(digits: Column) -> Column:
    """Whether the last of at most 19 digits is the Luhn check digit of those before."""
    back, total = F.reverse(digits), F.lit(0)
    for i in range(19):
        d = F.greatest(F.ascii(F.substring(back, i + 1, 1)) - ord("0"), F.lit(0))  # nothing is 0
        total = total + (d * 2 - F.when(d > 4, 9).otherwise(0) if i % 2 else d)
    return total % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 when it is read as digits (A is 10), its first four characters last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    code = lambda i: F.instr(F.lit(CODES), F.substring(turned, i, F.lit(1))) - 1
    left = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda r, i: (r * F.when(code(i) > 9, 100).otherwise(10) + code(i)) % 97)
    return left == 1


def _digits() -> Column:
    return F.regexp_replace("hit", "[^0-9]", "")


def _account(hit: Column | str) -> Column:
    return F.replace(F.col(hit) if isinstance(hit, str) else hit, F.lit(" "))


def _shorter() -> Column:
    """An account number without its last group, which may be a word that follows."""
    return F.regexp_replace("hit", r"\x20[A-Z0-9]+$", "")


def _valid(kind: str) -> Column:
    """What a candidate of the kind must fulfil beside its pattern."""
    digits, n = _digits(), F.length(_digits())
    if kind == "ip":
        parts = F.transform(F.split("hit", r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod_97(_account("hit")) | mod_97(_account(_shorter()))
    if kind == "ssn":
        return ~F.col("hit").rlike("^(?:000|666|9..)|-00-|-0000$")
    if kind == "local":
        return n.between(7, 11)
    return F.lit(True)


def _of(kind: int):
    return lambda z, n: F.struct(F.lit(kind).alias("kind"), n.alias("number"), z["hit"].alias("hit"), z["before"].alias("before"), z["after"].alias("after"))


def candidates(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each candidate: its keys, kind (place in KINDS), number within kind and row, gap (length since the one before), size, taken (of which the span takes so much), ok and score.

    Rows without any candidate give one with a null kind. docs: keys and a text without nulls.
    """
    split = docs
    for k in KINDS:
        may = F.contains(F.col("text"), F.lit(k.marks)) if k.marks == "@" else F.col("text").rlike(k.marks)
        none = F.array().cast("array<string>")
        split = split.withColumns({f"__gaps_{k.name}": F.when(may, F.split("text", k.pattern, -1)).otherwise(none), f"__hits_{k.name}": F.when(may, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none)})
    found = []
    for i, k in enumerate(KINDS):
        gaps, hits = F.col(f"__gaps_{k.name}"), F.col(f"__hits_{k.name}")
        zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("before"), F.slice(gaps, F.lit(2), F.size(hits)).alias("after"))
        found.append(F.transform(zipped, _of(i)))
    rows = split.select(*keys, F.explode_outer(F.concat(*found)).alias("c")).select(*keys, "c.*")
    near = F.concat(F.right("before", F.lit(NEARBY)), F.lit(" | "), F.left("after", F.lit(NEARBY)))
    rows = rows.withColumn("near", F.lower(near))
    ok, score = F.lit(False), F.lit(0.0)
    for i, k in enumerate(KINDS):
        ok = F.when(F.col("kind") == i, _valid(k.name)).otherwise(ok)
        score = F.when(F.col("kind") == i, F.lit(k.score) + F.when(F.col("near").rlike(k.words), FOR).otherwise(0.0)).otherwise(score)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score - F.when(F.col("near").rlike(CONTRARY), AGAINST).otherwise(0.0)))
    return rows.select(*keys, "kind", "number", F.length("before").alias("gap"), F.length("hit").alias("size"), F.when((F.col("kind") == IBAN) & ~mod_97(_account("hit")), F.length(_shorter())).otherwise(F.length("hit")).alias("taken"), ok.alias("ok"), score.alias("score"))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_<base kind>, base_sha256, spans and scores (of the spans, in thousandths) of each row."""
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = candidates(rows, ["key", "row"]).repartition("row")
    along = W.partitionBy("row", "kind").orderBy("number")
    rows = rows.withColumn("start", F.sum(F.col("gap") + F.col("size")).over(along) - F.col("size")).withColumn("end", F.col("start") + F.col("taken"))
    base = F.col("ok") & (F.col("kind") < len(BASE))
    # the greatest end of base spans that begin no later, and the least beginning of those that begin later
    so_far = W.partitionBy("row").orderBy("start")
    later = W.partitionBy("row").orderBy(F.col("start").desc())
    rows = rows.withColumn("base", F.coalesce(base, F.lit(False)))
    rows = rows.withColumn("covered", F.max(F.when(F.col("base"), F.col("end"))).over(so_far)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(later))
    free = F.coalesce(F.col("covered") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    further = F.col("ok") & (F.col("kind") >= len(BASE)) & (F.col("score") >= LEAST_SCORE) & ((F.col("kind") == IBAN) | free)
    span = F.struct("start", "kind", "end", F.round(F.col("score") * 1000).cast("int").alias("score"))
    spans = F.array_sort(F.collect_list(F.when(F.col("base") | further, span)))
    counts = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{name}") for i, name in enumerate(BASE)]
    out = rows.groupBy("row", F.col("key")).agg(*counts, spans.alias("found"))
    return out.select(
        F.col("key").alias(key),
        *(f"n_{name}" for name in BASE),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op11_pii(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
