"""Personal data in texts: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only; each row is worked on by itself, without a shuffle. Repetitions are possessive where the
expression could not give anything back, so that long runs cost neither stack nor quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import text_of
from adlens.llm.spans import placed

#: Characters before and behind a span in which a context word counts.
WINDOW = 48
#: Spans beyond the base kinds are reported from this score on.
MIN_SCORE = 0.5


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an IBAN, spaces allowed, leaves remainder 1 on division by 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def octets(m: Column) -> Column:
    def small(x: Column) -> Column:
        plain = F.regexp_replace(x, "^0+", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), small)


@dataclass(frozen=True)
class Kind:
    """gate: what a text must hold for the expression to be run; ok: the validator; prior: the score of a confirmed
    span; context: words that add `boost` when they stand shortly before or behind it."""

    name: str
    gate: Callable[[Column], Column]
    regex: str
    ok: Callable[[Column], Column]
    prior: float
    context: str
    boost: float
    base: bool = True


def _between(m: Column, least: int, most: int) -> Column:
    return F.length(digits(m)).between(least, most)


KINDS = (
    Kind("email", lambda t: F.contains(t, F.lit("@")), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, r"(?i)mail|contact|write|address", 0.1),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", octets, 0.7, r"(?i)\bip\b|host|server|address", 0.3),
    Kind("card", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"), r"[0-9](?:[\x20-]?[0-9])++", lambda m: _between(m, 14, 19) & luhn(digits(m)), 0.7, r"(?i)card|visa|credit|debit|pay", 0.3),
    Kind("phone", lambda t: t.rlike(r"\+[0-9]"), r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _between(m, 10, 15), 0.6, r"(?i)phone|call|tel|mobile|fax", 0.4),
    Kind("iban", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod97, 0.8, r"(?i)iban|account|bank|konto|compte|cuenta", 0.2, False),
    Kind("ssn", lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]{4}"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000"), 0.3, r"(?i)ssn|social security|tax", 0.5, False),
    Kind("secret", lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{16,}+", lambda m: m.rlike("[0-9]"), 0.8, r"(?i)auth|access|login", 0.2, False),
)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one array<struct<start, k, kind, end, score>> column `pii` of all spans, by start, then kind.

    Ends are exclusive; places count code points. Null and empty texts have none. Every base match that its validator
    confirms is kept, whatever its score; the others from MIN_SCORE on. An existing column `pii` is replaced.
    """
    text = text_of(text_col)

    def score(kind: Kind, s: Column, e: Column) -> Column:
        before = F.substring(text, F.greatest(s - WINDOW + 1, F.lit(1)), F.least(s, F.lit(WINDOW)))
        behind = F.substring(text, e + 1, F.lit(WINDOW))
        return F.lit(kind.prior) + F.when(before.rlike(kind.context) | behind.rlike(kind.context), kind.boost).otherwise(0.0)

    def spans(k: int, kind: Kind) -> Column:
        def one(x: Column) -> Column:
            return F.struct(x["s"].alias("start"), F.lit(k).alias("k"), F.lit(kind.name).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"), score(kind, x["s"].cast("int"), (x["s"] + F.length(x["m"])).cast("int")).alias("score"))

        found = F.transform(placed(text, kind.regex, kind.ok), one)
        found = found if kind.base else F.filter(found, lambda x: x["score"] >= MIN_SCORE)
        return F.when(kind.gate(text), found).otherwise(F.array().cast("array<struct<start:bigint,k:int,kind:string,end:bigint,score:double>>"))

    each = [spans(k, kind) for k, kind in enumerate(KINDS)]
    return docs.drop("pii").withColumn("pii", F.array_sort(F.concat(*each)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _is(k: int) -> Callable[[Column], Column]:
    return lambda x: x["k"] == k


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the counts of the base kinds, base_sha256, spans, max_score (null: no span).

    Repeated rows and null ids come back as they are; an empty table gives an empty result; other columns are not
    read.
    """
    found = find(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    base = F.filter("pii", lambda x: x["k"] < 4)
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{kind.name}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda x: x["score"])).alias("max_score"))
