"""Text functions on Columns; X2 alone needs Python (Spark has no compatibility decomposition)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def js_regex(source: str, flags: str = "") -> str:
    """A pattern with ASCII word edges and Unicode white space, as the rule tables mean them."""
    flags = "".join(x for x in flags if x in "im")
    return (f"(?{flags})" if flags else "") + source.replace(r"\b", _EDGE).replace(r"\s", r"[\s\x{A0}\x{FEFF}\x{2028}\x{2029}]").replace(r"\S", r"[^\s\x{A0}\x{FEFF}\x{2028}\x{2029}]")


def collapse(s: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"[\s\x{A0}\x{FEFF}\x{2028}\x{2029}]+", " "))


_ACCENTS = re.compile("[\u0300-\u036f]+")


def without_accents(x: str) -> str:
    """x decomposed for compatibility, its combining marks gone."""
    return x if x.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFKD", x))


def _decompose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else without_accents(x))


def _fold(s: Column) -> Column:
    return F.pandas_udf(_decompose, "string")(s)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(s: Column, mark: str = "") -> Column:
    """Lower case, marks stripped, plain quotes, a small set of characters, white space collapsed. mark: a control
    character that stays."""
    plain = F.translate(_fold(F.lower(s)), "’‘`“”", "'''\"\"")
    return collapse(F.regexp_replace(plain, rf"[^a-z0-9%$\x{{A3}}\x{{20AC}}'\".,!?/+\-\s{mark}]", " "))


def tokenise(normalised: Column) -> Column:
    """X3."""
    return F.filter(F.split(normalised, "[^a-z0-9'+-]+"), lambda t: F.length(t) > 1)


def token_count(normalised: Column) -> Column:
    """The size of X3, counted in place: a token is a whole run of two characters and more."""
    return F.regexp_count(normalised, F.lit("[a-z0-9'+-]{2,}"))


def count_term(normalised: Column, term: Column | str) -> Column:
    """Whole-word occurrences of a normalised term; its spaces match any white space."""
    term = F.lit(term) if isinstance(term, str) else term
    quoted = F.regexp_replace(F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"\\s+")
    return F.when(F.length(term) > 0, F.regexp_count(normalised, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))).otherwise(0)


def sentences(s: Column) -> Column:
    """Cut after . ! ? or an ellipsis before a capital, digit, quote or bracket."""
    return F.filter(F.transform(F.split(collapse(s), "(?<=[.!?…])\\s+(?=[A-Z0-9\"'“‘(])"), F.trim), lambda x: x != "")


def truncate(s: Column, most: int) -> Column:
    """X6."""
    clean = collapse(s)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, max(0, most - 1))), F.lit("…")))


def syllables(word: Column) -> Column:
    """X7."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.regexp_count(stem, F.lit("[aeiouy]{1,2}")), F.lit(1)))


def words(s: Column) -> Column:
    return F.filter(F.split(collapse(s), " "), lambda w: w != "")


def word_count(s: Column) -> Column:
    """X9."""
    return F.size(words(s))


def reading_ease(s: Column) -> Column:
    """X8, with the sums of A36; 0 for a text without a word or sentence."""

    def judge(x: Column) -> Column:
        n, total, lines = x["words"], x["syllables"], x["lines"]
        score = F.lit(206.835) - F.lit(1.015) * (n / lines) - F.lit(84.6) * (total / n)
        return F.when((n == 0) | (lines == 0), 0.0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)) + 0.5).cast("double"))

    return let(F.pandas_udf(_lengths, "words int, syllables int, lines int")(s), judge)


_SPACES = re.compile(r"[ \t\n\x0b\f\r\u00a0\ufeff\u2028\u2029]+")
_STOP = re.compile("(?<=[.!?…])[ \t\n\x0b\f\r]+(?=[A-Z0-9\"'“‘(])")
_NO_LETTER, _SILENT, _VOWELS = re.compile("[^a-z]"), re.compile("(?:[^laeiouy]es|ed|[^laeiouy]e)$"), re.compile("[aeiouy]{1,2}")
#: Distinct words that a batch remembers the syllables of.
_KNOWN = 100_000


def _syllables(word: str) -> int:
    """`syllables` of a word with a letter, 0 of one without."""
    if not re.search("[A-Za-z]", word):
        return 0
    w = _NO_LETTER.sub("", word.lower())
    stem = _SILENT.sub("", w)
    return 1 if len(w) <= 3 else max(1, len(_VOWELS.findall(stem[1:] if stem.startswith("y") else stem)))


def _lengths(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of each text the words with a letter, their syllables, and the sentences; null for a null text."""
    known: dict[str, int] = {}
    for s in batches:
        rows = []
        for x in s:
            if x is None:
                rows.append((None, None, None))
                continue
            clean = _SPACES.sub(" ", x).strip(" ")
            n = total = 0
            for w in clean.split(" "):
                k = known.get(w)
                if k is None:
                    if len(known) > _KNOWN:
                        known.clear()
                    k = known[w] = _syllables(w)
                n += k > 0
                total += k
            lines = sum(1 for y in _STOP.split(clean) if y.strip(" "))
            rows.append((n, total, lines))
        yield pd.DataFrame(rows, columns=["words", "syllables", "lines"], dtype="Int32")


def title_case(s: Column) -> Column:
    """The first letter of every run of characters that starts at a word character."""
    piece = F.regexp_extract_all(s, F.lit(r"\w\S*|[^\w]+"), F.lit(0))
    return F.array_join(F.transform(piece, lambda x: F.when(x.rlike(r"^\w"), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))).otherwise(x)), "")


def escape_html(s: Column) -> Column:
    """X12."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def format_count(v: Column) -> Column:
    """1.2M, 3.4k, 56."""
    return F.when(v >= 1e6, F.format_string("%.1fM", v / 1e6)).when(v >= 1e3, F.format_string("%.1fk", v / 1e3)).otherwise(F.floor(v + 0.5).cast("string"))


def parse_count(s: Column) -> Column:
    """12.4k, 1,200, 2m; 0 for anything else."""
    clean = F.regexp_replace(F.lower(s), r"[,\s]", "")
    scale = F.regexp_extract(clean, r"^[\d.]+([km])?$", 1)
    number = F.regexp_extract(clean, r"^([\d.]+)[km]?$", 1).try_cast("double")
    return F.coalesce(F.floor(number * F.when(scale == "k", 1000).when(scale == "m", 1_000_000).otherwise(1) + 0.5).cast("double"), F.lit(0.0))


def first_number(s: Column, pattern: str) -> Column:
    """Group 1 of the first match as a number, commas dropped; null if there is none."""
    return F.replace(F.regexp_extract(s, pattern, 1), F.lit(","), F.lit("")).try_cast("double")


def product_name(s: Column) -> Column:
    """whether a link text looks like a product's name."""
    clean = collapse(s)
    menu = clean.rlike("(?i)^(home|shop|cart|menu|search|login|account|about|contact|blog|faq|sale|new|all)$")
    call = clean.rlike("(?i)(add to cart|view all|learn more|read more|shop now|see all|sign up|subscribe)")
    return F.length(clean).between(3, 90) & clean.rlike("[A-Za-z]") & ~menu & ~call


def useful_query(s: Column, brand: Column) -> Column:
    """F8: whether a product's name is worth a search of its own."""
    clean = collapse(s)
    return F.length(clean).between(4, 60) & (F.lower(clean) != F.lower(brand)) & ~clean.rlike("(?i)^(gift card|e-?gift|sample|bundle|subscription|shop all|all products)")


def gram_tokens(sentence: Column) -> Column:
    """The tokens of a normalised sentence, thousands separators joined."""
    return F.filter(F.split(F.regexp_replace(sentence, r"(?<=\d),(?=\d{3}(?![A-Za-z0-9_]))", ""), "[^a-z0-9'+-]+"), lambda t: t != "")


def ngrams(tokens: Column, most: int, stop: list[str]) -> Column:
    """The 1..most-grams of a sentence's tokens. None has a stop word at an edge or ends in a number;
    a single token must be usable (two characters, not a number), a longer one must hold a usable token."""
    stops = F.array(*[F.lit(x) for x in stop])

    def usable(t: Column) -> Column:
        return (F.length(t) >= 2) & ~t.rlike(r"^\d+$")

    def good(g: Column) -> Column:
        first, last = F.element_at(g, 1), F.element_at(g, -1)
        return ~F.array_contains(stops, first) & ~F.array_contains(stops, last) & ~last.rlike(r"^\d+$") & F.exists(g, usable)

    def of(own: Column, n: int) -> Column:
        at = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(F.transform(at, lambda i: F.slice(own, i, n)), good), lambda g: F.array_join(g, " "))

    # The tokens are an expression: bound once, not worked out again for every gram.
    return let(tokens, lambda own: F.flatten(F.array(*[of(own, n) for n in range(1, most + 1)])))


def company_name(s: Column) -> Column:
    """A company's name in lower case without its legal form, marks or punctuation."""
    from adlens.dims.rules import LEGAL_FORMS

    bare = F.regexp_replace(F.lower(s), rf"(?i)[,\s]+(?:{LEGAL_FORMS})\s*$", "")
    return collapse(F.regexp_replace(F.regexp_replace(bare, "[®™©]", ""), "[^a-z0-9]+", " "))


def names_match(a: Column, b: Column) -> Column:
    """Equal after folding, spaces aside; never for an empty name."""
    x, y = (F.replace(company_name(c), F.lit(" "), F.lit("")) for c in (a, b))
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def anchor_quality(s: Column) -> Column:
    """How much a link text looks like a brand's name: -6 .. 14."""
    from adlens.dims.rules import GENERIC_ANCHORS

    clean = collapse(s)
    n = word_count(s)
    points = (
        F.lit(6) + F.when(n <= 4, 4).otherwise(0) + F.when(clean.rlike("^[A-Z0-9]"), 3).otherwise(0)
        + F.when(clean.rlike("^.+[A-Z]"), 1).otherwise(0) - F.when(clean.rlike("[.!?]$"), 3).otherwise(0)
    )
    return F.when(clean == "", -4).when(clean.rlike(f"(?i){GENERIC_ANCHORS}"), -6).when(n > 8, -2).otherwise(points)


def session_id(s: Column) -> Column:
    """A label reduced to the characters a session id may hold, 50 at most, never empty."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(s, r"[^\w._~]+", "_"), "^_+|_+$", ""), 1, 50)
    return F.when(clean == "", "session").otherwise(clean)


def defined(values: Column) -> Column:
    """an array without its nulls."""
    return F.array_compact(values)
