"""Where the matches of a regular expression lie in a text, as DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def placed(text: Column, regex: Column | str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<m string, s bigint>>: the non-overlapping matches, leftmost first, and their starts in code points.

    keep: which matches to return. The starts come from the lengths of the matches and of what lies between them,
    summed in blocks, so that a long text with very many matches stays near linear. The expression must not match
    the empty string.
    """
    regex = F.lit(regex) if isinstance(regex, str) else regex

    def starts(m: Column, g: Column) -> Column:
        lengths = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))

        def of(each: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(each) / _BLOCK).cast("int")), lambda k: _total(F.slice(each, k * _BLOCK + 1, _BLOCK)))

            def at(whole: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    k = F.floor(i / _BLOCK).cast("int")
                    before = _total(F.slice(whole, 1, k)) + _total(F.slice(each, k * _BLOCK + 1, i % _BLOCK))
                    return F.struct(x.alias("m"), (before + F.length(F.get(g, i))).alias("s"))

                found = F.transform(m, one)
                return F.filter(found, lambda x: keep(x["m"])) if keep else found

            return let(blocks, at)

        return let(lengths, of)

    none = F.array().cast("array<struct<m:string,s:bigint>>")
    return let(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, regex, -1), lambda g: starts(m, g))))
