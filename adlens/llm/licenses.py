"""License scan: ordered signature rules behind a keyword prefilter; a detection inside one of higher priority is
suppressed. DataFrame functions only; each row is worked on by itself, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import text_of
from adlens.llm.spans import let, placed

#: Words of the base phrases, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: label | keyword every text with the license must hold | expression for its name | SPDX expression | address
LICENSES = r"""
agpl|affero|(?:gnu )?affero general public licen[sc]e|agpl-?[0-9.]*(?:-only|-or-later|\+)?|gnu\.org/licenses/agpl
lgpl|lesser|(?:gnu )?lesser general public licen[sc]e|lgpl-?[0-9.]*(?:-only|-or-later|\+)?|gnu\.org/licenses/lgpl
lgpl|library general|(?:gnu )?library general public licen[sc]e|lgpl-2\.0|gnu\.org/licenses/old-licenses/lgpl
gpl|general public|(?:gnu )?general public licen[sc]e|gpl-?[0-9.]*(?:-only|-or-later|\+)?|gnu\.org/licenses/gpl
gpl|gpl|\bgnu gpl\b|gpl-[0-9](?:\.0)?|gnu\.org/copyleft/gpl
gfdl|free documentation|(?:gnu )?free documentation licen[sc]e|gfdl-[0-9.]+|gnu\.org/licenses/fdl
apache|apache|apache(?: software)? licen[sc]e|apache-[0-9.]+|apache\.org/licenses
mit|mit|\b(?:the )?mit(?:/x11| style|-style)? licen[sc]e|mit|opensource\.org/licen[sc]es?/mit
mit|expat|expat licen[sc]e|mit-0|jclark\.com/xml/copying
mit|permission is hereby|permission is hereby granted, free of charge|mit-modern-variant|mit-license\.org
x11|x11|\bx11 licen[sc]e|x11|x\.org/downloads/terms
bsd-2-clause|bsd|(?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e|bsd-2-clause|opensource\.org/licen[sc]es?/bsd-2-clause
bsd-3-clause|bsd|(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e|bsd-3-clause|opensource\.org/licen[sc]es?/bsd-3-clause
bsd-4-clause|bsd|(?:original|old|4-clause|four-clause) bsd licen[sc]e|bsd-4-clause|directory\.fsf\.org/wiki/license:bsd-4clause
bsd|bsd|\bbsd(?:-style| style)? licen[sc]e|0bsd|opensource\.org/licen[sc]es?/bsd-license
bsd|redistribution|redistribution and use in source and binary forms|bsd-source-code|freebsd\.org/copyright
isc|isc|\bisc licen[sc]e|isc|opensource\.org/licen[sc]es?/isc
mpl|mozilla|mozilla public licen[sc]e|mpl-[0-9.]+|mozilla\.org/(?:[a-z-]+/)?mpl
epl|eclipse|eclipse public licen[sc]e|epl-[0-9.]+|eclipse\.org/legal/epl
edl|eclipse|eclipse distribution licen[sc]e|edl-1\.0|eclipse\.org/org/documents/edl
cddl|cddl|\bcddl\b|cddl-[0-9.]+|opensource\.org/licen[sc]es?/cddl
cddl|common development|common development and distribution licen[sc]e|cddl-1\.1|oss\.oracle\.com/licenses/cddl
cpl|common public|common public licen[sc]e|cpl-1\.0|opensource\.org/licen[sc]es?/cpl
ipl|ibm public|ibm public licen[sc]e|ipl-1\.0|opensource\.org/licen[sc]es?/ibmpl
eupl|european union|european union public licen[sc]e|eupl-[0-9.]+|joinup\.ec\.europa\.eu/[a-z/]*eupl
eupl|eupl|\beupl\b|eupl-1\.1|ec\.europa\.eu/idabc/eupl
cecill|cecill|\bcecill(?:-[abc])?\b|cecill-[0-9a-c.]+|cecill\.info/licences
artistic|artistic|artistic licen[sc]e|artistic-[0-9.]+|perlfoundation\.org/artistic
perl|perl|same terms as perl(?: itself)?|artistic-1\.0-perl|dev\.perl\.org/licenses
python|python|python software foundation licen[sc]e|(?:psf|python)-[0-9.]+|python\.org/psf/license
php|php|php licen[sc]e|php-3\.[0-9]+|php\.net/license
ruby|ruby|ruby(?:'s)? licen[sc]e|ruby|ruby-lang\.org/en/about/license
zlib|zlib|zlib(?:/libpng)? licen[sc]e|zlib|zlib\.net/zlib_license
libpng|libpng|libpng licen[sc]e|libpng(?:-2\.0)?|libpng\.org/pub/png/src/libpng-license
openssl|openssl|openssl licen[sc]e|openssl|openssl\.org/source/license
boost|boost|boost software licen[sc]e|bsl-1\.0|boost\.org/license_1_0
unlicense|unlicense|\b(?:the )?unlicense\b|unlicense|unlicense\.org
unlicense|unencumbered|free and unencumbered software|unlicense-libtelnet|choosealicense\.com/licenses/unlicense
wtfpl|wtfpl|\bwtfpl\b|wtfpl|wtfpl\.net
wtfpl|what the|do what the f[a-z*]+ you want to public licen[sc]e|wtfpl-2\.0|sam\.zoy\.org/wtfpl
afl|academic free|academic free licen[sc]e|afl-[0-9.]+|opensource\.org/licen[sc]es?/afl
osl|open software|open software licen[sc]e|osl-[0-9.]+|opensource\.org/licen[sc]es?/osl
ms-pl|microsoft public|microsoft public licen[sc]e|ms-pl|opensource\.org/licen[sc]es?/ms-pl
ms-rl|microsoft reciprocal|microsoft reciprocal licen[sc]e|ms-rl|opensource\.org/licen[sc]es?/ms-rl
apsl|apple public|apple public source licen[sc]e|apsl-[0-9.]+|opensource\.apple\.com/apsl
ofl|open font|(?:sil )?open font licen[sc]e|ofl-1\.[01]|scripts\.sil\.org/ofl
ncsa|illinois|university of illinois(?:/ncsa)? open source licen[sc]e|ncsa|otm\.illinois\.edu/uiuc_openSource
postgresql|postgresql|postgresql licen[sc]e|postgresql|postgresql\.org/about/licence
vim|vim|vim licen[sc]e|vim|vimdoc\.sourceforge\.net/htmldoc/uganda
w3c|w3c|w3c software (?:notice and )?licen[sc]e|w3c(?:-[0-9]+)?|w3\.org/consortium/legal
sspl|server side|server side public licen[sc]e|sspl-1\.0|mongodb\.com/licensing/server-side-public-license
busl|business source|business source licen[sc]e|busl-1\.1|mariadb\.com/bsl
elastic|elastic|elastic licen[sc]e|elastic-2\.0|elastic\.co/licensing/elastic-license
upl|universal permissive|universal permissive licen[sc]e|upl-1\.0|oss\.oracle\.com/licenses/upl
odbl|open database|open (?:data commons )?(?:open )?database licen[sc]e|odbl-1\.0|opendatacommons\.org/licenses/odbl
odc-by|open data commons|open data commons attribution licen[sc]e|odc-by-1\.0|opendatacommons\.org/licenses/by
pddl|public domain dedication|(?:open data commons )?public domain dedication and licen[sc]e|pddl-1\.0|opendatacommons\.org/licenses/pddl
cc0|cc0|\bcc0(?: [0-9.]+)?\b|cc0-1\.0|creativecommons\.org/publicdomain/zero
cc-by-nc-nd|by-nc-nd|\bcc[ -]by-nc-nd\b|cc-by-nc-nd-[0-9.]+|creativecommons\.org/licenses/by-nc-nd
cc-by-nc-sa|by-nc-sa|\bcc[ -]by-nc-sa\b|cc-by-nc-sa-[0-9.]+|creativecommons\.org/licenses/by-nc-sa
cc-by-nc|by-nc|\bcc[ -]by-nc\b|cc-by-nc-[0-9.]+|creativecommons\.org/licenses/by-nc
cc-by-nd|by-nd|\bcc[ -]by-nd\b|cc-by-nd-[0-9.]+|creativecommons\.org/licenses/by-nd
cc-by-sa|by-sa|\bcc[ -]by-sa\b|cc-by-sa-[0-9.]+|creativecommons\.org/licenses/by-sa
cc-by|cc|\bcc[ -]by\b|cc-by-[0-9.]+|creativecommons\.org/licenses/by
cc-by|creative commons|creative commons attribution|cc-by|creativecommons\.org/licenses
public-domain|public domain|(?:placed|released|is) (?:in|into|to) the public domain|cc-pddc|creativecommons\.org/publicdomain/mark
proprietary|all rights reserved|all rights reserved|licenseref-(?:proprietary|commercial)|(?:www\.)?[a-z0-9.-]+/eula
"""

#: Before a short name: a field or phrase that says what it is, and other names set beside it.
_ONE = r"[a-z0-9.+-]{{1,24}}[ \t]{{0,2}}(?:/|,|\bor\b|\band\b|\bwith\b)[ \t]{{0,2}}\(?"
_BESIDE = ("(?:" + _ONE) * 4 + ")?" * 4  # written out, as what stands before a place must have a greatest length
_SAID = r"(?:licen[sc]e[sd]?(?: under| as)?(?: the)?[:=]?|licen[sc]e ?(?:identifier|type|name)[:=])"
_GIVEN = r"(?:released|distributed|published|available|provided) under(?: the)?"
_ID = r"(?:{spdx})(?:-only|-or-later|\+)?(?![a-z0-9+-]|\.[a-z0-9])"

#: Forms in which a license is named: expression, priority, certainty. A short name counts alone, so that each of several that stand
#: side by side is found; what has to stand before it is looked at only where the name itself is met.
FORMS = (
    ("(?=" + _ID + r")(?<=spdx-license-identifier:[ \t]{{0,3}}\(?" + _BESIDE + ")" + _ID, 5, 0.99),
    ("(?=" + _ID + ")(?<=" + _SAID + r"[ \t\"'(]{{1,3}}" + _BESIDE + ")" + _ID, 4, 0.9),
    ("(?=" + _ID + ")(?<=" + _GIVEN + r"[ \t\"'(]{{1,3}}" + _BESIDE + ")" + _ID, 4, 0.85),
    (r"spdx-license-identifier:[ \t]*(?:{spdx})(?![a-z0-9.+-])", 5, 0.99),
    (r"https?://(?:www\.)?{address}[a-z0-9._/-]*", 4, 0.95),
    (r"(?:licen[sc]ed|made available|released|distributed|published|provided) (?:under|by|with)(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)? {name}(?:,? v(?:ersion|\.)? ?[0-9.]+)?", 3, 0.9),
    (r"{name}(?:,? (?:v(?:ersion|\.)? ?[0-9]+(?:\.[0-9]+)*|[0-9]+\.[0-9]+))(?: or (?:any )?later(?: version)?)?", 2, 0.8),
    (r"{name}", 1, 0.7),
)
BASE_CERTAINTY = 0.6

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of these stands in every text that a rule or a base phrase can match, lower-cased.
_HINTS = ("licen", "released under", "distributed under", "published under", "available under", "provided under", "spdx", "creativecommons", "creative commons", "public domain", "publicdomain", "same terms as perl", "permission is hereby", "redistribution and use", "unencumbered", "all rights reserved", "gpl", "cddl", "eupl", "cecill", "wtfpl", "cc0", "http")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, expression, priority, certainty), the most telling first."""
    out = []
    for form, priority, certainty in FORMS:
        for line in LICENSES.strip().splitlines():
            label, keyword, name, spdx, address = line.split("|") if line.count("|") == 4 else _fields(line)
            gate = "spdx-license" if priority == 5 else "http" if form.startswith("http") else "licen" if _SAID in form else " under" if _GIVEN in form else keyword
            out.append((label, gate, form.format(name=f"(?:{name})", spdx=spdx, address=f"(?:{address})"), priority, certainty))
    return out


def _fields(line: str) -> tuple[str, str, str, str, str]:
    """The five fields; bars inside brackets belong to an expression."""
    out, depth = [""], 0
    for c in line:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return tuple(out)  # type: ignore[return-value]


_FOUND = "array<struct<s:bigint,e:bigint,p:int,r:int,label:string,w:double>>"


def detections(low: Column) -> Column:
    """The detections in a lower-cased text that no other suppresses, by rule."""
    table = F.array(*[F.struct(F.lit(k).alias("r"), F.lit(a).alias("label"), F.lit(b).alias("kw"), F.lit(c).alias("re"), F.lit(d).alias("p"), F.lit(e).alias("w")) for k, (a, b, c, d, e) in enumerate(rules())])

    def run(r: Column) -> Column:
        return F.transform(placed(low, r["re"]), lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), r["p"].alias("p"), r["r"].alias("r"), r["label"].alias("label"), r["w"].alias("w")))

    def hides(y: Column, x: Column) -> Column:
        longer = (y["e"] - y["s"]) > (x["e"] - x["s"])
        return (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & ((y["p"] > x["p"]) | (y["p"] == x["p"]) & (longer | (y["e"] - y["s"] == x["e"] - x["s"]) & (y["r"] < x["r"])))

    found = F.flatten(F.transform(F.filter(table, lambda r: F.contains(low, r["kw"])), run))
    return let(found, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: hides(y, x))))


def _places(words: Column, phrase: str) -> Column:
    """Starts, in words, of a phrase."""
    parts = phrase.split()
    n = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            same &= F.get(words, i + k) == w
        return same

    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Only A-Z are lower-cased. Null and empty texts have no words and no labels, and score 0. Repeated rows and null
    ids come back as they are; an empty table gives an empty result; other columns are not read.
    """
    text = text_of(text_col)
    lower = F.lower(text)
    hint = F.contains(lower, F.lit(_HINTS[0]))
    for h in _HINTS[1:]:
        hint |= F.contains(lower, F.lit(h))
    hint |= F.contains(lower, F.lit("cc")) & text.rlike(rf"(?i)(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])cc{_GAP}by(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])")
    low = F.translate(text, _UPPER, _LOWER)

    def read(t: Column) -> Column:
        def of(words: Column) -> Column:
            return F.struct(*[_places(words, p).alias(f"b{k}") for k, (p, _) in enumerate(PHRASES)])

        return F.struct(let(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)), of).alias("base"), detections(t).alias("found"))

    kind = "struct<base:struct<" + ",".join(f"b{k}:array<int>" for k in range(len(PHRASES))) + f">,found:{_FOUND}>"
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(_ANY_CASE_WORD)).cast("long").alias("n_words"),
        F.when(hint, let(low, read).cast(kind)).alias("x"),
    )
    places = [F.coalesce(F.col(f"x.base.b{k}"), F.array().cast("array<int>")) for k in range(len(PHRASES))]
    every = F.concat(*places)
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, PHRASES, strict=True)]))
    found = F.coalesce("x.found", F.array().cast(_FOUND))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform(found, lambda x: x["label"])))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(found, lambda x: x["w"])), F.lit(0.0)), F.when(F.size(every) > 0, BASE_CERTAINTY).otherwise(0.0)).alias("score"),
    )
