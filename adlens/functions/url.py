"""URL functions. Cleaning needs a full parser, so X40 and X44 run in Arrow batches; the rest are Columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.functions.text import js_regex

_TRACKING, _LANDING = re.compile(rules.TRACKING, re.I), re.compile(rules.LANDING_TRACKING, re.I)


def clean(raw: str | None, base: str | None = None, landing: bool = False) -> str | None:
    """An absolute http(s) address without fragment and tracking parameters, or None. landing: host without www, sorted
    parameters, no slash at the end."""
    try:
        u = urlsplit(urljoin(base, raw.strip()) if base else (raw or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except (ValueError, AttributeError):
        return None
    if u.scheme.lower() not in ("http", "https") or not host or " " in host:
        return None
    host = host.removeprefix("www.") if landing else host
    place = host + (f":{port}" if port and port != {"http": 80, "https": 443}[u.scheme.lower()] else "")
    drop = _LANDING if landing else _TRACKING
    pairs = parse_qsl(u.query, keep_blank_values=True)
    left = [(k, v) for k, v in pairs if not drop.match(k)]
    query = quote(u.query, safe="%/:?@!$&'()*+,;=-._~[]|{}") if len(left) == len(pairs) and not landing else urlencode(sorted(left, key=lambda x: x[0]) if landing else left)
    path = quote(u.path, safe="%/:@!$&'()*+,;=-._~[]|") or "/"
    if landing and len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    return urlunsplit((u.scheme.lower(), place, path, query, ""))


def _clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raw, base in batches:
        yield pd.Series([clean(r, b) for r, b in zip(raw, base, strict=True)], dtype=object)


def _landing(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda r: clean(r, None, True))


def normalise_url(raw: Column, base: Column | None = None) -> Column:
    """X40."""
    return F.pandas_udf(_clean, "string")(raw, F.lit(None).cast("string") if base is None else base)


def canonical_landing(raw: Column) -> Column:
    """X44."""
    return F.pandas_udf(_landing, "string")(raw)


def host_of(url: Column) -> Column:
    """Lower case, without www."""
    return F.regexp_replace(F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.when(host_of(url).isNotNull(), F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/")))


def registrable_domain(url: Column) -> Column:
    """The last two labels, or three under a suffix of two."""
    host = host_of(url)
    parts = F.split(host, r"\.")
    two = F.array_join(F.slice(parts, -2, 2), ".")
    return F.when(F.size(parts) < 2, None).when(F.size(parts) == 2, host).when(two.isin(*rules.MULTI_PART_SUFFIXES), F.array_join(F.slice(parts, -3, 3), ".")).otherwise(two)


def same_site(a: Column, b: Column) -> Column:
    """F4."""
    return F.coalesce(registrable_domain(a) == registrable_domain(b), F.lit(False))


def denied_domain(domain: Column, extra: tuple[str, ...] = ()) -> Column:
    """a host of the deny list, or one of `extra` or below it."""
    bad = domain.isin(*rules.DENY_HOSTS)
    for x in extra:
        own = x.strip().lower().removeprefix("www.")
        if own:
            bad |= (domain == own) | domain.endswith("." + own)
    return bad


def denied_path(url: Column) -> Column:
    """true for what cannot be parsed."""
    return F.coalesce(path_of(url).rlike(js_regex(rules.DENY_PATHS, "i")), F.lit(True))


def brand_name(domain: Column) -> Column:
    """X43."""
    return F.trim(F.initcap(F.regexp_replace(F.split(domain, r"\.")[0], "[-_]+", " ")))


def directory_of(path: Column) -> Column:
    """X45."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) <= 1, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")))


def funnel_type(url: Column, brand: Column | None = None) -> Column:
    """Where an ad leads; articles are tested last, hosts off the brand's site first."""
    host, path = host_of(url), path_of(url)
    order = sorted(rules.table(rules.FUNNELS), key=lambda r: r[0] == "advertorial")
    rows = [F.when(path.rlike(js_regex(p, "i")) | host.rlike(js_regex(p, "i")), F.lit(n)) for n, p in order]
    off = F.lit(False) if brand is None else brand.isNotNull() & (host != brand) & ~host.endswith(F.concat(F.lit("."), brand))
    outside = F.when(host.rlike(r"(?i)apps\.apple\.com|play\.google\.com"), "app-store").otherwise("offsite")
    return F.when(host.isNull(), "unknown").when(off, outside).otherwise(F.coalesce(*rows, F.when(path == "/", "homepage"), F.lit("landing-page")))


def page_kind(url: Column) -> Column:
    """X47."""
    path = path_of(url)
    return F.coalesce(F.when(path.isNull(), "other"), F.when(path == "/", "home"), *[F.when(path.rlike(js_regex(p, "i")), F.lit(k)) for k, p in rules.table(rules.PAGE_KINDS)], F.lit("other"))


def linkedin_slug(url: Column) -> Column:
    """The slug of a company page, lower case, else null."""
    return F.lower(F.nullif(F.try_url_decode(F.regexp_extract(url, r"(?i)linkedin\.com/(?:company|showcase|school)/([^/?#]+)", 1)), F.lit("")))
