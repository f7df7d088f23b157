"""The options of a run, read from a plain mapping, bounded and checked."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


class InputError(ValueError):
    """An option set that cannot be run."""


#: Default, least and most of the whole numbers; the choices of the enumerations, default first; the switches.
BOUNDS = {
    "max_brands": (25, 1, 500), "max_products_per_brand": (8, 0, 50), "min_classification_confidence": (25, 0, 100), "ads_per_brand": (20, 1, 200), "min_exposure_score": (0, 0, 100), "proven_winner_min_days": (60, 1, 365),
    "max_landing_pages_per_brand": (5, 1, 25), "max_product_pages_per_brand": (5, 1, 50), "max_sitemap_urls": (2000, 100, 20000), "max_concurrency": (5, 1, 50), "request_timeout_secs": (30, 5, 300), "max_request_retries": (3, 0, 10), "max_product_queries": (3, 0, 20),
}
CHOICES = {
    "discovery_mode": ("auto", "outbound-links", "single-brand"), "profile_depth": ("standard", "fast", "deep"), "ads_provider": ("auto", "meta-graph", "apify-actor", "none"), "ad_search_strategy": ("brand+products", "brand", "products"),
    "ad_active_status": ("ALL", "ACTIVE", "INACTIVE"), "rank_by": ("composite", "impressions", "reach", "longevity", "spend"),
}
SWITCHES = ("analyse_landing_pages", "discover_page_inventory", "analyse_product_pages", "analyse_checkout")
FORMATS = ("json", "markdown", "html")
#: Older names of options.
ALIASES = {"min_confidence": "min_classification_confidence", "max_retries": "max_request_retries", "active_status": "ad_active_status", "countries": "ad_countries", "taxonomy": "custom_taxonomy"}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


@dataclass(frozen=True)
class EngineConfig:
    """The options of a run. Numbers, choices and switches are attributes by their names."""

    start_urls: tuple[str, ...]
    as_of: str
    numbers: Mapping[str, int] = field(default_factory=dict)
    choices: Mapping[str, str] = field(default_factory=dict)
    switches: Mapping[str, bool] = field(default_factory=dict)
    countries: tuple[str, ...] = ("US",)
    include_domains: tuple[str, ...] = ()
    exclude_domains: tuple[str, ...] = ()
    output_formats: tuple[str, ...] = FORMATS
    brand_link_selector: str | None = None
    taxonomy: Mapping[str, Any] = field(default_factory=dict)
    nested_input: Mapping[str, Any] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()

    def __getattr__(self, name: str) -> Any:
        name = ALIASES.get(name, name)
        for group in ("numbers", "choices", "switches"):
            if name in self.__dict__.get(group, {}):
                return self.__dict__[group][name]
        raise AttributeError(name)

    @property
    def provider(self) -> str:
        """The provider that "auto" stands for: the official interface where a country asked for has its figures."""
        from adlens.sources.providers import asks_eu

        return self.ads_provider if self.ads_provider != "auto" else "meta-graph" if asks_eu(self.countries) else "apify-actor"

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> EngineConfig:
        """Names in snake or camel case. Unknown keys are passed over; a number is clamped; a choice that is none falls back to
        its default, and a warning says so."""
        if not isinstance(raw, Mapping):
            raise InputError("the input must be an object")
        given = {ALIASES.get(snake(k), snake(k)): v for k, v in raw.items()}
        urls = tuple(u for u in (x.get("url", "") if isinstance(x, Mapping) else str(x) for x in _list(given.get("start_urls"))) if re.match(r"(?i)^https?://", u))
        if not urls:
            raise InputError("at least one http(s) start URL is needed")
        if not given.get("as_of"):
            raise InputError("as_of, the clock of the run, is needed")
        numbers, warnings = {}, []
        for name, (default, least, most) in BOUNDS.items():
            try:
                numbers[name] = min(most, max(least, int(float(given.get(name, default)))))
            except (TypeError, ValueError, OverflowError):
                numbers[name] = default
        choices = {}
        for name, allowed in CHOICES.items():
            asked = given.get(name)
            choices[name] = asked if asked in allowed else allowed[0]
            if asked is not None and asked not in allowed:
                warnings.append(f"{name}: {asked!r} is not one of {', '.join(allowed)}; {allowed[0]} is taken")
        lists = {name: tuple(str(x).strip() for x in _list(given.get(name)) if str(x).strip()) for name in ("include_domains", "exclude_domains")}
        countries = tuple(str(x).strip().upper() for x in _list(given.get("ad_countries")) if str(x).strip()) or ("US",)
        formats = tuple(f for f in _list(given.get("output_formats")) if f in FORMATS) or FORMATS
        selector = str(given.get("brand_link_selector") or "").strip() or None
        nested = {name: given[key] if isinstance(given.get(key), Mapping) else {} for name, key in (("taxonomy", "custom_taxonomy"), ("nested_input", "ads_apify_actor_input"))}
        return cls(urls, str(given["as_of"]), numbers, choices, {name: given.get(name) is True for name in SWITCHES}, countries, output_formats=formats, brand_link_selector=selector, warnings=tuple(warnings), **lists, **nested)


def _list(value: Any) -> list:
    return list(value) if isinstance(value, list | tuple) else []
