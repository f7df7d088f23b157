"""Rounding, shares, dates and scores on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Fixed values of the exposure score.
IMPRESSIONS, REACH, SPEND, DAYS, VARIANTS, UNMEASURED = 10_000_000, 5_000_000, 500_000, 180, 50, 85
WEIGHTS = {"impressions": 0.35, "reach": 0.3, "spend": 0.1, "longevity": 0.2, "variants": 0.1}
ACTIVE = 1.05


def js_round(x: Column, places: int = 0) -> Column:
    """Half up on the binary value."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale if places else F.floor(x + 0.5).cast("double")


def mean_tenths(x: Column) -> Column:
    """The mean of figures of one decimal place, to one place, half up; summed in whole tenths, so that no order of adding shows."""
    return mean_of_tenths(F.sum(F.round(x * 10).cast("long")), F.count(x))


def mean_of_tenths(total: Column, of: Column) -> Column:
    """The mean of `of` figures that are `total` tenths in all, to one place, half up."""
    tenths, n = total * 2 + of, of * 2
    return F.when(n > 0, (tenths - F.pmod(tenths, n)) / n / 10)


def sum_tenths(x: Column) -> Column:
    """The sum of figures of one decimal place."""
    return F.sum(F.round(x * 10).cast("long")) / 10


def share(part: Column, total: Column) -> Column:
    """X11: a percentage to one place; 0 of nothing."""
    return F.when(total > 0, F.floor(part / total * 1000 + 0.5) / 10).otherwise(0.0)


def days_between(start: Column, end: Column) -> Column:
    """Whole days, half a day up, never negative."""
    days = F.floor((F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))) / DAY_MS + 0.5).cast("long")
    return F.when(days.isNotNull(), F.greatest(F.lit(0).cast("long"), days))


def days_since(at: Column, as_of: Column) -> Column:
    """X61."""
    return days_between(at, as_of)


def log_scale(v: Column, ceiling: float) -> Column:
    """X62."""
    return F.when(v.isNull(), None).when(v <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log10(1 + v) / F.log10(F.lit(1.0 + ceiling))))


def midpoint(low: Column, high: Column) -> Column:
    """X63."""
    return F.coalesce((low + high) / 2, low, high)


def exposure(impressions: Column, reach: Column, spend: Column, days: Column, variants: Column, active: Column, rank_by: str = "composite") -> Column:
    """0 .. 100 to one place; at most 85 where neither impressions, reach nor spend are known."""
    parts = {"impressions": log_scale(impressions, IMPRESSIONS), "reach": log_scale(reach, REACH), "spend": log_scale(spend, SPEND), "longevity": F.least(F.lit(1.0), days / float(DAYS)), "variants": log_scale(variants, VARIANTS)}
    parts["longevity"] = F.when(days.isNotNull(), parts["longevity"])
    if rank_by == "composite":
        total = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
        weight = sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
        score = F.when(weight > 0, total / weight * 100).otherwise(0.0)
        score = F.when(F.coalesce(active, F.lit(False)), F.least(F.lit(100.0), score * ACTIVE)).otherwise(score)
    else:
        order = {"impressions": ("impressions", "reach", "longevity"), "reach": ("reach", "impressions", "longevity"), "spend": ("spend", "impressions", "longevity"), "longevity": ("longevity",)}[rank_by]
        score = F.coalesce(*[parts[k] for k in order], F.lit(0.0)) * 100
    ceiling = F.when(F.coalesce(impressions, reach, spend).isNotNull(), 100.0).otherwise(float(UNMEASURED))
    return js_round(F.greatest(F.lit(0.0), F.least(ceiling, score)), 1)


def exposure_signals(impressions: Column, reach: Column, spend: Column, days: Column, variants: Column, active: Column, currency: Column) -> Column:
    """struct<signals array<string>, basis string>: which figures an ad's exposure rests on."""
    from adlens.functions.text import format_count

    told = [
        ("impressions", impressions, F.concat(F.lit("~"), format_count(impressions), F.lit(" impressions"))),
        ("eu-reach", reach, F.concat(F.lit("EU reach "), format_count(reach))),
        ("spend", spend, F.concat_ws(" ", F.concat(F.lit("~"), format_count(spend)), F.nullif(currency, F.lit("")), F.lit("spend"))),
        ("longevity", days, F.concat(F.lit("running "), days.cast("string"), F.when(days == 1, " day").otherwise(" days"))),
        ("variants", variants, F.concat(variants.cast("string"), F.lit(" creative variants"))),
        ("active", F.when(F.coalesce(active, F.lit(False)), True), F.lit("still active")),
    ]
    basis = F.concat_ws("; ", *[F.when(x.isNotNull(), text) for _, x, text in told])
    return F.struct(
        F.array_compact(F.array(*[F.when(x.isNotNull(), F.lit(name)) for name, x, _ in told])).alias("signals"),
        F.when(basis == "", "no exposure signals published for this ad").otherwise(basis).alias("basis"),
    )


def dampen(hits: Column) -> Column:
    """X65."""
    return F.when(hits <= 0, 0.0).otherwise(F.least(F.lit(3.0), 1 + F.log2(hits)))


def confidence(raw: Column, scale: float = 14.0) -> Column:
    """X66 with scale 14, X67 with 45."""
    return F.when(raw <= 0, 0.0).otherwise(js_round(100 * (1 - F.exp(-raw / scale))))


def angle_score(raw: Column) -> Column:
    return js_round(F.least(F.lit(100.0), (1 - F.exp(-raw / 5)) * 100))


def price_tier(brand: Column, niche: Column) -> Column:
    """Where a brand's median price stands against its niche's."""
    ratio = brand / niche
    return F.when(brand.isNull() | niche.isNull() | (niche <= 0), None).when(ratio >= 1.5, "premium").when(ratio >= 1.15, "above-market").when(ratio <= 0.66, "value").when(ratio <= 0.85, "below-market").otherwise("at-market")


def deviation(brand: Column, niche: Column, ratio: float = 1.4) -> Column:
    """Above or below where the brand is `ratio` times off its niche's figure, else null."""
    r = brand / niche
    return F.when((niche > 0) & (r >= ratio), "above").when((niche > 0) & (r <= 1 / ratio), "below")


def posture(newest: Column, launched: Column, longest: Column) -> Column:
    """From the days since the newest ad, the launches of the last 30 days and the longest run."""
    long_runner = F.coalesce(longest, F.lit(0)) >= 90
    return F.when(F.coalesce(newest, F.lit(999)) > 60, "stale").when((launched >= 5) & long_runner, "scaling").when(launched >= 5, "testing").when(long_runner, "steady").otherwise("testing")


def posture_reason(newest: Column, launched: Column, longest: Column, total: Column) -> Column:
    """The figures behind a posture, in words."""
    text = lambda c: c.cast("long").cast("string")
    long_runner = F.coalesce(longest, F.lit(0)) >= 90
    pace = F.concat(text(launched), F.lit(" launches in 30 days "))
    quiet = F.concat(F.lit("newest ad started "), F.coalesce(text(newest), F.lit("undefined")), F.lit(" days ago — the account has gone quiet"))
    few = F.concat(text(total), F.when(total == 1, " ad").otherwise(" ads"), F.lit(" observed, none established yet"))
    return (
        F.when(F.coalesce(newest, F.lit(999)) > 60, quiet).when((launched >= 5) & long_runner, F.concat(pace, F.lit("with a "), text(longest), F.lit("-day runner still live"))).when(launched >= 5, F.concat(pace, F.lit("but nothing has run past 90 days yet")))
        .when(long_runner, F.concat(F.lit("few new launches, but a "), text(longest), F.lit("-day runner is still delivering"))).otherwise(few)
    )


def discovery_score(points: Column, mentions: Column) -> Column:
    """Link points plus a damped bonus for mentions, null where that is not positive."""
    raw = points + F.least(F.lit(10.0), F.log2(mentions + 1) * 4)
    return F.when(raw > 0, js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 2.5))))
