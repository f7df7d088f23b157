"""Brand and niche rollups over ranked ads: breakdowns, mixes, leaderboards, benchmarks, deviations, competitors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.functions import score as S
from adlens.functions import text as T
from adlens.functions.lineage import written


def breakdown(rows: DataFrame, totals: DataFrame, keys: list[str], by: str) -> DataFrame:
    """For each of `by`: ads, share of the group's ads, mean exposure. rows: one for each ad and value;
    totals: keys and total."""
    n = rows.groupBy(*keys, by).agg(F.count("*").alias("ad_count"), S.mean_tenths(F.col("exposure")).alias("avg_exposure"))
    return n.join(totals, keys).withColumn("share", S.share(F.col("ad_count"), F.col("total"))).drop("total")


def top_angle(parts: DataFrame, keys: list[str], by: str = "angle") -> DataFrame:
    """A10: the value of the largest (rounded mean exposure x ads); ties go to more ads, then the higher mean, then the name."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("avg_exposure") * F.col("ad_count")), F.desc("ad_count"), F.desc("avg_exposure"), by)
    return parts.withColumn("n", F.row_number().over(order)).filter("n = 1").select(*keys, F.col(by).alias("top_angle"))


def mix(rows: DataFrame, keys: list[str], by: str, weight: Column | None = None) -> DataFrame:
    """The share of each value in the group, which need not be counted once an ad."""
    n = rows.groupBy(*keys, by).agg((F.sum(weight) if weight is not None else F.count("*")).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("share", S.share(F.col("n"), total))


def leaderboard(parts: DataFrame) -> DataFrame:
    """Over all brands: ads, brands by name, and the plain mean of the brands' rounded means."""
    return parts.groupBy("angle").agg(F.sum("ad_count").alias("ad_count"), F.countDistinct("brand_name").alias("brand_count"), S.mean_tenths(F.col("avg_exposure")).alias("avg_exposure"))


def niche_angles(parts: DataFrame, brands: DataFrame, most: int = 8) -> DataFrame:
    """Each niche's angles by ads, with their share of the niche's ads."""
    totals = brands.groupBy("niche").agg(F.sum("ad_count").alias("total"))
    n = parts.groupBy("niche", "angle").agg(F.sum("ad_count").alias("ad_count")).join(totals, "niche")
    place = F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("ad_count"), "angle"))
    return n.select("niche", "angle", "ad_count", S.share(F.col("ad_count"), F.col("total")).alias("share")).withColumn("place", place).filter(F.col("place") <= most)


def median(x: Column, places: int) -> Column:
    return S.js_round(F.percentile(x, F.lit(0.5)), places)


def benchmark(brands: DataFrame, figures: list[str], flags: list[str]) -> DataFrame:
    """Each niche's brands, ads, medians of the figures (brands without one left out) and shares of the flags."""
    yes = [S.share(F.count_if(F.coalesce(F.col(c), F.lit(False))), F.count("*")).alias(f"{c}_share") for c in flags]
    return brands.groupBy("niche").agg(F.count("*").alias("brand_count"), F.sum("ad_count").alias("ad_count"), median(F.col("ad_count"), 2).alias("median_ads_per_brand"), *[median(F.col(c), 2).alias(f"median_{c}") for c in figures], *yes)


def whitespace(angles: DataFrame, totals: DataFrame, library: DataFrame, least_ads: int = 10, rare: float = 8.0, most: int = 8) -> DataFrame:
    """What a niche of at least least_ads ads hardly uses (share under `rare`), and what it never uses."""
    big = totals.filter(F.col("total") >= least_ads).select("niche")
    seldom = angles.join(big, "niche").filter(F.col("share") < rare).select("niche", "angle", "share")
    # The library is a rule table; as one array it is a single row, and every niche against it stays small.
    every = library.agg(F.collect_set("angle").alias("every"))
    unused = big.crossJoin(every).select("niche", F.explode("every").alias("angle")).join(angles.select("niche", "angle"), ["niche", "angle"], "left_anti")
    both = seldom.unionByName(unused.withColumn("share", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("niche").orderBy("share", "angle"))
    return both.withColumn("place", place).filter(F.col("place") <= most)


def deviations(brands: DataFrame, norms: DataFrame, signals: list[tuple[str, str, str, float]], least_brands: int = 3) -> DataFrame:
    """(brand, signal, value, norm, direction) where a brand is off its niche's norm. signals: name,
    brand column, norm column, ratio. Niches of fewer brands set no norm."""
    joined = brands.drop("brand_count").join(norms.filter(F.col("brand_count") >= least_brands), "niche")
    each = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(a).cast("double").alias("value"), F.col(b).cast("double").alias("norm"), S.deviation(F.col(a), F.col(b), r).alias("direction")) for n, a, b, r in signals])
    return joined.select("brand", F.inline(each)).filter("direction is not null")


def absences(brands: DataFrame, norms: DataFrame, flags: list[tuple[str, str, str]], least: float = 60.0, least_brands: int = 3) -> DataFrame:
    """The categorical part of X70: what most of a niche has and a brand lacks. flags: name, brand column, share column."""
    joined = brands.drop("brand_count").join(norms.filter(F.col("brand_count") >= least_brands), "niche")
    each = F.array(*[F.struct(F.lit(n).alias("signal"), F.when((F.col(b) >= least) & (F.col(a) == False), "absent").alias("direction")) for n, a, b in flags])  # noqa: E712
    return joined.select("brand", F.inline(each)).filter("direction is not null")


#: Name, brand column, ratio, unit, what a brand off the norm is told; and name, flag, what it has instead, what the niche does,
#: what that means.
SIGNALS = (
    ("Price", "price_median", 1.4, "", "prices {off}% {direction} the {niche} median — check whether the copy justifies it"), ("Discount depth", "max_discount", 1.4, "%", "discounts {direction} the category norm"), ("Guarantee", "guarantee_days", 1.4, " days", "guarantee window is {direction} the category norm"),
    ("Social proof volume", "review_count", 2.0, "", "review count is {direction} the category norm"), ("Ad volume", "ad_count", 1.8, "", "running {direction} as many ads as the typical brand here"), ("Stack maturity", "stack_score", 1.4, "", "growth stack is {direction} the category norm"),
)
FLAGS = (
    ("Subscription", "subscription", "not offered", "% of the niche offers it", "the category monetises on repeat purchase and this brand does not"), ("Paid media", "paid_media", "no ad pixel detected", "% of the niche tracks paid", "not set up to buy traffic while its competitors are"),
    ("Reviews", "reviews", "no review tool", "% of the niche runs one", "collecting less social proof than the category standard"),
)
#: What the norms also hold where the brands have it.
MORE_FIGURES, MORE_FLAGS = ("per_month",), ("bnpl",)


def norms(brands: DataFrame) -> DataFrame:
    """The benchmark of every figure and flag that the deviations need, the launches a month of brands with ads, and the share
    with pay-later. brands: brand, niche and their columns."""
    have = [c for c in MORE_FIGURES if c in brands.columns]
    running = brands.withColumns({c: F.when(F.col("ad_count") > 0, F.col(c)) for c in have}) if have else brands
    return benchmark(running, [c for _, c, *_ in SIGNALS if c != "ad_count"] + have, [c for _, c, *_ in FLAGS] + [c for c in MORE_FLAGS if c in brands.columns])


def common_tools(brands: DataFrame, most: int = 12) -> DataFrame:
    """(niche, tool, share, place): the tools most of a niche's brands have. brands: niche, tools array<string>."""
    total = brands.groupBy("niche").agg(F.count("*").alias("total"))
    n = brands.select("niche", F.explode(F.array_distinct("tools")).alias("tool")).groupBy("niche", "tool").agg(F.count("*").alias("n")).join(total, "niche")
    place = F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("share"), "tool"))
    return n.select("niche", "tool", S.share(F.col("n"), F.col("total")).alias("share")).withColumn("place", place).filter(F.col("place") <= most)


def _number(x: Column) -> Column:
    """A figure as a person writes it: no point where there is no fraction."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def _told(template: str, parts: dict[str, Column]) -> Column:
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[x] if k % 2 else F.lit(x) for k, x in enumerate(pieces) if k % 2 or x])


def deviation_set(brands: DataFrame, norms_: DataFrame, least_brands: int = 3) -> DataFrame:
    """(brand, signal, value, norm, direction, note): the six figures, the three absences, a lead angle that is not
    the niche's (brands: lead_angle, norms: niche_lead_angle and its share if known) and a stale posture. Niches of fewer brands set
    no norm. One pass over brands joined with their niche's norms: all signals of a brand are read off its row."""
    n = norms_.filter(F.col("brand_count") >= least_brands).drop("ad_count", "brand_count")
    met = brands.drop("brand_count").join(n, "niche")

    def optional(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in met.columns else F.lit(None).cast(kind)

    def found(signal: str, when: Column, value: Column, norm: Column, direction: Column | str, note: Column | str) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(when, F.struct(F.lit(signal).alias("signal"), value.cast("string").alias("value"), norm.cast("string").alias("norm"), lit(direction).alias("direction"), lit(note).alias("note")))

    each = []
    for name, c, ratio, unit, note in SIGNALS:
        value, norm = F.col(c).cast("double"), F.col("median_ads_per_brand" if c == "ad_count" else f"median_{c}").cast("double")
        way = S.deviation(value, norm, ratio)
        off = _number(S.js_round(F.abs(value / norm - 1) * 100))
        each.append(found(name, way.isNotNull(), F.concat(_number(value), F.lit(unit)), F.concat(_number(norm), F.lit(unit)), way, _told(note, {"off": off, "direction": way, "niche": F.col("niche")})))
    for name, c, value, norm, note in FLAGS:
        each.append(found(name, (F.col(f"{c}_share") >= 60) & (F.col(c) == False), F.lit(value), F.concat(_number(F.col(f"{c}_share")), F.lit(norm)), "absent", note))  # noqa: E712
    lead, share = F.col("niche_lead_angle"), optional("niche_lead_share", "double")
    each.append(found("Lead angle", F.col("lead_angle") != lead, F.col("lead_angle"), F.concat(lead, F.coalesce(F.concat(F.lit(" ("), _number(share), F.lit("% of category ads)")), F.lit(""))), "unique", "leads on a different angle from the category — deliberate differentiation or a blind spot"))
    scaling = F.concat(_number(F.coalesce(optional("scaling_share", "double"), F.lit(0.0))), F.lit("% of the niche is scaling"))
    each.append(found("Creative freshness", F.col("posture") == "stale", F.coalesce(optional("posture_reason"), F.col("posture")), scaling, "below", "competitors are shipping creative and this one is not"))
    return met.select("brand", F.inline(F.array_compact(F.array(*each))))


#: Bins of a round of `exact_medians`.
BINS = 1024


def exact_medians(rows: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """Keys and the exact median of each figure (half up to two places; null without values), however many values a group has.

    Narrowing histograms: a round counts the values of each group in BINS equal bins between the bounds that are left, finds the
    bins of the two middle ranks, and goes on with the values that really stand in that bin. Only counts and bounds of bins
    are shuffled, and no task holds a group's values; a round leaves a 1024th of the range, or a single value."""
    melted = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("v")) for c in figures])).alias("f")
    own = [*keys, "figure"]
    values = written(rows.select(*keys, melted).select(*keys, "f.figure", "f.v").filter("v is not null"), "median-values")
    n = F.col("n")
    state = values.groupBy(*own).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("below", F.lit(0).cast("long"))
    state = written(state.withColumns({"first": F.floor((n - 1) / 2), "second": F.floor(n / 2)}).drop("n"), "median-state")
    done = None
    while not state.isEmpty():
        inside = values.join(state, own).filter("v between lo and hi")
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0)
        bins = inside.groupBy(*own, "below", "first", "second", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*own).orderBy("bin")) + F.col("below")
        ends = bins.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("c"))
        hit = lambda rank: F.min(F.when((F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.struct("bin", "least", "most", "start"))).alias(f"at_{rank}")
        met = written(ends.groupBy(*own, "first", "second").agg(hit("first"), hit("second")), "median-bins")
        apart = F.col("at_first.bin") != F.col("at_second.bin")
        alone = F.col("at_first.least") == F.col("at_first.most")
        value = F.when(apart, (F.col("at_first.most") + F.col("at_second.least")) / 2).when(alone, F.col("at_first.least"))
        settled = met.filter(apart | alone).select(*own, value.alias("median"))
        done = settled if done is None else done.union(settled)
        state = written(met.filter(~(apart | alone)).select(*own, F.col("at_first.least").alias("lo"), F.col("at_first.most").alias("hi"), F.col("at_first.start").alias("below"), "first", "second"), "median-state")
    found = rows.select(*keys).distinct()
    if done is None:
        return found.select(*keys, *[F.lit(None).cast("double").alias(c) for c in figures])
    wide = done.groupBy(*keys).agg(*[S.js_round(F.max(F.when(F.col("figure") == c, F.col("median"))), 2).alias(c) for c in figures])
    return found.join(wide, keys, "left")


def winner_angles(ads: DataFrame, keys: list[str], least_days: int = 60, most: int = 5) -> DataFrame:
    """Keys and the angles that most of the long-running ads share, most first, then by name."""
    n = ads.filter(F.coalesce("days", F.lit(0)) >= least_days).select(*keys, F.explode("angles").alias("angle")).groupBy(*keys, "angle").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "angle"))
    top = n.withColumn("place", place).filter(F.col("place") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "angle"))), lambda x: x["angle"]).alias("angles"))


#: Keys whose angles place a vector, and the width of a cell in radians.
PIVOTS, CELL = 4, 0.25
#: How far, in radians, each round of `competitors` looks; the last is everything, as no two vectors of shares are further apart.
RADII = (0.15, 0.45, 1.6)
#: Vectors of a cell, and vectors that ask there, which one task compares.
CHUNK = 2048


def _nearest(most: int):  # noqa: ANN202
    """Two frames of vectors (id, v, and of those that are there peers) -> for each that asks the `most` best others by
    similarity, then name."""

    def run(asks: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "other": [], "similarity": []}
        if len(asks) and len(there):
            keys = {k: n for n, k in enumerate(sorted({x["key"] for part in (asks, there) for v in part["v"] for x in v}))}

            def matrix(part: pd.DataFrame) -> np.ndarray:
                m = np.zeros((len(part), len(keys)))
                for n, v in enumerate(part["v"]):
                    for x in v:
                        m[n, keys[x["key"]]] = x["value"]
                return m

            a, b = matrix(asks), matrix(there)
            size = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
            s = np.floor((a @ b.T) / size * 1000 + 0.5) / 10
            s[asks["id"].to_numpy()[:, None] == there["id"].to_numpy()[None, :]] = 0.0
            peers = list(there["peers"])
            for n, own in enumerate(asks["id"]):
                floor = max(np.partition(s[n], -most)[-most] if len(there) >= most else 0.0, 0.05)
                near = sorted((-s[n, m], o) for m in np.flatnonzero(s[n] >= floor) for o in peers[m])[:most]
                out["id"] += [own] * len(near)
                out["other"] += [o for _, o in near]
                out["similarity"] += [-v for v, _ in near]
        return pd.DataFrame({c: pd.Series(x, dtype=object if c == "other" else None) for c, x in out.items()})

    return run


def competitors(features: DataFrame, most: int = 3) -> DataFrame:
    """Each brand's most similar others by the cosine of their shares, half up to one place; of equal similarities those with
    the very same shares come first, then the name decides. features: brand, key, value (the keys are rule names, so a vector is short).

    Brands of equal shares are one vector. Where more than `most` brands have it, they are each other's answer. The others look
    around: the angles to the PIVOTS commonest keys put every vector into a cell, and two vectors are at least as far apart as
    their angles to a key differ, so a vector asks only the cells within a radius, and is done once what it has found beats anything
    beyond it. Cells, of which there are a few thousand at most, are broadcast; crowded ones are cut into chunks of CHUNK on both
    sides. Results are exact, and nothing meets everything unless it resembles nothing.
    """
    kind = features.schema["brand"].dataType.simpleString()
    vector = F.array_sort(F.collect_list(F.struct("key", F.col("value").cast("double").alias("value"))))
    own = written(features.filter("value > 0").groupBy("brand").agg(vector.alias("v")), "rival-vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("brand"))
    first = own.withColumn("n", nth).filter(F.col("n") <= most + 1).groupBy("v").agg(F.array_sort(F.collect_list("brand")).alias("peers"))
    classes = written(first.withColumn("id", F.monotonically_increasing_id()), "rival-classes")
    total = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["value"] * x["value"]))
    weights = classes.select(F.explode("v").alias("x"), total.alias("t")).groupBy("x.key").agg(F.sum(F.pow(F.col("x.value") / F.col("t"), 2)).alias("w"))
    pivots = [r.key for r in weights.orderBy(F.desc("w"), "key").limit(PIVOTS).collect()]
    angles = {}
    for k, p in enumerate(pivots):
        held = F.get(F.filter("v", _has_key(p)), 0)["value"]
        angles[f"a{k}"] = F.acos(F.least(F.lit(1.0), F.coalesce(held, F.lit(0.0)) / total))
    cell = F.array(*[F.floor(F.col(f"a{k}") / CELL).cast("int") for k in range(len(pivots))])
    at = written(classes.withColumns(angles).withColumn("cell", cell), "rival-cells")
    cells = F.broadcast(at.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    there = at.join(cells, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "v", F.slice("peers", 1, most).alias("peers"))
    found = None
    open_ = at.filter(F.size("peers") <= most)
    for radius in RADII:
        near = F.lit(True)
        for k in range(len(pivots)):
            lo = F.get("near", F.lit(k)) * CELL
            near = near & (lo <= F.col(f"a{k}") + radius) & (lo + CELL >= F.col(f"a{k}") - radius)
        asks = open_.select("id", "v", *[f"a{k}" for k in range(len(pivots))]).crossJoin(F.broadcast(cells.select(F.col("cell").alias("near"), "chunks"))).filter(near)
        asks = written(asks.select(F.col("near").alias("cell"), "chunks", "id", "v"), "rival-asks")
        pieces = F.broadcast(asks.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("pieces")))
        left = asks.join(pieces, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "v")
        right = there.join(pieces, "cell").select("cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "id", "v", "peers")
        met = left.groupBy("cell", "chunk", "piece").cogroup(right.groupBy("cell", "chunk", "piece")).applyInPandas(_nearest(most), f"id long, other {kind}, similarity double")
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
        best = met.withColumn("k", place).filter(F.col("k") <= most).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "other", "similarity"))).alias("best"))
        # With the others of its own vector, a brand still needs so many; what lies beyond the radius is no more similar than this.
        needed = most - (F.size("peers") - 1)
        beyond = float(np.floor(np.cos(min(radius, np.pi / 2)) * 1000 + 0.5) / 10) if radius < np.pi / 2 else -1.0
        done = F.coalesce(F.get("best", needed - 1)["similarity"] > beyond, F.lit(False)) | F.lit(radius >= np.pi / 2) | (needed <= 0)
        state = written(open_.join(best, "id", "left").withColumn("done", done), "rival-round")
        settled = state.filter("done").select("id", F.transform("best", lambda x: F.struct(x["other"].alias("other"), x["similarity"].alias("similarity"))).alias("best"))
        found = settled if found is None else found.union(settled)
        open_ = state.filter("not done").drop("best", "done")
        if open_.isEmpty():
            break
    every = own.join(classes, "v").join(found, "id", "left") if found is not None else own.join(classes, "v").withColumn("best", F.lit(None))
    same = F.transform(F.filter("peers", lambda p: p != F.col("brand")), lambda p: F.struct(p.alias("other"), F.lit(100.0).alias("similarity")))
    both = F.slice(F.concat(same, F.coalesce("best", F.array().cast(f"array<struct<other:{kind},similarity:double>>"))), 1, most)
    return every.select("brand", F.posexplode(both).alias("place", "x")).select("brand", "x.other", "x.similarity", (F.col("place") + 1).alias("place"))


def _has_key(key: str):  # noqa: ANN202
    return lambda x: x["key"] == key


def shared(features: DataFrame, pairs: DataFrame, most: int = 4) -> DataFrame:
    """The keys that both brands of a pair have, by the first one's value."""
    hit = pairs.select("brand", "other").join(features, "brand").join(features.select(F.col("brand").alias("other"), "key"), ["other", "key"])
    place = F.row_number().over(Window.partitionBy("brand", "other").orderBy(F.desc("value"), "key"))
    top = hit.withColumn("place", place).filter(F.col("place") <= most)
    return top.groupBy("brand", "other").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("shared"))


def creative_signals(ads: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """Launches, ages, run lengths, variants, active ads, pace and posture. ads: start timestamp, days,
    variants, active."""
    age = S.days_since(F.col("start"), as_of)
    g = ads.groupBy(*keys).agg(
        F.count("*").alias("ad_count"), F.count_if(age <= 30).alias("launched_30"), F.min(age).alias("newest"), F.max(age).alias("oldest"),
        F.percentile("days", F.lit(0.5)).alias("mid"), F.max("days").alias("longest_run"), F.count_if(F.coalesce("active", F.lit(False))).alias("active_ads"), F.sum(F.coalesce("variants", F.lit(1))).cast("long").alias("variants"),
    )
    window = F.greatest(F.lit(30), F.coalesce("oldest", F.lit(30)))
    return g.select(
        *keys, "ad_count", "launched_30", "newest", S.js_round(F.col("mid")).alias("median_run"), "longest_run", "active_ads", "variants",
        (F.floor(F.col("ad_count") / window * 30 * 10 + 0.5) / 10).alias("per_month"), S.posture(F.col("newest"), F.col("launched_30"), F.col("longest_run")).alias("posture"), S.posture_reason(F.col("newest"), F.col("launched_30"), F.col("longest_run"), F.col("ad_count")).alias("posture_reason"),
    )


def angle_label(key: Column) -> Column:
    """An angle's name, or its key where the library has none."""
    names = F.create_map(*[F.lit(x) for k, name, _ in rules.table(rules.ANGLES) for x in (k, name)])
    return F.coalesce(F.element_at(names, key), key)


def _first_values(ads: DataFrame, keys: list[str], column: str, name: str, most: int, distinct: bool = True) -> DataFrame:
    """keys and the first `most` values of a column by exposure, then ad: picked by a group limit, so no group is collected whole."""
    order = [F.desc("exposure"), F.col("ad_id") if "ad_id" in ads.columns else F.col(column)]
    told = ads.filter(F.col(column).isNotNull())
    if distinct:
        best = F.min(F.struct((-F.col("exposure")).alias("neg"), (F.col("ad_id") if "ad_id" in ads.columns else F.lit(0)).alias("id"))).alias("o")
        told, order = told.groupBy(*keys, column).agg(best), [F.col("o"), F.col(column)]
    top = told.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("k") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", column))), lambda x: x[column]).alias(name))


def proven_winners(ads: DataFrame, keys: list[str], least_days: int = 60) -> DataFrame:
    """Ads that ran long: how many, their median exposure, ids, formats and funnels (where ads have ad_id, format, funnel;
    200 ids at most, which is what a brand keeps), the most shared angle, and in a line what they share. ads: days, exposure,
    angles array<string>."""
    won = ads.filter(F.coalesce("days", F.lit(0)) >= least_days)
    head = won.groupBy(*keys).agg(F.count("*").alias("winners"), median(F.col("exposure"), 1).alias("median_exposure"))
    for c, n in (("ad_id", "ids"), ("format", "formats"), ("funnel", "funnels")):
        if c in ads.columns:
            head = head.join(_first_values(won, keys, c, n, 200), keys, "left")
    n = won.select(*keys, F.explode("angles").alias("angle")).groupBy(*keys, "angle").agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("neg"), "angle")).alias("x")).select(*keys, F.col("x.angle").alias("angle"), (-F.col("x.neg")).alias("n"))
    only = F.get("funnels", F.lit(0)) if "funnel" in ads.columns else F.lit(None).cast("string")
    one = F.when(F.size("funnels") == 1, F.concat(F.lit(", all pointing at "), F.when(only.rlike("(?i)^[aeiou]"), "an ").otherwise("a "), only)) if "funnel" in ads.columns else F.lit("")
    ads_ = F.concat(F.col("winners").cast("string"), F.when(F.col("winners") == 1, " ad past ").otherwise(" ads past "), F.lit(f"{least_days} days; "))
    told = F.concat(ads_, F.when(F.col("n") == F.col("winners"), "every one").otherwise(F.concat_ws(" of ", "n", "winners")), F.lit(" runs "), angle_label(F.col("angle")), F.coalesce(one, F.lit("")))
    none = F.concat(F.col("winners").cast("string"), F.when(F.col("winners") == 1, " long-running ad").otherwise(" long-running ads"), F.lit(" with no shared angle"))
    return head.join(best, keys, "left").withColumn("pattern", F.when(F.col("angle").isNull(), none).otherwise(told)).drop("n")


def landing_pages(ads: DataFrame, keys: list[str]) -> DataFrame:
    """Ads by canonical destination: share of all ads, exposure total, median and top, active, first and last start,
    longest run, place by exposure; with the columns for them also funnel, angles (five, most first), hooks (three, by exposure) and
    variants of the address (six). ads: url, exposure, active, start, days; and funnel, angles array<string>, hook, landing_url, ad_id."""
    have = set(ads.columns)
    more = [F.min("funnel").alias("funnel")] if "funnel" in have else []
    own = ads.filter("url is not null")
    g = own.groupBy(*keys, "url").agg(
        F.count("*").alias("ad_count"), S.sum_tenths(F.col("exposure")).alias("total_exposure"), median(F.col("exposure"), 1).alias("median_exposure"), F.max("exposure").alias("top_exposure"),
        F.count_if(F.coalesce("active", F.lit(False))).alias("active_ads"), F.min("start").alias("first_seen"), F.max("start").alias("last_seen"), F.max("days").alias("longest_run"), *more,
    )
    if "hook" in have:
        g = g.join(_first_values(own, [*keys, "url"], "hook", "hooks", 3, distinct=False), [*keys, "url"], "left").withColumn("hooks", F.transform("hooks", lambda h: T.truncate(h, 140)))
    if "landing_url" in have:
        g = g.join(_first_values(own, [*keys, "url"], "landing_url", "variants", 6), [*keys, "url"], "left")
    if "angles" in have:
        n = own.select(*keys, "url", F.explode("angles").alias("angle")).groupBy(*keys, "url", "angle").agg(F.count("*").alias("n"))
        top = n.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "url").orderBy(F.desc("n"), "angle"))).filter("k <= 5")
        g = g.join(top.groupBy(*keys, "url").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "angle", "n"))), lambda x: F.struct(x["angle"].alias("angle"), x["n"].alias("n"))).alias("angles")), [*keys, "url"], "left")
    total = ads.groupBy(*keys).agg(F.count("*").alias("every"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total_exposure"), F.desc("ad_count"), "url"))
    return g.join(total, keys).withColumn("share", S.share(F.col("ad_count"), F.col("every"))).drop("every").withColumn("place", place)


def split_tests(pages: DataFrame, keys: list[str], directory: str = "directory") -> DataFrame:
    """Directories under which at least two destinations are tried."""
    return pages.groupBy(*keys, directory).agg(F.count("*").alias("pages"), F.sum("ad_count").cast("long").alias("ad_count")).filter("pages >= 2")
