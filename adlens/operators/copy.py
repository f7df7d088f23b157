"""Copy analysis: angles, awareness, hooks, formats, offers, emotions, claims, proof. Each is one Column expression, so
a row of copy is read in place, without a join against the rules. Which of a table's patterns a text may hold is found
beforehand by a linear matcher over whole batches (`may_hold`); only these are then looked for one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.functions import score as S
from adlens.functions import text as T


def copy_of(*parts: Column) -> Column:
    """The filled parts (title, body, link description, call to action) on lines of their own."""
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", p) for p in parts])


def _wide(pattern: str) -> str:
    """A pattern for the linear matcher that holds wherever T.js_regex(pattern, "i") does."""
    return "(?i)" + pattern.replace(r"\s", r"[\s\x{0B}\x{A0}\x{FEFF}\x{2028}\x{2029}]")


def may_hold(text: Column, patterns: list[str]) -> Column:
    """array<boolean>: for each pattern, whether the text may match it; a null text may. Patterns that the linear matcher does not
    know (looking around) and those with an end anchor, on which it differs, may always match."""
    wide = [None if "(?!" in p or "(?=" in p or "(?<" in p or p.rstrip(")").endswith("$") else _wide(p) for p in patterns]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            values = pa.array(s, pa.large_string())
            held = [None if p is None else pc.fill_null(pc.match_substring_regex(values, p), True).to_numpy(zero_copy_only=False) for p in wide]
            yield pd.Series([[True if h is None else bool(h[k]) for h in held] for k in range(len(values))], index=s.index, dtype=object)

    return F.pandas_udf(run, "array<boolean>")(text)


def _counts(text: Column, patterns: list[str]) -> Column:
    """array<int>: how often each pattern stands in the text."""
    held = may_hold(text, patterns)
    return F.array(*[F.when(held[k], F.regexp_count(text, F.lit(T.js_regex(p, "i")))).otherwise(0) for k, p in enumerate(patterns)])


def _found(text: Column, patterns: list[str]) -> Column:
    """array<array<string>>: what of the text matches each pattern."""
    held, none = may_hold(text, patterns), F.array().cast("array<string>")
    return F.array(*[F.when(held[k], F.regexp_extract_all(text, F.lit(T.js_regex(p, "i")), F.lit(0))).otherwise(none) for k, p in enumerate(patterns)])


def _matches(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(T.js_regex(pattern, "i")), F.lit(0)), T.collapse)


def angles(text: Column) -> Column:
    """array<struct<angle, label, score, evidence>>: scores of 20 and more, six at most, best first. Every
    pattern runs over the text once."""
    patterns = rules.table(rules.ANGLE_PATTERNS)

    def judge(m: Column) -> Column:
        hits = []
        for pos, (key, label, _) in enumerate(rules.table(rules.ANGLES)):
            own = [(k, float(w)) for k, (name, w, _) in enumerate(patterns) if name == key]
            raw = reduce(lambda a, b: a + b, [F.lit(w) * F.least(F.lit(3), F.size(m[k])) for k, w in own])
            evidence = F.slice(F.array_distinct(F.transform(F.concat(*[F.slice(m[k], 1, 3) for k, _ in own]), T.collapse)), 1, 6)
            hits.append(F.struct((-S.angle_score(raw)).alias("order"), F.lit(pos).alias("pos"), F.lit(key).alias("angle"), F.lit(label).alias("label"), evidence.alias("evidence")))
        best = F.slice(F.array_sort(F.filter(F.array(*hits), lambda h: h["order"] <= -20)), 1, 6)
        return F.transform(best, lambda h: F.struct(h["angle"].alias("angle"), h["label"].alias("label"), (-h["order"]).alias("score"), h["evidence"].alias("evidence")))

    return T.let(_found(text, [p for _, _, p in patterns]), judge)


def awareness(text: Column, found: Column) -> Column:
    """The stage of the highest score from rules and detected angles; without any, by length. found: angle keys.

    On a tie the stage that was scored first wins: rules in order, then the angles' additions in theirs.
    """
    table = rules.table(rules.AWARENESS)
    order = list(dict.fromkeys(stage for stage, _, _ in table))

    # Counts and angles are bound together: what is named inside a lambda would be worked out at each of its places.
    def judge(x: Column) -> Column:
        scored, n, own = [], x["n"], x["found"]
        for bump, (keys, stage, points) in enumerate(rules.AWARENESS_BUMPS):
            by_rule = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.least(F.lit(3), n[k]) for k, (s, w, _) in enumerate(table) if s == stage])
            has = F.arrays_overlap(own, F.array(*[F.lit(k) for k in keys]))
            total = by_rule + F.when(has, points).otherwise(0.0)
            scored.append(F.struct((-total).alias("neg"), F.when(by_rule > 0, order.index(stage)).otherwise(len(order) + bump).alias("first"), F.lit(stage).alias("stage")))
        return F.array_min(F.filter(F.array(*scored), lambda x: x["neg"] < 0))["stage"]

    best = T.let(F.struct(_counts(text, [p for _, _, p in table]).alias("n"), found.alias("found")), judge)
    return F.coalesce(best, F.when(T.word_count(text) < 25, "most-aware").otherwise("solution-aware"))


def first_match(text: Column, table: list[tuple[str, Column]], default: Column | str) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in table], F.lit(default) if isinstance(default, str) else default)


def hook(text: Column) -> Column:
    """The first sentence, 220 characters at most."""
    return T.truncate(F.coalesce(F.get(T.sentences(text), 0), text), 220)


def hook_type(h: Column) -> Column:
    return first_match(h, [(name, F.trim(h).rlike(T.js_regex(p, flags))) for name, flags, p in rules.table(rules.HOOKS)], "statement")


def copy_format(text: Column, words: Column) -> Column:
    """X19."""
    rows = []
    for name, flags, least, most, pattern in rules.FORMATS:
        test = text.rlike(T.js_regex(pattern, flags))
        test = test & (words >= least) if least else test
        rows.append((name, test & (words <= most) if most else test))
    return first_match(text, rows, F.when(words <= 60, "short-copy").otherwise("long-copy"))


def emotions(text: Column) -> Column:
    """Five at most, the most often named first."""
    table = rules.table(rules.EMOTIONS)

    def named(n: Column) -> Column:
        each = F.array(*[F.struct((-n[k]).alias("neg"), F.lit(k).alias("pos"), F.lit(name).alias("emotion")) for k, (name, _) in enumerate(table)])
        return F.slice(F.transform(F.array_sort(F.filter(each, lambda x: x["neg"] < 0)), lambda x: x["emotion"]), 1, 5)

    return T.let(_counts(text, [p for _, p in table]), named)


def offers(text: Column) -> Column:
    """array<struct<kind, detail>>: two matches a rule at most, the first spelling of each kept."""
    table = rules.table(rules.OFFERS)

    def named(found: Column) -> Column:
        return F.concat(*[_twice(F.transform(F.slice(found[k], 1, 2), T.collapse), kind) for k, (kind, _) in enumerate(table)])

    return T.let(_found(text, [p for _, p in table]), named)


def _twice(own: Column, kind: str) -> Column:
    """Two matches of a rule, or the first where they differ in case alone."""
    once = F.when((F.size(own) == 2) & (F.lower(F.get(own, 0)) == F.lower(F.get(own, 1))), F.slice(own, 1, 1)).otherwise(own)
    return _named(once, kind)


def _named(details: Column, kind: str) -> Column:
    return F.transform(details, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("detail")))


def claims(text: Column) -> Column:
    """The first six sentences of 220 characters at most that hold a claim's verb."""
    own = F.filter(T.sentences(text), lambda s: s.rlike(T.js_regex(rules.CLAIM, "i")) & (F.length(s) <= 220))
    return F.transform(F.slice(own, 1, 6), lambda s: T.truncate(s, 200))


def proof_points(text: Column) -> Column:
    """Ten distinct figures at most."""
    return F.slice(F.array_distinct(_matches(text, rules.PROOF)), 1, 10)


def call_to_action(text: Column, told: Column | None = None) -> Column:
    """What the ad states, else the first phrase that calls to act, else null."""
    found = F.nullif(T.collapse(F.regexp_extract(text, T.js_regex(rules.CTA, "i"), 0)), F.lit(""))
    return found if told is None else F.coalesce(F.nullif(T.collapse(told), F.lit("")), found)


def described(angle: Column) -> Column:
    """struct<label, description> of an angle's key; null for what is no angle."""
    rows = [F.when(angle == key, F.struct(F.lit(label).alias("label"), F.lit(told).alias("description"))) for key, label, told in rules.table(rules.ANGLES)]
    return F.coalesce(*rows)


def offer_counts(ads: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Offers (column offers, as `offers` gives them) by kind and lower-cased detail, the first spelling by pos kept: keys, kind,
    detail, n, place."""
    each = ads.select(*keys, "pos", F.posexplode("offers").alias("nth", "o")).select(*keys, "pos", "nth", "o.kind", "o.detail")
    # pos and nth as one number, which a hash table holds in place.
    pos = F.coalesce(F.col("pos").cast("decimal(20,0)"), F.lit(-(2**63)).cast("decimal(20,0)"))
    return count_offers(each.withColumn("at", pos * F.lit(2**31).cast("decimal(10,0)") + F.col("nth").cast("decimal(10,0)")), keys, most)


def count_offers(each: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """A12 of single offers: keys, at (a number by which they follow each other), kind, detail. Spellings are counted first, in hash
    tables, so that nothing as long as the offers is sorted."""
    from pyspark.sql import Window

    spelt = each.groupBy(*keys, "kind", "detail").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    n = spelt.groupBy(*keys, "kind", F.lower("detail").alias("low")).agg(F.sum("n").alias("n"), F.min(F.struct("at", "detail"))["detail"].alias("detail"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "kind", "detail"))
    return n.drop("low").withColumn("place", place).filter(F.col("place") <= most)


def top_hooks(ads: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Keys and the hooks of the first ads by exposure, then arrival."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("exposure"), "pos"))
    first = ads.withColumn("place", place).filter(F.col("place") <= most)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hook"))), lambda x: x["hook"]).alias("hooks"))


def analyse(ads: DataFrame) -> DataFrame:
    """Ads (title, body, link_description, cta_text) with their copy and all of the above put in."""
    text = F.col("copy")
    out = ads.withColumn("copy", copy_of(*[F.col(c) for c in ("title", "body", "link_description", "cta_text")]))
    out = out.withColumns({"words": T.word_count(text), "angles": angles(text), "hook": hook(text)})
    return out.withColumns({
        "primary_angle": F.get("angles", 0)["angle"], "awareness": awareness(text, F.transform("angles", lambda a: a["angle"])), "hook_type": hook_type(F.col("hook")), "format": copy_format(text, F.col("words")),
        "emotions": emotions(text), "offers": offers(text), "claims": claims(text), "cta": call_to_action(text, F.col("cta_text")), "proof_points": proof_points(text), "reading_ease": T.reading_ease(text),
    })


def per_copy(ads: DataFrame, parts: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ads with the columns that `read` adds to a table of their copy (the columns in parts). Ads repeat their copy, so each distinct
    one is read once, by as many tasks as its shuffle has, and joined back, null to null."""
    own = {p: f"own_{p}" for p in parts}
    once = read(ads.select(*parts).distinct()).withColumnsRenamed(own)
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(k)) for p, k in own.items()])
    return ads.join(once, same).drop(*own.values())
