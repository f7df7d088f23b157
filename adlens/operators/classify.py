"""Niche and audience classification by weighted terms."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.dims.rules import STOPWORDS
from adlens.functions import score as S
from adlens.functions import text as T


def taxonomy(spark, nested: dict[str, dict[str, dict]]) -> DataFrame:  # noqa: ANN001
    """{niche: {sub: {"terms": [term or [term, weight]], "audience": [...]}}} as a table
    (niche, sub, sub_pos, term, weight). The taxonomy is a parameter: its terms are the caller's."""
    rows, pos = [], 0
    for niche, subs in nested.items():
        for sub, body in subs.items():
            for term in body["terms"] if isinstance(body, dict) and isinstance(body.get("terms"), list) else ():
                name, weight = (term, 1.0) if isinstance(term, str) else term
                rows.append((niche, sub, pos, name, float(weight)))
            pos += 1
    return spark.createDataFrame(rows, "niche string, sub string, sub_pos int, term string, weight double")


#: What a name says as a whole, what a part of it says that is a phrase or a word of its own, and a word of such a phrase.
NAME_WEIGHT, PART_WEIGHT, WORD_WEIGHT = 4.0, 3.0, 1.0


def _terms_of(name: str) -> list[list]:
    """The terms of a sub-niche by its name: "Sports & performance" -> the parts at 3 (each one word); "Sun care" -> the whole at
    4 and its words at 1."""
    parts = [p.strip().lower() for p in re.split(r"[&,]", name) if p.strip()]
    terms: dict[str, float] = {}
    for part in parts:
        terms[part] = NAME_WEIGHT if len(parts) == 1 and " " in part else PART_WEIGHT
        for word in part.split() if " " in part else ():
            if len(word) > 2 and word not in STOPWORDS:
                terms.setdefault(word, WORD_WEIGHT)
    return [[t, w] for t, w in terms.items()]


def built_in() -> dict[str, dict[str, dict]]:
    """G1: the built-in niches and sub-niches with their audience hints, as `taxonomy` takes them. Their terms follow from the
    names by a rule (`_terms_of`); a caller with term lists of its own hands them to `merge_taxonomy` or the run's option."""
    nested: dict[str, dict[str, dict]] = {}
    for niche, subs in rules.table(rules.NICHES):
        for entry in subs.split("; "):
            name, _, hints = entry.partition(" | ")
            nested.setdefault(niche, {})[name] = {"terms": _terms_of(name), "audience": hints.split(", ") if hints else []}
    return nested


def hints(spark, nested: dict[str, dict[str, dict]]) -> DataFrame:  # noqa: ANN001
    """A5: (niche, sub, audience): the audiences that a sub-niche hints at."""
    rows = [(n, s, a) for n, subs in nested.items() for s, body in subs.items() for a in body.get("audience", [])]
    return spark.createDataFrame(rows, "niche string, sub string, audience string")


def audience_terms(spark) -> DataFrame:  # noqa: ANN001
    """The built-in audiences: audience, pos, term, weight."""
    rows = [(a, k, term.rsplit(":", 1)[0], float(term.rsplit(":", 1)[1])) for k, (a, terms) in enumerate(rules.table(rules.AUDIENCES)) for term in terms.split(", ")]
    return spark.createDataFrame(rows, "audience string, pos int, term string, weight double")


def merge_taxonomy(base: DataFrame, override: DataFrame) -> DataFrame:
    """An override replaces whole sub-niches and adds new ones behind."""
    kept = base.join(override.select("niche", "sub").distinct(), ["niche", "sub"], "left_anti")
    top = F.coalesce(F.lit(base.agg(F.max("sub_pos")).first()[0]), F.lit(-1)) + 1
    own = base.select("niche", "sub", F.col("sub_pos").alias("old")).distinct()
    placed = override.join(own, ["niche", "sub"], "left").withColumn("sub_pos", F.coalesce("old", F.col("sub_pos") + top)).drop("old")
    return kept.unionByName(placed.select(*base.columns))


#: Terms that become part of the plan; more are joined.
PLANNED_TERMS = 5_000
#: Up to so many terms it is cheaper to look for each than to look up a text's runs.
FEW_TERMS = 64


def term_hits(texts: DataFrame, terms: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, term, hits) for the terms that a folded text (columns id, text) holds as whole words, terms of any
    length and number.

    An index finds the terms that a text may hold in one pass over it: each term hangs on its longest run of letters and
    digits, the text's own runs are looked up, and only the terms found that way are counted. With up to PLANNED_TERMS terms
    the index is a constant of the plan and each text is read where it stands; with more, runs and index are joined, and a
    text moves once, to the terms it may hold. A term without such a run is looked for in every text.
    """
    folded = terms.select("term").distinct().select("term", T.normalise(F.col("term")).alias("folded")).filter("folded != ''")
    runs = F.regexp_extract_all("folded", F.lit("[a-z0-9]+"), F.lit(0))
    indexed = folded.withColumn("anchor", F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), 0)["r"])
    known = indexed.limit(PLANNED_TERMS + 1).collect()
    own = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)))
    if len(known) <= FEW_TERMS:
        every = [F.struct(F.lit(r.term).alias("term"), F.lit(r.folded).alias("folded")) for r in sorted(known, key=lambda r: r.term)]
        held = texts.select(id_col, "text", (F.array(*every) if every else F.expr("cast(array() as array<struct<term:string,folded:string>>)")).alias("met"))
    elif len(known) <= PLANNED_TERMS:
        by: dict[str, list[dict]] = {}
        for r in sorted(known, key=lambda r: r.term):
            by.setdefault(r.anchor or "", []).append({"term": r.term, "folded": r.folded})
        index = F.from_json(F.lit(json.dumps(by)), "map<string,array<struct<term:string,folded:string>>>")
        names = F.from_json(F.lit(json.dumps(sorted(by))), "array<string>")
        met = F.flatten(F.transform(F.array_intersect(F.concat(own, F.array(F.lit(""))), names), lambda a: F.element_at(index, a)))
        held = texts.select(id_col, "text", met.alias("met"))
    else:
        may = texts.select(id_col, F.explode(F.concat(own, F.array(F.lit("")))).alias("anchor")).join(indexed.withColumn("anchor", F.coalesce("anchor", F.lit(""))), "anchor")
        held = texts.select(id_col, "text").join(may.groupBy(id_col).agg(F.collect_list(F.struct("term", "folded")).alias("met")), id_col)
    counted = F.transform(F.filter("met", lambda x: F.contains(F.col("text"), x["folded"])), lambda x: F.struct(x["term"].alias("term"), T.count_term(F.col("text"), x["folded"]).alias("hits")))
    return held.select(id_col, F.inline(counted)).filter("hits > 0")


def classify(hits: DataFrame, terms: DataFrame, id_col: str = "id", least_confidence: float = 25.0) -> DataFrame:
    """One row an id that has any hit: niche, sub, confidence, unclassified, alternatives
    array<string> (three others, best first), evidence array<string> (twelve terms, by hits x weight). hits: id, term,
    hits."""
    scored = hits.join(terms, "term").groupBy(id_col, "niche", "sub", "sub_pos").agg(
        F.sum(S.dampen(F.col("hits")) * F.col("weight")).alias("raw"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("hits") * F.col("weight")).alias("o"), "term"))), 1, 12), lambda x: x["term"]).alias("evidence"),
    )
    w = Window.partitionBy(id_col)
    order = [F.desc("raw"), F.col("sub_pos")]
    ranked = scored.filter("raw > 0").withColumn("total", F.sum("raw").over(Window.partitionBy(id_col, "niche"))).withColumn("place", F.row_number().over(w.orderBy(*order)))
    # The winner's niche rules unless another has strictly more in total; then the largest, first in order of place.
    won = F.max(F.when(F.col("place") == 1, F.col("total"))).over(w)
    ranked = ranked.withColumn("lead", F.when(F.max("total").over(w) > won, F.min_by("niche", F.struct(-F.col("total"), "place")).over(w)).otherwise(F.min_by("niche", "place").over(w)))
    chosen = F.min(F.when(F.col("niche") == F.col("lead"), F.col("place"))).over(w)
    ranked = ranked.withColumn("chosen", chosen)
    others = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("place") != F.col("chosen"), F.struct("place", F.concat_ws(" / ", "niche", "sub").alias("name"))))), 1, 3), lambda x: x["name"])
    best = ranked.groupBy(id_col).agg(F.max(F.when(F.col("place") == F.col("chosen"), F.struct("niche", "sub", "raw", "total", "evidence"))).alias("b"), others.alias("alternatives"))
    out = best.select(id_col, "b.niche", "b.sub", S.confidence(F.col("b.raw") + F.col("b.total") * 0.25).alias("confidence"), "alternatives", "b.evidence")
    return out.withColumn("unclassified", F.col("confidence") < least_confidence)


UNCLASSIFIED = "Unclassified"


def classified(texts: DataFrame, nested: dict[str, dict[str, dict]], terms: DataFrame | None = None, id_col: str = "id", least_confidence: float = 25.0) -> DataFrame:
    """One row a text (id, text, folded): niche, sub, confidence, unclassified, alternatives, evidence and audience. A text
    without a term of any niche is Unclassified with confidence 0. A sub-niche's hints count for its audience. terms: the
    taxonomy as a table, if it is not that of `nested`, which then only gives the hints."""
    spark = texts.sparkSession
    table = taxonomy(spark, nested) if terms is None else terms
    found = classify(term_hits(texts, table, id_col), table, id_col, least_confidence)
    people = audience_terms(spark)
    told = found.join(hints(spark, nested), ["niche", "sub"]).select(id_col, "audience")
    for_whom = audience(term_hits(texts, people, id_col), people, told, id_col).select(id_col, "audience")
    out = texts.select(id_col).join(found, id_col, "left").join(for_whom, id_col, "left")
    none = F.array().cast("array<string>")
    filled = {"niche": F.coalesce("niche", F.lit(UNCLASSIFIED)), "sub": F.coalesce("sub", F.lit(UNCLASSIFIED)), "confidence": F.coalesce("confidence", F.lit(0.0)), "unclassified": F.coalesce("unclassified", F.lit(True)), "alternatives": F.coalesce("alternatives", none), "evidence": F.coalesce("evidence", none)}
    return out.withColumns(filled)


def audience(hits: DataFrame, terms: DataFrame, hints: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """A5: (id, audience, score) of the best audience of at least 4 points. terms: audience, pos, term, weight; hints:
    id, audience (six points each)."""
    n = hits.join(terms, "term").groupBy(id_col, "audience", "pos").agg(F.sum(S.dampen(F.col("hits")) * F.col("weight")).alias("score"))
    if hints is not None:
        named = hints.join(terms.select("audience", "pos").distinct(), "audience").select(id_col, "audience", "pos", F.lit(6.0).alias("score"))
        n = n.union(named.select(*n.columns)).groupBy(id_col, "audience", "pos").agg(F.sum("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "pos"))
    return n.withColumn("place", place).filter("place = 1 and score >= 4").select(id_col, "audience", "score")
