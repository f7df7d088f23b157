"""Entity resolution: who stands behind a brand, from signals with weights, an alias table and its upkeep as CSV."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.dims.rules import LEGAL_FORMS
from adlens.functions import score as S
from adlens.functions import text as T
from adlens.functions import url as U

#: Where a site says who runs it, and the kind of page each is.
IDENTITY_PATHS = rules.IDENTITY_PATHS
RIVAL = 25
CONFIDENT = 70
ALIAS_COLUMNS = ("legal_entity", "brand", "website", "linkedin_slug", "confirmed_by", "confirmed_at")
REVIEW_COLUMNS = ("status", "confidence", "brand", "legal_entity", "website", "linkedin_slug", "review_reason", "evidence", "confirm_brand", "confirm_legal_entity")

_NAME = rf"([A-Z0-9][\w&.,'’\-/ ]{{1,60}}?[\w.’])[,\s]+({LEGAL_FORMS})"
_SIGNAL = "array<struct<role:string,value:string,source:string,weight:int,quote:string>>"


def signals(pages: DataFrame) -> DataFrame:
    """(site, pos, role, value, source, weight, quote, url) of each page of a site: trademark lines (the owner and the
    brand), the wordings of contracts, copyright lines, JSON-LD names, the site's name and its title. Quotes are 220
    characters at most. pages: site, pos, kind, text, json_ld array<string>, site_name, and title and url if known."""

    def column(name: str) -> Column:
        return F.col(name) if name in pages.columns else F.lit(None).cast("string")

    def claim(role: str, value: Column, source: Column | str, weight: Column | int, quote: Column | None = None) -> Column:
        made = {"role": F.lit(role), "value": value, "source": F.lit(source) if isinstance(source, str) else source, "weight": (F.lit(weight) if isinstance(weight, int) else weight).cast("int"), "quote": F.lit(None).cast("string") if quote is None else T.truncate(quote, 220)}
        return F.struct(*[x.alias(k) for k, x in made.items()])

    def named(prefix: str, source: Column | str, weight: Column | int) -> Column:
        pattern = T.js_regex(prefix + _NAME, "i")
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda q: claim("legal-entity", clean_entity(F.regexp_extract(q, pattern, 1), F.regexp_extract(q, pattern, 2)), source, weight, q))

    def one(value: Column, role: str, source: str, weight: int) -> Column:
        clean = T.collapse(value)
        return F.when(F.length(clean).between(2, 90), F.array(claim(role, clean, source, weight))).otherwise(F.array().cast(_SIGNAL))

    mark = T.js_regex(rules.TRADEMARK + _NAME, "i")
    marks = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(mark), F.lit(0)), lambda q: F.array(claim("legal-entity", clean_entity(F.regexp_extract(q, mark, 2), F.regexp_extract(q, mark, 3)), "trademark-notice", 50, q), claim("brand", T.collapse(F.regexp_extract(q, mark, 1)), "trademark-notice", 50, q))))
    source, weight = (F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[i])) for k, v in rules.PAGE_SOURCES.items()], F.lit(rules.PAGE_SOURCES["other"][i])) for i in (0, 1))
    text = lambda n, path: F.when(~F.coalesce(F.get_json_object(n, path), F.lit("")).rlike(r"^[\[{]"), F.get_json_object(n, path))
    nodes = F.flatten(F.transform("json_ld", lambda n: F.concat(one(text(n, "$.legalName"), "legal-entity", "jsonld-legal-name", 40), one(text(n, "$.name"), "brand", "jsonld-legal-name", 20), one(text(n, "$.alternateName"), "brand", "jsonld-legal-name", 15), one(text(n, "$.parentOrganization.name"), "legal-entity", "jsonld-parent", 35))))
    title = F.split(column("title"), r"[|\-–—]")[0]
    every = F.concat(*[F.coalesce(x, F.array().cast(_SIGNAL)) for x in (marks, *[named(p, source, weight) for p in rules.CONTRACTS], named(rules.COPYRIGHT, "footer-copyright", 30), nodes, one(F.col("site_name"), "brand", "og-site-name", 25), one(title, "brand", "page-title", 10))])
    return pages.select("site", "pos", column("url").alias("url"), F.posexplode(every).alias("nth", "s")).select("site", F.struct("pos", "nth").alias("pos"), "s.*", "url")


def identity_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """What `signals` reads of each site (site, url): its home page and those of IDENTITY_PATHS that pages (url, status,
    body) hold, parsed; its legal pages come first in order of the paths."""
    from adlens.operators import pages as P

    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    paths = F.posexplode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind")) for p, k in IDENTITY_PATHS])).alias("pos", "p")
    asked = sites.select("site", base.alias("base"), paths).select("site", F.concat("base", "p.path").alias("url"), (F.col("pos") + 1).alias("pos"), "p.kind").union(sites.select("site", "url", F.lit(0), F.lit("home")))
    read = asked.join(pages.filter("status < 400").select("url", "body"), "url").withColumn("page", P.read_html(F.col("body")))
    return P.page_meta(read, "body").select("site", "pos", "kind", "url", T.truncate(F.col("page.body"), 60_000).alias("text"), F.col("page.json_ld").alias("json_ld"), F.element_at(F.col("page.meta"), "og:site_name").alias("site_name"), F.col("page.title").alias("title"))


def clean_entity(name: Column, form: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(T.collapse(name), r"(?i)^(?:the|by|and|of|to|is|are|a|an)\s+", ""), r"[,\s]+$", "")
    return F.substring(F.concat_ws(", ", base, F.nullif(T.collapse(form), F.lit(""))), 1, 90)


def dedupe_signals(found: DataFrame, keys: list[str]) -> DataFrame:
    """The strongest of each role, folded name and source; the first on a tie."""
    order = Window.partitionBy(*keys, "role", "name", "source").orderBy(F.desc("weight"), "pos")
    return found.withColumn("name", T.company_name(F.col("value"))).filter("name != ''").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def score_claims(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, weight, spelling, sources): each source counts once, with its strongest, the second best for a
    half, the third for a third; the longest spelling is kept, the first on a tie."""
    once = found.groupBy(*keys, "name", "source").agg(F.max("weight").alias("weight"), F.min(F.struct((-F.length("value")).alias("n"), "pos", "value")).alias("s"))
    ranked = once.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "name").orderBy(F.desc("weight"), "source")))
    return ranked.groupBy(*keys, "name").agg(S.js_round(F.sum(F.col("weight") / F.col("i")), 1).alias("weight"), F.min("s")["value"].alias("spelling"), F.count("*").alias("sources"))


def claims_confidence(weight: Column) -> Column:
    """X67."""
    return S.confidence(weight, 45.0)


def top_evidence(found: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """W11."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "pos"))).filter(F.col("place") <= most)


def find_alias(inputs: DataFrame, aliases: DataFrame) -> DataFrame:
    """The first alias (by pos) that an input meets on slug, folded legal name, folded brand or host: four
    equi-joins. inputs: id, slug, name, website; aliases: pos and the alias columns."""
    a = aliases.withColumns({"a_slug": F.lower("linkedin_slug"), "a_entity": T.company_name(F.col("legal_entity")), "a_brand": T.company_name(F.col("brand")), "a_host": U.host_of(F.col("website"))})
    i = inputs.withColumns({"i_slug": F.lower("slug"), "i_name": T.company_name(F.col("name")), "i_host": U.host_of(F.col("website"))}).select("id", "i_slug", "i_name", "i_host")
    met = None
    for left, right in (("i_slug", "a_slug"), ("i_name", "a_entity"), ("i_name", "a_brand"), ("i_host", "a_host")):
        hit = i.filter(F.col(left) != "").join(a.filter(F.col(right) != ""), F.col(left) == F.col(right)).select("id", "pos", *ALIAS_COLUMNS)
        met = hit if met is None else met.union(hit)
    return met.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter("n = 1").drop("n", "pos")


def resolve(inputs: DataFrame, found: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row an input: status (confirmed, resolved, needs-review, unresolved), confidence, brand, entity,
    reason. inputs: id, slug, name, website; found: signals with site = id."""
    s = dedupe_signals(found.withColumnRenamed("site", "id"), ["id"])
    entity = score_claims(s.filter("role = 'legal-entity'"), ["id"]).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "name")))
    best = entity.filter("rank = 1").select("id", F.col("spelling").alias("entity"), F.col("name").alias("entity_name"), "weight")
    rivals = entity.filter((F.col("rank") > 1) & (F.col("weight") >= RIVAL)).groupBy("id").agg(F.count("*").alias("rivals"))
    brand = score_claims(s.filter("role = 'brand'"), ["id"]).groupBy("id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "spelling")).alias("b")).select("id", F.col("b.spelling").alias("brand"))
    name = T.company_name(F.col("name"))
    squash = F.replace(name, F.lit(" "), F.lit(""))
    any_match = entity.withColumnRenamed("name", "e").join(inputs.select("id", squash.alias("claimed")), "id").filter(F.replace("e", F.lit(" "), F.lit("")) == F.col("claimed")).groupBy("id").agg(F.min("rank").alias("met"))
    j = inputs.join(best, "id", "left").join(rivals, "id", "left").join(brand, "id", "left").join(any_match, "id", "left").join(find_alias(inputs, aliases).select("id", F.col("brand").alias("alias_brand"), F.col("legal_entity").alias("alias_entity"), F.lit(True).alias("known")), "id", "left")
    claimed = F.coalesce(name, F.lit("")) != ""
    against = claimed & F.col("entity").isNotNull() & F.col("met").isNull()
    points = F.coalesce("weight", F.lit(0.0)) + F.when(F.col("met") == 1, 35).when(F.col("met") > 1, 20).otherwise(0)
    sure = F.when(against, F.least(F.lit(45.0), claims_confidence(points))).otherwise(claims_confidence(points))
    status = F.when(F.col("known"), "confirmed").when(F.col("entity").isNull(), "unresolved").when(against | (F.col("rivals") > 0) | (sure < CONFIDENT), "needs-review").otherwise("resolved")
    reason = F.when(F.col("known"), None).when(F.col("entity").isNull(), "no legal entity found").when(against, "the name given is none of the entities found").when(F.col("rivals") > 0, "several entities are claimed").when(sure < CONFIDENT, "too little evidence")
    return j.select("id", status.alias("status"), F.when(F.col("known"), 100.0).otherwise(sure).alias("confidence"), F.coalesce("alias_brand", "brand", "name").alias("brand"), F.coalesce("alias_entity", "entity").alias("legal_entity"), "website", F.col("slug").alias("linkedin_slug"), reason.alias("review_reason"))


def signal_summary(signals: Column) -> Column:
    """One line of the distinct values (array<struct<value, source>>) with their sources, in order of first sight."""
    return F.array_join(F.array_distinct(F.transform(signals, lambda s: F.concat(s["value"], F.lit(" ("), s["source"], F.lit(")")))), " · ")


def resolution_summary(entity: Column, brand: Column, status: Column, confidence: Column, sources: Column) -> Column:
    """One line on a resolution, 240 characters at most. sources: array<string> of its evidence, in order."""
    entity, brand = F.nullif(entity, F.lit("")), F.nullif(brand, F.lit(""))
    head = F.coalesce(F.concat(entity, F.lit(" → "), brand), entity, brand, F.lit("unidentified"))
    said = F.coalesce(F.nullif(F.array_join(F.array_distinct(sources), ", "), F.lit("")), F.lit("no evidence"))
    sure = F.regexp_replace(confidence.cast("string"), r"\.0$", "")
    return T.truncate(F.concat(head, F.lit(" · "), status, F.lit(" ("), sure, F.lit(") · "), said), 240)


def stats(resolutions: DataFrame) -> DataFrame:
    """A35."""
    n = {s: F.count_if(F.col("status") == s) for s in ("confirmed", "resolved", "needs-review", "unresolved")}
    return resolutions.agg(F.count("*").alias("total"), *[x.alias(k.replace("-", "_")) for k, x in n.items()], S.share(n["confirmed"] + n["resolved"], F.count("*")).alias("automatic_rate"))


def review_queue(resolutions: DataFrame) -> DataFrame:
    """What a person has to look at, in the columns of the review sheet."""
    r = resolutions.filter(F.col("status").isin("needs-review", "unresolved"))
    have = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in r.columns else F.lit("").alias(c) for c in REVIEW_COLUMNS]
    return r.select(*have)


def to_alias(resolutions: DataFrame, by: str, as_of: str) -> DataFrame:
    """G12."""
    return resolutions.select("legal_entity", "brand", "website", "linkedin_slug", F.lit(by).alias("confirmed_by"), F.lit(as_of).alias("confirmed_at"))


def alias_key(row: str = "") -> Column:
    """Slug, else host, else folded legal name."""
    c = lambda n: F.col(f"{row}{n}")
    return F.coalesce(F.nullif(F.concat(F.lit("li:"), F.lower(c("linkedin_slug"))), F.lit("li:")), F.concat(F.lit("web:"), U.host_of(c("website"))), F.concat(F.lit("name:"), F.lower(c("legal_entity"))))


def merge_aliases(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(key, outcome, alias columns): outcome is kept, added, filled or conflict. The first incoming row of a key
    speaks for it; a row that contradicts what is known on brand or legal entity is a conflict and changes nothing, else
    it fills what is missing. existing and incoming: pos and the alias columns."""
    def first(df: DataFrame) -> DataFrame:
        k = df.withColumn("key", alias_key()).filter("key is not null")
        return k.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).filter("n = 1").drop("n", "pos")

    old, new = first(existing), first(incoming)
    j = old.select("key", *[F.col(c).alias(f"o_{c}") for c in ALIAS_COLUMNS], F.lit(True).alias("was")).join(new.select("key", *[F.col(c).alias(f"n_{c}") for c in ALIAS_COLUMNS], F.lit(True).alias("comes")), "key", "full_outer")

    def clash(c: str) -> Column:
        a, b = F.col(f"o_{c}"), F.col(f"n_{c}")
        return F.coalesce((a != "") & (b != "") & (F.lower(a) != F.lower(b)), F.lit(False))

    outcome = F.when(F.col("was").isNull(), "added").when(F.col("comes").isNull(), "kept").when(clash("brand") | clash("legal_entity"), "conflict").otherwise("filled")
    return j.select("key", outcome.alias("outcome"), *[F.coalesce(F.nullif(f"o_{c}", F.lit("")), F.when(outcome != "conflict", F.col(f"n_{c}"))).alias(c) for c in ALIAS_COLUMNS])


def read_csv(spark, path: str) -> DataFrame:  # noqa: ANN001
    """A CSV file with quoted fields over several lines; headers in snake case, cells trimmed, blank rows dropped."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    names = [re.sub(r"\s+", "_", re.sub(r"\s+", " ", c).strip().lower()) for c in raw.columns]
    out = raw.toDF(*names).select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names])
    return out.filter(F.concat(*[F.col(f"`{c}`") for c in names]) != "")


def read_aliases(spark, path: str) -> DataFrame:  # noqa: ANN001
    """An alias file or a filled review sheet; a review row that nobody filled in confirms nothing."""
    rows = read_csv(spark, path)
    have = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    review = "confirm_legal_entity" in rows.columns
    done = rows.filter((F.col("confirm_legal_entity") != "") | (F.col("confirm_brand") != "")) if review else rows
    own = {"legal_entity": have("confirm_legal_entity", "legal_entity"), "brand": have("confirm_brand", "brand")}
    return done.select(F.monotonically_increasing_id().alias("pos"), *[own.get(c, have(c)).alias(c) for c in ALIAS_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    """K5-K7: line feeds become spaces, quotes are doubled."""
    plain = df.select(*[F.regexp_replace(F.col(c).cast("string"), r"\r?\n", " ").alias(c) for c in df.columns])
    plain.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
