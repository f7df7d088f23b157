"""The whole run as one lazily evaluated flow over tables of pages and ad records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.config import EngineConfig
from adlens.functions import text as T
from adlens.functions import url as U
from adlens.operators import ads as A
from adlens.operators import classify as C
from adlens.operators import copy as X
from adlens.operators import pages as P
from adlens.operators import profile as B
from adlens.operators import report as O
from adlens.operators import resolve as R
from adlens.operators import rollup as RU
from adlens.operators import vocabulary as V


@dataclass(frozen=True)
class Results:
    """candidates, profiles (with classification), terms (what to search for), ads (ranked and analysed), vocabulary,
    inventory (published pages by kind), gaps (published without ads), reports (one row a brand), details (all further looks, by
    name; see `details`)."""

    candidates: DataFrame
    profiles: DataFrame
    terms: DataFrame
    ads: DataFrame
    vocabulary: DataFrame
    inventory: DataFrame
    gaps: DataFrame
    reports: DataFrame
    details: dict[str, DataFrame]


def _below(domain: str, hosts: tuple[str, ...]):  # noqa: ANN202
    """whether a domain is one of the hosts or below it."""
    hit = F.lit(False)
    for x in hosts:
        own = x.lower().removeprefix("www.")
        hit |= (F.col(domain) == own) | F.col(domain).endswith("." + own)
    return hit


def discover(config: EngineConfig, pages: DataFrame) -> DataFrame:
    """Source pages (url, html) -> the best candidates of all of them (H4, H5, A2, W4, F2, F5): domain, url, name, score,
    source_pos. A page of one brand's own site stands for itself; `discovery_mode` may settle which it is."""
    read = pages.withColumn("page", P.read_html(F.col("html"), config.brand_link_selector))
    found = P.discover(P.links(read), 100)
    if config.exclude_domains:
        found = found.filter(~_below("domain", config.exclude_domains))
    if config.include_domains:
        found = found.filter(_below("domain", config.include_domains))
    if config.discovery_mode == "auto":
        mode = B.discovery_mode(found, read)
    else:
        mode = read.select("url", F.lit(config.discovery_mode).alias("mode"))
    listed = found.join(mode.filter("mode = 'outbound-links'").select(F.col("url").alias("page_url")), "page_url", "left_semi").filter(F.col("place") <= config.max_brands)
    own = B.self_candidates(read).join(mode.filter("mode = 'single-brand'").select("url"), "url", "left_semi")
    both = listed.select("domain", "url", "name", "score", F.col("place").cast("long").alias("source_pos"), "anchors").union(own.select("domain", "url", "name", "score", F.lit(0).cast("long"), F.array().cast("array<string>")))
    return P.dedupe_candidates(both, config.max_brands)


def profile(config: EngineConfig, candidates: DataFrame, fetched: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Candidates read on their own sites (H16) and classified (G6, G19): the profile's columns, niche, sub_niche, confidence,
    alternatives, audience. A confidence under `min_classification_confidence` is unclassified. taxonomy: as `classify.taxonomy` gives it;
    without one the built-in niches stand, and the run's own `custom_taxonomy` goes over either."""
    p = B.profiles(candidates, fetched, config.profile_depth, config.max_products_per_brand)
    spark = p.sparkSession
    own = C.taxonomy(spark, config.taxonomy)
    base = C.taxonomy(spark, C.built_in()) if taxonomy is None else taxonomy
    terms = C.merge_taxonomy(base, own) if config.taxonomy else base
    nested = {n: dict(subs) for n, subs in C.built_in().items()}
    for niche, subs in config.taxonomy.items():
        nested.setdefault(niche, {}).update(subs)
    texts = p.select(F.col("url").alias("id"), T.normalise(F.col("corpus")).alias("text"))
    found = C.classified(texts, nested, terms, least_confidence=float(config.min_classification_confidence))
    named = found.select(F.col("id").alias("url"), F.when(F.col("unclassified"), C.UNCLASSIFIED).otherwise(F.col("niche")).alias("niche"), F.when(F.col("unclassified"), C.UNCLASSIFIED).otherwise(F.col("sub")).alias("sub_niche"), "confidence", "alternatives", "evidence", "audience")
    return p.join(named, "url", "left")


def queries(config: EngineConfig, profiles: DataFrame) -> DataFrame:
    """(brand, pos, term): what to search the ad libraries for."""
    brands = profiles.select(F.col("domain").alias("brand"), "brand_name")
    products = profiles.select(F.col("domain").alias("brand"), F.posexplode("products").alias("pos", "p")).select("brand", F.col("p.name").alias("product"), "pos")
    return A.search_terms(brands, products, config.ad_search_strategy, config.max_product_queries)


def research(config: EngineConfig, records: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Provider records (with brand) -> ranked, analysed ads of each brand: only the survivors' copy is read. With terms,
    each ad is named after the term that found it (J14)."""
    ads = A.dedupe(A.read_records(records, F.lit(config.as_of).cast("timestamp")).join(records.select("pos", "brand"), "pos"))
    ranked = A.rank(A.score(ads, config.rank_by), config.ads_per_brand, float(config.min_exposure_score))
    ranked = A.attribute_term(ranked, terms) if terms is not None else ranked
    ranked = ranked.withColumns({"start": F.col("start_date").try_cast("timestamp"), "url": U.canonical_landing(F.col("landing_url")), "funnel": U.funnel_type(F.col("landing_url"), F.col("brand"))})
    return X.analyse(ranked.fillna("", ["title", "link_description", "cta_text"]))


def inventory(config: EngineConfig, profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """(brand, pos, url): what the brands' sites publish, from documents (url, body)."""
    sites = profiles.select(F.col("domain").alias("brand"), F.col("url").alias("site"))
    return P.crawl(documents, sites.select("site"), most_urls=config.max_sitemap_urls).join(sites, "site").select("brand", "pos", "url")


def details(config: EngineConfig, profiles: DataFrame, ads: DataFrame, published: DataFrame, fetched: DataFrame, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """The further looks at each brand, each with a column brand: gaps and kinds of its site, destinations it does not publish, who
    is behind it, and where the options ask for them its landing pages, product pages and checkout read."""
    sites = profiles.select(F.col("domain").alias("brand"), "url")
    spark = profiles.sparkSession
    advertised = ads.filter("url is not null").select("brand", "url", F.col("rank").alias("pos"))
    pages = fetched.select("url", "status", "body")
    found = {"inventory": P.kind_counts(published, ["brand"]), "gaps": P.unadvertised(published, advertised, ["brand"]), "unlisted": P.unlisted(published, advertised, ["brand"])}
    none = F.lit(None).cast("string")
    known = aliases if aliases is not None else spark.createDataFrame([], "pos int, " + ", ".join(f"{c} string" for c in R.ALIAS_COLUMNS))
    signals = R.signals(R.identity_pages(sites.withColumnRenamed("brand", "site"), pages))
    inputs = profiles.select(F.col("domain").alias("id"), none.alias("slug"), none.alias("name"), F.col("url").alias("website"))
    found["resolution"] = R.resolve(inputs, signals, known).withColumnRenamed("brand", "trading_name").withColumnRenamed("id", "brand")
    if config.analyse_landing_pages:
        landing = RU.landing_pages(ads.withColumn("angles", F.transform("angles", lambda a: a["angle"])), ["brand"])
        asked = landing.select("brand", "url", F.col("total_exposure").alias("exposure"), F.transform("angles", lambda a: a["angle"]).alias("angles"))
        found["teardowns"] = P.teardown(pages.withColumnRenamed("body", "html"), asked, config.max_landing_pages_per_brand, ("brand",))
    if config.analyse_product_pages:
        product = lambda df: df.filter(U.page_kind(F.col("url")) == "product")
        listed = profiles.select(F.col("domain").alias("brand"), F.explode("page_products").alias("p")).select("brand", "p.pos", F.col("p.product_url").alias("url"))
        targets = B.product_targets(product(advertised), product(published), listed, config.max_product_pages_per_brand)
        found["product_pages"] = B.read_product_pages(targets, pages)
    if config.analyse_checkout:
        found["checkout"] = B.checkout(sites, pages)
    return found


#: What a brand's row shows of each detail, and in which order.
SHOWN = {
    "vocabulary": (["slot", "term", "ad_count", "ad_share", "words", "avg_exposure"], ["slot", "place"]), "inventory": (["kind", "count", "share", "samples"], ["-count", "kind"]), "gaps": (["kind", "count", "examples"], ["-count", "kind"]), "unlisted": (["url"], ["url"]),
    "resolution": (["status", "confidence", "trading_name", "legal_entity", "review_reason"], ["status"]), "teardowns": (["url", "shape", "words", "ctas", "match", "match_note", "error"], ["url"]),
    "product_pages": (["url", "title", "price", "review_count", "guarantee_days", "error"], ["place"]), "checkout": (["cart_style", "free_shipping_over", "payment_methods", "bnpl", "return_days"], ["cart_style"]),
}


def run(config: EngineConfig, pages: DataFrame, fetched: DataFrame, records: DataFrame, work: str, taxonomy: DataFrame | None = None, aliases: DataFrame | None = None) -> Results:
    """pages: url, html of the start pages; fetched: url, status, content_type, body of everything read from the brands'
    sites; records: brand (the domain), provider, matched_query, pos, record; aliases: who is known to stand behind a brand. work: a
    folder that driver and executors share; every step's rows are written there once, and what follows reads them, so nothing is worked
    out twice. The report rows and the run's document both come from `reports`."""

    def done(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

    candidates = done(discover(config, pages), "candidates")
    profiles = done(profile(config, candidates, fetched, taxonomy), "profiles")
    terms = done(queries(config, profiles), "terms")
    ads = done(research(config, records, terms), "ads")
    brands = profiles.select(F.col("domain").alias("brand"), "brand_name", F.col("url").alias("website"), "niche", "sub_niche", "audience", "confidence", "platform", "tech_stack", "commerce")
    words = ads.select("brand", F.col("ad_id").alias("ad"), "exposure", "title", "body", "link_description", "cta_text", "hook", F.transform("angles", lambda a: a["angle"]).alias("angles"))
    names = profiles.select(F.col("domain").alias("brand"), F.concat(F.array("brand_name"), F.transform("products", lambda p: p["name"])).alias("names"))
    vocabulary = done(V.brand_vocabulary(words, names), "vocabulary")
    published = done(inventory(config, profiles, fetched.filter("status < 400").select("url", "body")), "published")
    more = {name: done(df, name) for name, df in details(config, profiles, ads, published, fetched, aliases).items()}
    order = lambda c: F.desc(c[1:]) if c.startswith("-") else F.col(c)
    shown = {name: (df, SHOWN[name][0], [order(c) for c in SHOWN[name][1]]) for name, df in ({"vocabulary": vocabulary} | more).items()}
    reports = done(O.with_details(O.brand_reports(brands, ads, config.as_of, config.proven_winner_min_days), shown), "reports")
    return Results(candidates, profiles, terms, ads, vocabulary, more["inventory"], more["gaps"], reports, more)


def document(config: EngineConfig, results: Results) -> dict:
    """The run's document, with the best 25 ads of all brands."""
    from adlens.sources.providers import graph_warnings

    top = results.ads.orderBy(F.desc("exposure"), "brand", "rank").select("brand", "ad_id", "exposure", "hook", "url").limit(25)
    said = graph_warnings(config.countries) if config.provider == "meta-graph" else ()
    return O.run_report(results.reports, config.as_of, (*config.warnings, *said), [r.asDict() for r in top.collect()])


def write(config: EngineConfig, results: Results, folder: str, run_name: str) -> dict[str, str]:
    """K1-K4: the brand rows added to the dataset at folder/brands, and the documents that `output_formats` asks for: name -> text."""
    O.write_rows(results.reports, f"{folder}/brands", run_name)
    made = document(config, results)
    texts = {"json": ("REPORT.json", O.document), "markdown": ("REPORT.md", O.markdown), "html": ("REPORT.html", O.html)}
    return {texts[f][0]: texts[f][1](made) for f in config.output_formats}
