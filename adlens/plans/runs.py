"""Provider records, searches, identity, taxonomy and reports over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlens.catalogue import query
from adlens.dims import rules
from adlens.functions import score as S
from adlens.functions import text as T
from adlens.functions.lineage import shuffled
from adlens.operators import ads as A
from adlens.operators import classify as C
from adlens.operators import report as O
from adlens.operators import resolve as R
from adlens.operators import rollup as RU
from adlens.plans import ads as Q
from adlens.plans.ads import AS_OF, t
from adlens.plans.marketing import sql_str
from adlens.plans.sites import cat


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """An order as a provider's record, in one of three spellings by its status; a few have neither id nor copy."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    day, spent = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice")
    flat = F.to_json(F.struct(k.cast("string").alias("adArchiveID"), F.array(F.lit(" "), cat("Body ", k)).alias("ad_creative_bodies"), day.alias("startDate"), F.array(F.lit("facebook"), F.lit("instagram")).alias("publisherPlatforms"), F.struct(F.lit("1,000").alias("lower_bound"), F.lit("2000").alias("upper_bound")).alias("impressions"), F.lit(True).alias("isActive"), F.lit("VIDEO").alias("mediaType")))
    nested = F.to_json(F.struct(F.struct(cat("Body  ", k).alias("text")).alias("body"), cat("Head ", k).alias("title"), k.cast("string").alias("ad_archive_id"), F.lit("US").alias("country"), F.format_number(F.floor(spent), 0).alias("reach"), day.alias("start_date"), F.date_format(F.date_add("o_orderdate", 10), "yyyy-MM-dd").alias("endDate"), F.array(F.struct(F.lit("x").alias("original_image_url"))).alias("images")))
    bare = F.when(k % 7 == 0, F.lit('{"currency":"USD","note":""}')).otherwise(F.to_json(F.struct(k.cast("string").alias("id"), cat("Title ", k).alias("headline"), F.struct(F.lit(5).alias("min"), F.lit(9).alias("max")).alias("spend"), F.lit("EUR").alias("currency"), F.lit("carousel_card").alias("kind"))))
    s = F.col("o_orderstatus")
    return o.select(F.lit("p").alias("provider"), F.lit("q").alias("matched_query"), k.alias("pos"), F.when(s == "P", flat).when(s == "F", nested).otherwise(bare).alias("record"))


@query(
    "ad_records",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS ad_id, CASE WHEN o_orderstatus IN ('P', 'F') THEN 'Body ' || o_orderkey ELSE '' END AS body, CASE o_orderstatus WHEN 'F' THEN 'Head ' || o_orderkey WHEN 'O' THEN 'Title ' || o_orderkey END AS title,
     CASE o_orderstatus WHEN 'P' THEN 'facebook,instagram' ELSE '' END AS platforms, CASE o_orderstatus WHEN 'F' THEN 'US' ELSE '' END AS countries, CASE o_orderstatus WHEN 'P' THEN 1000.0 END AS impressions_min, CASE o_orderstatus WHEN 'P' THEN 2000.0 END AS impressions_max,
     CASE o_orderstatus WHEN 'O' THEN 5.0 END AS spend_min, CASE o_orderstatus WHEN 'O' THEN 9.0 END AS spend_max, CASE o_orderstatus WHEN 'O' THEN 'EUR' END AS currency, CASE o_orderstatus WHEN 'F' THEN floor(o_totalprice) END AS reach,
     CASE o_orderstatus WHEN 'P' THEN true WHEN 'F' THEN o_orderdate::DATE + 10 > DATE '{AS_OF}' END AS active, CASE o_orderstatus WHEN 'P' THEN greatest(0, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}')) WHEN 'F' THEN 10 END AS days, CASE o_orderstatus WHEN 'P' THEN 'video' WHEN 'F' THEN 'image' ELSE 'carousel' END AS media_type
     FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderkey % 7 = 0)""",
)
def ad_records(spark: SparkSession, d: str) -> DataFrame:
    """X80-X85, F10."""
    a = A.read_records(raw_records(spark, d), F.lit(AS_OF).cast("timestamp"))
    return a.select("ad_id", "body", "title", F.array_join("platforms", ",").alias("platforms"), F.array_join("countries", ",").alias("countries"), "impressions_min", "impressions_max", "spend_min", "spend_max", "currency", "reach", "active", "days", "media_type")


@query("media_types", "SELECT CASE o_orderstatus WHEN 'P' THEN 'video' WHEN 'F' THEN 'image' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'carousel' END END AS media, count(*) AS n FROM orders GROUP BY 1")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    """X84, A20."""
    return raw_records(spark, d).select(A.media_type(A.parsed(F.col("record")), F.col("record")).alias("media")).groupBy("media").agg(F.count("*").alias("n"))


@query("search_terms", "WITH p AS (SELECT p_brand AS brand, p_name, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE length(p_name) BETWEEN 4 AND 60 AND lower(p_name) <> lower(p_brand)) SELECT brand, min(pos) AS pos, term FROM (SELECT DISTINCT p_brand AS brand, 0 AS pos, p_brand AS term FROM part UNION ALL SELECT brand, n, brand || ' ' || p_name FROM p WHERE n <= 5) GROUP BY brand, term")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """U3, F8."""
    p = t(spark, d, "part")
    brands = p.select(F.col("p_brand").alias("brand"), F.concat(F.lit(" "), "p_brand").alias("brand_name")).distinct()
    return A.search_terms(brands, p.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("product"), F.col("p_partkey").alias("pos"))).withColumn("pos", F.col("pos").cast("long"))


@query("attributed_terms", "SELECT p_partkey AS ad, CASE WHEN p_size % 3 = 0 THEN p_brand || ' ' || p_type WHEN p_size % 3 = 1 THEN p_brand ELSE p_brand END AS term FROM part")
def attributed_terms(spark: SparkSession, d: str) -> DataFrame:
    """The longest of the brand's terms that the copy holds, else its first."""
    p, s = t(spark, d, "part"), F.col("p_size") % 3
    terms = p.select(F.col("p_brand").alias("brand"), F.lit(0).alias("pos"), F.col("p_brand").alias("term")).union(p.select("p_brand", F.lit(1), F.concat_ws(" ", "p_brand", "p_type"))).distinct()
    copy = F.when(s == 0, F.concat(F.lit("Buy "), F.upper(F.concat_ws(" ", "p_brand", "p_type")))).when(s == 1, F.concat(F.lower("p_brand"), F.lit(" it is"))).otherwise("nothing")
    ads = p.select(F.col("p_partkey").alias("ad"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("page_name"), F.lit("").alias("title"), copy.alias("body"))
    return A.attribute_term(ads, terms).select("ad", "term")


@query("library_requests", "SELECT n_name AS term, c AS country, 'https://www.facebook.com/ads/library/?active_status=active&ad_type=all&country=' || c || '&q=' || n_name || '%26co&search_type=keyword_unordered&media_type=all' AS url, c = 'DE' AS eu FROM nation, (SELECT unnest(['US', 'DE']) AS c)")
def library_requests(spark: SparkSession, d: str) -> DataFrame:
    """J22, S16, S17."""
    from adlens.sources.providers import asks_eu

    out = A.requests(t(spark, d, "nation").select(cat(F.col("n_name"), "&co").alias("term")), ["US", "DE"], "ACTIVE")
    return out.select(F.regexp_replace("term", "&co", "").alias("term"), "country", "url", F.col("country").isin(*[c for c in ("US", "DE") if asks_eu([c])]).alias("eu"))


@query("shared_angles", "WITH f AS (SELECT c_nationkey AS brand, o_orderpriority AS key, count(*) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), p AS (SELECT a.n_nationkey AS brand, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey), r AS (SELECT brand, other, a.key, row_number() OVER (PARTITION BY brand, other ORDER BY a.value DESC, a.key) AS n FROM p JOIN f a USING (brand) JOIN f b ON b.brand = other AND b.key = a.key) SELECT brand, other, string_agg(key, ',' ORDER BY n) AS shared FROM r WHERE n <= 4 GROUP BY 1, 2")
def shared_angles(spark: SparkSession, d: str) -> DataFrame:
    """J20."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    f = o.groupBy(F.col("c_nationkey").alias("brand"), F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("value"))
    n = t(spark, d, "nation")
    pairs = n.select(F.col("n_nationkey").alias("brand"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("other"), "n_regionkey"), "n_regionkey").filter("brand != other")
    return RU.shared(f, pairs).select("brand", "other", F.array_join("shared", ",").alias("shared"))


@query("winner_angles", f"WITH {Q.ADS}, w AS (SELECT * FROM scored WHERE coalesce(days, 0) >= 60), n AS (SELECT brand, angle, count(*) AS n FROM w GROUP BY 1, 2) SELECT brand, string_agg(angle, ',' ORDER BY n DESC, angle) AS angles FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, angle) AS r FROM n) WHERE r <= 5 GROUP BY brand")
def winner_angles(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    won = A.score(Q.ads(spark, d)).withColumn("angles", F.array("angle"))
    return RU.winner_angles(won, ["brand"]).select("brand", F.array_join("angles", ",").alias("angles"))


TAXONOMY = {"home": {"rings": {"terms": [["ring", 2.0], "red ring"]}, "plates": {"terms": ["plate", ["hot plate", 3]]}}, "tools": {"bolts": {"terms": [["bolt", 2.5], "large bolt"]}, "gears": {"terms": ["gear", "widget", "a thing of very many words in a row"]}}}


@query("taxonomy_rows", """WITH b AS (SELECT DISTINCT p_type AS niche, p_brand AS sub, CAST(dense_rank() OVER (ORDER BY p_type, p_brand) AS INTEGER) - 1 AS sub_pos, p_name AS term, 1.0::DOUBLE AS weight FROM part),
 o AS (SELECT DISTINCT kind AS niche, brand AS sub, name AS term, 2.5::DOUBLE AS weight FROM items WHERE kind IS NOT NULL AND brand IS NOT NULL AND name IS NOT NULL UNION SELECT DISTINCT p_type, p_brand, 'new ' || p_name, 2.5 FROM part WHERE p_size = 1),
 p AS (SELECT niche, sub, CAST(dense_rank() OVER (ORDER BY niche, sub) AS INTEGER) - 1 AS pos FROM (SELECT DISTINCT niche, sub FROM o))
 SELECT * FROM b WHERE (niche, sub) NOT IN (SELECT (niche, sub) FROM o) UNION ALL SELECT o.niche, o.sub, CAST(coalesce(m.sub_pos, p.pos + (SELECT max(sub_pos) + 1 FROM b)) AS INTEGER), o.term, o.weight FROM o JOIN p ON p.niche = o.niche AND p.sub = o.sub LEFT JOIN (SELECT DISTINCT niche, sub, sub_pos FROM b) m ON m.niche = o.niche AND m.sub = o.sub""")
def taxonomy_rows(spark: SparkSession, d: str) -> DataFrame:
    """An override replaces whole sub-niches and adds new ones behind: the parts' types and brands, overridden by those
    of the smallest parts and by the shop's items."""
    def placed(df: DataFrame) -> DataFrame:
        subs = df.select("niche", "sub").distinct()
        first = subs.withColumn("sub_pos", (F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("niche", "sub")) - 1).cast("int"))
        return df.join(first, ["niche", "sub"]).select("niche", "sub", "sub_pos", "term", "weight")

    part, items = t(spark, d, "part"), t(spark, d, "items").dropna(subset=["kind", "brand", "name"])
    base = part.select(F.col("p_type").alias("niche"), F.col("p_brand").alias("sub"), F.col("p_name").alias("term"), F.lit(1.0).alias("weight")).distinct()
    small = part.filter("p_size = 1").select(F.col("p_type").alias("niche"), F.col("p_brand").alias("sub"), cat("new ", F.col("p_name")).alias("term"), F.lit(2.5).alias("weight"))
    over = items.select(F.col("kind").alias("niche"), F.col("brand").alias("sub"), F.col("name").alias("term"), F.lit(2.5).alias("weight")).union(small).distinct()
    return C.merge_taxonomy(placed(base), placed(over))


_TAX = "tx AS (SELECT * FROM (VALUES " + ", ".join(
    f"({sql_str(n)}, {sql_str(s)}, {k}, {sql_str(x if isinstance(x, str) else x[0])}, {1.0 if isinstance(x, str) else float(x[1])}::DOUBLE)" for k, (n, s, terms) in enumerate((n, s, b["terms"]) for n, subs in TAXONOMY.items() for s, b in subs.items()) for x in terms
) + ") v(niche, sub, pos, term, weight))"


def goods(spark: SparkSession, d: str) -> DataFrame:
    """What a customer bought, as one text: (id, text)."""
    line = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    own = line.groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), ", ").alias("text"))
    return own.select("id", F.when(F.col("id") % 10 == 0, F.concat("text", F.lit(", a thing of very many words in a row"))).otherwise(F.col("text")).alias("text"))


_GOODS = "gd AS (SELECT id, x || CASE WHEN id % 10 = 0 THEN ', a thing of very many words in a row' ELSE '' END AS x FROM (SELECT o_custkey AS id, string_agg(p_name, ', ' ORDER BY p_name) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1))"
_GHITS = f"{_GOODS}, {_TAX}, gh AS (SELECT id, niche, sub, pos, term, weight, len(regexp_extract_all(x, '\\b' || term || '\\b')) AS hits FROM gd CROSS JOIN tx)"
_GSCORE = f"{_GHITS}, gs AS (SELECT id, niche, sub, min(pos) AS pos, sum(least(3.0, 1 + log2(hits)) * weight) AS raw FROM gh WHERE hits > 0 GROUP BY 1, 2, 3), gn AS (SELECT *, sum(raw) OVER (PARTITION BY id, niche) AS total, row_number() OVER (PARTITION BY id ORDER BY round(raw, 9) DESC, pos) AS place FROM gs)"


@query("taxonomy_hits", f"WITH {_GHITS} SELECT id, term, hits FROM gh WHERE hits > 0")
def taxonomy_hits(spark: SparkSession, d: str) -> DataFrame:
    """J1, X4, with a term of eight words."""
    return C.term_hits(goods(spark, d), C.taxonomy(spark, TAXONOMY)).withColumn("hits", F.col("hits").cast("long"))


@query(
    "taxonomy_classes",
    f"""WITH {_GSCORE}, lead AS (SELECT id, arg_min(niche, place) AS first, arg_min(total, place) AS won, max(total) AS most, arg_max(niche, round(total, 9)) AS top FROM gn GROUP BY id), l AS (SELECT id, CASE WHEN most > won + 1e-9 THEN top ELSE first END AS lead FROM lead),
    c AS (SELECT gn.id, min(place) AS chosen FROM gn JOIN l ON l.id = gn.id AND l.lead = gn.niche GROUP BY gn.id), b AS (SELECT gn.* FROM gn JOIN c ON c.id = gn.id AND c.chosen = gn.place),
    alt AS (SELECT gn.id, string_agg(niche || ' / ' || sub, '|' ORDER BY place) AS others FROM (SELECT gn.*, row_number() OVER (PARTITION BY gn.id ORDER BY place) AS r FROM gn JOIN c ON c.id = gn.id AND c.chosen <> gn.place) gn WHERE r <= 3 GROUP BY gn.id)
    SELECT b.id, b.niche, b.sub, floor(100 * (1 - exp(-(b.raw + b.total * 0.25) / 14)) + 0.5) AS confidence, coalesce(others, '') AS alternatives FROM b LEFT JOIN alt USING (id)""",
)
def taxonomy_classes(spark: SparkSession, d: str) -> DataFrame:
    """G6, A3, A4, W6, X65, X66."""
    x = C.taxonomy(spark, TAXONOMY)
    return C.classify(C.term_hits(goods(spark, d), x), x).select("id", "niche", "sub", "confidence", F.array_join("alternatives", "|").alias("alternatives"))


@query("niche_tree", "WITH s AS (SELECT c_mktsegment AS niche, c_nationkey AS sub, count(*) AS brands, CAST(sum(n) AS BIGINT) AS ads FROM (SELECT c_mktsegment, c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1, 2) SELECT niche, CAST(sum(brands) AS BIGINT) AS brands, CAST(sum(ads) AS BIGINT) AS ads, string_agg(sub || ':' || brands || ':' || ads, ',' ORDER BY brands DESC, sub) AS subs FROM s GROUP BY niche")
def niche_tree(spark: SparkSession, d: str) -> DataFrame:
    """A14."""
    c = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    brands = c.groupBy(F.col("c_custkey").alias("brand"), F.col("c_mktsegment").alias("niche"), F.col("c_nationkey").alias("sub_niche")).agg(F.count("o_orderkey").alias("ad_count"))
    out = O.niche_tree(brands)
    return out.select("niche", "brands", "ads", F.array_join(F.transform("subs", lambda s: F.concat_ws(":", s["sub_niche"], s["brands"], s["ads"])), ",").alias("subs"))


_FORMS = ("Inc.", "LLC", "Ltd")


def identity_pages(spark: SparkSession, d: str) -> DataFrame:
    """A site a supplier, read as pages: terms that name the operator twice, a home page with a trademark and a copyright line
    in its footer (of another firm on every second site), and on every fourth JSON-LD with a parent."""
    k, s = F.col("s_suppkey"), t(spark, d, "supplier")
    firm = cat("Alpha", k, " Trading, ", F.get(F.array(*[F.lit(x) for x in _FORMS]), (k % 3).cast("int")))
    base = cat("https://alpha", k, ".com")
    ld = F.when(k % 4 == 0, cat('<script type="application/ld+json">{"@type":"Organization","legalName":"Alpha', k, ' Trading","parentOrganization":{"name":"Group ', k, '"}}</script>')).otherwise("")
    holder = F.when(k % 2 == 0, cat("Beta", k, " Works, LLC")).otherwise(firm)
    home = cat("<html><head><title>Alpha", k, " — Daily performance</title><meta property='og:site_name' content='Alpha", k, "'>", ld, "</head><body><footer><p>© 2026 ", holder, ". All rights reserved.</p><p>ALPHA", k, "® is a registered trademark of ", firm, ".</p></footer></body></html>")
    terms = cat("<html><head><title>Terms of Service</title></head><body><p>These Terms are an agreement between you and ", firm, " (we), and this site is operated by ", firm, " alone.</p></body></html>")
    pages = s.select(cat(base, "/").alias("url"), F.lit(200).alias("status"), home.alias("body")).union(s.select(cat(base, "/terms"), F.lit(200), terms)).union(s.select(cat(base, "/privacy"), F.lit(404), terms))
    return R.identity_pages(s.select(cat("s", k).alias("site"), cat(base, "/").alias("url")), pages)


_FIRM = "'Alpha' || s_suppkey || ' Trading, ' || ['Inc', 'LLC', 'Ltd'][1 + s_suppkey % 3]"
_SIGNALS = f"""sg AS (SELECT s_suppkey AS k, unnest([{{'role': 'legal-entity', 'source': 'trademark-notice', 'weight': 50, 'value': {_FIRM}}}, {{'role': 'brand', 'source': 'trademark-notice', 'weight': 50, 'value': 'ALPHA' || s_suppkey}},
 {{'role': 'legal-entity', 'source': 'terms-of-service', 'weight': 45, 'value': {_FIRM}}}, {{'role': 'legal-entity', 'source': 'terms-of-service', 'weight': 45, 'value': {_FIRM}}}, {{'role': 'legal-entity', 'source': 'footer-copyright', 'weight': 30, 'value': CASE WHEN s_suppkey % 2 = 0 THEN 'Beta' || s_suppkey || ' Works, LLC' ELSE {_FIRM} END}},
 {{'role': CASE WHEN s_suppkey % 4 = 0 THEN 'legal-entity' END, 'source': 'jsonld-legal-name', 'weight': 40, 'value': 'Alpha' || s_suppkey || ' Trading'}}, {{'role': CASE WHEN s_suppkey % 4 = 0 THEN 'legal-entity' END, 'source': 'jsonld-parent', 'weight': 35, 'value': 'Group ' || s_suppkey}},
 {{'role': 'brand', 'source': 'og-site-name', 'weight': 25, 'value': 'Alpha' || s_suppkey}}, {{'role': 'brand', 'source': 'page-title', 'weight': 10, 'value': 'Alpha' || s_suppkey}}, {{'role': 'brand', 'source': 'page-title', 'weight': 10, 'value': 'Terms of Service'}}]) AS x FROM supplier)"""


@query("identity_signals", f"WITH {_SIGNALS} SELECT 's' || k AS site, x.role AS role, x.source AS source, x.weight AS weight, x.value AS value FROM sg WHERE x.role IS NOT NULL")
def identity_signals(spark: SparkSession, d: str) -> DataFrame:
    """H17, H18, X28."""
    return R.signals(identity_pages(spark, d)).select("site", "role", "source", "weight", F.regexp_replace("value", r"\.$", "").alias("value"))


@query("identity_evidence", f"WITH {_SIGNALS}, once AS (SELECT DISTINCT k, x.role AS role, x.source AS source, x.weight AS weight, x.value AS value FROM sg WHERE x.role IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY weight DESC) AS place FROM once) SELECT 's' || k AS site, string_agg(source || ':' || weight, ',' ORDER BY place) AS evidence FROM r WHERE place <= 4 GROUP BY k")
def identity_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each page twice over says nothing more."""
    found = R.signals(identity_pages(spark, d).union(identity_pages(spark, d).withColumn("pos", F.col("pos") + 10)))
    top = R.top_evidence(R.dedupe_signals(found, ["site"]), ["site"], 4)
    return top.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "source", "weight").alias("x")))), lambda x: x["x"]), ",").alias("evidence"))


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every fifth supplier claims another name, every seventh has no pages, every eleventh is known by its slug."""
    k, s = F.col("s_suppkey"), t(spark, d, "supplier")
    none = F.lit(None).cast("string")
    inputs = s.select(cat("s", k).alias("id"), cat("Firm", k).alias("slug"), F.when(k % 5 == 0, "Gamma Group").otherwise(cat("alpha", k, " trading")).alias("name"), none.alias("website"))
    pages = identity_pages(spark, d).filter(F.regexp_replace("site", "s", "").cast("int") % 7 != 0)
    known = s.filter(k % 11 == 0).select(k.alias("pos"), cat("Known ", k, ", Inc.").alias("legal_entity"), cat("Known ", k).alias("brand"), none.alias("website"), cat("FIRM", k).alias("linkedin_slug"), F.lit("me").alias("confirmed_by"), F.lit(AS_OF).alias("confirmed_at"))
    return inputs, R.signals(pages), known


_RESOLVED = """rs AS (SELECT s_suppkey AS k, s_suppkey % 11 = 0 AS known, s_suppkey % 7 = 0 AS blank, s_suppkey % 5 = 0 AS against, s_suppkey % 2 = 0 AS rival, floor((50 + 45 / 2.0 + CASE WHEN s_suppkey % 4 = 0 THEN 40 / 3.0 WHEN s_suppkey % 2 = 1 THEN 30 / 3.0 ELSE 0 END) * 10 + 0.5) / 10 AS w FROM supplier),
 rd AS (SELECT *, CASE WHEN known THEN 'confirmed' WHEN blank THEN 'unresolved' WHEN against OR rival THEN 'needs-review' ELSE 'resolved' END AS status, CASE WHEN known THEN 100.0 WHEN blank THEN 0.0 ELSE least(CASE WHEN against THEN 45.0 ELSE 100.0 END, floor(100 * (1 - exp(-(w + CASE WHEN against THEN 0 ELSE 35 END) / 45)) + 0.5)) END AS confidence FROM rs)"""


@query("entity_resolutions", f"WITH {_RESOLVED} SELECT 's' || k AS id, status, confidence, CASE WHEN known THEN NULL WHEN blank THEN 'no legal entity found' WHEN against THEN 'the name given is none of the entities found' WHEN rival THEN 'several entities are claimed' END AS review_reason FROM rd")
def entity_resolutions(spark: SparkSession, d: str) -> DataFrame:
    """G11, J15, J16, F21, X67."""
    return R.resolve(*_claims(spark, d)).select("id", "status", "confidence", "review_reason")


@query("resolved_aliases", f"WITH {_RESOLVED} SELECT CASE WHEN known THEN 'Known ' || k ELSE 'ALPHA' || k END AS brand, 'Firm' || k AS linkedin_slug, 'bot' AS confirmed_by FROM rd WHERE status IN ('confirmed', 'resolved')")
def resolved_aliases(spark: SparkSession, d: str) -> DataFrame:
    """G12."""
    sure = R.resolve(*_claims(spark, d)).filter("status in ('confirmed', 'resolved')")
    return R.to_alias(sure, "bot", AS_OF).select("brand", "linkedin_slug", "confirmed_by")


@query("resolution_lines", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_name || ' → ' || c_mktsegment WHEN 1 THEN c_mktsegment ELSE 'unidentified' END || ' · needs-review (50) · ' || CASE WHEN c_custkey % 2 = 0 THEN 'contract, copyright' ELSE 'no evidence' END AS line, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (contract) · ' || c_name || ' (copyright)' ELSE '' END AS signals FROM customer")
def resolution_lines(spark: SparkSession, d: str) -> DataFrame:
    """X29."""
    k = F.col("c_custkey")
    none = F.array().cast("array<struct<value:string,source:string>>")
    each = F.when(k % 2 == 0, F.array(*[F.struct(F.col("c_name").alias("value"), F.lit(x).alias("source")) for x in ("contract", "copyright", "contract")])).otherwise(none)
    entity, brand = F.when(k % 3 == 0, F.col("c_name")), F.when(k % 3 < 2, F.col("c_mktsegment")).otherwise("")
    line = R.resolution_summary(entity, brand, F.lit("needs-review"), F.lit(50.0), F.transform(each, lambda x: x["source"]))
    return t(spark, d, "customer").select(k.alias("id"), line.alias("line"), R.signal_summary(each).alias("signals"))


def analysed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Brands and their ranked ads as an analysis leaves them, the angle and format being the order's."""
    a = A.rank(A.score(Q.ads(spark, d)))
    a = a.withColumns({"angles": F.array(F.struct(F.col("angle").alias("angle"), F.col("angle").alias("label"))), "awareness": F.col("format"), "hook": cat("Hook ", F.col("ad_id")), "offers": F.array(F.struct(F.lit("discount").alias("kind"), F.col("angle").alias("detail"))), "url": F.concat(F.lit("https://b.com/"), "angle")})
    brands = t(spark, d, "customer").select(F.col("c_custkey").alias("brand"), F.col("c_name").alias("brand_name"), F.col("c_mktsegment").alias("niche"), F.col("c_nationkey").cast("string").alias("sub_niche"))
    return brands, a


_REPORT = f"""WITH {Q.PARTS}, rk AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY exposure DESC, ad_id) AS rank FROM scored), hk AS (SELECT brand, string_agg('Hook ' || ad_id, ',' ORDER BY rank) AS hooks FROM rk WHERE rank <= 10 GROUP BY 1),
  tp AS (SELECT brand, angle AS top_angle FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY avg_exposure * ad_count DESC, ad_count DESC, avg_exposure DESC, angle) AS n FROM angles) WHERE n = 1), ex AS (SELECT brand, count(*) AS ad_count, ((2 * sum(CAST(round(exposure * 10) AS BIGINT)) + count(*)) // (2 * count(*))) / 10 AS exposure_score FROM scored GROUP BY 1),
  ob AS (SELECT brand, string_agg(angle || ':' || ad_count, ',' ORDER BY ad_count DESC, angle) AS offers FROM angles GROUP BY 1), lp AS (SELECT brand, count(DISTINCT angle) AS landing FROM scored GROUP BY 1)"""


@query("brand_reports", f"{_REPORT} SELECT c_custkey AS brand, coalesce(ad_count, 0) AS ad_count, exposure_score, top_angle, hooks, offers, coalesce(landing, 0) AS landing FROM customer LEFT JOIN ex ON ex.brand = c_custkey LEFT JOIN tp ON tp.brand = c_custkey LEFT JOIN hk ON hk.brand = c_custkey LEFT JOIN ob ON ob.brand = c_custkey LEFT JOIN lp ON lp.brand = c_custkey")
def brand_reports(spark: SparkSession, d: str) -> DataFrame:
    """G8, A13, W9, A12."""
    r = O.brand_reports(*analysed(spark, d), AS_OF)
    told = F.array_join(F.transform("offers", lambda o: F.concat_ws(":", o["detail"], o["n"])), ",")
    return r.select("brand", "ad_count", "exposure_score", "top_angle", F.array_join(F.transform("top_hooks", lambda h: h["hook"]), ",").alias("hooks"), told.alias("offers"), F.coalesce(F.size("landing_pages"), F.lit(0)).cast("long").alias("landing"))


@query("run_overview", "SELECT count(*) AS brands_profiled, count(*) FILTER (WHERE n > 0) AS brands_with_ads, CAST(sum(n) AS BIGINT) AS ads_analysed FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def run_overview(spark: SparkSession, d: str) -> DataFrame:
    """A17, by the report code."""
    c = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return O.run_totals(c.groupBy(F.col("c_custkey").alias("brand")).agg(F.count("o_orderkey").alias("ad_count")))


_MORE = f"""{Q.ADS}, b AS (SELECT brand, any_value(niche) AS niche, count(*) AS ad_count, median(reach) AS price_median, CAST(max(days) AS DOUBLE) AS guarantee_days, CAST(min(variants) AS DOUBLE) AS review_count, CAST(count(*) FILTER (WHERE format = 'P') * 10 AS DOUBLE) AS max_discount, CAST(count(DISTINCT angle) * 10 AS DOUBLE) AS stack_score, bool_or(active) AS subscription, count(*) FILTER (WHERE format = 'P') >= 3 AS paid_media, max(days) > 150 AS reviews FROM ads GROUP BY 1),
 m AS (SELECT niche, count(*) AS brand_count, floor(median(ad_count) * 100 + 0.5) / 100 AS a, floor(median(price_median) * 100 + 0.5) / 100 AS p, floor(median(guarantee_days) * 100 + 0.5) / 100 AS g, floor(median(review_count) * 100 + 0.5) / 100 AS r, floor(median(max_discount) * 100 + 0.5) / 100 AS d, floor(median(stack_score) * 100 + 0.5) / 100 AS s,
  floor(count(*) FILTER (WHERE subscription) / count(*) * 1000 + 0.5) / 10 AS sub, floor(count(*) FILTER (WHERE paid_media) / count(*) * 1000 + 0.5) / 10 AS pm, floor(count(*) FILTER (WHERE reviews) / count(*) * 1000 + 0.5) / 10 AS rv FROM b GROUP BY 1)"""


def _figures(spark: SparkSession, d: str) -> DataFrame:
    a = Q.ads(spark, d)
    return a.groupBy("brand", "niche").agg(
        F.count("*").alias("ad_count"), F.percentile("reach", F.lit(0.5)).alias("price_median"), F.max("days").cast("double").alias("guarantee_days"), F.min("variants").cast("double").alias("review_count"), (F.count_if(F.col("format") == "P") * 10).cast("double").alias("max_discount"),
        (F.countDistinct("angle") * 10).cast("double").alias("stack_score"), F.max("active").alias("subscription"), (F.count_if(F.col("format") == "P") >= 3).alias("paid_media"), (F.max("days") > 150).alias("reviews"),
    )


@query("niche_norms", f"WITH {_MORE} SELECT niche, a AS median_ads_per_brand, p AS median_price_median, d AS median_max_discount, g AS median_guarantee_days, r AS median_review_count, s AS median_stack_score, sub AS subscription_share, pm AS paid_media_share, rv AS reviews_share FROM m")
def niche_norms(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    return RU.norms(_figures(spark, d)).drop("brand_count", "ad_count")


@query(
    "deviation_set",
    f"""WITH {_MORE}, x AS (SELECT brand, niche, unnest(['Price', 'Discount depth', 'Guarantee', 'Social proof volume', 'Ad volume', 'Stack maturity']) AS signal, unnest([price_median, max_discount, guarantee_days, review_count, CAST(b.ad_count AS DOUBLE), stack_score]) AS v, unnest([p, d, g, r, a, s]) AS n, unnest([1.4, 1.4, 1.4, 2, 1.8, 1.4]) AS q FROM b JOIN m USING (niche) WHERE brand_count >= 3),
    na AS (SELECT niche, angle FROM (SELECT niche, angle, row_number() OVER (PARTITION BY niche ORDER BY count(*) DESC, angle) AS n FROM ads GROUP BY 1, 2) WHERE n = 1), ba AS (SELECT brand, angle FROM (SELECT brand, angle, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, angle) AS n FROM ads GROUP BY 1, 2) WHERE n = 1),
    y AS (SELECT *, CASE WHEN v / n >= q THEN 'above' ELSE 'below' END AS direction FROM x WHERE n > 0 AND v IS NOT NULL AND (v / n >= q OR v / n <= 1 / q))
    SELECT brand, signal, direction, CASE signal WHEN 'Price' THEN 'prices ' || CAST(floor(abs(v / n - 1) * 100 + 0.5) AS BIGINT) || '% ' || direction || ' the ' || niche || ' median — check whether the copy justifies it' WHEN 'Discount depth' THEN 'discounts ' || direction || ' the category norm' WHEN 'Guarantee' THEN 'guarantee window is ' || direction || ' the category norm'
      WHEN 'Social proof volume' THEN 'review count is ' || direction || ' the category norm' WHEN 'Ad volume' THEN 'running ' || direction || ' as many ads as the typical brand here' ELSE 'growth stack is ' || direction || ' the category norm' END AS note FROM y
    UNION ALL SELECT brand, 'Subscription', 'absent', 'the category monetises on repeat purchase and this brand does not' FROM b JOIN m USING (niche) WHERE brand_count >= 3 AND sub >= 60 AND NOT subscription UNION ALL SELECT brand, 'Paid media', 'absent', 'not set up to buy traffic while its competitors are' FROM b JOIN m USING (niche) WHERE brand_count >= 3 AND pm >= 60 AND NOT paid_media UNION ALL SELECT brand, 'Reviews', 'absent', 'collecting less social proof than the category standard' FROM b JOIN m USING (niche) WHERE brand_count >= 3 AND rv >= 60 AND NOT reviews
    UNION ALL SELECT brand, 'Lead angle', 'unique', 'leads on a different angle from the category — deliberate differentiation or a blind spot' FROM b JOIN na USING (niche) JOIN ba USING (brand) WHERE ba.angle <> na.angle UNION ALL SELECT brand, 'Creative freshness', 'below', 'competitors are shipping creative and this one is not' FROM b WHERE brand % 13 = 0""",
)
def deviation_set(spark: SparkSession, d: str) -> DataFrame:
    """Six figures, three absences, the lead angle, freshness."""
    f, a = _figures(spark, d), Q.ads(spark, d)

    def lead(keys: str) -> DataFrame:
        n = a.groupBy(keys, "angle").agg(F.count("*").alias("n"))
        return n.groupBy(keys).agg(F.min(F.struct((-F.col("n")).alias("neg"), "angle"))["angle"].alias("lead"))

    f = f.join(lead("brand").withColumnRenamed("lead", "lead_angle"), "brand").withColumn("posture", F.when(F.col("brand") % 13 == 0, "stale").otherwise("steady"))
    norms = RU.norms(f).join(lead("niche").withColumnRenamed("lead", "niche_lead_angle"), "niche")
    return RU.deviation_set(f, norms).select("brand", "signal", "direction", "note")


_SUBS = [(n, s, k) for k, (n, s) in enumerate((n, s) for n, subs in C.built_in().items() for s in subs)]
_BUILT = "bt AS (SELECT * FROM (VALUES " + ", ".join(f"({sql_str(n)}, {sql_str(s)}, {k}, {sql_str(x[0])}, {float(x[1])}::DOUBLE)" for n, s, k in _SUBS for x in C.built_in()[n][s]["terms"]) + ") v(niche, sub, pos, term, weight))"
_NAMES = "[" + ", ".join(sql_str(s) for _, s, _ in _SUBS) + "]"
_HINTS = "hn AS (SELECT * FROM (VALUES " + ", ".join(f"({sql_str(n)}, {sql_str(s)}, {sql_str(a)})" for n, s, _ in _SUBS for a in C.built_in()[n][s]["audience"]) + ") v(niche, sub, audience))"
_PEOPLE = "pe AS (SELECT * FROM (VALUES " + ", ".join(f"({sql_str(a)}, {k}, {sql_str(x.rsplit(':', 1)[0])}, {float(x.rsplit(':', 1)[1])}::DOUBLE)" for k, (a, terms) in enumerate(rules.table(rules.AUDIENCES)) for x in terms.split(", ")) + ") v(audience, pos, term, weight))"
_FOLD = "trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9''., -]', ' ', 'g'), ' +', ' ', 'g'))"


def _whole(term: str) -> str:
    """How often a term stands in x as a whole word (RE2 knows no looking around, so each hit takes the character before it)."""
    return f"len(regexp_extract_all(' ' || replace(x, ' ', '  ') || ' ', '[^a-z0-9]' || replace(regexp_replace({term}, '([.+])', '\\\\\\1', 'g'), ' ', '  ') || '[^a-z0-9]'))"


@query(
    "built_in_classes",
    f"""WITH {_BUILT}, {_HINTS}, {_PEOPLE}, nm AS (SELECT {_NAMES} AS s), tx AS (SELECT c_custkey AS id, {_FOLD} AS x FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN c_name || ' sells nothing of note' ELSE 'We do ' || s[1 + c_custkey % 73] || ' and ' || s[1 + (c_custkey * 7) % 73] || '. More ' || s[1 + c_custkey % 73] || ' for ' || c_mktsegment END AS x FROM customer, nm)),
    gh AS (SELECT id, niche, sub, pos, term, weight, {_whole('term')} AS hits FROM tx CROSS JOIN bt), gs AS (SELECT id, niche, sub, min(pos) AS pos, sum(least(3.0, 1 + log2(hits)) * weight) AS raw FROM gh WHERE hits > 0 GROUP BY 1, 2, 3),
    gn AS (SELECT *, sum(raw) OVER (PARTITION BY id, niche) AS total, row_number() OVER (PARTITION BY id ORDER BY round(raw, 9) DESC, pos) AS place FROM gs), lead AS (SELECT id, arg_min(niche, place) AS first, arg_min(total, place) AS won, max(total) AS most FROM gn GROUP BY id),
    tops AS (SELECT gn.id, arg_min(niche, place) AS top FROM gn JOIN lead ON lead.id = gn.id AND gn.total > lead.most - 1e-9 GROUP BY gn.id), l AS (SELECT lead.id, CASE WHEN most > won + 1e-9 THEN top ELSE first END AS lead FROM lead JOIN tops ON tops.id = lead.id),
    b AS (SELECT gn.* FROM gn JOIN (SELECT gn.id, min(place) AS chosen FROM gn JOIN l ON l.id = gn.id AND l.lead = gn.niche GROUP BY gn.id) c ON c.id = gn.id AND c.chosen = gn.place),
    ah AS (SELECT id, audience, pos, {_whole('term')} AS hits, weight FROM tx CROSS JOIN pe), sa AS (SELECT id, audience, pos, least(3.0, 1 + log2(hits)) * weight AS score FROM ah WHERE hits > 0 UNION ALL SELECT b.id, hn.audience, p.pos, 6.0 FROM b JOIN hn ON hn.niche = b.niche AND hn.sub = b.sub JOIN (SELECT DISTINCT audience, pos FROM pe) p ON p.audience = hn.audience),
    au AS (SELECT id, audience FROM (SELECT id, audience, sum(score) AS score, row_number() OVER (PARTITION BY id ORDER BY round(sum(score), 9) DESC, min(pos)) AS r FROM sa GROUP BY 1, 2) WHERE r = 1 AND score >= 4)
    SELECT tx.id, coalesce(b.niche, 'Unclassified') AS niche, coalesce(b.sub, 'Unclassified') AS sub, coalesce(floor(100 * (1 - exp(-(b.raw + b.total * 0.25) / 14)) + 0.5), 0.0) AS confidence, audience FROM tx LEFT JOIN b ON b.id = tx.id LEFT JOIN au ON au.id = tx.id""",
)
def built_in_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's words against the built-in niches; a ninth say nothing of any."""
    k, s = F.col("c_custkey"), F.array(*[F.lit(s) for _, s, _ in _SUBS])
    pick = lambda n: F.get(s, (n % 73).cast("int"))
    text = F.when(k % 9 == 0, cat(F.col("c_name"), " sells nothing of note")).otherwise(cat("We do ", pick(k), " and ", pick(k * 7), ". More ", pick(k), " for ", F.col("c_mktsegment")))
    texts = t(spark, d, "customer").select(k.alias("id"), T.normalise(text).alias("text"))
    return C.classified(texts, C.built_in()).select("id", "niche", "sub", "confidence", "audience")


@query("niche_medians", f"WITH {Q.ADS} SELECT niche, floor(median(reach) * 100 + 0.5) / 100 AS reach, floor(median(days) * 100 + 0.5) / 100 AS days, floor(median(variants) * 100 + 0.5) / 100 AS variants FROM ads GROUP BY 1")
def niche_medians(spark: SparkSession, d: str) -> DataFrame:
    """A18 over all ads of a niche, by narrowing histograms."""
    return RU.exact_medians(Q.ads(spark, d), ["niche"], ["reach", "days", "variants"])


@query("recorded_searches", """WITH o AS (SELECT o_custkey AS brand, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
 SELECT * FROM (SELECT 'c' || brand AS brand, 'Customer ' || brand AS matched_query, row_number() OVER (PARTITION BY brand ORDER BY n) AS pos, CAST(k AS VARCHAR) AS id FROM o WHERE NOT (brand % 7 = 0 AND n >= 4) AND k % 5 <> 0) WHERE pos <= 12""")
def recorded_searches(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is a search, its orders the ads on pages of four; every fifth ad has no id and does not count, every seventh
    search breaks on its second page."""
    from adlens.sources import providers as V

    own = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), own.alias("n")).withColumn("page", F.floor(F.col("n") / 4))
    requests = V.graph_requests(t(spark, d, "customer").select(cat("c", F.col("c_custkey")).alias("brand"), F.lit(0).alias("pos"), cat("Customer ", F.col("c_custkey")).alias("term")), ["DE"], 12)
    ad = F.when(F.col("k") % 5 == 0, F.lit('{"note":1}')).otherwise(cat('{"id":"', F.col("k"), '"}'))
    body = o.groupBy("c", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", ad.alias("x")))), lambda x: x["x"]), ",").alias("data"))
    broken = (F.col("c") % 7 == 0) & (F.col("page") == 1)
    text = F.when(broken, F.lit("<html>busy</html>")).otherwise(cat('{"data":[', F.col("data"), '],"paging":{"next":"https://next/', F.col("c"), "/", F.col("page") + 1, '"}}'))
    first = requests.select(F.regexp_replace("brand", "c", "").cast("long").alias("c"), "url")
    pages = body.join(shuffled(first), "c").select(F.when(F.col("page") == 0, F.col("url")).otherwise(cat("https://next/", F.col("c"), "/", F.col("page"))).alias("url"), F.lit(200).alias("status"), text.alias("body"))
    found, _ = V.graph_records(requests, pages)
    return found.select("brand", "matched_query", F.col("pos").cast("long").alias("pos"), F.get_json_object("record", "$.id").alias("id"))
