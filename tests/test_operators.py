import json

from pyspark.sql import functions as F

from adlens.config import EngineConfig, InputError
from adlens.operators import ads as A
from adlens.operators import classify as C
from adlens.operators import copy as X
from adlens.operators import pages as P
from adlens.operators import report as O
from adlens.operators import resolve as R
from adlens.operators import vocabulary as V

RECORDS = [
    {"id": "1", "page_name": "Peak", "ad_creative_bodies": ["Tired of brain fog? Our formula works by targeting the root cause. Shop now."], "ad_creative_link_titles": ["50% off today only"], "ad_delivery_start_time": "2024-01-01", "ad_delivery_stop_time": "2024-03-01", "impressions": {"lower_bound": "1,000", "upper_bound": "5000"}, "publisher_platforms": ["facebook", "instagram"], "eu_total_reach": 120000},
    {"adArchiveID": 2, "pageName": "Peak", "body": {"text": "I started taking this and honestly I am obsessed."}, "headline": "My story", "startDate": "2024-05-01", "collationCount": 4, "isActive": True},
    {"id": "1", "ad_creative_bodies": ["Tired"], "eu_total_reach": 5},
    {"nothing": 1},
]


def raw(spark):
    return spark.createDataFrame([("p", q, k, json.dumps(r), "b") for k, (q, r) in enumerate(zip(("peak", "fog", "brain", ""), RECORDS, strict=True))], "provider string, matched_query string, pos long, record string, brand string")


def test_records(spark):
    rows = {r.pos: r for r in A.read_records(raw(spark), F.lit("2024-06-01").cast("timestamp")).collect()}
    assert sorted(rows) == [0, 1, 2]
    a, b = rows[0], rows[1]
    assert (a.ad_id, a.days, a.active, a.impressions_min, a.impressions_max, a.reach, a.platforms) == ("1", 60, False, 1000.0, 5000.0, 120000.0, ["facebook", "instagram"])
    assert (b.ad_id, b.body, b.title, b.days, b.active, b.variants) == ("2", "I started taking this and honestly I am obsessed.", "My story", 31, True, 4.0)


def test_dedupe_and_rank(spark):
    ads = A.read_records(raw(spark), F.lit("2024-06-01").cast("timestamp"))
    once = A.dedupe(ads).withColumn("brand", F.lit("b"))
    rows = {r.ad_id: r for r in once.collect()}
    assert rows["1"].matched_query == "peak; brain" and rows["1"].reach == 120000.0 and len(rows) == 2
    ranked = A.rank(A.score(once), 1).collect()
    assert [r.ad_id for r in ranked] == ["1"] and A.rank(A.score(once), 5, 99.0).count() == 0
    assert sorted(map(str, A.dedupe(ads.repartition(5)).collect())) == sorted(map(str, A.dedupe(ads.coalesce(1)).collect()))


def test_terms(spark):
    brands = spark.createDataFrame([("b", " Iron  Peak ")], "brand string, brand_name string")
    products = spark.createDataFrame([("b", 0, "Gift card"), ("b", 1, "Creatine"), ("b", 2, "Iron Peak Whey Protein Powder Blend")], "brand string, pos int, product string")
    terms = A.search_terms(brands, products)
    assert {r.term for r in terms.collect()} == {"Iron Peak", "Iron Peak Creatine", "Iron Peak Whey Protein Powder Blend"}
    ads = spark.createDataFrame([("b", "x", "Iron Peak Creatine now", ""), ("b", None, None, "zzz")], "brand string, page_name string, title string, body string")
    assert [r.term for r in A.attribute_term(ads, terms).orderBy("body").collect()] == ["Iron Peak Creatine", "Iron Peak"]
    assert A.requests(terms, ["US", "DE"]).count() == 6


def test_copy(spark):
    ads = spark.createDataFrame(
        [(1, "50% off today only", "Tired of brain fog? I was tired of it. Our formula works by targeting the root cause. Shop now.", "", ""), (2, "", "", "", "")], "ad int, title string, body string, link_description string, cta_text string"
    )
    r, empty = X.analyse(ads).orderBy("ad").collect()
    keys = [a.angle for a in r.angles]
    assert keys[0] in ("problem-agitation", "mechanism") and "offer-value" in keys and r.primary_angle == keys[0]
    assert r.hook_type == "question" and r.format == "direct-offer" and r.cta == "Shop now" and r.proof_points == ["50%"] and {o.kind for o in r.offers} == {"discount-percent", "limited-time"}
    assert r.emotions[0] in ("frustration", "urgency") and empty.awareness == "most-aware" and empty.hook_type == "statement" and empty.angles == []


def test_vocabulary_folds(spark):
    rows = [("b", "clean energy drink", 4, 3, 0), ("b", "energy drink", 4, 2, 1), ("b", "drink clean energy", 4, 3, 2), ("b", "other", 9, 1, 3)]
    ranked = spark.createDataFrame(rows, "brand string, term string, ad_count int, words int, place int").withColumns({"ad_share": F.lit(50.0), "avg_exposure": F.lit(1.0)})
    kept = {r.term for r in V.prefer_longer(ranked, ["brand"]).collect()}
    assert kept == {"clean energy drink", "drink clean energy", "other"}
    assert [r.term for r in V.drop_shifted(ranked, ["brand"], 9).orderBy("place").collect()] == ["clean energy drink", "energy drink", "other"]


def test_shifted_terms_in_rounds(spark):
    """Against going through the terms in order."""
    import random

    rng = random.Random(1)
    terms = list({" ".join(rng.choices("abcde", k=rng.choice([1, 2, 2, 3, 4]))) for _ in range(400)})
    rows = [(rng.choice("xy"), t, rng.randint(2, 3)) for t in terms]
    rows = [(b, t, n, k) for k, (b, t, n) in enumerate(rows)]
    want = []
    for b in "xy":
        kept = []
        for _, t, n, k in sorted((r for r in rows if r[0] == b), key=lambda r: r[3]):
            w = t.split()
            if not any(m == n and len(v) == len(w) > 1 and (v[1:] == w[:-1] or w[1:] == v[:-1]) for v, m in kept):
                kept.append((w, n))
                want.append((b, t, len(kept)))
    got = V.drop_shifted(spark.createDataFrame(rows, "brand string, term string, ad_count int, place int"), ["brand"], 1000).collect()
    assert sorted((r.brand, r.term, r.place) for r in got) == sorted(want) and len(want) < len(rows)


def test_competitors_and_medians(spark, monkeypatch):
    """Against brute force, with cells and chunks of a few vectors."""
    import math
    import random
    import statistics

    from adlens.operators import rollup as RU

    rng = random.Random(2)
    vectors = {}
    for k in range(120):
        if k % 3 == 0 and k:
            vectors[f"b{k:03}"] = dict(vectors[f"b{rng.randrange(k):03}"])
        else:
            vectors[f"b{k:03}"] = {f"k{rng.randrange(7)}": float(rng.choice([10, 25, 33.3, 50, 100])) for _ in range(rng.choice([1, 2, 3, 4]))}
    vectors |= {f"same{k}": {"k1": 50.0, "k9": 50.0} for k in range(9)} | {"alone": {"k99": 1.0}}
    monkeypatch.setattr(RU, "CHUNK", 8)
    rows = [(b, k, v) for b, own in vectors.items() for k, v in own.items()] + [("none", "k1", 0.0)]

    def alike(a, b):
        dot = sum(v * b.get(k, 0.0) for k, v in a.items())
        return math.floor(dot / (math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))) * 1000 + 0.5) / 10

    want = set()
    for b, own in vectors.items():
        near = sorted((-alike(own, v), v != own, o) for o, v in vectors.items() if o != b and alike(own, v) > 0)[:3]
        want |= {(b, o, -s, k + 1) for k, (s, _, o) in enumerate(near)}
    got = {tuple(r) for r in RU.competitors(spark.createDataFrame(rows, "brand string, key string, value double")).collect()}
    assert len(got ^ want) <= 4 and {r[0] for r in got} == {r[0] for r in want}, sorted(got ^ want)[:6]

    monkeypatch.setattr(RU, "BINS", 4)
    figures = [(rng.choice("xyz"), rng.choice([None, rng.gauss(0, 50), 7.0, 1e9 * rng.random()]), float(rng.randrange(3))) for _ in range(400)] + [("w", None, 1.5)]
    got = {r.g: (r.a, r.b) for r in RU.exact_medians(spark.createDataFrame(figures, "g string, a double, b double"), ["g"], ["a", "b"]).collect()}
    for g in "xyzw":
        for i in (0, 1):
            own = [f[1 + i] for f in figures if f[0] == g and f[1 + i] is not None]
            assert got[g][i] == (math.floor(statistics.median(own) * 100 + 0.5) / 100 if own else None)


def test_classify(spark):
    tax = C.taxonomy(spark, {"Food": {"Protein": {"terms": [["whey protein", 3], "shake"]}, "Tea": {"terms": ["green tea"]}}, "Skin": {"Serum": {"terms": [["serum", 4]]}}})
    texts = spark.createDataFrame([(1, "whey protein shake whey protein and green tea"), (2, "a serum"), (3, "none")], "id int, text string")
    rows = {r.id: r for r in C.classify(C.term_hits(texts, tax), tax).collect()}
    assert (rows[1].niche, rows[1].sub, rows[1].alternatives) == ("Food", "Protein", ["Food / Tea"]) and rows[2].niche == "Skin" and 3 not in rows
    assert rows[1].confidence == round(100 * (1 - 2.718281828459045 ** (-(7 + 0.25 * 8) / 14)))
    many = tax.union(spark.createDataFrame([("X", "Y", 9, f"filler {k}", 1.0) for k in range(30)] + [("X", "Y", 9, "+", 1.0)], tax.schema))
    texts = texts.union(spark.createDataFrame([(4, "nad+ whey protein filler 7, filler 77"), (5, None), (6, "x + y")], "id int, text string"))
    want = {(1, "whey protein", 2), (1, "shake", 1), (1, "green tea", 1), (2, "serum", 1), (4, "whey protein", 1), (4, "filler 7", 1), (6, "+", 1)}
    assert {tuple(r) for r in C.term_hits(texts, many).collect()} == want
    before = C.FEW_TERMS, C.PLANNED_TERMS
    for C.FEW_TERMS, C.PLANNED_TERMS in ((5, 5000), (5, 10)):
        assert {tuple(r) for r in C.term_hits(texts, many).collect()} == want
    C.FEW_TERMS, C.PLANNED_TERMS = before
    merged = C.merge_taxonomy(tax, C.taxonomy(spark, {"Food": {"Tea": {"terms": ["oolong"]}}, "New": {"A": {"terms": ["b"]}}}))
    assert {(r["sub"], r.term) for r in merged.collect() if r["sub"] in ("Tea", "A")} == {("Tea", "oolong"), ("A", "b")}


def test_built_in_niches(spark):
    nested = C.built_in()
    assert len(nested) == 18 and sum(map(len, nested.values())) == 73
    texts = spark.createDataFrame([(1, "sun care and more sun care for skin"), (2, "nothing of the kind"), (3, "men's health, men's health and a coffee"), (4, None)], "id int, text string")
    rows = {r.id: r for r in C.classified(texts, nested).collect()}
    assert (rows[1].niche, rows[1]["sub"], rows[1].unclassified) == ("Skincare", "Sun care", False)
    assert (rows[2].niche, rows[2].confidence, rows[2].unclassified, rows[2].audience) == (C.UNCLASSIFIED, 0.0, True, None) and rows[4].niche == C.UNCLASSIFIED
    assert (rows[3]["sub"], rows[3].audience) == ("Men's health", "men")
    broken = C.taxonomy(spark, {"Bad": {"Sub": {"terms": "nope"}, "Good": {"terms": ["x"]}}})
    assert [r.term for r in broken.collect()] == ["x"]


def test_options_by_their_names():
    c = EngineConfig.from_dict({"startUrls": ["https://a.com"], "as_of": "2024-01-01", "discoveryMode": "outbound-links", "profileDepth": "fast", "adsProvider": "apify-actor", "adCountries": [" de "], "brandLinkSelector": " .list a ", "analyseCheckout": True, "outputFormats": ["json", "pdf"], "maxSitemapUrls": 5, "rankBy": "best"})
    assert (c.discovery_mode, c.profile_depth, c.ads_provider, c.countries, c.brand_link_selector, c.analyse_checkout, c.analyse_landing_pages) == ("outbound-links", "fast", "apify-actor", ("DE",), ".list a", True, False)
    assert c.output_formats == ("json",) and c.max_sitemap_urls == 100 and c.rank_by == "composite" and len(c.warnings) == 1 and "best" in c.warnings[0]
    auto = {"start_urls": ["https://a.com"], "as_of": "2024-01-01"}
    assert EngineConfig.from_dict(auto).provider == "apify-actor" and EngineConfig.from_dict(auto | {"ad_countries": ["FR"]}).provider == "meta-graph" and c.provider == "apify-actor"


LIST = """<html><head><title>Best</title><script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Org"},{"@type":"Product","name":"Powder","offers":{"price":"49.5","priceCurrency":"EUR"}}]}</script></head><body>
<nav><a href="https://facebook.com/x">fb</a><a href="https://navlink.com">Nav</a></nav><article><h2>1. <a href="https://www.ironpeak.com/?utm_source=x">Iron Peak</a></h2><p>text <a href="https://ironpeak.com/products/a">here</a></p>
<h2>2. North</h2><ul><li><a href="https://northlabs.com/">North Labs</a></li></ul><a href="/products/green">Green Powder</a><a href="https://northlabs.com/privacy">p</a></article><script>var a = "<a href='https://evil.com'>";</script></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([("https://list.com/top", LIST), ("https://empty.com", None)], "url string, html string")
    read = P.page_meta(df)
    rows = {r.domain: r for r in P.discover(P.links(read)).collect()}
    assert rows["ironpeak.com"].name == "Iron Peak" and rows["ironpeak.com"].url == "https://www.ironpeak.com/" and rows["ironpeak.com"].mentions == 2
    assert "facebook.com" not in rows and "evil.com" not in rows and rows["northlabs.com"].name == "North Labs"
    assert [r.product_url for r in P.product_links(read).orderBy("place").collect()] == ["https://ironpeak.com/products/a", "https://list.com/products/green"]
    nodes = P.ld_rows(read)
    assert P.organisations(nodes).first().name == "Org" and P.ld_products(nodes).first().price == 49.5


def test_site_crawl(spark):
    docs = [
        ("https://b.com/robots.txt", "User-agent: *\nSitemap: https://b.com/maps.xml\n"), ("https://b.com/maps.xml", "<sitemapindex><loc>https://b.com/a.xml</loc><loc>https://other.com/b.xml</loc></sitemapindex>"),
        ("https://b.com/a.xml", "<urlset><loc>https://b.com/products/x</loc><loc> https://b.com/blogs/n/y?utm_source=a&amp;p=1 </loc><loc>https://b.com/products/x</loc></urlset>"),
    ]
    urls = P.crawl(spark.createDataFrame(docs, "url string, body string"), spark.createDataFrame([("https://b.com/",)], "site string"))
    assert [r.url for r in urls.orderBy("pos").collect()] == ["https://b.com/products/x", "https://b.com/blogs/n/y?p=1"]
    ads = spark.createDataFrame([("https://b.com/", "https://www.b.com/products/x"), ("https://b.com/", "https://b.com/lp/z")], "site string, url string")
    assert [(r.kind, r["count"]) for r in P.unadvertised(urls, ads, ["site"]).collect()] == [("article", 1)]
    assert [r.url for r in P.unlisted(urls, ads, ["site"]).collect()] == ["https://b.com/lp/z"]


def test_tools_and_commerce(spark):
    html = "<script src='https://connect.facebook.net/en/fbevents.js'></script><script src='https://static.klaviyo.com/x'></script> x.klarna.com"
    text = "Subscribe and save. Free shipping on orders over $50. 30-day money back guarantee. 20% off, 35% off! 12,480 reviews. Rated 4.8 out of 5."
    r = spark.createDataFrame([(html, text)], "h string, t string").select(P.tech_stack(P.tools(F.col("h"))).alias("s"), P.commerce(F.col("t")).alias("c")).first()
    assert r.s.paid_media and r.s.lifecycle and r.s.bnpl and r.s.score == 38
    assert (r.c.subscription, r.c.guarantee_days, r.c.max_discount, r.c.review_count, r.c.rating, r.c.free_shipping_over) == (True, 30.0, 35.0, 12480.0, 4.8, 50.0)


def test_resolution(spark):
    pages = spark.createDataFrame(
        [("trysparta", 0, "terms", "This site is operated by 115 Ventures, LLC. © 2024 115 Ventures, LLC", [], "Sparta"), ("weak", 0, "home", "hello", [], None)], "site string, pos int, kind string, text string, json_ld array<string>, site_name string"
    )
    inputs = spark.createDataFrame([("trysparta", None, "115 Ventures", None), ("weak", None, "Weak", None), ("known", "known-co", "x", None)], "id string, slug string, name string, website string")
    aliases = spark.createDataFrame([(0, "Known Inc", "Known", "https://known.com", "known-co", "me", "2024")], "pos int, legal_entity string, brand string, website string, linkedin_slug string, confirmed_by string, confirmed_at string")
    rows = {r.id: r for r in R.resolve(inputs, R.signals(pages), aliases).collect()}
    assert (rows["trysparta"].status, rows["trysparta"].legal_entity) == ("resolved", "115 Ventures, LLC") and rows["trysparta"].confidence >= 70
    assert rows["weak"].status == "unresolved" and (rows["known"].status, rows["known"].confidence, rows["known"].brand) == ("confirmed", 100.0, "Known")
    assert R.review_queue(R.resolve(inputs, R.signals(pages), aliases)).count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = [("A, \"B\"", "x\ny", None)]
    R.write_csv(spark.createDataFrame(rows, "`Legal Entity` string, brand string, website string"), str(tmp_path / "a"))
    back = R.read_aliases(spark, str(tmp_path / "a")).first()
    assert (back.legal_entity, back.brand, back.website) == ('A, "B"', "x y", None)


def test_config():
    c = EngineConfig.from_dict({"start_urls": [{"url": "https://a.com"}, "ftp://x"], "as_of": "2024-01-01", "max_brands": "9999", "rank_by": "?"})
    assert c.start_urls == ("https://a.com",) and c.max_brands == 500 and c.rank_by == "composite" and c.ads_per_brand == 20
    for bad in ({}, {"start_urls": ["https://a.com"]}, []):
        try:
            EngineConfig.from_dict(bad)
        except InputError:
            continue
        raise AssertionError(bad)


def test_engine(spark, tmp_path):
    from adlens.engine import document, run, write

    c = EngineConfig.from_dict({"start_urls": ["https://list.com/top"], "as_of": "2024-06-01", "exclude_domains": ["nope.com"], "min_confidence": 1, "analyse_landing_pages": True, "analyse_product_pages": True, "analyse_checkout": True, "profile_depth": "fast", "taxonomy": {"Food": {"Tea": {"terms": [["green tea", 5], "leaf"]}, "Protein": {"terms": [["whey", 5]]}}}})
    listed = "<h2>Peak</h2><a href='https://peak.com/'>Peak</a><h2>Zed</h2><a href='https://zed.com/'>Zed</a><h2>Nope</h2><a href='https://nope.com/'>Nope</a><h2>Moo</h2><a href='https://moo.com/'>Moo</a>"
    pages = spark.createDataFrame([("https://list.com/top", f"<html><body>{listed}</body></html>"), ("https://own.com/", "<html><head><title>Own - home</title></head><body>hello</body></html>")], "url string, html string")
    home = "<html><head><meta property='og:site_name' content='Peak &lt;b&gt;'></head><body><p>Whey and more whey. Save 20% off.</p><a href='/products/x'>Whey tub</a></body></html>"
    fetched = [("https://peak.com/", 200, "text/html", home), ("https://zed.com/", 200, "text/html", "<html><body>green tea leaf</body></html>"), ("https://moo.com/", 500, "text/html", ""), ("https://peak.com/sitemap.xml", 200, "text/xml", "<urlset><loc>https://peak.com/products/x</loc><loc>https://peak.com/products/y</loc></urlset>")]
    records = [("peak.com", "p", "q", k, json.dumps({"id": f"a{k}", "body": "Problem? Shop now and get 20% off today.", "title": "Whey tub", "startDate": "2024-01-01", "link_url": "https://peak.com/products/x", "reach": 1000 * k})) for k in (1, 2)]
    r = run(c, pages, spark.createDataFrame(fetched, "url string, status int, content_type string, body string"), spark.createDataFrame(records, "brand string, provider string, matched_query string, pos long, record string"), str(tmp_path))
    assert {x.domain for x in r.candidates.collect()} == {"peak.com", "zed.com", "moo.com", "own.com"}
    found = {x.domain: x for x in r.profiles.collect()}
    assert (found["peak.com"].niche, found["peak.com"].sub_niche, found["zed.com"].sub_niche, found["moo.com"].niche, found["moo.com"].error) == ("Food", "Protein", "Tea", "Unclassified", "homepage HTTP 500")
    assert {(x.brand, x.term) for x in r.terms.collect()} >= {("peak.com", "Peak <b>"), ("peak.com", "Peak <b> Whey tub")}
    assert [(x.kind, x["count"]) for x in r.gaps.collect()] == [("product", 1)] and r.inventory.filter("kind = 'product'").first()["count"] == 2
    assert r.vocabulary.filter("slot = 'signature'").count() > 0
    doc = document(c, r)
    assert doc["brands_profiled"] == 4 and doc["brands_with_ads"] == 1 and doc["ads_analysed"] == 2 and doc["leaderboard"] and doc["niches"][0]["subs"]
    assert {b["brand"]: b["posture"] for b in doc["brands"]}["zed.com"] == "absent"
    top = next(b for b in doc["brands"] if b["brand"] == "peak.com")
    assert top["offers"] and top["landing_pages"][0]["url"] == "https://peak.com/products/x"
    assert doc["top_ads"] and {m["mix"] for m in doc["mixes"]} >= {"angle", "format", "awareness", "funnel", "posture"} and top["vocabulary"] and top["teardowns"][0]["url"] == "https://peak.com/products/x"
    assert top["posture_reason"] and top["media_type_mix"] and top["checkout"][0]["cart_style"] == "unknown" and top["resolution"][0]["status"] == "unresolved" and top["product_pages"]
    files = write(c, r, str(tmp_path), "one")
    write(c, r, str(tmp_path), "two")
    write(c, r, str(tmp_path), "one")
    from adlens.sources.store import runs

    assert set(files) == {"REPORT.json", "REPORT.md", "REPORT.html"} and runs(spark, str(tmp_path / "brands")).groupBy("run").count().orderBy("run").collect() == [("one", 4), ("two", 4)]
    text = O.markdown(doc)
    assert "### Recurring words" in text and "### Landing pages read" in text and "## Mixes" in text
    assert "Peak &lt;b&gt;" in O.html(doc) and "## Angles" in text and "### Offers" in text and json.loads(O.document(doc))["brands_profiled"] == 4


def test_stream_equals_batch(spark, tmp_path):
    from adlens.streaming.launches import launches, stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), events.schema).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("day", "event_type", "n").collect()}
    want = {tuple(r) for r in launches(events).select("day", "event_type", "n").collect()}
    assert got and got <= want
