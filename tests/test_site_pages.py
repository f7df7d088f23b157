"""Pages read against what a person would say of them: discovery, socials, shapes, identity."""

import pytest
from pyspark.sql import functions as F

from adlens.functions.dom import Tree
from adlens.operators import pages as P
from adlens.operators import resolve as R


def parsed(spark, *pages, selector=None):
    return spark.createDataFrame(list(pages), "url string, html string").withColumn("page", P.read_html(F.col("html"), selector))


def test_tree():
    t = Tree("<div id=a class='x y'><p>one<p>two<ul><li>a<li>b</ul></div><script>var a = '<p>';</script><p data-k=v>three")
    assert [t.text(k) for k in t.all("p")] == ["one", "two", "three"] and [t.text(k) for k in t.all("li")] == ["a", "b"]
    assert t.body() == "one two a b three"
    assert [t.elements[k].tag for k in t.select("#a > p, .x.y li, [data-k=v], [data-k='v'] b, p:first-child")] == ["p", "p", "li", "li", "p"]
    assert t.select("div p") == t.select("div>p") and t.select("li > p") == [] and len(t.select("*")) == len(t.elements)
    assert Tree(None).body() == "" and Tree("</p></div>text<br>more").body() == "text more"


LISTICLE = """<html><head><title>Top hair brands</title></head><body>
<header><a href="https://header-sponsor.com/">Header Sponsor</a></header>
<article><h1>Best of the year</h1>
<section><h2>1. Iron Peak — best overall</h2><div><p>We like <a href="https://www.ironpeak.com/products/one">their bottle</a> and <a href="https://ironpeak.com/?utm_source=a">read more</a>.</p></div></section>
<section><h2>2) Runner-up: the lab</h2><ul><li><a href="https://northlabs.com/"><img src="n.png" alt="n">North Labs</a></li></ul></section>
<section><h2>3. Hims — best for hair loss</h2><p><a rel="sponsored" href="https://hims.com/hair">Check price</a></p></section>
<h3><a href="https://vitalroot.co.uk/shop">Vital Root</a></h3><p>Nothing above this one: <a href="https://abc.com/">a b c d e f</a> <a href="https://abc.com/x">the shortest has too many words</a></p>
</article><footer><a href="https://footer-badge.com/">Badge</a><a href="https://facebook.com/list">Facebook</a></footer></body></html>"""


def test_discovery_reads_headings_and_content(spark):
    read = parsed(spark, ("https://list.org/top", LISTICLE))
    found = {r.domain: r for r in P.discover(P.links(read)).collect()}
    assert set(found) == {"ironpeak.com", "northlabs.com", "hims.com", "vitalroot.co.uk", "abc.com"}  # nothing outside the article
    assert {d: r.name for d, r in found.items()} == {"ironpeak.com": "Iron Peak", "northlabs.com": "North Labs", "hims.com": "Hims", "vitalroot.co.uk": "Vital Root", "abc.com": "Abc"}
    assert found["ironpeak.com"].url == "https://ironpeak.com/" and found["ironpeak.com"].mentions == 2
    links = {r.url: r for r in P.links(read).collect()}
    assert links["https://hims.com/hair"].heading == "3. Hims — best for hair loss" and links["https://hims.com/hair"].after_heading
    assert links["https://vitalroot.co.uk/shop"].in_heading and links["https://northlabs.com/"].in_item and links["https://northlabs.com/"].has_image
    # The h3 is an earlier sibling of the paragraph, the sections' headings are not.
    assert links["https://abc.com/"].heading == "Vital Root"


def test_discovery_selector(spark):
    page = ("https://list.org/top", LISTICLE)
    only = {r.domain for r in P.discover(P.links(parsed(spark, page, selector="article section ul"))).collect()}
    assert only == {"northlabs.com"}
    assert {r.domain for r in P.discover(P.links(parsed(spark, page, selector=".not-there"))).collect()} >= {"hims.com", "ironpeak.com"}
    few = ("https://l.org/", "<main><a href='https://a1.com/'>Aone</a></main><p><a href='https://b2.com/'>Btwo</a></p>")
    assert {r.domain for r in P.discover(P.links(parsed(spark, few))).collect()} == {"a1.com", "b2.com"}  # main holds too few links


def test_platform_and_socials(spark):
    marks = {"window.Shopify = {}": "shopify", "/wp-content/plugins/woocommerce/x": "woocommerce", "cdn11.bigcommerce": "bigcommerce", "/static/version123/x": "magento", "static1.squarespace": "squarespace", "parastorage.com": "wix", "plain": "unknown"}
    got = spark.createDataFrame(list(marks.items()), "h string, want string").select("want", P.platform(F.col("h")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    html = "<a href='https://www.instagram.com/one?x=1'>i</a><a href='https://instagram.com/two'>i</a><a href='https://pinterest.de/pins'>p</a><a href='https://linkedin.com/in/person'>l</a><a href='//linkedin.com/company/firm'>l</a><a href='https://youtube.com/watch?v=1'>y</a><a href='http://tiktok.com/@me'>t</a>"
    s = parsed(spark, ("https://b.com/", html)).select(P.socials(F.col("page")).alias("s")).first().s
    assert s == {"instagram": "https://instagram.com/one", "pinterest": "https://pinterest.de/pins", "linkedin": "https://linkedin.com/company/firm", "tiktok": "https://tiktok.com/@me"}


def test_products_and_own_pages(spark):
    html = "<a href='/products/a' title='Titled bottle'>Text</a><a href='/item/b'><img alt='Imaged box'></a><a href='/products/c'>Titled BOTTLE</a><a href='/why'>w</a><a href='/bestsellers/'>b</a><a href='https://www.b.com/about'>other host</a><a href='/reviews'>r</a><a href='/why?ref=1'>w</a>"
    read = parsed(spark, ("https://b.com/", html))
    assert [(r.name, r.product_url) for r in P.product_links(read).orderBy("place").collect()] == [("Titled bottle", "https://b.com/products/a"), ("Imaged box", "https://b.com/item/b")]
    assert [r.to for r in P.internal_pages(read).orderBy("place").collect()] == ["https://b.com/products/a", "https://b.com/products/c", "https://b.com/why", "https://b.com/bestsellers"] or [r.to for r in P.internal_pages(read).orderBy("place").collect()][:3] == ["https://b.com/products/a", "https://b.com/products/c", "https://b.com/why"]


def test_products_merge_by_richness(spark):
    rows = [("b", 0, "Red Ring", None, None, None), ("b", 1, "redring", 5.0, "EUR", None), ("b", 2, "RED-RING", 9.0, "USD", None), ("b", 3, "red ring!", 7.0, None, "round"), ("b", 4, "red  ring", 1.0, "GBP", "late"), ("b", 5, "Blue", 0.0, "EUR", None), ("b", 6, "blue", 4.0, None, None)]
    got = P.dedupe_products(spark.createDataFrame(rows, "brand string, pos int, name string, price double, currency string, description string"), ["brand"]).orderBy("place").collect()
    assert [(r.name, r.price, r.currency, r.description) for r in got] == [("red ring!", 7.0, "USD", "round"), ("redring", 5.0, "EUR", None), ("blue", 4.0, "EUR", None)]
    low = P.price_range(spark.createDataFrame([("b", 0, 0.0, "EUR"), ("b", 1, 9.0, None), ("b", 2, 11.0, "USD")], "brand string, pos int, price double, currency string"), ["brand"]).first()
    assert (low.low, low.high, low.currency) == (9.0, 11.0, "USD")


@pytest.mark.parametrize(
    ("body", "shape"),
    [
        ("<h2>1. A</h2><h3>2) B</h3><h2>3. C</h2>", "listicle"), ("<p>Only $ 49</p><a>Add to Bag</a>", "product-page"), ("<p>Add to cart</p>", "landing-page"), ("<p>Question 1</p><input><select></select>", "quiz"),
        ("<p>Sign up</p><input><input><textarea></textarea>", "lead-form"), ("<p>" + "</p><p>".join(["word " * 50] * 8) + "</p>", "article"), ("<p>" + "word " * 1000 + "</p>", "landing-page"), ("", "unknown"), ("<h2>#1 A</h2><h2>1 B</h2><h2>2: C</h2>", "landing-page"),
    ],
)
def test_shapes(spark, body, shape):
    from adlens.functions import text as T

    page = parsed(spark, ("u", f"<html><body>{body}</body></html>"))
    assert page.select(P.page_shape(F.col("page"), T.word_count(F.col("page.body"))).alias("s")).first().s == shape


def test_teardown(spark):
    html = "<title>Own</title><h1>Head</h1><h2>Head</h2><h4>Small</h4><a>Shop it</a><button>Start</button><a>Read</a><input type=email><p>Tired of brain fog? Fed up with it? 20% off, a 30-day money back guarantee.</p><footer>© Footer words</footer>"
    pages = spark.createDataFrame([("a", html, 200), ("b", html, 503)], "url string, html string, status int")
    ads = spark.createDataFrame([("a", 9.0, ["problem-agitation", "curiosity"]), ("b", 8.0, ["curiosity"]), ("c", 7.0, None)], "url string, exposure double, angles array<string>")
    a, b, c = P.teardown(pages, ads, 3).orderBy("url").collect()
    assert a.ok and a.headings == ["Head"] and a.ctas == 2 and a.form and a.commerce.guarantee_days == 30.0 and "problem-agitation" in a.page_angles
    assert a.match_note == "carries 1 of the ads' angles but drops Curiosity / open loop" and a.lost == ["curiosity"] and 0 < a.match < 100
    assert (b.ok, b.error, b.shape, b.match_note) == (False, "HTTP 503", "unknown", None) and c.error == "not fetched"


def test_identity_of_a_trading_brand(spark):
    home = '<html><head><title>Sparrow — Daily performance</title><meta property="og:site_name" content="Sparrow"></head><body><footer><p>© 2026 77 Holdings, LLC. All rights reserved.</p><p>Sparrow® is a registered trademark of 77 Holdings, LLC.</p></footer></body></html>'
    terms = '<html><head><title>Terms of Service</title></head><body><p>These terms are an agreement between you and 77 Holdings, LLC ("we").</p><p>The site is provided by 77 Holdings, LLC; it is a service of 77 Holdings, LLC.</p></body></html>'
    pages = spark.createDataFrame([("https://sparrow.com/", 200, home), ("https://sparrow.com/pages/terms-of-service", 200, terms), ("https://sparrow.com/privacy", 404, terms)], "url string, status int, body string")
    sites = spark.createDataFrame([("x", "https://sparrow.com/")], "site string, url string")
    found = R.signals(R.identity_pages(sites, pages)).collect()
    got = sorted((r.role, r.source, r.weight, r.value.rstrip(".")) for r in found)
    assert got == sorted([("legal-entity", "footer-copyright", 30, "77 Holdings, LLC"), ("legal-entity", "trademark-notice", 50, "77 Holdings, LLC"), ("brand", "trademark-notice", 50, "Sparrow"), *[("legal-entity", "terms-of-service", 45, "77 Holdings, LLC")] * 3, ("brand", "og-site-name", 25, "Sparrow"), ("brand", "page-title", 10, "Sparrow"), ("brand", "page-title", 10, "Terms of Service")])
    inputs = spark.createDataFrame([("x", "77-holdings", "77 Holdings", "https://sparrow.com"), ], "id string, slug string, name string, website string")
    none = spark.createDataFrame([], "pos int, legal_entity string, brand string, website string, linkedin_slug string, confirmed_by string, confirmed_at string")
    signals = R.signals(R.identity_pages(sites, pages))
    r = R.resolve(inputs, signals, none).first()
    assert (r.status, r.brand, r.legal_entity) == ("resolved", "Sparrow", "77 Holdings, LLC") and r.confidence >= 70
    other = R.resolve(inputs.withColumn("name", F.lit("Northern Goods")), signals, none).first()
    assert other.status == "needs-review" and other.confidence <= 45


def test_advertised_and_published(spark):
    urls = spark.createDataFrame([("s", k, f"https://b.com/products/{k}") for k in range(8)] + [("s", 9, "https://b.com/blogs/n/a")], "site string, pos int, url string")
    ads = spark.createDataFrame([("s", "https://www.b.com/products/0"), ("s", "https://else.org/x"), *[("s", f"https://go.b.com/lp/{k}") for k in range(12)], ("t", "https://c.com/x")], "site string, url string")
    left = {r.kind: (r["count"], r.examples) for r in P.unadvertised(urls, ads, ["site"]).collect()}
    assert left == {"article": (1, ["https://b.com/blogs/n/a"]), "product": (7, [f"https://b.com/products/{k}" for k in range(1, 6)])}
    gone = P.unlisted(urls, ads, ["site"]).collect()
    assert len(gone) == 10 and all(r.url.startswith("https://go.b.com/lp/") for r in gone)
    kinds = {r.kind: (r["count"], r.share, len(r.samples)) for r in P.kind_counts(urls, ["site"]).collect()}
    assert kinds == {"article": (1, 11.1, 1), "product": (8, 88.9, 5)}
