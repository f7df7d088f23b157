from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.functions import score as S
from adlens.functions import text as T
from adlens.functions import url as U


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text(spark):
    s = lambda x: F.lit(x)
    got = one(
        spark, T.collapse(s(" a \n\t b ")), T.truncate(s("abcdefghij"), 5), F.size(T.sentences(s("One. Two! Three?"))), T.word_count(s("  ")), T.title_case(s("hello wORLD")), T.escape_html(s("<a & 'b'>")),
        T.format_count(s(1_234_567.0)), T.format_count(s(12_400.0)), T.format_count(s(56.0)), T.parse_count(s("12.4k")), T.parse_count(s("1,200")), T.parse_count(s("2m")), T.parse_count(s("x")), T.session_id(s("!!")), T.session_id(s("a b/c")),
    )
    assert got == ("a b", "abcd…", 3, 0, "Hello World", "&lt;a &amp; &#39;b&#39;&gt;", "1.2M", "12.4k", "56", 12400.0, 1200.0, 2_000_000.0, 0.0, "session", "a_b_c")


def test_terms_and_folding(spark):
    text = T.normalise(F.col("t"))
    got = one(spark, text, T.count_term(text, "testosterone"), T.count_term(text, "testosterone booster"), t="Crème  BRÛLÉE’s. Testosterone support. A testosterone booster, not testosterones.")
    assert got[0].startswith("creme brulee's") and got[1:] == (2, 1)
    grams = one(spark, F.flatten(F.transform(T.sentences(F.lit("Trusted by 40,000 men. Shop now.")), lambda x: T.ngrams(T.gram_tokens(F.lower(x)), 4, rules.STOPWORDS))))[0]
    assert "shop now" in grams and not any("men shop" in g for g in grams) and "40000 men" in grams


def test_names(spark):
    got = one(spark, T.names_match(F.lit("115 Ventures, LLC"), F.lit("115ventures")), T.names_match(F.lit(""), F.lit("")), T.company_name(F.lit("Acme® Foods Inc.")), T.product_name(F.lit("Add to cart")), T.product_name(F.lit("Green Powder")), T.anchor_quality(F.lit("click here")), T.anchor_quality(F.lit("Iron Peak")))
    assert got == (True, False, "acme foods", False, True, -6, 14)


def test_scores(spark):
    n = F.lit(None).cast("double")
    d = lambda x: F.lit(float(x))
    got = one(
        spark, S.share(F.lit(1), F.lit(3)), S.share(F.lit(3), F.lit(0)), S.exposure(n, d(1_400_000), n, d(140), n, F.lit(True)), S.exposure(n, n, n, d(4), n, F.lit(False)), S.exposure(n, n, n, d(900), n, F.lit(True)), S.exposure(n, n, n, n, n, F.lit(None)),
        S.angle_score(d(1)), S.angle_score(d(1.5)), S.angle_score(d(3)), S.confidence(d(30), 45.0), S.confidence(d(50), 45.0), S.js_round(d(1.005), 2), S.price_tier(d(150), d(100)), S.price_tier(d(60), d(100)), S.deviation(d(50), d(100)), S.posture(F.lit(10), F.lit(6), F.lit(120)),
    )
    assert got == (33.3, 0.0, 90.5, 2.2, 85.0, 0.0, 18.0, 26.0, 45.0, 49.0, 67.0, 1.0, "premium", "value", "below", "scaling")


def test_urls(spark):
    u = "https://www.brand.com/lp/offer?utm_source=fb&fbclid=xyz&ad_id=9"
    assert U.clean(u, None, True) == "https://brand.com/lp/offer" and U.clean("/a b#x", "https://x.com/y/") == "https://x.com/a%20b" and U.clean("mailto:a@b.c") is None and U.clean(None) is None
    assert U.clean("https://X.com?b=2&a=1", None, True) == "https://x.com/?a=1&b=2"
    got = one(
        spark, U.registrable_domain(F.lit("https://shop.vitalroot.co.uk/x")), U.registrable_domain(F.lit("nope")), U.brand_name(F.lit("iron-peak.com")), U.denied_domain(F.lit("facebook.com")), U.denied_domain(F.lit("a.b.com"), ("b.com",)), U.denied_path(F.lit("https://a.com/privacy")), U.denied_path(F.lit("x")),
        U.directory_of(F.lit("/a/b/c")), U.directory_of(F.lit("/a")), U.linkedin_slug(F.lit("https://www.linkedin.com/company/Iron%20Peak/about")), U.same_site(F.lit("https://a.b.com"), F.lit("https://b.com/x")),
    )
    assert got == ("vitalroot.co.uk", None, "Iron Peak", True, True, True, True, "/a/b", "/", "iron peak", True)
    kinds = {"/products/x": "product", "/collections/all": "collection", "/blogs/news/a": "article", "/quiz": "quiz", "/policies/refund": "policy", "/cart": "cart", "/pages/x": "landing", "/": "home", "/zzz": "other"}
    rows = spark.createDataFrame([("https://b.com" + p, k) for p, k in kinds.items()], "u string, k string").select("k", U.page_kind(F.col("u")).alias("g")).collect()
    assert all(r.k == r.g for r in rows)
    funnels = {"https://b.com/quiz": "quiz", "https://b.com/blogs/top-5": "listicle", "https://b.com/products/x": "product-page", "https://b.com/": "homepage", "https://other.com/x": "offsite", "https://apps.apple.com/x": "app-store", "bad": "unknown", "https://b.com/zz": "landing-page"}
    rows = spark.createDataFrame(list(funnels.items()), "u string, k string").select("u", "k", U.funnel_type(F.col("u"), F.lit("b.com")).alias("g")).collect()
    assert all(r.k == r.g for r in rows), rows
