"""Brands from their own sites: profiles, product pages, checkout terms, discovery mode.

Pages come in as a table (url, status, content_type, body); what a live crawler would fetch next is joined to it, so a
missing page is a row that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.functions import text as T
from adlens.functions import url as U
from adlens.functions.lineage import shuffled
from adlens.operators import pages as P

#: Further pages of a site that are read, by depth.
EXTRA_PAGES = {"fast": 0, "standard": 2, "deep": 5}
MAX_CORPUS = 60_000
MODE_DOMAINS = 3


def discovery_mode(found: DataFrame, pages: DataFrame) -> DataFrame:
    """H4: (url, mode): a page that leads to three surviving domains and more talks about brands. found: candidates
    (page_url, domain) of `pages.discover`; pages: url."""
    n = found.groupBy(F.col("page_url").alias("url")).agg(F.countDistinct("domain").alias("n"))
    return pages.select("url").join(n, "url", "left").select("url", F.when(F.col("n") >= MODE_DOMAINS, "outbound-links").otherwise("single-brand").alias("mode"))


def self_candidates(pages: DataFrame) -> DataFrame:
    """H5: the one candidate that stands for a page's own site: url, domain, name, mentions, score. pages: url, page."""
    p, domain = F.col("page"), U.registrable_domain(F.col("url"))
    head = F.split(p["title"], r"[|\-–—]")
    name = F.coalesce(*[F.nullif(T.collapse(x), F.lit("")) for x in (F.element_at(p["meta"], "og:site_name"), F.element_at(p["meta"], "application-name"), F.get(head, 0))], U.brand_name(domain))
    return pages.select("url", domain.alias("domain"), T.truncate(name, 60).alias("name"), F.lit(1).alias("mentions"), F.lit(100.0).alias("score")).filter("domain is not null")


def corpus(name: Column, title: Column, tagline: Column, description: Column, anchors: Column, products: Column, text: Column) -> Column:
    """Everything known about a brand as one text; anchors array<string>, products array<struct<name, description>>."""
    of_products = F.array_join(F.transform(products, lambda p: F.concat(p["name"], F.lit(" "), F.coalesce(p["description"], F.lit("")))), " ")
    parts = F.array(name, title, tagline, description, F.array_join(anchors, " "), of_products, text)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " \n ")


def apps(html: Column, table: str = rules.CONVERSION_APPS) -> Column:
    """The names of a rule table whose pattern a page holds, in the table's order."""
    return T.defined(F.array(*[F.when(html.rlike(T.js_regex(p, "i")), F.lit(n)) for n, p in rules.table(table)]))


def product_page(html: Column, text: Column, page: Column, feed: Column | None = None) -> Column:
    """Struct of what one product's page says. feed: the body of the product's own JSON file, where there is one; it
    goes before JSON-LD, which goes before the page."""
    nodes = F.transform(page["json_ld"], lambda n: F.coalesce(F.get_json_object(n, "$.offers[0]"), F.get_json_object(n, "$.offers")))
    priced = F.filter(F.transform(nodes, lambda o: F.struct(F.coalesce(F.get_json_object(o, "$.price"), F.get_json_object(o, "$.lowPrice")).try_cast("double").alias("price"), F.get_json_object(o, "$.priceCurrency").alias("currency"))), lambda x: x["price"] > 0)
    ld = F.get(priced, 0)
    f = P.product_file(feed) if feed is not None else None
    told = F.coalesce(f["price"].isNotNull(), F.lit(False)) if f is not None else F.lit(False)

    def of(name: str, kind: str) -> Column:
        return F.when(told, f[name]).cast(kind) if f is not None else F.lit(None).cast(kind)

    images = F.regexp_count(html, F.lit(r"(?i)<img[\s>]"))
    bundles = F.transform(F.regexp_extract_all(text, F.lit(T.js_regex(rules.BUNDLES, "i")), F.lit(0)), T.collapse)
    both = T.js_regex(rules.SUBSCRIPTION_DISCOUNT, "i")
    off = F.coalesce(F.nullif(F.regexp_extract(text, both, 1), F.lit("")), F.nullif(F.regexp_extract(text, both, 2), F.lit(""))).try_cast("double")
    return F.struct(
        T.truncate(F.coalesce(F.nullif(T.collapse(of("title", "string")), F.lit("")), page["h1"]), 160).alias("title"), F.coalesce(of("price", "double"), ld["price"]).alias("price"), of("compare_at", "double").alias("compare_at"), of("discount", "double").alias("discount"),
        F.when(~told, ld["currency"]).alias("currency"), of("available", "boolean").alias("available"), of("variants", "int").alias("variants"),
        text.rlike(T.js_regex(rules.PRODUCT_SUBSCRIPTION, "i")).alias("subscription"), off.alias("subscription_discount"), T.first_number(text, T.js_regex(rules.PRODUCT_REVIEWS, "i")).alias("review_count"),
        T.first_number(text, T.js_regex(rules.RATING, "i")).alias("rating"), T.first_number(text, T.js_regex(rules.PRODUCT_GUARANTEE, "i")).alias("guarantee_days"), F.slice(F.array_distinct(bundles), 1, 6).alias("bundles"),
        apps(text, rules.TRUST).alias("trust"), images.alias("images"), html.rlike(r"(?i)<video[\s>]|<iframe[^>]+src=[^>]*(youtube|vimeo)").alias("video"), T.word_count(text).alias("words"), apps(html).alias("apps"),
    )


def read_product_pages(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets (brand, place, url) read from pages (url, status, body); a product's JSON file is the row of its
    address with .js behind. One row a target: ok, error and the fields of `product_page` (null if not read)."""
    own = pages.select(F.col("url").alias("page_url"), "status", "body")
    base = F.regexp_replace(F.regexp_replace("url", r"\?.*$", ""), "/$", "")
    asked = targets.withColumn("file", F.when(F.col("url").rlike("(?i)/products/"), F.concat(base, F.lit(".js"))))
    met = asked.join(shuffled(own), F.col("url") == F.col("page_url"), "left").drop("page_url")
    feeds = pages.filter("status < 400").select(F.col("url").alias("feed_url"), F.col("body").alias("feed"))
    met = met.join(shuffled(feeds), F.col("file") == F.col("feed_url"), "left").drop("feed_url")
    ok = F.coalesce(F.col("status") < 400, F.lit(False))
    read = met.withColumn("ok", ok).withColumn("page", P.read_html(F.when(ok, F.col("body"))))
    read = read.withColumn("x", F.when(F.col("ok"), product_page(F.col("body"), F.col("page.body"), F.col("page"), F.col("feed"))))
    error = F.when(~F.col("ok"), F.coalesce(F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.lit("not fetched")))
    return read.select("brand", "place", "url", "ok", error.alias("error"), "x.*")


def product_targets(advertised: DataFrame, published: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """(brand, place, url): the product pages to read: those that ads lead to, then the sitemap's, then the profile's;
    each once, `most` a brand. All three: brand, pos, url."""
    each = [df.select("brand", F.struct(F.lit(k).alias("from"), F.col("pos").cast("long").alias("pos")).alias("at"), "url") for k, df in enumerate((advertised, published, listed))]
    once = each[0].union(each[1]).union(each[2]).filter("url is not null").groupBy("brand", "url").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("brand").orderBy("at", "url"))
    return once.withColumn("place", place).filter(F.col("place") <= most).select("brand", "place", "url")


def with_teardown(landing: DataFrame, teardowns: DataFrame) -> DataFrame:
    """Landing pages (url, ...) with the teardown of the same address, null where it was not read."""
    rest = [c for c in teardowns.columns if c != "url"]
    return landing.join(shuffled(teardowns.select("url", F.struct(*rest).alias("teardown"))), "url", "left")


def policies(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """(brand, place, path, text): the policy pages of a site (brand, url) that were read and say at least forty words."""
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    paths = F.posexplode(F.array(*[F.lit(p) for p in rules.POLICY_PATHS])).alias("place", "path")
    asked = sites.select("brand", base.alias("base"), paths).withColumn("at", F.concat("base", "path"))
    met = asked.join(shuffled(pages.filter("status < 400").select(F.col("url").alias("at"), "body")), "at").withColumn("text", F.substring(P.read_html(F.col("body"))["body"], 1, 20_000))
    return met.filter(T.word_count(F.col("text")) >= 40).select("brand", "place", "path", "text")


def checkout(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a site (brand, url): cart style, currency, free-shipping threshold, ways to pay, pay-later providers, the
    other tools, return window, restocking fee, shipping terms, policies read. A policy counts in the order of its path."""
    home = sites.join(shuffled(pages.filter("status < 400").select("url", F.col("body").alias("html"))), "url", "left")
    carts = pages.filter("status < 400").select(F.col("url").alias("cart_url"), P.cart_currency(F.col("body")).alias("currency"))
    home = home.withColumn("cart_url", F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("/cart.js"))).join(shuffled(carts), "cart_url", "left").withColumn("found", apps(F.col("html")))
    one, two = (T.first_number(F.col("text"), T.js_regex(p, "i")) for p in rules.RETURN_WINDOWS)
    sentence = F.get(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x.rlike(f"(?i){rules.SHIPPING_NOTE}")), 0)
    p = policies(sites, pages).withColumns({"window": F.coalesce(one, two), "note": F.when(F.col("text").rlike("(?i)ship"), sentence), "fee": F.col("text").rlike("(?i)restocking fee")})

    def first(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct("place", F.col(c).alias("v"))))["v"]

    read = p.groupBy("brand").agg(first("window").alias("return_days"), T.truncate(first("note"), 240).alias("shipping_note"), F.max("fee").alias("fee"), F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("read"))
    ways = F.filter("found", lambda a: a.rlike("(?i)pay|klarna|afterpay|affirm|sezzle"))
    style = F.when(F.col("html").rlike(f"(?i){rules.DRAWER}"), "drawer").when(F.col("html").rlike(f"(?i){rules.CART_LINK}"), "page").otherwise("unknown")
    none = F.array().cast("array<string>")
    return home.join(shuffled(read), "brand", "left").select(
        "brand", style.alias("cart_style"), "currency", T.first_number(F.col("html"), T.js_regex(rules.CHECKOUT_OVER, "i")).alias("free_shipping_over"), F.coalesce(ways, none).alias("payment_methods"),
        F.coalesce(F.filter("found", lambda a: a.isin(*rules.BNPL)), none).alias("bnpl"), F.coalesce(F.array_except("found", ways), none).alias("stack"), "return_days", F.coalesce("fee", F.lit(False)).alias("restocking_fee"), "shipping_note", F.coalesce("read", none).alias("policies_read"),
    )


def profiles(candidates: DataFrame, pages: DataFrame, depth: str = "standard", most: int = 20) -> DataFrame:
    """One row a candidate (url, domain, name, anchors array<string>): brand_name, site_title, description, tagline,
    platform, socials, products, text, corpus, tech_stack, commerce, pages_read, error. pages: url, status, content_type, body.

    The name is the organisation's of JSON-LD, else the site's, else the candidate's, else the domain's. Product records
    come from JSON-LD, the page's links and, for a Shopify site, its feed; the first of a folded name is kept and filled
    by later ones. EXTRA_PAGES says how many further pages of the site are read.
    """
    got = pages.select("url", "status", "content_type", "body")
    home = candidates.join(shuffled(got), "url", "left")
    is_html = F.coalesce(F.col("content_type"), F.lit("html")).rlike("(?i)html") | F.contains("body", F.lit("<"))
    error = F.when(F.col("status").isNull(), "homepage fetch failed").when(F.col("status") >= 400, F.concat(F.lit("homepage HTTP "), F.col("status").cast("string"))).when(~is_html, F.concat(F.lit("homepage returned "), F.coalesce("content_type", F.lit("non-HTML"))))
    home = P.page_meta(home.withColumn("error", error).withColumn("html", F.when(F.col("error").isNull(), F.col("body"))))
    extra = P.internal_pages(home.filter("error is null"), EXTRA_PAGES[depth]) if EXTRA_PAGES[depth] else None
    nodes = P.ld_rows(home)
    org = P.organisations(nodes).select("url", F.col("name").alias("org_name"), F.col("description").alias("org_description"))
    kinds = "url string, n long, name string, price double, currency string, description string"
    found = P.ld_products(nodes).select("url", F.col("pos").cast("long").alias("n"), "name", "price", "currency", "description")
    blank = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in kinds.split(", ")[3:]]
    found = found.union(P.product_links(home, most).select("url", (F.col("place") + 1000).cast("long"), "name", *blank))
    text = home.select("url", F.lit(0).alias("n"), F.col("page.body").alias("t"))
    if depth != "fast":
        base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
        shops = home.filter(P.platform(F.col("html")) == "shopify").select("url", F.concat(base, F.lit("/products.json?limit=250")).alias("feed"))
        feeds = shops.join(shuffled(got.filter("status < 400").select(F.col("url").alias("feed"), "body")), "feed").select("url", "body")
        found = found.union(P.shop_products(feeds, most).select("url", (F.col("place") + 2000).cast("long"), "name", "price", F.lit(None).cast("string"), "description"))
    if extra is not None:
        more = extra.join(shuffled(got.filter("status < 400").select(F.col("url").alias("to"), "body")), "to").withColumn("page", P.read_html(F.col("body")))
        own = more.select(F.col("url").alias("site"), F.col("to").alias("url"), "place", "page")
        site = own.select("site", "url", "place")
        later = P.ld_products(P.ld_rows(own)).join(site, "url").select("site", (3000 + F.col("place") * 100 + F.col("pos")).cast("long"), "name", "price", "currency", "description")
        later = later.union(P.product_links(own, most).select("url", "name", F.col("place").alias("nth")).join(site, "url").select("site", (3050 + F.col("place") * 100 + F.col("nth")).cast("long"), "name", *blank))
        found = found.union(later)
        text = text.union(own.select(F.col("site"), F.col("place").cast("int"), F.substring("page.body", 1, 15_000)))
    links = P.product_links(home, most).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "product_url"))), lambda x: F.struct(x["place"].cast("int").alias("pos"), x["product_url"].alias("product_url"))).alias("page_products"))
    merged = P.dedupe_products(found.withColumn("pos", F.col("n")), ["url"], most)
    goods = merged.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "price", "currency", "description"))), lambda x: F.struct(x["name"].alias("name"), x["price"].alias("price"), x["currency"].alias("currency"), x["description"].alias("description"))).alias("products"))
    said = text.filter("t != ''").groupBy("url").agg(T.truncate(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"])), " \n "), MAX_CORPUS).alias("text"), F.count("*").alias("read"))
    out = home.join(shuffled(org), "url", "left").join(shuffled(links), "url", "left").join(shuffled(goods), "url", "left").join(shuffled(said), "url", "left")
    out = out.withColumn("products", F.coalesce("products", F.array().cast("array<struct<name:string,price:double,currency:string,description:string>>")))
    out = out.withColumns({"brand_name": T.truncate(F.coalesce(F.nullif("org_name", F.lit("")), "site_name", F.nullif("name", F.lit("")), U.brand_name(F.col("domain"))), 60), "about": F.coalesce("org_description", "description"), "text": F.coalesce("text", F.lit(""))})
    return out.select(
        "url", "domain", "brand_name", "site_title", F.col("about").alias("description"), "tagline", F.when(F.col("error").isNull(), P.platform(F.col("html"))).otherwise("unknown").alias("platform"), P.socials(F.col("page")).alias("socials"), "products", "text",
        corpus(F.col("brand_name"), F.col("site_title"), F.col("tagline"), F.col("about"), F.col("anchors"), F.col("products"), F.col("text")).alias("corpus"),
        F.when(F.col("error").isNull(), P.tech_stack(P.tools(F.col("html")))).alias("tech_stack"), F.when(F.col("error").isNull(), P.commerce(F.col("text"), F.col("products"))).alias("commerce"), F.coalesce("read", F.lit(0)).alias("pages_read"), "error",
        F.coalesce("page_products", F.array().cast("array<struct<pos:int,product_url:string>>")).alias("page_products"),
    )
