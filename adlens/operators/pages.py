"""Web pages: parsing, link mining, brand discovery, site inventory, tools, commerce figures, teardown."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.functions import score as S
from adlens.functions import text as T
from adlens.functions import url as U
from adlens.functions.dom import Tree, collapse
from adlens.functions.lineage import shuffled, written

PARSED = (
    "title string, meta map<string,string>, h1 string, headings array<string>, heads array<struct<tag:string,text:string>>, body string, json_ld array<string>, forms int, inputs int, contact_inputs int, ctas int, paragraphs int,"
    "links array<struct<pos:int,href:string,text:string,title:string,rel:string,alt:string,heading:string,in_heading:boolean,after_heading:boolean,in_item:boolean,has_image:boolean,in_chrome:boolean,in_content:boolean>>"
)
#: What is read of a batch goes back whenever its pages come to so many characters, so a task holds little more than its largest page.
PARSED_CHARS = 1 << 20
_HEADS = frozenset(("h1", "h2", "h3", "h4"))
_SECTIONS = frozenset(("h2", "h3", "h4"))
_CHROME = frozenset(("nav", "footer", "header", "aside"))


def ld_nodes(blocks: list[str]) -> list[str]:
    """The objects of all JSON-LD blocks, lists and @graph opened breadth first; what is no JSON is passed over."""
    out = []
    for block in blocks:
        try:
            queue = json.loads(block)
        except ValueError:
            continue
        queue = list(queue) if isinstance(queue, list) else [queue]
        while queue:
            node = queue.pop(0)
            if isinstance(node, dict):
                out.append(json.dumps(node))
                if isinstance(node.get("@graph"), list):
                    queue += node["@graph"]
    return out


def json_ld(tree: Tree) -> list[str]:
    return ld_nodes([tree.raw[k] for k in tree.all("script") if k in tree.raw and tree.elements[k].attrs.get("type", "").lower() == "application/ld+json"])


def content_root(tree: Tree, selector: str | None = None) -> list[int]:
    """The elements that hold a page's content: what the selector matches, else the first of the usual places
    with three links or more, else none, which means the whole page."""
    if selector and (found := tree.select(selector)):
        return found
    for usual in rules.CONTENT_SELECTORS:
        found = tree.select(usual)
        links = {k for at in found for k in tree.inside(at) if tree.elements[k].tag == "a" and "href" in tree.elements[k].attrs}
        if len(links) >= 3:
            return found
    return []


def _heading_above(tree: Tree, at: int, tops: set[int], known: dict[int, list[int]]) -> int:
    """The heading that a link stands under: the nearest h2-h4 before one of its ancestors, among that one's siblings, from
    the nearest ancestor up to the content root. known: the headings among each element's children, as far as looked for."""
    for up in tree.ancestors(at):
        if up in tops or not tops and tree.elements[up].tag == "body":
            break
        parent = tree.elements[up].parent
        if parent not in known:
            siblings = tree.elements[parent].children if parent >= 0 else [k for k, e in enumerate(tree.elements) if e.parent < 0]
            known[parent] = [k for k in siblings if tree.elements[k].tag in _SECTIONS]
        before = bisect_left(known[parent], up)
        if before:
            return known[parent][before - 1]
    return -1


def parse(html: str | None, selector: str | None = None) -> dict:
    tree = Tree(html)
    of, texts = tree.elements, {}

    def text(at: int) -> str:
        if at not in texts:
            texts[at] = tree.text(at)
        return texts[at]

    root = content_root(tree, selector)
    tops, covered = set(root), {k for at in root for k in tree.inside(at)}
    meta: dict[str, str] = {}
    known: dict[int, list[int]] = {}
    for k in tree.all("meta"):
        if name := of[k].attrs.get("property") or of[k].attrs.get("name"):
            meta.setdefault(name.lower(), collapse(of[k].attrs.get("content", "")))
    links = []
    for k in tree.all("a"):
        a = of[k].attrs
        if not a.get("href"):
            continue
        own = tree.closest(k, _HEADS)
        under = _heading_above(tree, k, tops, known) if own < 0 else -1
        images = [i for i in tree.inside(k) if of[i].tag == "img"]
        links.append({
            "pos": len(links), "href": a["href"], "text": text(k), "title": collapse(a.get("title", "")), "rel": a.get("rel", ""), "alt": collapse(of[images[0]].attrs.get("alt", "")) if images else "",
            "heading": text(own) if own >= 0 else text(under) if under >= 0 else None, "in_heading": own >= 0, "after_heading": under >= 0, "in_item": tree.closest(k, frozenset(("li",))) >= 0,
            "has_image": bool(images), "in_chrome": tree.closest(k, _CHROME) >= 0, "in_content": not root or k in covered,
        })
    heads = [{"tag": of[k].tag, "text": text(k)} for k in tree.all("h1", "h2", "h3")]
    titles = tree.all("title")
    act = re.compile(rules.CALL_TO_ACT, re.IGNORECASE)
    return {
        "title": text(titles[0]) if titles else None, "meta": meta, "h1": next((h["text"] for h in heads if h["tag"] == "h1"), None), "headings": [h["text"] for h in heads], "heads": heads, "body": tree.body(),
        "json_ld": json_ld(tree),
        "forms": len(tree.all("form")), "inputs": len(tree.all("input", "select", "textarea")), "contact_inputs": sum(of[k].attrs.get("type", "").lower() in ("email", "tel") for k in tree.all("input")),
        "ctas": sum(bool(act.search(text(k))) for k in tree.all("a", "button")), "paragraphs": len(tree.all("p")), "links": links,
    }


def read_html(html: Column, selector: str | None = None) -> Column:
    """S3, H1, H2, H6, H10 from one walk over each page. selector: where a page's content is to be looked for first."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return parsed(batches, selector)

    return F.pandas_udf(read, PARSED)(html)


def read_json_ld(html: Column) -> Column:
    """S4 alone: read_html's json_ld, where nothing else of the pages is asked for."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: json_ld(Tree(x)))

    return F.pandas_udf(read, "array<string>")(html)


def parsed(batches: Iterator[pd.Series], selector: str | None = None) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows, size = [], 0
        for x in s:
            rows.append(parse(x, selector))
            size += len(x or "")
            if size >= PARSED_CHARS:
                yield pd.DataFrame({c: [r[c] for r in rows] for c in _FIELDS})
                rows, size = [], 0
        if rows:
            yield pd.DataFrame({c: [r[c] for r in rows] for c in _FIELDS})


_FIELDS = ("title", "meta", "h1", "headings", "heads", "body", "json_ld", "forms", "inputs", "contact_inputs", "ctas", "paragraphs", "links")


def _meta(page: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.element_at(page["meta"], n), F.lit("")) for n in names])


def source_title(html: Column) -> Column:
    """The first plain title element as a page's source has it: white space collapsed, and of entities only &lt;, &gt; and &amp;
    resolved, each with its semicolon; empty without one. The parsed page's title resolves all entities, as a browser does."""
    said = F.trim(F.regexp_replace(F.regexp_extract(html, "<title>([^<]*)</title>", 1), r"[\t\n\f\r ]+", " "))
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        said = F.replace(said, F.lit(entity), F.lit(mark))
    return said


def page_meta(pages: DataFrame, html: str = "html") -> DataFrame:
    """H6: site_title, site_name, description, tagline put in, and the parsed page as `page`."""
    out = pages.withColumn("page", read_html(F.col(html)))
    p = F.col("page")
    return out.withColumns({
        "site_title": T.truncate(p["title"], 200), "site_name": T.truncate(_meta(p, "og:site_name", "application-name"), 120),
        "description": T.truncate(_meta(p, "description", "og:description", "twitter:description"), 500), "tagline": F.when(F.length(p["h1"]).between(1, 140), p["h1"]),
    })


def links(pages: DataFrame) -> DataFrame:
    """H2: (page_url, pos, url, domain, text, points, ...): the links in the content of parsed pages off their own site, scored."""
    inside = F.filter("page.links", lambda l: l["in_content"])  # noqa: E741
    each = pages.select(F.col("url").alias("page_url"), F.explode(inside).alias("l")).select("page_url", "l.*")
    each = each.withColumn("url", U.normalise_url(F.col("href"), F.col("page_url"))).filter("url is not null").withColumn("domain", U.registrable_domain(F.col("url")))
    each = each.filter(F.col("domain").isNotNull() & ~U.same_site(F.col("url"), F.col("page_url")) & ~U.denied_domain(F.col("domain")) & ~U.denied_path(F.col("url")))
    points = (
        T.anchor_quality(F.col("text")) + F.when(F.col("in_heading"), 12).when(F.col("after_heading"), 3).otherwise(0) + F.when(F.col("in_item"), 2).otherwise(0) + F.when(F.col("has_image"), 2).otherwise(0)
        - F.when(F.col("in_chrome"), 10).otherwise(0) + F.when(F.col("rel").rlike("(?i)sponsored|affiliate|advertisement"), 1).otherwise(0)
    )
    return each.withColumn("points", points)


def discover(found: DataFrame, most: int = 25) -> DataFrame:
    """Candidates of each page: domain, url, name, mentions, score, place."""
    keys = ["page_url", "domain"]
    n = found.groupBy(*keys, "url").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    depth = F.size(F.filter(F.split(U.path_of(F.col("url")), "/"), lambda x: x != ""))
    best = n.groupBy(*keys).agg(F.min(F.struct(depth.alias("depth"), (-F.col("n")).alias("neg"), "first", "url")).alias("u"))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    stem = plain(F.split("domain", r"\.")[0])
    good = (F.col("text") != "") & ~F.col("text").rlike(f"(?i){rules.GENERIC_ANCHORS}") & (F.length("text") <= 80)
    # A heading names the brand up to a dash, bar or colon, without its number.
    cut = F.split(F.regexp_replace("heading", r"^\s*\d+[.)]\s*", ""), "[—–|:]")[0]
    told = (F.length(stem) >= 4) & F.contains(plain(F.col("heading")), stem) & (F.length(T.collapse(cut)) >= 2)
    said = good & (F.length(stem) >= 4) & F.contains(plain(F.col("text")), stem)
    g = found.groupBy(*keys).agg(
        F.count("*").alias("mentions"), F.sum("points").alias("points"), F.min(F.when(told, F.struct("pos", cut.alias("t")))).alias("by_heading"), F.min(F.when(said, F.struct("pos", F.col("text").alias("t")))).alias("by_anchor"),
        F.min(F.when(good, F.struct(F.length("text").alias("n"), "pos", F.col("text").alias("t")))).alias("shortest"), F.array_sort(F.collect_list(F.when(good, F.struct("pos", "text")))).alias("texts"),
    )
    out = g.join(best, keys).withColumn("score", S.discovery_score(F.col("points"), F.col("mentions"))).filter("score is not null")
    place = F.row_number().over(Window.partitionBy("page_url").orderBy(F.desc("score"), "domain"))
    short = F.when((F.length("shortest.t") >= 2) & (T.word_count(F.col("shortest.t")) <= 5), F.col("shortest.t"))
    name = F.coalesce(T.truncate(F.coalesce("by_heading.t", "by_anchor.t", short), 60), U.brand_name(F.col("domain")))
    anchors = F.slice(F.array_distinct(F.transform("texts", lambda x: x["text"])), 1, 8)
    return out.select("page_url", "domain", F.col("u.url").alias("url"), name.alias("name"), "mentions", "score", anchors.alias("anchors"), place.alias("place")).filter(F.col("place") <= most)


def dedupe_candidates(candidates: DataFrame, most: int) -> DataFrame:
    """Over all pages: each domain's best, the first on a tie; the best `most` of all. candidates: domain, score,
    source_pos."""
    first = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "source_pos"))
    return candidates.withColumn("n", first).filter("n = 1").drop("n").orderBy(F.desc("score"), "domain").limit(most)


def platform(html: Column) -> Column:
    """H7: the shop system a page shows itself to run on, first rule first."""
    return F.coalesce(*[F.when(html.rlike(T.js_regex(p, "i")), F.lit(n)) for n, p in rules.table(rules.PLATFORMS)], F.lit("unknown"))


def socials(page: Column) -> Column:
    """H8: map of network -> first profile link, the part of it that the network's pattern matches."""

    def first(pattern: str) -> Column:
        found = F.filter(F.transform(page["links"], lambda l: F.regexp_extract(l["href"], f"(?i){pattern}", 0)), lambda x: x != "")  # noqa: E741
        return F.transform(F.slice(found, 1, 1), lambda x: F.when(x.startswith("http"), x).otherwise(F.concat(F.lit("https://"), x)))

    found = [F.struct(F.lit(n).alias("key"), F.get(first(p), 0).alias("value")) for n, p in rules.table(rules.SOCIALS)]
    return F.map_from_entries(F.filter(F.array(*found), lambda x: x["value"].isNotNull()))


def product_links(pages: DataFrame, most: int = 20) -> DataFrame:
    """(url, name, product_url): links shaped like a product's page, once a name: the link's title, else its text, else
    its image's."""
    blank = F.lit("")
    l = pages.select("url", F.posexplode("page.links").alias("n", "l")).select("url", "n", F.col("l.href").alias("href"), F.coalesce(F.nullif("l.title", blank), F.nullif("l.text", blank), F.col("l.alt")).alias("name"))  # noqa: E741
    l = l.filter(F.col("href").rlike(T.js_regex(rules.PRODUCT_URL, "i")) & T.product_name(F.col("name"))).withColumn("to", U.normalise_url(F.col("href"), F.col("url"))).filter("to is not null")  # noqa: E741
    once = l.withColumn("k", F.lower("name")).groupBy("url", "k").agg(F.min(F.struct("n", "name", "to")).alias("x"))
    place = F.row_number().over(Window.partitionBy("url").orderBy("x.n"))
    return once.withColumn("place", place).filter(F.col("place") <= most).select("url", T.truncate(F.col("x.name"), 90).alias("name"), F.col("x.to").alias("product_url"), "place")


def internal_pages(pages: DataFrame, most: int = 5) -> DataFrame:
    """a site's own pages that say what it sells and why: the first `most` addresses of the first three times as many
    links of that kind on the page's own host."""
    each = pages.select("url", F.explode("page.links").alias("l")).filter(F.col("l.href").rlike(f"(?i){rules.INTERNAL_PAGES}"))
    each = each.select("url", "l.pos", U.normalise_url(F.col("l.href"), F.col("url")).alias("to"))
    host = lambda c: F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#:]+)", 1))
    own = each.filter(host("to") == host("url"))
    early = own.withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter(F.col("nth") <= 3 * most)
    first = early.groupBy("url", "to").agg(F.min("pos").alias("pos"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter(F.col("place") <= most)


def ld_rows(pages: DataFrame) -> DataFrame:
    """(url, pos, types array<string>, node) of the JSON-LD nodes."""
    n = pages.select("url", F.posexplode("page.json_ld").alias("pos", "node"))
    kind = F.get_json_object("node", "$.@type")
    return n.withColumn("types", F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array_compact(F.array(kind))))


def organisations(nodes: DataFrame) -> DataFrame:
    """(url, name, description) of the first organisation-like node that has either."""
    kinds = F.array(*[F.lit(k) for k in ("Organization", "OnlineStore", "Store", "Brand", "Corporation", "LocalBusiness")])
    own = nodes.filter(F.arrays_overlap("types", kinds)).select("url", "pos", T.collapse(F.get_json_object("node", "$.name")).alias("name"), T.collapse(F.get_json_object("node", "$.description")).alias("description")).filter("name is not null or description is not null")
    return own.groupBy("url").agg(F.min(F.struct("pos", "name", "description")).alias("x")).select("url", "x.name", "x.description")


def ld_products(nodes: DataFrame) -> DataFrame:
    """(url, pos, name, price, currency, description)."""
    offer = F.coalesce(F.get_json_object("node", "$.offers[0]"), F.get_json_object("node", "$.offers"))
    price = F.coalesce(F.get_json_object(offer, "$.price"), F.get_json_object(offer, "$.lowPrice"))
    p = nodes.filter(F.array_contains("types", "Product"))
    return p.select("url", "pos", T.collapse(F.get_json_object("node", "$.name")).alias("name"), F.replace(price, F.lit(","), F.lit("")).try_cast("double").alias("price"), F.get_json_object(offer, "$.priceCurrency").alias("currency"), T.truncate(F.get_json_object("node", "$.description"), 300).alias("description")).filter(T.product_name(F.col("name")))


def shop_products(feeds: DataFrame, most: int = 20) -> DataFrame:
    """(url, place, name, price, product_url, description) of a products.json feed (url, body)."""
    kind = "products array<struct<title:string,handle:string,body_html:string,tags:string,variants:array<struct<price:string>>>>"
    each = feeds.select("url", F.posexplode(F.slice(F.from_json("body", f"struct<{kind.replace(' array', ':array')}>")["products"], 1, 3 * most)).alias("pos", "p"))
    named = each.select("url", "pos", T.collapse(F.col("p.title")).alias("name"), F.col("p.variants")[0]["price"].try_cast("double").alias("price"), F.concat(F.regexp_extract("url", r"^(https?://[^/]+)", 1), F.lit("/products/"), F.col("p.handle")).alias("product_url"), T.truncate(F.regexp_replace("p.body_html", "<[^>]*>", " "), 300).alias("description")).filter(T.product_name(F.col("name")))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter(F.col("place") <= most).drop("pos")


def product_file(body: Column) -> Column:
    """A product's own JSON file: title, price and compare-at price in units, discount, availability, variants."""
    price, before = F.get_json_object(body, "$.price").try_cast("double") / 100, F.get_json_object(body, "$.compare_at_price").try_cast("double") / 100
    off = F.when(before > price, S.js_round((1 - price / before) * 100))
    return F.struct(F.get_json_object(body, "$.title").alias("title"), price.alias("price"), before.alias("compare_at"), off.alias("discount"), F.get_json_object(body, "$.available").try_cast("boolean").alias("available"), F.size(F.from_json(F.get_json_object(body, "$.variants"), "array<string>")).alias("variants"))


def cart_currency(body: Column) -> Column:
    """S10."""
    return F.get_json_object(body, "$.currency")


def robots_sitemaps(body: Column) -> Column:
    """S6."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)))


def sitemap_locs(xml: Column) -> Column:
    """S7."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def is_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def crawl(documents: DataFrame, sites: DataFrame, most_maps: int = 12, most_urls: int | None = 2000) -> DataFrame:
    """(site, pos, url): the addresses a site publishes, breadth first over its sitemaps as documents (url,
    body, and status if known) hold them, within its own domain; the caps are the first in order of the walk (most_urls=None: all).

    Each round writes its frontier and what it found, so a round reads the files of those before it and nothing is worked
    out twice; the rounds end when no site has a new index, at the latest after most_maps, as none reads more maps."""
    documents = documents.filter("status < 400") if "status" in documents.columns else documents
    base = F.regexp_extract("site", r"^(https?://[^/]+)", 1)
    robots = documents.join(shuffled(sites.select("site", F.concat(base, F.lit("/robots.txt")).alias("url"))), "url").select("site", robots_sitemaps(F.col("body")).alias("told"))
    usual = F.array(F.concat(base, F.lit("/sitemap.xml")), F.concat(base, F.lit("/sitemap_index.xml")))
    start = sites.join(robots, "site", "left").select("site", F.posexplode(F.array_distinct(F.concat(F.coalesce("told", F.array().cast("array<string>")), usual))).alias("p", "url"))
    frontier = written(start.select("site", F.array(F.col("p")).alias("path"), "url"), "crawl-frontier")
    seen, found = frontier.select("site", "url").limit(0), None
    for _ in range(most_maps):
        fresh = frontier.groupBy("site", "url").agg(F.min("path").alias("path"))
        read = fresh.join(shuffled(documents), "url").filter(F.contains("body", F.lit("<loc")))
        # A body is judged once, before its addresses become rows.
        read = read.select("site", F.col("url").alias("map"), "path", is_index(F.col("body")).alias("index"), sitemap_locs(F.col("body")).alias("locs"))
        inner = read.select("site", "map", "path", "index", F.posexplode("locs").alias("p", "url")).withColumn("path", F.concat("path", F.array("p")))
        inner = written(inner.filter(U.same_site(F.col("url"), F.col("site"))), "crawl-found")
        found = inner if found is None else found.union(inner)
        seen = seen.union(fresh.select("site", "url"))
        frontier = written(inner.filter("index").select("site", "path", "url").join(seen, ["site", "url"], "left_anti"), "crawl-frontier")
        if frontier.isEmpty():
            break
    maps = found.groupBy("site", "map").agg(F.min("path").alias("m")).withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy(F.size("m"), "m"))).filter(F.col("nth") <= most_maps)
    clean = found.filter("not index").join(maps.select("site", "map"), ["site", "map"]).withColumn("url", U.normalise_url(F.col("url"))).filter("url is not null").groupBy("site", "url").agg(F.min("path").alias("path"))
    placed = clean.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy(F.size("path"), "path"))).select("site", "pos", "url")
    return placed if most_urls is None else placed.filter(F.col("pos") <= most_urls)


def kind_counts(published: DataFrame, keys: list[str], samples: int = 5) -> DataFrame:
    """Kinds of published pages with counts, shares and the first few. The counts come from one aggregate; the samples
    from a group limit, which every task applies before anything is shuffled."""
    k = published.withColumn("kind", U.page_kind(F.col("url")))
    g = k.groupBy(*keys, "kind").agg(F.count("*").alias("count"))
    g = g.withColumn("share", S.share(F.col("count"), F.sum("count").over(Window.partitionBy(*(keys or [F.lit(1)])))))
    early = k.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("pos"))).filter(F.col("n") <= samples)
    first = early.groupBy(*keys, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: x["url"]).alias("samples"))
    return g.join(first, [*keys, "kind"])


def unadvertised(published: DataFrame, advertised: DataFrame, keys: list[str], examples: int = 5) -> DataFrame:
    """Published articles, landing pages, quizzes and products that no ad leads to, by kind, with the first few. Hosts
    are compared without www on both sides; published has a pos if their order matters."""
    key = F.regexp_replace("url", r"^(https?://)www\.", "$1")
    left = published.withColumn("u", key).join(advertised.withColumn("u", key).select(*keys, "u").distinct(), [*keys, "u"], "left_anti")
    left = left.withColumn("kind", U.page_kind(F.col("url"))).filter(F.col("kind").isin("article", "landing", "quiz", "product"))
    order = "pos" if "pos" in published.columns else "url"
    counts = left.groupBy(*keys, "kind").agg(F.count("*").alias("count"))
    early = left.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(order))).filter(F.col("n") <= examples)
    first = early.groupBy(*keys, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: x["url"]).alias("examples"))
    return counts.join(first, [*keys, "kind"])


def unlisted(published: DataFrame, advertised: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Destinations of ads on a brand's own domain that its site does not publish, the first `most` of each: by pos where
    advertised has one, else by address. A brand without a published page has none, as nothing is known of its site."""
    key = F.regexp_replace("url", r"^(https?://)www\.", "$1")
    own = published.select(*keys, U.registrable_domain(F.col("url")).alias("domain")).filter("domain is not null").distinct()
    order = F.col("pos") if "pos" in advertised.columns else F.col("url")
    asked = advertised.withColumn("u", key).withColumn("domain", U.registrable_domain(F.col("url"))).groupBy(*keys, "url", "u", "domain").agg(F.min(order).alias("at"))
    left = asked.join(own, [*keys, "domain"], "left_semi").join(published.withColumn("u", key).select(*keys, "u"), [*keys, "u"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "url"))
    return left.withColumn("place", place).filter(F.col("place") <= most).select(*keys, "url")


def tools(html: Column) -> Column:
    """array<struct<name, category>> of the tools whose mark a page holds."""
    return F.array_compact(F.array(*[F.when(html.rlike(f"(?i){p}"), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"))) for n, c, p in rules.table(rules.TOOLS)]))


def tech_stack(found: Column) -> Column:
    """Struct of the flags and the score that a list of tools gives."""
    cats = F.array_distinct(F.transform(found, lambda x: x["category"]))
    names = F.transform(found, lambda x: x["name"])
    points = sum((F.when(F.array_contains(cats, c), w).otherwise(0) for c, w in rules.TOOL_POINTS.items()), F.lit(0))
    return F.struct(
        names.alias("all"), F.array_contains(cats, "adPixel").alias("paid_media"), (F.array_contains(cats, "email") | F.array_contains(cats, "sms")).alias("lifecycle"), F.array_contains(cats, "subscription").alias("subscription"),
        F.array_contains(cats, "reviews").alias("reviews"), F.arrays_overlap(names, F.array(*[F.lit(x) for x in ("Klarna", "Afterpay", "Affirm", "Sezzle")])).alias("bnpl"), F.least(F.lit(100), points).alias("score"),
    )


def commerce(text: Column, products: Column | None = None) -> Column:
    """What a shop's own words say: subscription, free shipping and its threshold, guarantee days, the loudest
    discount, review count, rating, press and certifications named, founding year; and of its products (an array of
    structs with price and currency) their number, price range and median."""
    low = T.normalise(text)

    def loudest(pattern: str, least: float, below: float) -> Column:
        each = F.transform(F.regexp_extract_all(text, F.lit(T.js_regex(pattern, "i")), F.lit(1)), T.parse_count)
        return F.array_max(F.filter(each, lambda n: (n > least) & (n < below)))

    def named(names: tuple[str, ...], low_case: bool) -> Column:
        own = F.lower(text) if low_case else text
        return F.slice(F.array_compact(F.array(*[F.when(F.contains(own, F.lit(n.lower() if low_case else n)), F.lit(n)) for n in names])), 1, 10)

    rating = T.first_number(text, T.js_regex(rules.RATING, "i"))
    told = [
        text.isNotNull() & low.rlike(T.js_regex(rules.SUBSCRIPTION)), low.rlike(T.js_regex(rules.FREE_SHIPPING)), T.first_number(low, T.js_regex(rules.SHIPPING_OVER, "i")), T.first_number(low, T.js_regex(rules.GUARANTEE, "i")),
        loudest(rules.DISCOUNT, 0, 100), loudest(rules.REVIEWS, 0, float("inf")), F.when(rating.between(1, 5), rating), named(rules.PRESS, False), named(rules.CERTIFICATIONS, True), T.first_number(text, T.js_regex(rules.FOUNDED, "i")),
    ]
    names = ["subscription", "free_shipping", "free_shipping_over", "guarantee_days", "max_discount", "review_count", "rating", "press", "certifications", "founded"]
    none = F.lit(None).cast("double")
    if products is None:
        more = [F.lit(0).alias("product_count"), *[none.alias(n) for n in ("price_min", "price_median", "price_max")], F.lit(None).cast("string").alias("currency")]
    else:
        prices = F.array_sort(F.filter(F.transform(products, lambda p: p["price"]), lambda x: x > 0))
        n = F.size(prices)
        half = F.floor(n / 2).cast("int")
        middle = F.when(n % 2 == 1, F.get(prices, half)).otherwise((F.get(prices, half - 1) + F.get(prices, half)) / 2)
        first = F.get(F.filter(F.transform(products, lambda p: p["currency"]), lambda c: c.isNotNull() & (c != "")), 0)
        more = [F.coalesce(F.size(products), F.lit(0)).alias("product_count"), F.array_min(prices).alias("price_min"), F.when(n > 0, S.js_round(middle, 2)).alias("price_median"), F.array_max(prices).alias("price_max"), F.when(n > 0, first).alias("currency")]
    return F.struct(*[x.alias(k) for x, k in zip(told, names, strict=True)], *more)


def grouped(n: Column) -> Column:
    """A whole number with commas between its thousands."""
    return F.format_number(n, 0)


def plain(n: Column) -> Column:
    """A number without a fraction of zero."""
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def commerce_summary(c: Column) -> Column:
    """One line of what is known, 240 characters at most."""
    line = F.concat_ws(
        " · ", F.when(c["price_median"].isNotNull(), F.concat(F.lit("median "), F.concat_ws(" ", plain(c["price_median"]), c["currency"]))), F.when(c["product_count"] > 0, F.concat(c["product_count"].cast("string"), F.lit(" products"))), F.when(c["subscription"], F.lit("subscription")),
        F.concat(plain(c["guarantee_days"]), F.lit("-day guarantee")), F.concat(F.lit("up to "), plain(c["max_discount"]), F.lit("% off")), F.concat(grouped(c["review_count"]), F.lit(" reviews")), F.concat(plain(c["rating"]), F.lit("/5")),
    )
    return F.when(line == "", "no commercial signals found").otherwise(T.truncate(line, 240))


def dedupe_products(products: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """Products once a name, whatever its case and marks, in order of first sight. A later record speaks over the earlier
    ones where it is the first with a description, or the first with a price; what it does not say stays. So three records
    of a name count at most, and each field is that of the last of them that has it."""
    name = T.collapse(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    fields = ("name", "price", "currency", "description")
    row = F.struct("pos", *fields)
    told = products.withColumn("price", F.when(F.col("price") > 0, F.col("price"))).withColumn("k", name).filter("k != ''")
    g = told.groupBy(*keys, "k").agg(F.min(row).alias("one"), F.min(F.when(F.col("description") != "", row)).alias("two"), F.min(F.when(F.col("price").isNotNull(), row)).alias("three"))
    late = F.sort_array(F.array_compact(F.array("one", "two", "three")), asc=False)
    out = g.select(*keys, F.col("one.pos").alias("pos"), *[F.get(F.array_compact(late[c]), 0).alias(c) for c in fields])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return out.withColumn("place", place).filter(F.col("place") <= most)


def price_range(products: DataFrame, keys: list[str]) -> DataFrame:
    """Over products with a price above zero; the currency is that of the first of them that names one."""
    priced = products.filter("price > 0")
    return priced.groupBy(*keys).agg(F.min("price").alias("low"), S.js_round(F.percentile("price", F.lit(0.5)), 2).alias("median"), F.max("price").alias("high"), F.coalesce(F.min(F.when(F.col("currency").isNotNull(), F.struct("pos", "currency")))["currency"], F.lit("USD")).alias("currency"))


def overlap(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two sets as a whole percentage; 0 of two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, S.js_round(F.size(F.array_intersect(a, b)) / both * 100)).otherwise(0.0)


def page_shape(page: Column, words: Column) -> Column:
    """What kind of page an ad leads to."""
    text = page["body"]
    numbered = F.size(F.filter(page["heads"], lambda h: h["tag"].isin("h2", "h3") & h["text"].rlike(r"^\s*\d+[.)]")))
    prose = ((page["paragraphs"] >= 8) & (words >= 350)) | ((words >= 900) & (page["paragraphs"] >= 5))
    return (
        F.when(numbered >= 3, "listicle").when(text.rlike(r"[$£€]\s?\d") & text.rlike(T.js_regex(rules.CART_WORDS, "i")), "product-page").when(text.rlike(T.js_regex(rules.QUIZ_WORDS, "i")) & (page["inputs"] >= 2), "quiz")
        .when((page["inputs"] >= 3) & (words < 600), "lead-form").when(prose, "article").when(words > 0, "landing-page").otherwise("unknown")
    )


def match_note(shared: Column, lost_labels: Column, on_page: Column) -> Column:
    """How far a page keeps what its ads promise, in words; null without angles of ads."""
    two = F.array_join(F.slice(lost_labels, 1, 2), " and ")
    none = F.concat(F.lit("the page runs none of the angles its ads run — the ads promise "), two, F.lit(" and the page does not continue it"))
    some = F.concat(F.lit("carries "), F.size(shared).cast("string"), F.lit(" of the ads' angles but drops "), two)
    both = F.when(F.size(shared) == 0, none).when(F.size(lost_labels) > 0, some).otherwise("the page continues every angle its ads run")
    return F.when((F.size(shared) == 0) & (F.size(lost_labels) == 0), None).when(F.size(on_page) == 0, "no angle detected on the page, while its ads run several").otherwise(both)


def teardown(pages: DataFrame, advertised: DataFrame, most: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Landing pages read: title, h1, headings, calls to act, shape, commerce, angles, and how far they
    match the angles of the ads that lead there. pages: url, html, and status if known; advertised: url, exposure, angles
    array<string>, and the keys; `most` of each of these are read, those of the most exposure."""
    from adlens.operators import copy as X

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("exposure"), "url")) if keys else None
    top = advertised.withColumn("place_", place).filter(F.col("place_") <= most).drop("place_") if keys else advertised.orderBy(F.desc("exposure"), "url").limit(most)
    status = F.col("status") if "status" in pages.columns else F.lit(None).cast("int")
    read = top.join(shuffled(pages.select("url", "html", status.alias("status"))), "url", "left")
    bad = F.col("html").isNull() | F.coalesce(F.col("status") >= 400, F.lit(False))
    error = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(F.col("html").isNull(), "not fetched")
    read = read.withColumn("error", error).withColumn("page", read_html(F.when(~bad, F.col("html"))))
    text = T.truncate(F.col("page.body"), 40_000)
    blank = F.lit(None).cast("string")
    found = X.angles(X.copy_of(F.col("page.title"), T.truncate(F.col("page.body"), 8000), blank, blank))
    label = F.create_map(*[F.lit(x) for key, name, _ in rules.table(rules.ANGLES) for x in (key, name)])
    out = read.withColumns({"words": T.word_count(text), "page_angles": F.transform(found, lambda a: a["angle"]), "said": commerce(text), "angles": F.coalesce("angles", F.array().cast("array<string>"))})
    lost = F.array_except("angles", "page_angles")
    heads = F.array_distinct(F.filter(F.col("page.headings"), lambda h: (h != "") & (F.length(h) <= 160)))
    note = match_note(F.array_intersect("angles", "page_angles"), F.transform(lost, lambda a: F.coalesce(F.element_at(label, a), a)), F.col("page_angles"))
    match = F.when(F.size("angles") > 0, overlap(F.col("angles"), F.col("page_angles")))

    def ok(c: Column) -> Column:
        return F.when(F.col("error").isNull(), c)

    return out.select(
        *keys, "url", F.col("error").isNull().alias("ok"), F.col("status").alias("status_code"), "error", ok(T.truncate(F.col("page.title"), 200)).alias("title"), ok(T.truncate(F.col("page.h1"), 200)).alias("h1"), F.coalesce(ok(F.slice(heads, 1, 20)), F.array().cast("array<string>")).alias("headings"),
        F.coalesce(ok(F.col("page.ctas")), F.lit(0)).alias("ctas"), F.coalesce(ok((F.col("page.forms") > 0) | (F.col("page.contact_inputs") > 0)), F.lit(False)).alias("form"), F.coalesce(ok(F.col("words")), F.lit(0)).alias("words"), F.coalesce(ok(page_shape(F.col("page"), F.col("words"))), F.lit("unknown")).alias("shape"),
        ok(F.col("said")).alias("commerce"), ok(F.col("page_angles")).alias("page_angles"), ok(match).alias("match"), ok(note).alias("match_note"), ok(lost).alias("lost"), ok(F.array_except("page_angles", "angles")).alias("new"),
    )
