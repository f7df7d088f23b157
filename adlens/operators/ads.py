"""Ads: reading provider records, merging repeats, exposure, ranking.

An ad frame has ad_id, brand, pos (order of arrival) and the figures that exposure needs; see `score`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions import score as S
from adlens.functions import text as T

#: The names under which providers give a field, in order of preference.
KEYS = {
    "id": "id adArchiveID ad_archive_id adId archiveId adArchiveId",
    "body": "ad_creative_bodies adCreativeBodies body bodyText primaryText ad_creative_body text snapshot_body caption",
    "title": "ad_creative_link_titles adCreativeLinkTitles title headline linkTitle",
    "start": "ad_delivery_start_time adDeliveryStartTime startDate start_date startDateFormatted ad_creation_time",
    "end": "ad_delivery_stop_time adDeliveryStopTime endDate end_date endDateFormatted",
    "platforms": "publisher_platforms publisherPlatforms platforms",
    "countries": "ad_reached_countries reachedCountries countries country",
    "languages": "languages language",
    "page_name": "page_name pageName advertiser advertiserName pageInfo",
    "page_id": "page_id pageId",
    "snapshot_url": "ad_snapshot_url adSnapshotUrl snapshotUrl url adLibraryUrl",
    "link_description": "ad_creative_link_descriptions adCreativeLinkDescriptions linkDescription description",
    "cta_text": "ad_creative_link_captions adCreativeLinkCaptions ctaText cta_text callToAction",
    "cta_type": "cta_type ctaType call_to_action_type",
    "landing_url": "link_url linkUrl landingUrl destinationUrl caption_url",
    "active": "is_active isActive active",
    "flat_impressions": "impressionsCount totalImpressions",
    "reach": "eu_total_reach euTotalReach totalReach reach",
    "variants": "collation_count collationCount variantCount creativeCount totalActiveTime",
    "media": "mediaType media_type displayFormat display_format creativeType",
}


def parsed(record: Column) -> Column:
    """A record as VARIANT, parsed once; null where it is no JSON. What is read from it are typed paths."""
    return F.try_parse_json(record)


def _at(raw: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(raw, "$['" + key + "']", kind)


def _filled(s: Column) -> Column:
    return F.nullif(T.collapse(s), F.lit(""))


def _text_of(v: Column) -> Column:
    """The text of an object: its field `text`."""
    return _filled(F.try_variant_get(v, "$.text", "string"))


def pick_string(raw: Column, keys: str) -> Column:
    """The first key that holds a filled string, a list with one (or with objects that have a text), or an object
    with a text. raw: a VARIANT."""
    found = []
    for key in keys.split():
        items = _at(raw, key, "array<variant>")
        kind = F.schema_of_variant(_at(raw, key, "variant"))
        plain = F.filter(F.transform(items, lambda x: F.when(~F.schema_of_variant(x).rlike("^(ARRAY|OBJECT|VOID)"), _filled(F.try_variant_get(x, "$", "string")))), lambda x: x.isNotNull())
        texts = F.filter(F.transform(items, _text_of), lambda x: x.isNotNull())
        listed, simple = F.coalesce(F.get(plain, 0), F.get(texts, 0)), _filled(_at(raw, key))
        found.append(F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), _text_of(_at(raw, key, "variant"))).otherwise(simple))
    return F.coalesce(*found)


def pick_number(raw: Column, keys: str) -> Column:
    """The first key that holds a number, commas and spaces dropped."""
    return F.coalesce(*[F.regexp_replace(_at(raw, key), r"[,\s]", "").try_cast("double") for key in keys.split()])


def pick_strings(raw: Column, keys: str) -> Column:
    """The first key that holds strings; a single one becomes a list; else an empty list."""
    found = []
    for key in keys.split():
        items = _at(raw, key, "array<string>")
        one = F.trim(_at(raw, key))
        found.append(F.when(F.size(items) > 0, items).when(F.schema_of_variant(_at(raw, key, "variant")).rlike("^(ARRAY|OBJECT)"), None).when(one != "", F.array(one)))
    return F.coalesce(*found, F.array().cast("array<string>"))


def is_ad(raw: Column) -> Column:
    """whether a record names an id, a body or a title."""
    return F.coalesce(*[pick_string(raw, KEYS[k]) for k in ("id", "body", "title")]).isNotNull()


def bounds(raw: Column, key: str) -> tuple[Column, Column]:
    """The lower and upper figure of a range object."""
    v = _at(raw, key, "variant")
    return pick_number(v, "lower_bound lowerBound min"), pick_number(v, "upper_bound upperBound max")


def media_type(raw: Column, record: Column) -> Column:
    """What the record says, else what its JSON text mentions."""
    told = F.lower(pick_string(raw, KEYS["media"]))
    text = F.lower(F.substring(F.regexp_replace(record, r"\s*([:,])\s*", "$1"), 1, 20_000))
    named = F.when(told.contains("video"), "video").when(told.contains("carousel") | told.contains("multi"), "carousel").when(told.contains("dco") | told.contains("dynamic"), "dco").when(told.contains("image") | told.contains("photo"), "image")
    guess = F.when(text.contains("video_hd_url") | text.contains('"video"'), "video").when(text.contains("carousel"), "carousel").when(text.contains("original_image_url") | text.contains('"image"'), "image").otherwise("unknown")
    return F.coalesce(named, guess)


def read_records(raw: DataFrame, as_of: Column, record: str = "record") -> DataFrame:
    """Provider records (record: JSON string, provider, matched_query, pos) -> ads; records without an id, a
    body or a title are dropped. Each record is parsed once; neither it nor its text is carried on."""
    text, r = F.col(record), F.col("parsed_record")
    raw = raw.withColumn("parsed_record", parsed(text))
    low, high = bounds(r, "impressions")
    spend_low, spend_high = bounds(r, "spend")
    body, title = F.coalesce(pick_string(r, KEYS["body"]), F.lit("")), pick_string(r, KEYS["title"])
    picked = raw.select(
        "provider", "matched_query", "pos", pick_string(r, KEYS["id"]).alias("id"), body.alias("body"), title.alias("title"),
        pick_string(r, KEYS["start"]).alias("start_date"), pick_string(r, KEYS["end"]).alias("end_date"),
        *[pick_strings(r, KEYS[k]).alias(k) for k in ("platforms", "countries", "languages")],
        *[pick_string(r, KEYS[k]).alias(k) for k in ("page_name", "page_id", "snapshot_url", "cta_type", "landing_url")],
        T.truncate(pick_string(r, KEYS["link_description"]), 1000).alias("link_description"), T.truncate(pick_string(r, KEYS["cta_text"]), 200).alias("cta_text"),
        F.coalesce(*[_at(r, k).try_cast("boolean") for k in KEYS["active"].split()]).alias("told_active"),
        F.coalesce(low, pick_number(r, KEYS["flat_impressions"])).alias("impressions_min"), high.alias("impressions_max"), spend_low.alias("spend_min"), spend_high.alias("spend_max"),
        pick_string(r, "currency").alias("currency"), pick_number(r, KEYS["reach"]).alias("reach"), F.nullif(F.greatest(pick_number(r, KEYS["variants"]), F.lit(0.0)), F.lit(0.0)).alias("variants"),
        media_type(r, text).alias("media_type"),
    )
    start, end = F.col("start_date").try_cast("timestamp"), F.col("end_date").try_cast("timestamp")
    made = F.concat(F.col("provider"), F.lit(":"), F.substring(F.translate(F.base64(F.encode(F.concat("body", F.coalesce("title", F.lit(""))), "UTF-8")), "+/=\r\n", "-_"), 1, 24))
    return (
        picked.filter("id is not null or body != '' or title is not null")
        .withColumns({
            "ad_id": F.coalesce("id", made), "body": T.truncate(F.col("body"), 8000), "title": T.truncate(F.col("title"), 500),
            "active": F.coalesce("told_active", F.when(F.col("end_date").isNotNull(), end > as_of).when(F.col("start_date").isNotNull(), True)),
            "days": S.days_between(start, F.when(F.col("end_date").isNull(), as_of).otherwise(end)),
        })
        .drop("id", "told_active")
    )


def dedupe(ads: DataFrame) -> DataFrame:
    """One ad for each ad_id. The first arrival wins; a missing reach, or missing impressions as a pair, come
    from the first later one that has them; the queries that matched are joined, without those already named."""
    order = F.struct("pos", F.struct(*[c for c in ads.columns if c != "pos"]).alias("row"))
    queries = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("matched_query").alias("q")))), lambda x: x["q"])
    joined = F.aggregate(queries, F.lit("").cast("string"), lambda a, q: F.when((q.isNull()) | (q == "") | F.contains(a, q), a).when(a == "", q).otherwise(F.concat(a, F.lit("; "), q)))
    grouped = ads.groupBy("ad_id").agg(
        F.min(order).alias("first"),
        F.min(F.when(F.col("reach").isNotNull(), F.struct("pos", "reach"))).alias("reach"),
        F.min(F.when(F.col("impressions_min").isNotNull(), F.struct("pos", "impressions_min", "impressions_max"))).alias("imp"),
        joined.alias("queries"),
    )
    filled = {"reach": F.col("reach.reach"), "impressions_min": F.col("imp.impressions_min"), "impressions_max": F.when(F.col("first.row.impressions_min").isNotNull(), F.col("first.row.impressions_max")).otherwise(F.col("imp.impressions_max")), "matched_query": F.col("queries")}
    return grouped.select(*[(filled.get(c, F.col("first.pos") if c == "pos" else F.col(f"first.row.{c}"))).alias(c) for c in ads.columns])


def score(ads: DataFrame, rank_by: str = "composite") -> DataFrame:
    """Ads with exposure put in; absent columns count as unknown."""
    def at(name: str, kind: str = "double") -> Column:
        return F.col(name).cast(kind) if name in ads.columns else F.lit(None).cast(kind)

    return ads.withColumn("exposure", S.exposure(S.midpoint(at("impressions_min"), at("impressions_max")), at("reach"), S.midpoint(at("spend_min"), at("spend_max")), at("days"), at("variants"), at("active", "boolean"), rank_by))


def rank(scored: DataFrame, per_brand: int | None = None, floor: float = 0.0) -> DataFrame:
    """Rank within brand by exposure, then arrival; the floor is applied before the cut to per_brand."""
    place = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("exposure"), "pos"))
    kept = scored.filter(F.col("exposure") >= floor) if floor > 0 else scored
    ranked = kept.withColumn("rank", place)
    return ranked.filter(F.col("rank") <= per_brand) if per_brand else ranked


def search_terms(brands: DataFrame, products: DataFrame, strategy: str = "brand+products", most: int = 5) -> DataFrame:
    """(brand, pos, term): the brand's name, then its useful products' names, generic ones behind the brand's."""
    name = T.collapse(F.col("brand_name"))
    own = brands.select("brand", F.lit(0).alias("pos"), name.alias("term")).filter("term != ''")
    p = products.join(brands.select("brand", name.alias("brand_name")), "brand").withColumn("product", T.collapse(F.col("product")))
    p = p.filter(T.useful_query(F.col("product"), F.col("brand_name"))).withColumn("n", F.row_number().over(Window.partitionBy("brand").orderBy("pos"))).filter(F.col("n") <= most)
    generic = (T.word_count(F.col("product")) <= 3) & ~F.contains(F.lower("product"), F.lower("brand_name")) & (F.col("brand_name") != "")
    extra = p.select("brand", F.col("n").alias("pos"), F.when(generic, F.concat_ws(" ", "brand_name", "product")).otherwise(F.col("product")).alias("term"))
    terms = {"brand": own, "products": extra}.get(strategy, own.union(extra))
    return terms.groupBy("brand", "term").agg(F.min("pos").alias("pos")).select("brand", "pos", "term")


def attribute_term(ads: DataFrame, terms: DataFrame) -> DataFrame:
    """Each ad with the longest of its brand's terms that its copy holds, else the first term."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("page_name", F.lit("")), F.coalesce("title", F.lit("")), "body"))
    own = terms.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("terms"))
    hits = F.filter("terms", lambda t: (F.trim(t["term"]) != "") & F.contains(hay, F.lower(F.trim(t["term"]))))
    best = F.array_min(F.transform(hits, lambda t: F.struct((-F.length(F.trim(t["term"]))).alias("n"), t["pos"].alias("pos"), t["term"].alias("term"))))
    return ads.join(own, "brand", "left").withColumn("term", F.coalesce(best["term"], F.get("terms", 0)["term"])).drop("terms")


def library_url(term: Column, country: Column, status: Column) -> Column:
    """The address of an ad-library search."""
    return F.concat(F.lit("https://www.facebook.com/ads/library/?active_status="), F.lower(status), F.lit("&ad_type=all&country="), country, F.lit("&q="), F.url_encode(term), F.lit("&search_type=keyword_unordered&media_type=all"))


def requests(terms: DataFrame, countries: list[str], status: str = "ALL") -> DataFrame:
    """One row for each term and country, with the address to fetch."""
    each = terms.withColumn("country", F.explode(F.array(*[F.lit(c) for c in countries])))
    return each.withColumn("url", library_url(F.col("term"), F.col("country"), F.lit(status)))
