"""Ad queries over the order tables: a brand is a customer, a niche a market segment, an ad an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.catalogue import query
from adlens.functions import score as S
from adlens.operators import ads as A
from adlens.operators import rollup as R

AS_OF = "2001-08-02"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ads(spark: SparkSession, d: str) -> DataFrame:
    line = t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("variants"), F.max("l_shipdate").alias("end"), F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.max("l_extendedprice").alias("spend_max")
    )
    own = t(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return own.select(
        F.col("o_orderkey").alias("ad_id"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("brand"), F.col("c_name").alias("brand_name"), F.col("c_mktsegment").alias("niche"), F.col("c_nationkey").alias("sub_niche"),
        F.col("o_orderpriority").alias("angle"), F.col("o_orderstatus").alias("format"), F.col("o_orderdate").alias("start"), "end", (F.col("o_orderstatus") == "O").alias("active"), F.col("o_totalprice").alias("reach"),
        (F.col("q0") * 1000).alias("impressions_min"), (F.col("q1") * 1000).alias("impressions_max"), "spend_max", "variants", S.days_between(F.col("o_orderdate"), F.col("end")).alias("days"),
    )


_LOG = "CASE WHEN {v} IS NOT NULL THEN least(1.0, log10(1 + {v}) / log10(1 + {c}.0::DOUBLE)) END"
ADS = f"""
line AS (SELECT l_orderkey, count(*) AS variants, max(l_shipdate) AS "end", min(l_quantity) AS q0, max(l_quantity) AS q1, max(l_extendedprice) AS spend FROM lineitem GROUP BY 1),
ads AS (SELECT o_orderkey AS ad_id, o_custkey AS brand, c_name AS brand_name, c_mktsegment AS niche, c_nationkey AS sub_niche, o_orderpriority AS angle, o_orderstatus AS format, o_orderdate AS start, "end",
  o_orderstatus = 'O' AS active, o_totalprice AS reach, (q0 * 1000 + q1 * 1000) / 2 AS imp, spend, variants,
  CASE WHEN "end" IS NOT NULL THEN CAST(greatest(0, floor((epoch_ms("end") - epoch_ms(o_orderdate)) / 86400000.0 + 0.5)) AS BIGINT) END AS days
  FROM orders LEFT JOIN line ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
parts AS (SELECT *, {_LOG.format(v="imp", c=10000000)} AS si, {_LOG.format(v="reach", c=5000000)} AS sr, {_LOG.format(v="spend", c=500000)} AS ss, CASE WHEN days IS NOT NULL THEN least(1.0, days / 180.0) END AS sl, {_LOG.format(v="variants", c=50)} AS sv FROM ads),
rated AS (SELECT *, CASE WHEN active THEN least(100, raw * 1.05) ELSE raw END AS up FROM (SELECT *,
  CASE WHEN imp IS NULL THEN (sr * 0.3) / 0.3 * 100 ELSE (si * 0.35 + sr * 0.3 + ss * 0.1 + sl * 0.2 + sv * 0.1) / (0.35 + 0.3 + 0.1 + 0.2 + 0.1) * 100 END AS raw FROM parts)),
scored AS (SELECT *, floor(greatest(0, least(100, up)) * 10 + 0.5) / 10 AS exposure FROM rated)
"""


@query("exposure_composite", f"WITH {ADS} SELECT ad_id, days, exposure FROM scored")
def exposure_composite(spark: SparkSession, d: str) -> DataFrame:
    return A.score(ads(spark, d)).select("ad_id", "days", "exposure")


def _by(rank_by: str, order: str) -> None:
    sql = f"WITH {ADS} SELECT ad_id, floor(greatest(0, least(100, coalesce({order}, 0) * 100)) * 10 + 0.5) / 10 AS exposure FROM parts"

    @query(f"exposure_by_{rank_by}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return A.score(ads(spark, d), rank_by).select("ad_id", "exposure")


for _name, _order in (("impressions", "si, sr, sl"), ("reach", "sr, si, sl"), ("spend", "ss, si, sl"), ("longevity", "sl")):
    _by(_name, _order)


@query("top_ads_per_brand", f"WITH {ADS} SELECT brand, ad_id, exposure, rank FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY exposure DESC, ad_id) AS rank FROM scored WHERE exposure >= 20) WHERE rank <= 3")
def top_ads_per_brand(spark: SparkSession, d: str) -> DataFrame:
    return A.rank(A.score(ads(spark, d)), 3, 20.0).select("brand", "ad_id", "exposure", F.col("rank").cast("long").alias("rank"))


@query("top_ads_overall", f"WITH {ADS} SELECT ad_id, brand_name, angle, exposure FROM scored ORDER BY exposure DESC, ad_id LIMIT 25")
def top_ads_overall(spark: SparkSession, d: str) -> DataFrame:
    return A.score(ads(spark, d)).orderBy(F.desc("exposure"), "ad_id").limit(25).select("ad_id", "brand_name", "angle", "exposure")


@query("days_running", f"WITH {ADS} SELECT ad_id, days FROM ads")
def days_running(spark: SparkSession, d: str) -> DataFrame:
    return ads(spark, d).select("ad_id", "days")


@query(
    "ad_dedupe_merge",
    """WITH u AS (SELECT o_orderkey AS ad_id, o_orderkey * 10 AS pos, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS reach, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 END AS i0, CASE WHEN o_orderkey % 2 = 0 THEN 2.0 END AS i1, o_orderstatus AS format FROM orders
     UNION ALL SELECT o_orderkey - o_orderkey % 4, o_orderkey * 10 + 5, o_totalprice + 1, 3.0, 4.0, o_orderpriority FROM orders)
    SELECT ad_id, arg_min(format, pos) AS format, arg_min(pos, pos) AS pos, arg_min(reach, pos) FILTER (WHERE reach IS NOT NULL) AS reach, arg_min(i0, pos) FILTER (WHERE i0 IS NOT NULL) AS impressions_min,
      arg_min(i1, pos) FILTER (WHERE i0 IS NOT NULL) AS impressions_max FROM u GROUP BY ad_id""",
)
def ad_dedupe_merge(spark: SparkSession, d: str) -> DataFrame:
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    a = o.select(k.alias("ad_id"), (k * 10).alias("pos"), F.when(k % 3 == 0, F.col("o_totalprice")).alias("reach"), F.when(k % 2 == 0, 1.0).alias("impressions_min"), F.when(k % 2 == 0, 2.0).alias("impressions_max"), F.col("o_orderstatus").alias("format"), F.lit("a").alias("matched_query"))
    b = o.select(k - k % 4, k * 10 + 5, F.col("o_totalprice") + 1, F.lit(3.0), F.lit(4.0), F.col("o_orderpriority"), F.lit("b"))
    return A.dedupe(a.union(b)).drop("matched_query")


PARTS = f"""{ADS}, totals AS (SELECT brand, count(*) AS total FROM scored GROUP BY 1),
angles AS (SELECT brand, any_value(brand_name) AS brand_name, any_value(niche) AS niche, angle, count(*) AS ad_count, ((2 * sum(CAST(round(exposure * 10) AS BIGINT)) + count(*)) // (2 * count(*))) / 10 AS avg_exposure FROM scored GROUP BY brand, angle)"""


def angles(spark: SparkSession, d: str) -> DataFrame:
    a = A.score(ads(spark, d))
    return R.breakdown(a, a.groupBy("brand").agg(F.count("*").alias("total")), ["brand"], "angle")


def named_angles(spark: SparkSession, d: str) -> DataFrame:
    return angles(spark, d).join(t(spark, d, "customer").select(F.col("c_custkey").alias("brand"), F.col("c_name").alias("brand_name"), F.col("c_mktsegment").alias("niche")), "brand")


@query("brand_angle_breakdown", f"WITH {PARTS} SELECT brand, angle, ad_count, avg_exposure, floor(ad_count / total * 1000 + 0.5) / 10 AS share FROM angles JOIN totals USING (brand)")
def brand_angle_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return angles(spark, d)


@query("brand_top_angle", f"WITH {PARTS} SELECT brand, angle AS top_angle FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY avg_exposure * ad_count DESC, ad_count DESC, avg_exposure DESC, angle) AS n FROM angles) WHERE n = 1")
def brand_top_angle(spark: SparkSession, d: str) -> DataFrame:
    return R.top_angle(angles(spark, d), ["brand"])


@query("brand_mix_breakdown", "WITH n AS (SELECT o_custkey AS brand, o_orderstatus AS format, count(*) AS n FROM orders GROUP BY 1, 2) SELECT *, floor(n / sum(n) OVER (PARTITION BY brand) * 1000 + 0.5) / 10 AS share FROM n")
def brand_mix_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return R.mix(t(spark, d, "orders").select(F.col("o_custkey").alias("brand"), F.col("o_orderstatus").alias("format")), ["brand"], "format")


@query(
    "offer_counts",
    "SELECT o_custkey AS brand, kind, detail, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, kind, detail) AS r FROM (SELECT o_custkey, l_returnflag AS kind, CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% off' AS detail, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)) WHERE r <= 10",
)
def offer_counts(spark: SparkSession, d: str) -> DataFrame:
    """A customer's offers over its orders, each line being one."""
    from adlens.operators import copy as X

    line = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    detail = F.concat(F.floor(F.col("l_discount") * 100 + 0.5).cast("string"), F.lit("% off")).alias("detail")
    own = line.select(F.col("o_custkey").alias("brand"), F.col("o_orderkey").alias("at"), F.col("l_returnflag").alias("kind"), detail)
    return X.count_offers(own, ["brand"]).select("brand", "kind", "detail", "n")


@query("niche_rollup", "SELECT c_mktsegment AS niche, c_nationkey AS sub_niche, count(*) AS brands FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def niche_rollup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").rollup(F.col("c_mktsegment").alias("niche"), F.col("c_nationkey").alias("sub_niche")).agg(F.count("*").alias("brands"))


@query("niche_top_angles", f"WITH {PARTS}, nt AS (SELECT niche, count(*) AS total FROM scored GROUP BY 1), na AS (SELECT niche, angle, CAST(sum(ad_count) AS BIGINT) AS ad_count FROM angles GROUP BY 1, 2) SELECT niche, angle, ad_count, floor(ad_count / total * 1000 + 0.5) / 10 AS share, place FROM (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY ad_count DESC, angle) AS place FROM na JOIN nt USING (niche)) WHERE place <= 8")
def niche_top_angles(spark: SparkSession, d: str) -> DataFrame:
    brands = ads(spark, d).groupBy("brand", "niche").agg(F.count("*").alias("ad_count"))
    return R.niche_angles(named_angles(spark, d), brands).withColumn("place", F.col("place").cast("long"))


@query("angle_leaderboard", f"WITH {PARTS} SELECT angle, CAST(sum(ad_count) AS BIGINT) AS ad_count, count(DISTINCT brand_name) AS brand_count, ((2 * sum(CAST(round(avg_exposure * 10) AS BIGINT)) + count(*)) // (2 * count(*))) / 10 AS avg_exposure FROM angles GROUP BY angle")
def angle_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return R.leaderboard(named_angles(spark, d))


@query("run_totals", "SELECT count(DISTINCT c_custkey) AS brands, count(DISTINCT o_custkey) AS brands_with_ads, count(o_orderkey) AS ads FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    from adlens.operators import report as O

    c = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    total = O.run_totals(c.groupBy(F.col("c_custkey").alias("brand")).agg(F.count("o_orderkey").alias("ad_count")))
    return total.select(F.col("brands_profiled").alias("brands"), "brands_with_ads", F.col("ads_analysed").alias("ads"))


def brand_figures(spark: SparkSession, d: str) -> DataFrame:
    a = ads(spark, d)
    return a.groupBy("brand", "niche").agg(F.count("*").alias("ad_count"), F.percentile("reach", F.lit(0.5)).alias("price"), F.max("days").cast("double").alias("guarantee_days"), F.max("active").alias("subscription"), (F.count_if(F.col("format") == "P") >= 3).alias("paid_media"))


BRANDS = f"""{ADS}, brands AS (SELECT brand, niche, count(*) AS ad_count, median(reach) AS price, CAST(max(days) AS DOUBLE) AS guarantee_days, bool_or(active) AS subscription, count(*) FILTER (WHERE format = 'P') >= 3 AS paid_media FROM ads GROUP BY 1, 2),
norms AS (SELECT niche, count(*) AS brand_count, CAST(sum(ad_count) AS BIGINT) AS ad_count, floor(median(ad_count) * 100 + 0.5) / 100 AS median_ads_per_brand, floor(median(price) * 100 + 0.5) / 100 AS median_price, floor(median(guarantee_days) * 100 + 0.5) / 100 AS median_guarantee_days,
  floor(count(*) FILTER (WHERE subscription) / count(*) * 1000 + 0.5) / 10 AS subscription_share, floor(count(*) FILTER (WHERE paid_media) / count(*) * 1000 + 0.5) / 10 AS paid_media_share FROM brands GROUP BY niche)"""


def norms(spark: SparkSession, d: str) -> DataFrame:
    return R.benchmark(brand_figures(spark, d), ["price", "guarantee_days"], ["subscription", "paid_media"])


@query("niche_benchmark", f"WITH {BRANDS} SELECT * FROM norms")
def niche_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return norms(spark, d)


@query("niche_mix", "WITH n AS (SELECT c_mktsegment AS niche, o_orderpriority AS angle, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT *, floor(n / sum(n) OVER (PARTITION BY niche) * 1000 + 0.5) / 10 AS share FROM n")
def niche_mix(spark: SparkSession, d: str) -> DataFrame:
    return R.mix(ads(spark, d).select("niche", "angle"), ["niche"], "angle")


@query(
    "brand_deviations",
    f"""WITH {BRANDS}, x AS (SELECT brand, unnest(['Price', 'Guarantee', 'Ad volume']) AS signal, unnest([price, guarantee_days, CAST(b.ad_count AS DOUBLE)]) AS value, unnest([median_price, median_guarantee_days, median_ads_per_brand]) AS norm, unnest([1.4, 1.4, 1.8]) AS r
      FROM brands b JOIN norms n USING (niche) WHERE n.brand_count >= 3)
    SELECT brand, signal, value, norm, CASE WHEN value / norm >= r THEN 'above' ELSE 'below' END AS direction FROM x WHERE norm > 0 AND value IS NOT NULL AND (value / norm >= r OR value / norm <= 1 / r)""",
)
def brand_deviations(spark: SparkSession, d: str) -> DataFrame:
    n = norms(spark, d).drop("ad_count")
    return R.deviations(brand_figures(spark, d), n, [("Price", "price", "median_price", 1.4), ("Guarantee", "guarantee_days", "median_guarantee_days", 1.4), ("Ad volume", "ad_count", "median_ads_per_brand", 1.8)])


@query("brand_absences", f"WITH {BRANDS} SELECT brand, 'Paid media' AS signal, 'absent' AS direction FROM brands JOIN norms USING (niche) WHERE brand_count >= 3 AND paid_media_share >= 60 AND NOT paid_media")
def brand_absences(spark: SparkSession, d: str) -> DataFrame:
    return R.absences(brand_figures(spark, d), norms(spark, d).drop("ad_count"), [("Paid media", "paid_media", "paid_media_share")])


@query("price_tier", f"WITH {BRANDS} SELECT brand, CASE WHEN r >= 1.5 THEN 'premium' WHEN r >= 1.15 THEN 'above-market' WHEN r <= 0.66 THEN 'value' WHEN r <= 0.85 THEN 'below-market' ELSE 'at-market' END AS tier FROM (SELECT brand, price / median_price AS r FROM brands JOIN norms USING (niche))")
def price_tier(spark: SparkSession, d: str) -> DataFrame:
    return brand_figures(spark, d).join(norms(spark, d).select("niche", "median_price"), "niche").select("brand", S.price_tier(F.col("price"), F.col("median_price")).alias("tier"))


#: Order lines of a task, however many there are.
LINES = 500_000


def angles_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """The distinct (niche, o_orderkey, angle) of orders with lines. Lines are dealt out by part and then by order, and each side they meet is
    hashed, so that a task holds a fixed number of rows and sorts none."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))

    def met(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
        return rows.repartition(n, key).join(others.repartition(n, other).hint("shuffle_hash"), F.col(key) == F.col(other))

    angles = met(lines, "l_partkey", t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("angle")), "p_partkey").select("l_orderkey", "angle")
    niches = met(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("niche")), "c_custkey")
    return met(angles, "l_orderkey", niches.select("o_orderkey", "niche"), "o_orderkey").select("niche", "o_orderkey", "angle").distinct()


@query(
    "angle_whitespace",
    """WITH lib AS (SELECT unnest(['Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#99', 'Brand#98']) AS angle),
    ad AS (SELECT DISTINCT c_mktsegment AS niche, o_orderkey, p_brand AS angle FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    tot AS (SELECT niche, count(DISTINCT o_orderkey) AS total FROM ad GROUP BY 1), sh AS (SELECT niche, angle, floor(count(*) / any_value(total) * 1000 + 0.5) / 10 AS share FROM ad JOIN tot USING (niche) GROUP BY 1, 2),
    u AS (SELECT niche, angle, share FROM sh JOIN tot USING (niche) WHERE total >= 10 AND share < 8 UNION ALL SELECT niche, angle, 0.0 FROM tot CROSS JOIN lib WHERE total >= 10 AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.niche = tot.niche AND sh.angle = lib.angle))
    SELECT niche, angle, share, place FROM (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY share, angle) AS place FROM u) WHERE place <= 8""",
)
def angle_whitespace(spark: SparkSession, d: str) -> DataFrame:
    ad = angles_of_orders(spark, d)
    totals = ad.select("niche", "o_orderkey").distinct().groupBy("niche").agg(F.count("*").alias("total"))
    used = ad.groupBy("niche", "angle").agg(F.count("*").alias("n")).join(totals, "niche").select("niche", "angle", S.share(F.col("n"), F.col("total")).alias("share"))
    library = spark.createDataFrame([(x,) for x in ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#99", "Brand#98")], "angle string")
    return R.whitespace(used, totals, library).withColumn("place", F.col("place").cast("long"))


_FEATURES = """f AS (SELECT o_custkey AS brand, 'angle:' || o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT o_custkey, 'format:' || o_orderstatus, count(*) FROM orders GROUP BY 1, 2),
 v AS (SELECT brand, key, floor(n / sum(n) OVER (PARTITION BY brand, substr(key, 1, 5)) * 1000 + 0.5) / 10 AS value FROM f)"""


@query(
    "creative_competitors",
    f"""WITH {_FEATURES}, nm AS (SELECT brand, sqrt(sum(value * value ORDER BY key)) AS norm, string_agg(key || '=' || value, ',' ORDER BY key) AS whole FROM v GROUP BY 1), dot AS (SELECT a.brand, b.brand AS other, sum(a.value * b.value ORDER BY key) AS dot FROM v a JOIN v b USING (key) WHERE a.brand != b.brand GROUP BY 1, 2)
    SELECT brand, other, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY similarity DESC, same DESC, other) AS place FROM (SELECT dot.brand, other, x.whole = y.whole AS same, floor(dot / (x.norm * y.norm) * 1000 + 0.5) / 10 AS similarity FROM dot JOIN nm x ON x.brand = dot.brand JOIN nm y ON y.brand = other)) WHERE place <= 3""",
)
def creative_competitors(spark: SparkSession, d: str) -> DataFrame:
    """Every customer against all others."""
    a = ads(spark, d).select("brand", "angle", "format")
    x = R.mix(a, ["brand"], "angle").select("brand", F.concat(F.lit("angle:"), "angle").alias("key"), F.col("share").alias("value"))
    y = R.mix(a, ["brand"], "format").select("brand", F.concat(F.lit("format:"), "format").alias("key"), F.col("share").alias("value"))
    return R.competitors(x.union(y)).withColumn("place", F.col("place").cast("long"))


def _velocity(name: str, key: str, sql_key: str) -> None:
    sql = f"""WITH {ADS}, a AS (SELECT {sql_key} AS k, *, CAST(greatest(0, floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(start)) / 86400000.0 + 0.5)) AS BIGINT) AS age FROM ads),
    g AS (SELECT k, count(*) AS ad_count, count(*) FILTER (WHERE age <= 30) AS launched_30, min(age) AS newest, max(age) AS oldest, median(days) AS mid, max(days) AS longest_run, count(*) FILTER (WHERE active) AS active_ads, CAST(sum(coalesce(variants, 1)) AS BIGINT) AS variants FROM a GROUP BY k)
    SELECT k AS {key}, ad_count, launched_30, newest, floor(mid + 0.5) AS median_run, longest_run, active_ads, variants, floor(ad_count / greatest(30, oldest) * 30 * 10 + 0.5) / 10 AS per_month,
      CASE WHEN newest > 60 THEN 'stale' WHEN launched_30 >= 5 AND longest_run >= 90 THEN 'scaling' WHEN launched_30 >= 5 THEN 'testing' WHEN longest_run >= 90 THEN 'steady' ELSE 'testing' END AS posture,
      CASE WHEN newest > 60 THEN 'newest ad started ' || newest || ' days ago — the account has gone quiet' WHEN launched_30 >= 5 AND longest_run >= 90 THEN launched_30 || ' launches in 30 days with a ' || longest_run || '-day runner still live' WHEN launched_30 >= 5 THEN launched_30 || ' launches in 30 days but nothing has run past 90 days yet'
      WHEN longest_run >= 90 THEN 'few new launches, but a ' || longest_run || '-day runner is still delivering' ELSE ad_count || CASE WHEN ad_count = 1 THEN ' ad' ELSE ' ads' END || ' observed, none established yet' END AS posture_reason FROM g"""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return R.creative_signals(ads(spark, d).withColumnRenamed(key, "k") if key != "brand" else ads(spark, d).withColumn("k", F.col("brand")), F.lit(AS_OF).cast("timestamp"), ["k"]).withColumnRenamed("k", key)


_velocity("creative_velocity", "brand", "brand")
_velocity("posture", "sub_niche", "sub_niche")


@query(
    "proven_winners",
    f"""WITH {ADS}, won AS (SELECT * FROM scored WHERE coalesce(days, 0) >= 60), h AS (SELECT brand, count(*) AS winners, floor(median(exposure) * 10 + 0.5) / 10 AS median_exposure FROM won GROUP BY 1),
    n AS (SELECT brand, angle, count(*) AS n FROM won GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, angle) AS r FROM n) WHERE r = 1)
    SELECT brand, winners, median_exposure, angle, CAST(winners AS VARCHAR) || CASE WHEN winners = 1 THEN ' ad' ELSE ' ads' END || ' past 60 days; ' || CASE WHEN n = winners THEN 'every one' ELSE CAST(n AS VARCHAR) || ' of ' || CAST(winners AS VARCHAR) END || ' runs ' || angle AS pattern, ids, formats FROM h JOIN b USING (brand) JOIN (SELECT brand, string_agg(ad_id, ' ' ORDER BY exposure DESC, ad_id) AS ids FROM won GROUP BY 1) USING (brand)
    JOIN (SELECT brand, string_agg(format, ' ' ORDER BY r) AS formats FROM (SELECT brand, format, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY exposure DESC, ad_id) AS r FROM won) GROUP BY 1, 2) GROUP BY 1) USING (brand)""",
)
def proven_winners(spark: SparkSession, d: str) -> DataFrame:
    out = R.proven_winners(A.score(ads(spark, d)).withColumn("angles", F.array("angle")), ["brand"])
    return out.withColumns({c: F.array_join(c, " ") for c in ("ids", "formats")})


@query(
    "ad_landing_pages",
    f"""WITH {ADS}, u AS (SELECT *, CASE WHEN variants <> 2 THEN angle || '/' || CAST(sub_niche AS VARCHAR) END AS url, 'f' || sub_niche % 3 AS funnel FROM scored), g AS (SELECT niche, url, count(*) AS ad_count, sum(CAST(round(exposure * 10) AS BIGINT)) / 10 AS total_exposure, floor(median(exposure) * 10 + 0.5) / 10 AS median_exposure, max(exposure) AS top_exposure,
      count(*) FILTER (WHERE active) AS active_ads, min(start) AS first_seen, max(start) AS last_seen, max(days) AS longest_run, min(funnel) AS funnel FROM u WHERE url IS NOT NULL GROUP BY 1, 2),
    an AS (SELECT niche, url, string_agg(format || ':' || n, ' ' ORDER BY n DESC, format) AS angles FROM (SELECT niche, url, format, count(*) AS n FROM u WHERE url IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
    hk AS (SELECT niche, url, string_agg(hook, ' ' ORDER BY exposure DESC, ad_id) AS hooks FROM (SELECT *, 'Hook ' || ad_id AS hook, row_number() OVER (PARTITION BY niche, url ORDER BY exposure DESC, ad_id) AS r FROM u WHERE url IS NOT NULL) WHERE r <= 3 GROUP BY 1, 2), ev AS (SELECT niche, count(*) AS every FROM u GROUP BY 1)
    SELECT g.*, angles, hooks, floor(ad_count / every * 1000 + 0.5) / 10 AS share, row_number() OVER (PARTITION BY niche ORDER BY total_exposure DESC, ad_count DESC, url) AS place FROM g JOIN an USING (niche, url) JOIN hk USING (niche, url) JOIN ev USING (niche)""",
)
def ad_landing_pages(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("variants") != 2, F.concat_ws("/", "angle", F.col("sub_niche").cast("string")))
    a = A.score(ads(spark, d)).withColumns({"url": url, "funnel": F.concat(F.lit("f"), (F.col("sub_niche") % 3).cast("string")), "angles": F.array("format"), "hook": F.concat(F.lit("Hook "), F.col("ad_id").cast("string"))})
    out = R.landing_pages(a, ["niche"]).withColumns({"place": F.col("place").cast("long"), "hooks": F.array_join("hooks", " ")})
    return out.withColumn("angles", F.array_join(F.transform("angles", lambda x: F.concat_ws(":", x["angle"], x["n"])), " "))


@query("ad_split_tests", "WITH p AS (SELECT c_mktsegment AS niche, o_orderpriority AS directory, c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT niche, directory, count(*) AS pages, CAST(sum(n) AS BIGINT) AS ad_count FROM p GROUP BY 1, 2 HAVING count(*) >= 2")
def ad_split_tests(spark: SparkSession, d: str) -> DataFrame:
    pages = ads(spark, d).groupBy("niche", F.col("angle").alias("directory"), "sub_niche").agg(F.count("*").alias("ad_count"))
    return R.split_tests(pages, ["niche"])


@query("platform_mix", "SELECT event_type AS brand, platform, n, floor(n / sum(n) OVER (PARTITION BY event_type) * 1000 + 0.5) / 10 AS share FROM (SELECT event_type, platform, count(*) AS n FROM (SELECT event_type, unnest(CASE WHEN event_id % 5 = 0 THEN ['unknown'] WHEN event_id % 2 = 0 THEN ['facebook', 'instagram'] ELSE ['facebook'] END) AS platform FROM events) GROUP BY 1, 2)")
def platform_mix(spark: SparkSession, d: str) -> DataFrame:
    e, k = t(spark, d, "events"), F.col("event_id")
    told = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("facebook"), F.lit("instagram"))).otherwise(F.array(F.lit("facebook")))
    each = e.select(F.col("event_type").alias("brand"), told.alias("p")).select("brand", F.explode(F.when(F.size("p") == 0, F.array(F.lit("unknown"))).otherwise(F.col("p"))).alias("platform"))
    return R.mix(each, ["brand"], "platform")


_SHORT = "CASE WHEN {v} >= 1e6 THEN printf('%.1fM', floor({v} / 1e5 + 0.5) / 10) WHEN {v} >= 1e3 THEN printf('%.1fk', floor({v} / 1e2 + 0.5) / 10) ELSE CAST(CAST(floor({v} + 0.5) AS BIGINT) AS VARCHAR) END"


@query(
    "exposure_reasons",
    f"""WITH {ADS} SELECT ad_id, concat_ws(',', CASE WHEN imp IS NOT NULL THEN 'impressions' END, 'eu-reach', CASE WHEN days IS NOT NULL THEN 'longevity' END, CASE WHEN variants IS NOT NULL THEN 'variants' END, CASE WHEN active THEN 'active' END) AS signals,
    concat_ws('; ', CASE WHEN imp IS NOT NULL THEN '~' || {_SHORT.format(v='imp')} || ' impressions' END, 'EU reach ' || {_SHORT.format(v='floor(reach)')}, 'running ' || days || CASE WHEN days = 1 THEN ' day' ELSE ' days' END, variants || ' creative variants', CASE WHEN active THEN 'still active' END) AS basis FROM ads""",
)
def exposure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """X64's reasons, X13."""
    a, none = ads(spark, d), F.lit(None).cast("double")
    told = S.exposure_signals(S.midpoint(F.col("impressions_min"), F.col("impressions_max")), F.floor("reach").cast("double"), none, F.col("days"), F.col("variants"), F.col("active"), F.lit("USD"))
    return a.select("ad_id", told.alias("x")).select("ad_id", F.array_join("x.signals", ",").alias("signals"), "x.basis")
