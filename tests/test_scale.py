"""What only shows on larger tables: plans that broadcast built texts, caps, repeated copy, large batches."""

from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.functions import text as T
from adlens.operators import copy as X
from adlens.operators import pages as P
from adlens.operators import profile as B
from adlens.operators import vocabulary as W
from adlens.sources import providers as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_product_pages_are_not_broadcast(spark):
    targets = spark.createDataFrame([("b", 1, "https://b.com/products/1")], "brand string, place int, url string")
    pages = spark.createDataFrame([("https://b.com/products/1", 200, "<h1>One</h1>")], "url string, status int, body string")
    out = B.read_product_pages(targets, pages)
    assert "BroadcastHashJoin" not in plan(out)
    assert [(r.ok, r.title) for r in out.collect()] == [(True, "One")]


def test_requests_are_not_broadcast(spark):
    terms = spark.createDataFrame([("b", 0, "ring")], "brand string, pos int, term string")
    requests = V.graph_requests(terms, ["DE"], 12)
    assert "BroadcastHashJoin" not in plan(requests)
    seen = []
    whole, V.written = V.written, lambda df, name: (seen.append(plan(df)), whole(df, name))[1]
    try:
        found, _ = V.graph_records(requests, requests.select("url", F.lit(200).alias("status"), F.lit('{"data":[{"id":"7"}]}').alias("body")))
    finally:
        V.written = whole
    assert seen and not any("BroadcastHashJoin" in x for x in seen)
    assert found.count() == 1


def test_crawl_without_a_cap(spark):
    locs = "".join(f"<loc>https://a.com/p/{k}</loc>" for k in range(2500))
    docs = spark.createDataFrame([("https://a.com/sitemap.xml", f"<urlset>{locs}</urlset>")], "url string, body string")
    sites = spark.createDataFrame([("https://a.com/",)], "site string")
    assert P.crawl(docs, sites).count() == 2000
    assert P.crawl(docs, sites, most_urls=None).agg(F.count("*"), F.max("pos")).first()[:] == (2500, 2500)


def test_each_copy_is_read_once(spark):
    ads = spark.createDataFrame([(k, None if k % 3 == 0 else f"copy {k % 3}") for k in range(30)], "ad int, body string")
    read = []
    out = X.per_copy(ads, ["body"], lambda c: (read.append(c.count()), c.withColumn("n", F.length("body")))[1])
    assert read == [3]
    assert sorted(out.select("ad", "n").collect()) == sorted(ads.select("ad", F.length("body").alias("n")).collect())


def test_the_matcher_passes_over_nothing(spark):
    patterns = [p for table in (rules.ANGLE_PATTERNS, rules.AWARENESS, rules.EMOTIONS, rules.OFFERS) for *_, p in rules.table(table)]
    said = ["", None, "Tired\u00a0of it? STOP\x0bwasting money", "4.8\u2028out of 5, 12,000 customers", "SECRET warning \u017fecret \u212aeep", "no words of note"]
    texts = spark.createDataFrame([(x,) for x in said], "t string")
    exact = F.array(*[F.regexp_count("t", F.lit(T.js_regex(p, "i"))) > 0 for p in patterns])
    for r in texts.select("t", exact.alias("exact"), X.may_hold(F.col("t"), patterns).alias("may")).collect():
        assert all(m for e, m in zip(r.exact, r.may, strict=True) if e is not False)
        assert r.t != "no words of note" or not any(r.may)


def test_pages_go_back_before_the_batch_ends():
    import pandas as pd

    html = "<p>" + "x" * (P.PARSED_CHARS // 2)
    out = list(P.parsed(iter([pd.Series([html] * 5 + [None])])))
    assert [len(x) for x in out] == [2, 2, 2]


def test_grams_of_a_part_come_once(spark):
    """Against the columns' own grams, with sums of a term over a part and not a row for each of its ads."""
    said = ["Clean energy. The 40,000 men, it\u2019s 5 of_5!\nCaf\u00e9 time\ufeffNow", "clean energy; CLEAN energy\u2026 Clean", "", None, "a b 12", "Trusted\u00a0by \u0130zmir. \u2018Clean energy\u2019 1,000_x"]
    rows = [(k % 2, k, x, None if k == 1 else 50.1) for k, x in enumerate(said * 3)]
    texts = spark.createDataFrame(rows, "brand long, ad long, text string, exposure double").coalesce(1)
    each = texts.select("brand", "ad", "exposure", F.explode(T.sentences(F.col("text"))).alias("s")).withColumn("s", T.normalise(F.col("s")))
    each = each.select("brand", "ad", "exposure", F.explode(T.ngrams(T.gram_tokens(F.col("s")), 4, rules.STOPWORDS)).alias("term"))
    per_ad = each.groupBy("brand", "term", "ad", "exposure").agg(F.count("*").alias("n"))
    want = per_ad.groupBy("brand", "term").agg(F.count("*"), F.sum("n"), F.sum(F.round(F.col("exposure") * 10).cast("long")), F.count("exposure"))
    found = W.grams(texts, ["brand"])
    assert sorted(map(tuple, W.summed(found, ["brand"], ads="ads", n="n", tenths="tenths", rated="rated").collect())) == sorted((*r[:4], r[4] or 0, r[5]) for r in want.collect())
    assert W.grams(texts.limit(0), []).collect() == []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        terms = [r.term for r in W.grams(texts, []).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(terms) == len(set(terms)) and "clean energy" in terms


def test_a_fold_reads_its_terms_once(spark):
    rows = spark.createDataFrame([("b", "a b"), ("b", "b c"), ("b", "d")], "brand string, term string").mapInArrow(lambda batches: batches, "brand string, term string")
    ranked = rows.withColumns({"ad_count": F.lit(3), "place": F.ascii("term")})
    out = W.drop_shifted(ranked, ["brand"], 9)
    assert "MapInArrow" not in plan(out) and [r.term for r in out.orderBy("place").collect()] == ["a b", "d"]


def test_signatures_of_niches_are_worked_out_once(spark):
    from adlens.plans import copy as C

    own = C._own(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in plan(own) and {"niche", "brand", "term"} <= set(own.columns)


def test_refined_takes_the_first_terms_only(spark):
    """Equal to folding whole groups, also where a group's first terms all go, and from few of them where they do not."""
    import random

    rng = random.Random(2)
    rows = [(b, t, n, n * 10.0) for b in "xy" for t, n in {" ".join(rng.choices("abcdef", k=rng.choice([1, 2, 2, 3, 4]))): rng.randint(2, 9) for _ in range(150)}.items()]
    rows += [("z", " ".join("pqrs"[(k + j) % 4] for j in range(3)), 9, 90.0) for k in range(4)] + [("z", "p", 2, 20.0), ("z", "t u", 3, 30.0)]
    stats = spark.createDataFrame(rows, "brand string, term string, ad_count long, ad_share double").withColumns({"total_count": F.lit(1), "avg_exposure": F.lit(1.0), "words": F.size(F.split("term", " "))})
    columns = [*stats.columns, "place"]
    want = W.drop_shifted(W.rank(W.prefer_longer(stats, ["brand"]), ["brand"]), ["brand"], 7).select(columns).collect()
    sizes = []
    whole, W.drop_shifted = W.drop_shifted, lambda df, *a: (sizes.append(df.count()), whole(df, *a))[1]
    try:
        got = W.refined(stats, ["brand"], 7, ahead=4).select(columns).collect()
        assert W.refined(stats.limit(0), ["brand"], 7).collect() == []
    finally:
        W.drop_shifted = whole
    assert sorted(got) == sorted(want) and len(sizes) > 1 and sizes[0] < len(rows) / 4


def test_json_ld_alone_is_that_of_the_whole_page(spark):
    from adlens.plans import sites as Q

    said = ['<script type="application/LD+json">[{"a":1},{"@graph":[{"b":2},3]}]</script><SCRIPT type="application/ld+json">no</SCRIPT>', "<p>none", None, '<template><script type="application/ld+json">{"c":3}</script></template>']
    pages = spark.createDataFrame([(x,) for x in said], "html string")
    for r in pages.select(P.read_json_ld(F.col("html")).alias("own"), P.read_html(F.col("html"))["json_ld"].alias("whole")).collect():
        assert r.own == r.whole
    built = Q.structured_organisations(spark, "/root/testdata/sf0.001")
    assert "contact_inputs" not in plan(built) and "REPARTITION_BY_NUM" in plan(built) and built.count() > 0


def test_offers_are_counted_without_sorting_them(spark):
    from adlens.plans import ads as A

    built = A.offer_counts(spark, "/root/testdata/sf0.001")
    assert "collect_list" not in plan(built)
    ads = spark.createDataFrame([("b", 2, [("k", "10% OFF")]), ("b", 1, [("k", "10% Off"), ("k", "10% off"), ("j", "x")]), ("b", None, []), ("c", 5, [("k", None)])], "brand string, pos int, offers array<struct<kind string, detail string>>")
    assert sorted(map(tuple, X.offer_counts(ads, ["brand"]).select("brand", "kind", "detail", "n", "place").collect()), key=str) == [("b", "j", "x", 1, 2), ("b", "k", "10% Off", 3, 1), ("c", "k", None, 1, 1)]


def test_angles_of_orders_are_dealt_out_by_the_number_of_lines(spark, monkeypatch, tmp_path):
    from adlens.plans import ads

    spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "a"), (2, None)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "x"), (2, None)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (None, 1), (2, 7)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(ads, "LINES", 1)
    found = ads.angles_of_orders(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", 1, "x"), ("a", 1, None), ("a", 2, "x"), (None, 3, "x")], key=repr)
    assert found.rdd.getNumPartitions() == 8
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
