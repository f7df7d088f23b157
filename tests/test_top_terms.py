"""Vocabularies of brands: the first terms of a group without writing all of its terms."""

import random

from pyspark.sql import functions as F

from adlens.operators import vocabulary as V

COLUMNS = ("brand", "slot", "term", "ad_count", "ad_share", "total_count", "avg_exposure", "words", "place")


def ads(spark, n=60):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "7"]
    said = []
    for _ in range(n // 2):  # every text stands in two ads, so no gram of a body is rare
        said += [" ".join(rng.choices(words, weights=[1 / (k + 2) for k in range(len(words))], k=rng.randint(30, 90))) + ". Buy one now"] * 2
    rows = [("b" if k % 5 else "c", k, 10.0 * (k % 7), "Title 12", x, "", "shop", x[:40], ["a", "z"] if k % 3 else ["a"]) for k, x in enumerate(said)]
    rows += [("alone", 900, None, "", "", "", "", None, None), (None, 901, 1.0, "no", "brand at all", "", "", "", ["a"])]
    return spark.createDataFrame(rows, "brand string, ad long, exposure double, title string, body string, link_description string, cta_text string, hook string, angles array<string>")


def whole(texts, groups, banned, keys):
    """The same from all terms of all groups."""
    stats = V.without_names(V.term_stats(V.grams(texts, keys), groups.select(*keys, "total", "floor"), keys, F.col("floor")), banned, ["brand"])
    folded = V.drop_shifted(V.rank(V.prefer_longer(stats, keys), keys), keys, 1000)
    return stats, folded.join(groups.select(*keys, "most"), keys).filter("place <= most").select(*COLUMNS)


def test_first_terms_are_those_of_all_terms(spark, monkeypatch):
    asked, sizes = [], {}
    top, real = V.top_terms, V.written
    monkeypatch.setattr(V, "top_terms", lambda *a: asked.append(a) or top(*a))
    brands = spark.createDataFrame([("b", ["w3", "w5 w9"]), ("c", ["c"]), ("alone", ["alone"])], "brand string, names array<string>")

    def spied(df, name):
        out = real(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(V, "written", spied)
    got = sorted(V.brand_vocabulary(ads(spark), brands).select(*COLUMNS).collect())
    texts, groups, keys, banned, _ = asked[0]
    stats, want = whole(texts, groups, banned, keys)
    assert got == sorted(want.collect()) and {r.slot for r in got} == {"signature", "hook", "cta", "angle:a", "angle:z"}
    assert max(sizes["vocabulary-terms"]) < stats.count() / 4


def test_groups_go_on_until_they_have_their_terms(spark, monkeypatch):
    brands = spark.createDataFrame([("b", ["w0", "w1", "w2", "w3", "w4"])], "brand string, names array<string>")
    body = ads(spark).filter("brand is not null and brand != 'alone'").select("brand", F.lit("s").alias("slot"), "ad", "exposure", F.col("body").alias("text"))
    texts = body.union(body.limit(1).select(F.lit("one"), "slot", "ad", "exposure", "text"))
    keys = ["brand", "slot"]
    groups = texts.groupBy(*keys).agg(F.count("*").alias("total")).withColumns({"floor": F.lit(2), "most": F.lit(9)})
    banned = V.banned_names(brands, ["brand"])
    want = sorted(whole(texts, groups, banned, keys)[1].collect())
    for listed, ahead in ((4000, 1), (3, 1), (4000, 10_000)):
        monkeypatch.setattr(V, "_LISTED", listed)
        assert sorted(V.top_terms(texts, groups, keys, banned, ["brand"], ahead).select(*COLUMNS).collect()) == want
    assert V.top_terms(texts.limit(0), groups.limit(0), keys, banned, ["brand"]).collect() == []


def test_what_is_written_leaves_no_shuffle_behind(spark):
    tracker = spark._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    assert V.written(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "t").columns == ["k", "count"]
    assert tracker.shuffleStatuses().size() == before
