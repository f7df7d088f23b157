"""Provider searches over recorded pages, and stores that runs add to."""

import json

from adlens.sources import providers as V


def page(ids, following=None, **more):
    return json.dumps({"data": [{"id": str(k), "ad_creative_bodies": [f"b{k}"]} for k in ids] + [{"nothing": 1}], "paging": {"next": following} if following else {}} | more)


def recorded(countries):
    pages = {}
    first = V.graph_url("iron peak & co", countries, "ALL", 10)
    pages[first] = (200, page(range(4), "https://next/1"))
    pages["https://next/1"] = (200, page(range(4, 9), "https://next/2"))
    pages["https://next/2"] = (200, page(range(9, 15), "https://next/3"))
    pages["https://next/3"] = (200, page([99]))  # never asked for: the quota is full
    pages[V.graph_url("broken", countries, "ALL", 10)] = (500, "<html>")
    pages[V.graph_url("refused", countries, "ALL", 10)] = (200, json.dumps({"error": {"message": "bad token"}}))
    loop = V.graph_url("endless", countries, "ALL", 10)
    pages[loop] = (200, json.dumps({"data": [], "paging": {"next": loop}}))
    return pages


def test_recorded_pages(spark):
    countries = ["de", "US"]
    pages = recorded(countries)
    terms = spark.createDataFrame([("a", 0, "iron peak & co"), ("a", 1, "broken"), ("b", 0, "refused"), ("b", 1, "endless"), ("b", 2, "unknown"), ("c", 0, "iron peak & co")], "brand string, pos int, term string")
    rows = spark.createDataFrame([(u, s, b) for u, (s, b) in pages.items()], "url string, status int, body string")
    got, warnings = V.graph_records(V.graph_requests(terms, countries, 12), rows)
    got = got.orderBy("brand", "pos").collect()
    assert [json.loads(r.record)["id"] for r in got if r.brand == "a"] == [str(k) for k in range(10)]
    assert {r.brand for r in got} == {"a"}  # c's single term may bring 12, which makes another address
    assert [(r.brand, r.term) for r in warnings.orderBy("brand", "term").collect()] == [("a", "broken"), ("b", "refused"), ("b", "unknown"), ("c", "iron peak & co")]
    few, _ = V.graph_records(V.graph_requests(terms.filter("brand = 'a'"), countries, 3), rows)
    assert few.count() == 3


def test_data_source_reads_like_the_table(spark):
    countries = ["DE", "US"]
    pages = recorded(countries)
    spark.dataSource.register(V.ad_archive(lambda url: pages.get(url, (404, "gone"))))
    got = spark.read.format("ad_archive").option("terms", json.dumps(["iron peak & co", "broken"])).option("countries", json.dumps(countries)).option("limit", "12").load()
    assert got.rdd.getNumPartitions() == 2
    rows = got.orderBy("pos").collect()
    assert [r.matched_query for r in rows if r.warning] == ["broken"] and len([r for r in rows if r.record]) == 10


def test_requests_and_warnings(spark):
    assert V.graph_warnings(["US"]) and not V.graph_warnings(["us", "de"])
    assert "ad_type=ALL" in V.graph_url("x", ["de"], "ALL", 10) and "POLITICAL" in V.graph_url("x", ["US"], "ALL", 10) and V.graph_url("x", [], "ALL", 500).endswith("limit=100")
    assert V.per_term(20, 3) == 10 and V.per_term(100, 3) == 34 and V.per_term(5, 0) == 10
    terms = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("a", 2, "")], "brand string, pos int, term string")
    made = json.loads(V.nested_requests(terms, ["us", "de"], 30, extra={"maxItems": 5, "own": [1]}).first().input)
    assert made["searchTerms"] == ["one", "two"] and len(made["urls"]) == 4 and made["startUrls"][0]["method"] == "GET"
    assert (made["count"], made["maxItems"], made["own"], made["countryCode"], made["activeStatus"]) == (30, 5, [1], "US", "all")


def test_runs_are_added_and_replaced(spark, tmp_path):
    from adlens.sources import store as S

    path = str(tmp_path / "rows")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "brand string")
    S.append_run(rows("a", "b"), path, "2024-01")
    S.append_run(rows("c"), path, "2024-02")
    S.append_run(rows("d"), path, "2024-01")
    assert sorted((r.run, r.brand) for r in S.runs(spark, path).collect()) == [("2024-01", "d"), ("2024-02", "c")]


def test_aliases_are_merged_behind_a_pointer(spark, tmp_path):
    from adlens.operators.resolve import ALIAS_COLUMNS
    from adlens.sources import store as S

    path = str(tmp_path / "aliases")
    schema = "pos int, " + ", ".join(f"{c} string" for c in ALIAS_COLUMNS)
    assert S.version(spark, path) == 0 and S.snapshot(spark, path) is None
    S.upsert_aliases(spark.createDataFrame([(0, "Firm, LLC", "Brand", None, "firm", None, None)], schema), path)
    second = [(0, "Firm, LLC", "Brand", "https://b.com", "firm", "me", None), (1, "Other Inc", "Else", None, "other", None, None), (2, "Wrong", "Brand", None, "firm", None, None)]
    now = {r.key: r for r in S.upsert_aliases(spark.createDataFrame(second, schema), path).collect()}
    assert (now["li:firm"].outcome, now["li:firm"].website, now["li:firm"].legal_entity, now["li:other"].outcome) == ("filled", "https://b.com", "Firm, LLC", "added")
    clash = S.upsert_aliases(spark.createDataFrame([(0, "Firm, LLC", "Another", None, "firm", None, None)], schema), path)
    assert {r.key: (r.outcome, r.brand) for r in clash.collect()} == {"li:firm": ("conflict", "Brand"), "li:other": ("kept", "Else")}
    assert S.version(spark, path) == 3 and S.snapshot(spark, path, 1).count() == 1
    # A run that dies before it moves the pointer leaves the last snapshot as it was.
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/v4")
    assert S.version(spark, path) == 3 and S.replace(S.snapshot(spark, path), path) == 4


def test_ads_are_merged_across_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    from adlens.operators import ads as A
    from adlens.sources import store as S

    def sight(*records):
        raw = spark.createDataFrame([("p", q, k, json.dumps(r)) for k, (q, r) in enumerate(records)], "provider string, matched_query string, pos long, record string")
        return A.read_records(raw, F.lit("2024-06-01").cast("timestamp"))

    path = str(tmp_path / "ads")
    S.upsert_ads(sight(("peak", {"id": "1", "body": "first"})), path)
    second = sight(("fog", {"id": "1", "body": "later", "reach": 7}), ("fog", {"id": "2", "body": "new"}))
    for _ in range(2):
        rows = {r.ad_id: r for r in S.upsert_ads(second, path).collect()}
        assert sorted(rows) == ["1", "2"] and (rows["1"].body, rows["1"].reach, rows["1"].matched_query) == ("first", 7.0, "peak; fog")
