"""Where ads and pages come from. The deterministic core reads tables; live calls are a caller's."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from adlens.dims.rules import EU_COUNTRIES
from adlens.functions.lineage import shuffled, written

RAW = "provider string, matched_query string, pos long, record string"


def no_ads(spark: SparkSession) -> DataFrame:
    """S13."""
    return spark.createDataFrame([], RAW)


#: Fixed values of the official interface.
GRAPH = "https://graph.facebook.com/v21.0/ads_archive?"
GRAPH_FIELDS = (
    "id", "ad_creation_time", "ad_delivery_start_time", "ad_delivery_stop_time", "ad_creative_bodies", "ad_creative_link_captions", "ad_creative_link_descriptions", "ad_creative_link_titles", "ad_snapshot_url", "page_id",
    "page_name", "publisher_platforms", "languages", "currency", "impressions", "spend", "eu_total_reach", "target_ages", "target_gender",
)
#: Pages that are read for a term, at most.
MOST_PAGES = 10


def records(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Provider records as JSON lines; matched_query from each record. pos is the place in the files: a record of its own
    (`pos`), else the line's order within what Spark reads, file by file."""
    text = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    told = F.get_json_object("value", "$.pos").try_cast("long")
    first = F.coalesce(told, F.col("line"))
    return text.select(F.lit(provider).alias("provider"), F.coalesce(F.get_json_object("value", "$.matchedQuery"), F.lit("")).alias("matched_query"), first.alias("pos"), F.col("value").alias("record"))


def per_term(limit: int, terms: int) -> int:
    """The ads that each term of a search may bring."""
    return max(10, -(-limit // max(1, terms)))


def graph_parameters(countries: Sequence[str], status: str, quota: int) -> dict[str, str]:
    """What a request says besides its term, in the order of its address. Commercial ads are asked for where a country
    has figures for them."""
    asked = [c.upper() for c in countries] or ["US"]
    return {
        "ad_reached_countries": json.dumps(asked, separators=(",", ":")), "ad_active_status": status, "ad_type": "ALL" if asks_eu(asked) else "POLITICAL_AND_ISSUE_ADS", "fields": ",".join(GRAPH_FIELDS), "limit": str(min(100, max(10, quota))),
    }


def graph_url(term: str, countries: Sequence[str], status: str, quota: int) -> str:
    """The address of a term's first page, without the token, which the caller's function adds."""
    return GRAPH + urlencode({"search_terms": term} | graph_parameters(countries, status, quota))


def graph_requests(terms: DataFrame, countries: Sequence[str], limit: int, status: str = "ALL") -> DataFrame:
    """Terms (brand, pos, term) -> (brand, pos, term, quota, most, url), one row a term; every brand's terms share its limit."""
    n = terms.groupBy("brand").agg(F.count("*").alias("n"))
    quota = F.greatest(F.lit(10), F.ceil(F.lit(limit) / F.col("n"))).cast("int")
    rest = graph_parameters(countries, status, 0)
    rest.pop("limit")
    size = F.least(F.lit(100), F.col("quota")).cast("string")
    url = F.concat(F.lit(GRAPH + "search_terms="), F.url_encode("term"), F.lit("&" + urlencode(rest) + "&limit="), size)
    return terms.join(shuffled(n), "brand").withColumn("quota", quota).select("brand", "pos", "term", "quota", F.lit(limit).alias("most"), url.alias("url"))


def graph_records(requests: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of requests as recorded pages (url, status, body) hold them, and the warnings (brand, term, warning).

    A page names the next one; a term is read on until it has its quota of ads, its pages end or MOST_PAGES are read. A page
    that is missing, no JSON or an error ends its term with a warning. Each round joins the open terms with the pages and is
    written, so there are MOST_PAGES joins at most, whatever the number of terms. Of a brand's ads the first `most` count, its terms in
    order. Records: brand, provider, matched_query, pos, record.
    """
    from adlens.operators import ads as A

    frontier = requests.select("brand", "pos", "term", "quota", "most", "url", F.lit(0).alias("have"))
    read = None
    for k in range(MOST_PAGES):
        met = frontier.join(shuffled(pages.select("url", "status", "body")), "url", "left").withColumn("v", A.parsed(F.col("body")))
        data = F.filter(F.try_variant_get("v", "$.data", "array<variant>"), A.is_ad)
        told = F.try_variant_get("v", "$.error.message", "string")
        bad = F.try_variant_get("v", "$.error", "variant").isNotNull()
        quoted = F.concat(F.lit(' for "'), F.col("term"), F.lit('"'))
        warning = F.when(F.col("body").isNull(), F.concat(F.lit("no page was read"), quoted)).when(F.col("v").isNull(), F.concat(F.lit("the ad library returned no JSON (HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("?")), F.lit(")"), quoted))
        warning = warning.when(bad, F.concat(F.lit("the ad library reports an error"), quoted, F.lit(": "), F.coalesce(told, F.lit("unknown error"))))
        found = F.when(warning.isNull(), F.transform(data, lambda x: F.to_json(x)))
        step = met.select("brand", "pos", "term", "quota", "most", F.lit(k).alias("page"), F.coalesce(found, F.array().cast("array<string>")).alias("found"), warning.alias("warning"), (F.col("have") + F.coalesce(F.size(found), F.lit(0))).alias("have"), F.when(warning.isNull(), F.try_variant_get("v", "$.paging.next", "string")).alias("next"))
        step = written(step, "ad-pages")
        read = step if read is None else read.union(step)
        frontier = step.filter("next is not null and have < quota").select("brand", "pos", "term", "quota", "most", F.col("next").alias("url"), "have")
        if frontier.isEmpty():
            break
    each = read.select("brand", "pos", "term", "quota", "most", "page", F.posexplode("found").alias("nth", "record"))
    place = F.row_number().over(Window.partitionBy("brand", "pos").orderBy("page", "nth"))
    own = each.withColumn("n", place).filter("n <= quota")
    order = F.row_number().over(Window.partitionBy("brand").orderBy("pos", "page", "nth"))
    kept = own.withColumn("place", order).filter("place <= most")
    return kept.select("brand", F.lit("meta-graph").alias("provider"), F.col("term").alias("matched_query"), F.col("place").cast("long").alias("pos"), "record"), read.filter("warning is not null").select("brand", "term", "warning")


def graph_warnings(countries: Sequence[str]) -> tuple[str, ...]:
    """What a search will not find, said beforehand."""
    return () if asks_eu(c.upper() for c in countries) else ("no country asked for has figures for commercial ads: the official interface only returns political and issue ads there; add one, or take the nested provider",)


def nested_requests(terms: DataFrame, countries: Sequence[str], limit: int, status: str = "ALL", extra: Mapping[str, object] | None = None) -> DataFrame:
    """(brand, input): one run request a brand, as JSON: every term in every country as a search address, the terms, the
    limits; a caller's own fields go over these."""
    from adlens.operators.ads import library_url

    asked = [c.upper() for c in countries] or ["US"]
    where = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("country")) for k, c in enumerate(asked)]))
    each = terms.filter("term != ''").select("brand", "pos", "term", where.alias("w")).select("brand", "pos", "term", "w.k", library_url(F.col("term"), F.col("w.country"), F.lit(status)).alias("url"))
    own = each.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "url", "term"))).alias("x"))
    urls = F.transform("x", lambda x: x["url"])
    names = F.array_distinct(F.transform("x", lambda x: x["term"]))
    made = {
        "startUrls": F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit("GET").alias("method"))), "urls": urls, "searchTerms": names, **{n: F.lit(limit) for n in ("count", "resultsLimit", "maxItems")},
        "activeStatus": F.lit(status.lower()), "countryCode": F.lit(asked[0]),
    }
    for name, value in (extra or {}).items():
        made[name] = F.parse_json(F.lit(json.dumps(value)))
    return own.select("brand", F.to_json(F.struct(*[c.alias(n) for n, c in made.items()])).alias("input"))


def ad_archive(fetch: Callable[[str], tuple[int, str]]) -> type[DataSource]:
    """The official interface as a data source, for `spark.dataSource.register`: a partition a term, read page by page by
    fetch(url) -> (status, body) in the executors. Options: terms (a JSON list), countries, limit, status, format "ad_archive"."""

    class Archive(DataSource):
        @classmethod
        def name(cls) -> str:
            return "ad_archive"

        def schema(self) -> str:
            return RAW + ", warning string"

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader(self.options)

    class Reader(DataSourceReader):
        def __init__(self, options: Mapping[str, str]) -> None:
            self.terms = json.loads(options["terms"])
            self.countries, self.status = json.loads(options.get("countries", '["US"]')), options.get("status", "ALL")
            self.quota = per_term(int(options.get("limit", 20)), len(self.terms))

        def partitions(self) -> list[InputPartition]:
            return [InputPartition((k, term)) for k, term in enumerate(self.terms)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            at, term = partition.value
            url, have = graph_url(term, self.countries, self.status, self.quota), 0
            for page in range(MOST_PAGES):
                if not url or have >= self.quota:
                    return
                status, body = fetch(url)
                try:
                    payload = json.loads(body)
                except ValueError:
                    payload = {"error": {"message": f"no JSON (HTTP {status})"}}
                if payload.get("error"):
                    yield "meta-graph", term, at << 32, None, f'the ad library reports an error for "{term}": {payload["error"].get("message", "unknown error")}'
                    return
                for record in payload.get("data", [])[: self.quota - have]:
                    yield "meta-graph", term, (at << 32) + page * 1000 + have, json.dumps(record), None
                    have += 1
                url = payload.get("paging", {}).get("next")

    return Archive


def search(requests: DataFrame, call: Callable[[str, str], Sequence[str]], provider: str) -> DataFrame:
    """One call(term, country) for each request row, in the executors; it returns JSON records. A failing call
    yields no rows: the caller's function decides about retries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for term, country in zip(batch["term"], batch["country"], strict=True):
                rows += [(provider, term, k, r) for k, r in enumerate(call(term, country))]
            yield pd.DataFrame(rows, columns=["provider", "matched_query", "pos", "record"])

    return requests.select("term", "country").mapInPandas(run, RAW)


def fetched(pages: DataFrame) -> DataFrame:
    """Pages (url, status, content_type, body) with ok and error, and JSON bodies kept only below status 400."""
    ok = F.coalesce(F.col("status") < 400, F.lit(False))
    return pages.withColumns({"ok": ok, "error": F.when(~ok, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none")))), "json": F.when(ok & F.col("content_type").contains("json"), F.col("body"))})


def asks_eu(countries: Iterable[str]) -> bool:
    """Whether a search touches a country whose ads carry reach figures."""
    return bool(set(countries) & set(EU_COUNTRIES))


def recover_json(text: str | None) -> object | None:
    """The JSON in a model's answer, fenced or amid prose; None if there is none."""
    import json
    import re

    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in ([fenced[1]] if fenced else []) + [text[a : b + 1] for a, b in ((text.find(x), text.rfind(y)) for x, y in ("{}", "[]")) if 0 <= a < b]:
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None
