"""Copy and vocabulary queries over documents and conversations: a brand is a source, a niche a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.catalogue import query
from adlens.dims import rules
from adlens.functions import score as S
from adlens.functions import text as T
from adlens.functions.lineage import written
from adlens.operators import classify as C
from adlens.operators import copy as X
from adlens.operators import vocabulary as V
from adlens.plans.ads import t

#: Frequent words of the corpus: its prose is invented, so a lexicon is a parameter of these queries.
LEXICON = {"Alpha": {"the": 1.0, "and": 1.5, "that": 2.0}, "Beta": {"with": 2.0, "for": 2.0, "this": 1.0}, "Gamma": {"what": 3.0, "ing the": 2.0, "of the": 1.0}}

_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9%$£€''\".,!?/+\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("word_count", f"SELECT doc_id, CAST(len(list_filter(string_split({_CLEAN}, ' '), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("sentence_split", f"SELECT doc_id, CAST(1 + len(regexp_extract_all({_CLEAN}, '[.!?…] [A-Z0-9\"''“‘(]')) AS BIGINT) AS sentences FROM documents WHERE text <> ''")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text != ''").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("normalise_text", f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(T.normalise(F.col("text")).cast("binary")).alias("folded"))


@query("token_count", f"SELECT doc_id, CAST(len(list_filter(string_split_regex({_FOLD}, '[^a-z0-9''+-]+'), lambda x: length(x) > 1)) AS BIGINT) AS tokens FROM documents")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.token_count(T.normalise(F.col("text"))).cast("long").alias("tokens"))


@query("truncate_text", f"SELECT doc_id, CASE WHEN length({_CLEAN}) <= 60 THEN {_CLEAN} ELSE rtrim(substr({_CLEAN}, 1, 59)) || '…' END AS short FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.truncate(F.col("text"), 60).alias("short"))


@query("escape_html", "SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM conversations")
def escape_html(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", T.escape_html(F.col("text")).alias("html"))


_PADDED = "' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +', '  ', 'g')) || ' '"


def _terms_sql() -> str:
    rows = [(n, w, x) for n, terms in LEXICON.items() for w, x in terms.items()]
    return "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, '{w}', CAST({x} AS DOUBLE))" for k, (n, w, x) in enumerate(rows)) + ") AS v(niche, pos, term, weight))"


_HITS = f"""{_terms_sql()}, p AS (SELECT doc_id, {_PADDED} AS padded FROM documents),
hits AS (SELECT doc_id, niche, pos, term, weight, CAST((length(padded) - length(replace(padded, ' ' || replace(term, ' ', '  ') || ' ', ''))) / (length(replace(term, ' ', '  ')) + 2) AS BIGINT) AS hits FROM p CROSS JOIN lex)"""


def folded(spark: SparkSession, d: str) -> DataFrame:
    """The same words on both sides: only letters and digits count here, so that SQL can state it."""
    return docs(spark, d).select(F.col("doc_id").alias("id"), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("text"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, n, k, w, x) for k, (n, terms) in enumerate(LEXICON.items()) for w, x in terms.items()], "niche string, sub string, sub_pos int, term string, weight double")


@query("term_count_lexicon", f"WITH {_HITS} SELECT doc_id AS id, term, hits FROM hits WHERE hits > 0")
def term_count_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return C.term_hits(folded(spark, d), lexicon(spark)).withColumn("hits", F.col("hits").cast("long"))


@query(
    "classify_lexicon",
    f"""WITH {_HITS}, s AS (SELECT doc_id, niche, min(pos) AS pos, sum(least(3.0, 1 + log2(hits)) * weight) AS raw FROM hits WHERE hits > 0 GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, pos) AS n FROM s) SELECT doc_id AS id, niche, floor(100 * (1 - exp(-(raw * 1.25) / 14)) + 0.5) AS confidence FROM b WHERE n = 1""",
)
def classify_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(C.term_hits(folded(spark, d), lexicon(spark)), lexicon(spark)).select("id", "niche", "confidence")


@query(
    "audience_argmax",
    f"WITH {_HITS}, s AS (SELECT doc_id, niche, min(pos) AS pos, sum(least(3.0, 1 + log2(hits)) * weight) AS score FROM hits WHERE hits > 0 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS n FROM s) SELECT doc_id AS id, niche AS audience FROM b WHERE n = 1 AND score >= 4",
)
def audience_argmax(spark: SparkSession, d: str) -> DataFrame:
    terms = lexicon(spark).select(F.col("niche").alias("audience"), F.col("sub_pos").alias("pos"), "term", "weight")
    return C.audience(C.term_hits(folded(spark, d), terms), terms).select("id", "audience")


_STOP = "[" + ", ".join(f"'{w}'" for w in rules.STOPWORDS) + "]"
#: Grams of one to four words inside sentences; sentence ends become a mark that no token matches.
_GRAMS = f"""sent AS (SELECT doc_id, source, unnest(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?…]) ([A-Z0-9"''“‘(])', '\\1\x01\\2', 'g'), '\x01')) AS s FROM documents),
tok AS (SELECT doc_id, source, list_filter(string_split_regex(regexp_replace(regexp_replace(strip_accents(lower(s)), '[^a-z0-9%$£€''".,!?/+\\-\\s]', ' ', 'g'), '([0-9]),([0-9]{{3}})\\b', '\\1\\2', 'g'), '[^a-z0-9''+-]+'), lambda x: x <> '') AS w FROM sent),
one AS (SELECT doc_id, source, w, unnest(range(1, len(w) + 1)) AS i FROM tok), g AS (SELECT doc_id, source, w[i:i + k - 1] AS g FROM one, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
gram AS (SELECT doc_id, source, array_to_string(g, ' ') AS term FROM g WHERE NOT list_contains({_STOP}, g[1]) AND NOT list_contains({_STOP}, g[-1]) AND NOT regexp_matches(g[-1], '^[0-9]+$') AND len(list_filter(g, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$'))) > 0)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("source").alias("brand"), F.col("doc_id").alias("ad"), "text", F.lit(50.0).alias("exposure"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(F.col("source").alias("brand")).agg(F.count("*").alias("total"))


@query("ngram_document_frequency", f"WITH {_GRAMS} SELECT term, count(DISTINCT doc_id) AS ad_count, count(*) AS total_count FROM gram GROUP BY term HAVING count(DISTINCT doc_id) >= 5")
def ngram_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = V.grams(texts(spark, d), [])
    return V.summed(rows, [], ad_count="ads", total_count="n").filter("ad_count >= 5")


def stats(spark: SparkSession, d: str) -> DataFrame:
    return V.term_stats(V.frequent_grams(texts(spark, d), totals(spark, d), ["brand"]), totals(spark, d), ["brand"])


_STATS = f"""{_GRAMS}, tot AS (SELECT source, count(*) AS total FROM documents GROUP BY 1),
st AS (SELECT source AS brand, term, count(DISTINCT doc_id) AS ad_count, count(*) AS total_count, any_value(total) AS total FROM gram JOIN tot USING (source) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= greatest(2, ceil(any_value(total) * 0.15))),
sh AS (SELECT brand, term, ad_count, total_count, floor(ad_count / total * 1000 + 0.5) / 10 AS ad_share, 1 + length(term) - length(replace(term, ' ', '')) AS words FROM st)"""


@query("brand_term_stats", f"WITH {_STATS} SELECT brand, term, ad_count, ad_share, total_count FROM sh")
def brand_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d).select("brand", "term", "ad_count", "ad_share", "total_count")


_FOLDED = f"""{_STATS}, lw AS (SELECT brand, ad_count, words, string_split(term, ' ') AS p, unnest(range(1, words + 1)) AS i FROM sh WHERE words > 1), lg AS (SELECT brand, array_to_string(p[i:i + k - 1], ' ') AS term, ad_count AS longer FROM lw, (SELECT unnest([1, 2, 3]) AS k) WHERE k < words AND i + k - 1 <= words),
kept AS (SELECT sh.* FROM sh LEFT JOIN (SELECT brand, term, max(longer) AS longer FROM lg GROUP BY 1, 2) m USING (brand, term) WHERE longer IS NULL OR ad_count > longer * 1.25),
sig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY ad_share DESC, words DESC, term) AS place FROM kept) WHERE place <= 40)"""


def signature(spark: SparkSession, d: str) -> DataFrame:
    return V.rank(V.prefer_longer(stats(spark, d), ["brand"]), ["brand"], 40)


@query("signature_terms", f"WITH {_FOLDED} SELECT brand, term, ad_share, place FROM sig")
def signature_terms(spark: SparkSession, d: str) -> DataFrame:
    return signature(spark, d).select("brand", "term", "ad_share", F.col("place").cast("long").alias("place"))


@query("signature_terms_refined")
def signature_terms_refined(spark: SparkSession, d: str) -> DataFrame:
    return V.drop_shifted(V.rank(V.prefer_longer(stats(spark, d), ["brand"]), ["brand"]), ["brand"], 40).select("brand", "term", "ad_share", "place")


_NICHE = f"""{_FOLDED}, own AS (SELECT 'n' || CAST(CAST(substr(brand, 4) AS INTEGER) % 4 AS VARCHAR) AS niche, * FROM sig), nb AS (SELECT niche, count(DISTINCT brand) AS brands FROM own GROUP BY 1),
nt AS (SELECT niche, term, count(*) AS brand_count, ((2 * sum(CAST(round(ad_share * 10) AS BIGINT)) + count(*)) // (2 * count(*))) / 10 AS avg_ad_share, any_value(brands) AS brands FROM own JOIN nb USING (niche) GROUP BY 1, 2 HAVING count(*) >= CASE WHEN any_value(brands) >= 3 THEN 2 ELSE 1 END),
nv AS (SELECT * FROM (SELECT niche, term, brand_count, avg_ad_share, floor(brand_count / brands * 1000 + 0.5) / 10 AS brand_share, row_number() OVER (PARTITION BY niche ORDER BY brand_count DESC, avg_ad_share DESC, term) AS place FROM nt) WHERE place <= 40)"""


def _own(spark: SparkSession, d: str) -> DataFrame:
    """Written, as a niche's terms are read along several ways."""
    return written(signature(spark, d), "signatures").withColumn("niche", F.concat(F.lit("n"), (F.substring("brand", 4, 9).cast("int") % 4).cast("string")))


@query("niche_vocabulary", f"WITH {_NICHE} SELECT niche, term, brand_count, brand_share, avg_ad_share, place FROM nv")
def niche_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return V.niche_vocabulary(_own(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(
    "distinctive_terms",
    f"""WITH {_NICHE}, k AS (SELECT own.* FROM own JOIN nv USING (niche, term)), b AS (SELECT niche, brand, term, CASE WHEN count(*) OVER w > 1 THEN ((2 * (sum(CAST(round(ad_share * 10) AS BIGINT)) OVER w - CAST(round(ad_share * 10) AS BIGINT)) + count(*) OVER w - 1) // (2 * (count(*) OVER w - 1))) / 10 ELSE 0 END AS base FROM k WINDOW w AS (PARTITION BY niche, term)),
    l AS (SELECT own.niche, own.brand, own.term, own.ad_share, own.words, coalesce(base, 0.0) AS niche_ad_share FROM own LEFT JOIN b ON own.niche = b.niche AND own.brand = b.brand AND own.term = b.term),
    f AS (SELECT *, floor(ad_share / greatest(5, niche_ad_share) * 100 + 0.5) / 100 AS lift FROM l) SELECT brand, term, lift, niche_ad_share FROM (SELECT *, row_number() OVER (PARTITION BY niche, brand ORDER BY lift DESC, words DESC, ad_share DESC, term) AS place FROM f WHERE lift > 1.3 AND ad_share >= 40) WHERE place <= 8""",
)
def distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    own = _own(spark, d)
    return V.distinctive(own, V.niche_vocabulary(own)).select("brand", "term", "lift", "niche_ad_share")


@query("copy_hooks", "SELECT conv_id, turn, CASE WHEN regexp_matches(h, '\\?\\s*$') THEN 'question' WHEN regexp_matches(h, '(?i)^(attention|calling all|hey |psa|to (all|every) )') THEN 'call-out' WHEN regexp_matches(h, '\\b\\d{1,3}\\s?%|\\b\\d[\\d,]{2,}\\b') THEN 'statistic' WHEN regexp_matches(h, '(?i)^(warning|stop|don''?t|never|beware|read this before)') THEN 'warning' WHEN regexp_matches(h, '(?i)^(try|get|meet|discover|start|switch|ditch|throw out|say goodbye)') THEN 'command' WHEN regexp_matches(h, '(?i)^(the (real|one|weird|surprising)|this is (why|what|how)|nobody|turns out|here''?s (why|what|how))') THEN 'curiosity-gap' WHEN regexp_matches(h, '(?i)^(i |my |we |after (years|months)|\\d+ (years|months) ago)') THEN 'first-person-story' WHEN regexp_matches(h, '(?i)^(unlike|most (people|brands|men|women)|everyone (thinks|says))') THEN 'comparison' WHEN regexp_matches(h, '(?i)^(if you|when you|ever (felt|had|woken))') THEN 'relatable-pain' WHEN regexp_matches(h, '(?i)^(\\d{1,2}% off|save|free |buy one|limited time|today only)') THEN 'offer-led' ELSE 'statement' END AS hook_type FROM (SELECT *, trim(text) AS h FROM conversations)")
def copy_hooks(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", X.hook_type(F.col("text")).alias("hook_type"))


@query("brand_vocabulary")
def brand_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    ads = docs(spark, d).select(F.col("source").alias("brand"), F.col("doc_id").alias("ad"), F.lit(50.0).alias("exposure"), F.lit("").alias("title"), F.col("text").alias("body"), F.lit("").alias("link_description"), F.lit("").alias("cta_text"))
    ads = ads.withColumn("hook", X.hook(F.col("body"))).withColumn("angles", F.array(F.concat(F.lit("a"), (F.col("ad") % 3).cast("string"))))
    brands = docs(spark, d).select(F.col("source").alias("brand")).distinct().withColumn("names", F.array("brand"))
    return V.brand_vocabulary(ads, brands).select("brand", "slot", "term", "ad_count", "ad_share", "place")


@query("vocabulary_summary")
def vocabulary_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.summary(signature(spark, d), ["brand"])


@query("json_key_family", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_key_family(spark: SparkSession, d: str) -> DataFrame:
    from adlens.operators.ads import parsed, pick_string

    return t(spark, d, "events").select("event_id", pick_string(parsed(F.col("props")), "missing k").alias("k"))


@query("share_and_counts", "SELECT source, count(*) AS docs, floor(count(*) FILTER (WHERE lang = 'en') / count(*) * 1000 + 0.5) / 10 AS english FROM documents GROUP BY source")
def share_and_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("docs"), S.share(F.count_if(F.col("lang") == "en"), F.count("*")).alias("english"))
