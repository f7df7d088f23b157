"""Copy analysis over ads: an ad is an order, its copy phrases picked by the order's figures; SQL builds the same copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.catalogue import query
from adlens.dims import rules
from adlens.functions import text as T
from adlens.operators import classify as C
from adlens.operators import copy as X
from adlens.operators import vocabulary as V
from adlens.plans.ads import t

PHRASES = (
    "Tired of the same problem every morning?", "The struggle is real and you are not alone.", "Here's how it works: step 1 is simple.", "Backed by 12 clinical studies.", "9 out of 10 customers saw results in 14 days.",
    "Unlike other brands, we never cut corners.", "Shop now and get 20% off today only!", "Free shipping over $50, always!", "Use code SAVE10 at checkout.", "I tried everything before this.",
    "My skin has never looked better, honestly.", "Our founder started this in a garage.", "Dermatologists recommend it.", "30-day money back guarantee.", "Only 3 left, almost gone.",
    "Made with organic ingredients and 25 mg of zinc.", "Say goodbye to bloating for good.", "Discover the secret nobody talks about.", "It supports better sleep and reduces stress.", "Buy one get one free this weekend.",
    "Join 10,000 happy customers.", "As seen in Vogue and Forbes.", "Warning: read this before you buy.", "For busy moms who need energy.", "Save $15 when you subscribe.",
    "Imagine waking up with confidence.", "Don't miss out, the sale ends tonight.", "Proven to improve focus by 40%.", "This simple routine changed my life.", "Learn more about our mission.",
    "1. It lasts longer.", "What if you could feel ten years younger?", "Stop wasting money on things that fail.", "Love it or your money back, no risk.", "A gentle formula with no parabens.", "Get started with a free trial.",
)
_N = len(PHRASES)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The SQL of an ad's copy: ad, body.
ADS = (
    "ph AS (SELECT [" + ", ".join(sql_str(p) for p in PHRASES) + f"""] AS p),
one AS (SELECT o_orderkey AS ad, o_custkey AS brand, p[1 + o_orderkey % {_N}] || ' ' || p[1 + (o_orderkey // {_N}) % {_N}] || chr(10) || p[1 + (o_orderkey * 5 + 3) % {_N}] AS body FROM orders, ph),
ad AS (SELECT ad, brand, CASE WHEN ad % 97 = 0 THEN repeat(body || ' ', 14) ELSE body END AS body FROM one)"""
)
_FLAT = "trim(regexp_replace(body, '\\s+', ' ', 'g'))"
_WORDS = f"len(list_filter(string_split({_FLAT}, ' '), lambda x: x <> ''))"
_SENTENCES = f"string_split(regexp_replace({_FLAT}, '([.!?…]) ([A-Z0-9\"''“‘(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def short(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE rtrim(substr({x}, 1, {most - 1})) || '…' END"


def ads(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.array(*[F.lit(x) for x in PHRASES])

    def pick(n: Column) -> Column:
        return F.get(p, (n % _N).cast("int"))

    body = F.concat(pick(k), F.lit(" "), pick(F.floor(k / _N)), F.lit("\n"), pick(k * 5 + 3))
    return t(spark, d, "orders").select(k.alias("ad"), F.col("o_custkey").alias("brand"), F.when(k % 97 == 0, F.repeat(F.concat(body, F.lit(" ")), F.lit(14))).otherwise(body).alias("body"))


def _hits(pattern: str, flags: str = "i") -> str:
    return f"len(regexp_extract_all(body, {sql_str((f'(?{flags})' if flags else '') + pattern)}))"


def _angles_sql() -> str:
    patterns = rules.table(rules.ANGLE_PATTERNS)
    counts = ", ".join(f"{_hits(p)} AS m{k}" for k, (_, _, p) in enumerate(patterns))
    each = []
    for pos, (key, _, _) in enumerate(rules.table(rules.ANGLES)):
        raw = " + ".join(f"CAST({w} AS DOUBLE) * least(3, m{k})" for k, (name, w, _) in enumerate(patterns) if name == key)
        each.append(f"{{'o': -floor(least(100.0, (1 - exp(-({raw}) / 5)) * 100) + 0.5), 'pos': {pos}, 'angle': '{key}'}}")
    return f"m AS (SELECT ad, {counts} FROM ad), ang AS (SELECT ad, list_sort(list_filter([{', '.join(each)}], lambda x: x.o <= -20))[:6] AS found FROM m)"


def _awareness_sql() -> str:
    table = rules.table(rules.AWARENESS)
    order = list(dict.fromkeys(stage for stage, _, _ in table))
    counts = ", ".join(f"{_hits(p)} AS n{k}" for k, (_, _, p) in enumerate(table))
    each = []
    for bump, (keys, stage, points) in enumerate(rules.AWARENESS_BUMPS):
        by_rule = "(" + " + ".join(f"CAST({w} AS DOUBLE) * least(3, n{k})" for k, (s, w, _) in enumerate(table) if s == stage) + ")"
        has = f"list_has_any(list_transform(found, lambda x: x.angle), [{', '.join(sql_str(k) for k in keys)}])"
        each.append(f"{{'neg': -({by_rule} + CASE WHEN {has} THEN {points} ELSE 0.0 END), 'first': CASE WHEN {by_rule} > 0 THEN {order.index(stage)} ELSE {len(order) + bump} END, 'stage': '{stage}'}}")
    return f"na AS (SELECT ad.ad, body, found, {counts} FROM ad JOIN ang USING (ad)), aw AS (SELECT ad, coalesce(list_sort(list_filter([{', '.join(each)}], lambda x: x.neg < 0))[1].stage, CASE WHEN {_WORDS} < 25 THEN 'most-aware' ELSE 'solution-aware' END) AS awareness FROM na)"


_FORMAT = (
    "CASE " + " ".join(
        f"WHEN regexp_matches(body, {sql_str((f'(?{fl})' if fl else '') + p)})" + (f" AND {_WORDS} >= {lo}" if lo else "") + (f" AND {_WORDS} <= {hi}" if hi else "") + f" THEN '{name}'" for name, fl, lo, hi, p in rules.FORMATS
    ) + f" WHEN {_WORDS} <= 60 THEN 'short-copy' ELSE 'long-copy' END"
)
_EMOTIONS = "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'neg': -{_hits(p)}, 'pos': {k}, 'name': '{n}'}}" for k, (n, p) in enumerate(rules.table(rules.EMOTIONS))) + "], lambda x: x.neg < 0))[:5], lambda x: x.name), ',')"


def _offers_sql() -> str:
    each = []
    for kind, p in rules.table(rules.OFFERS):
        own = f"list_transform(regexp_extract_all(body, {sql_str('(?i)' + p)})[:2], lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
        each.append(f"list_transform(CASE WHEN len({own}) = 2 AND lower({own}[1]) = lower({own}[2]) THEN {own}[:1] ELSE {own} END, lambda x: '{kind}:' || x)")
    return f"array_to_string(flatten([{', '.join(each)}]), '|')"


_CLAIMS = f"array_to_string(list_transform(list_filter({_SENTENCES}, lambda s: regexp_matches(s, {sql_str('(?i)' + rules.CLAIM)}) AND length(s) <= 220)[:6], lambda s: {short('s', 200)}), '|')"
_CTA = f"nullif(trim(regexp_replace(regexp_extract(body, {sql_str('(?i)' + rules.CTA)}, 0), '\\s+', ' ', 'g')), '')"
_HOOK = short(f"{_SENTENCES}[1]", 220)
_HOOK_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(trim(hook), {sql_str((f'(?{fl})' if fl else '') + p)}) THEN '{n}'" for n, fl, p in rules.table(rules.HOOKS)) + " ELSE 'statement' END"
_SYLLABLES = "(CASE WHEN length(regexp_replace(lower(w), '[^a-z]', '', 'g')) = 0 THEN 0 WHEN length(regexp_replace(lower(w), '[^a-z]', '', 'g')) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(w), '[^a-z]', '', 'g'), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END)"


def ease_sql(table: str, key: str) -> str:
    """Words with a letter, sentences and syllables of `body` in a table, and the reading ease."""
    return f"""w AS (SELECT {key}, list_filter(string_split({_FLAT}, ' '), lambda x: regexp_matches(x, '[A-Za-z]')) AS ws, len(list_filter({_SENTENCES}, lambda x: trim(x) <> '')) AS lines FROM {table}),
z AS (SELECT {key}, len(ws) AS n, lines, CAST(coalesce(list_sum(list_transform(ws, lambda w: {_SYLLABLES})), 0) AS BIGINT) AS syllables FROM w),
re AS (SELECT {key}, n AS words, lines AS sentences, syllables, CASE WHEN n = 0 OR lines = 0 THEN 0.0 ELSE floor(greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * (n / lines) - 84.6::DOUBLE * (syllables / n))) + 0.5) END AS ease FROM z)"""


@query("angle_scores", f"WITH {ADS}, {_angles_sql()} SELECT ad, array_to_string(list_transform(found, lambda x: x.angle || ':' || CAST(CAST(-x.o AS BIGINT) AS VARCHAR)), ',') AS angles FROM ang")
def angle_scores(spark: SparkSession, d: str) -> DataFrame:
    """J3, A7, F11."""
    told = F.array_join(F.transform(X.angles(F.col("body")), lambda a: F.concat_ws(":", a["angle"], a["score"].cast("long"))), ",")
    return X.per_copy(ads(spark, d), ["body"], lambda c: c.withColumn("angles", told)).select("ad", "angles")


@query("awareness_stage", f"WITH {ADS}, {_angles_sql()}, {_awareness_sql()} SELECT ad, awareness FROM aw")
def awareness_stage(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    found, told = F.transform(X.angles(F.col("body")), lambda x: x["angle"]), X.awareness(F.col("body"), F.col("found"))
    return X.per_copy(ads(spark, d), ["body"], lambda c: c.withColumn("found", found).withColumn("awareness", told)).select("ad", "awareness")


@query("emotion_tags", f"WITH {ADS} SELECT ad, {_EMOTIONS} AS emotions FROM ad")
def emotion_tags(spark: SparkSession, d: str) -> DataFrame:
    """J4."""
    return ads(spark, d).select("ad", F.array_join(X.emotions(F.col("body")), ",").alias("emotions"))


@query("offer_matches", f"WITH {ADS} SELECT ad, {_offers_sql()} AS offers FROM ad")
def offer_matches(spark: SparkSession, d: str) -> DataFrame:
    """J5."""
    told = F.array_join(F.transform(X.offers(F.col("body")), lambda o: F.concat_ws(":", o["kind"], o["detail"])), "|")
    return X.per_copy(ads(spark, d), ["body"], lambda c: c.withColumn("offers", told)).select("ad", "offers")


@query("offer_rollup", f"WITH {ADS}, o AS (SELECT ad, brand, unnest(string_split({_offers_sql()}, '|')) AS x FROM ad), s AS (SELECT ad, brand, split_part(x, ':', 1) AS kind, substr(x, strpos(x, ':') + 1) AS detail FROM o WHERE x <> '') SELECT brand, kind, detail, n, place FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, kind, detail) AS place FROM (SELECT brand, kind, arg_min(detail, ad) AS detail, count(*) AS n FROM s GROUP BY brand, kind, lower(detail))) WHERE place <= 8")
def offer_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    a = ads(spark, d).select("brand", F.col("ad").alias("pos"), "body")
    a = X.per_copy(a, ["body"], lambda c: c.withColumn("offers", X.offers(F.col("body")))).drop("body")
    return X.offer_counts(a, ["brand"], 8).withColumn("place", F.col("place").cast("long"))


@query("copy_formats", f"WITH {ADS} SELECT ad, {_FORMAT} AS format FROM ad")
def copy_formats(spark: SparkSession, d: str) -> DataFrame:
    """X19."""
    return ads(spark, d).select("ad", X.copy_format(F.col("body"), T.word_count(F.col("body"))).alias("format"))


@query("copy_claims", f"WITH {ADS} SELECT ad, {_CLAIMS} AS claims FROM ad")
def copy_claims(spark: SparkSession, d: str) -> DataFrame:
    """X21."""
    return ads(spark, d).select("ad", F.array_join(X.claims(F.col("body")), "|").alias("claims"))


@query("copy_proof", f"WITH {ADS} SELECT ad, array_to_string(list_transform(list_distinct_in_order[:10], lambda x: x), '|') AS proof FROM (SELECT ad, list_filter(ms, lambda x, i: list_position(ms, x) = i) AS list_distinct_in_order FROM (SELECT ad, list_transform(regexp_extract_all(body, {sql_str('(?i)' + rules.PROOF.replace('(?![a-z0-9])', ''))}), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS ms FROM ad))")
def copy_proof(spark: SparkSession, d: str) -> DataFrame:
    """X20; no figure in these phrases is followed by a letter or digit, so SQL does without the look-ahead."""
    return ads(spark, d).select("ad", F.array_join(X.proof_points(F.col("body")), "|").alias("proof"))


@query("copy_cta", f"WITH {ADS} SELECT ad, {_CTA} AS cta, coalesce(CASE WHEN ad % 3 = 0 THEN 'Book a call' END, {_CTA}) AS told FROM ad")
def copy_cta(spark: SparkSession, d: str) -> DataFrame:
    """X22."""
    return ads(spark, d).select("ad", X.call_to_action(F.col("body")).alias("cta"), X.call_to_action(F.col("body"), F.when(F.col("ad") % 3 == 0, " Book  a call ").otherwise(" ")).alias("told"))


@query("copy_hook", f"WITH {ADS}, h AS (SELECT ad, {_HOOK} AS hook FROM ad) SELECT ad, hook, {_HOOK_TYPE} AS hook_type FROM h")
def copy_hook(spark: SparkSession, d: str) -> DataFrame:
    """X18."""
    return ads(spark, d).withColumn("hook", X.hook(F.col("body"))).select("ad", "hook", X.hook_type(F.col("hook")).alias("hook_type"))


@query("top_hooks", f"WITH {ADS}, h AS (SELECT ad, brand, {_HOOK} AS hook FROM ad) SELECT brand, array_to_string(list(hook ORDER BY n), '|') AS hooks FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY ad DESC) AS n FROM h) WHERE n <= 10 GROUP BY brand")
def top_hooks(spark: SparkSession, d: str) -> DataFrame:
    """W9, in order of exposure; here the later order has more."""
    a = ads(spark, d).select("brand", F.col("ad").cast("double").alias("exposure"), F.col("ad").alias("pos"), X.hook(F.col("body")).alias("hook"))
    return X.top_hooks(a, ["brand"], 10).select("brand", F.array_join("hooks", "|").alias("hooks"))


@query("copy_text", "SELECT p_partkey AS part, concat_ws(chr(10), p_name, CASE WHEN p_size > 10 THEN p_type END, p_brand) AS copy FROM part")
def copy_text(spark: SparkSession, d: str) -> DataFrame:
    """X17."""
    return t(spark, d, "part").select(F.col("p_partkey").alias("part"), X.copy_of(F.col("p_name"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(" "), F.lit(None).cast("string"), F.col("p_brand")).alias("copy"))


@query("ad_reading_ease", f"WITH {ADS}, {ease_sql('ad', 'ad')} SELECT ad, ease FROM re")
def ad_reading_ease(spark: SparkSession, d: str) -> DataFrame:
    """X8, A36."""
    return ads(spark, d).select("ad", T.reading_ease(F.col("body")).alias("ease"))


@query("syllable_counts", f"SELECT w AS word, {_SYLLABLES} AS syllables FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)")
def syllable_counts(spark: SparkSession, d: str) -> DataFrame:
    """X7 over every word of the corpus."""
    words = t(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.syllables(F.col("word")).cast("long").alias("syllables"))


@query(
    "ad_analysis",
    f"""WITH {ADS}, {_angles_sql()}, {_awareness_sql()}, {ease_sql('ad', 'ad')}, h AS (SELECT ad, {_HOOK} AS hook FROM ad)
    SELECT ad, {_WORDS} AS words, found[1].angle AS primary_angle, awareness, {_HOOK_TYPE} AS hook_type, {_FORMAT} AS format, {_EMOTIONS} AS emotions, {_offers_sql()} AS offers, {_CLAIMS} AS claims, {_CTA} AS cta, ease AS reading_ease
    FROM ad JOIN ang USING (ad) JOIN aw USING (ad) JOIN h USING (ad) JOIN re USING (ad)""",
)
def ad_analysis(spark: SparkSession, d: str) -> DataFrame:
    """X23."""
    a = ads(spark, d).withColumns({"title": F.lit(""), "link_description": F.lit(None).cast("string"), "cta_text": F.lit("")})
    out = X.per_copy(a, ["title", "body", "link_description", "cta_text"], X.analyse)
    return out.select(
        "ad", F.col("words").cast("long").alias("words"), "primary_angle", "awareness", "hook_type", "format", F.array_join("emotions", ",").alias("emotions"),
        F.array_join(F.transform("offers", lambda o: F.concat_ws(":", o["kind"], o["detail"])), "|").alias("offers"), F.array_join("claims", "|").alias("claims"), "cta", "reading_ease",
    )


@query("angle_descriptions", f"WITH {ADS}, {_angles_sql()}, lib AS (SELECT * FROM (VALUES " + ", ".join(f"({sql_str(k)}, {sql_str(label)}, {sql_str(told)})" for k, label, told in rules.table(rules.ANGLES)) + ") v(angle, label, description)) SELECT ad, label, description FROM ang LEFT JOIN lib ON lib.angle = found[1].angle")
def angle_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """J21."""
    a = X.per_copy(ads(spark, d), ["body"], lambda c: c.withColumn("angle", F.get(X.angles(F.col("body")), 0)["angle"])).select("ad", "angle")
    told = X.described(F.col("angle"))
    return a.select("ad", told["label"].alias("label"), told["description"].alias("description"))


@query("number_formats", "SELECT o_orderkey AS id, CASE WHEN v >= 1e6 THEN printf('%.1fM', floor(v / 1e5 + 0.5) / 10) WHEN v >= 1e3 THEN printf('%.1fk', floor(v / 1e2 + 0.5) / 10) ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) END AS told FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN floor(o_totalprice) * 10 WHEN o_orderstatus = 'F' THEN floor(o_totalprice) ELSE floor(o_totalprice / 500) END AS v FROM orders)")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    """X13."""
    v, s = F.floor("o_totalprice").cast("double"), F.col("o_orderstatus")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.format_count(F.when(s == "P", v * 10).when(s == "F", v).otherwise(F.floor(F.col("o_totalprice") / 500).cast("double"))).alias("told"))


@query("number_parses", "SELECT id, CASE WHEN id % 4 = 0 THEN floor(q * 100 + 0.5) WHEN id % 4 = 1 THEN q * 1000 WHEN id % 4 = 2 THEN q * 1000000 ELSE 0.0 END AS parsed FROM (SELECT o_orderkey AS id, CAST(o_orderkey % 977 AS DOUBLE) AS q FROM orders)")
def number_parses(spark: SparkSession, d: str) -> DataFrame:
    """1,200 and 12k and 2m and what is no number."""
    k = F.col("o_orderkey")
    q = (k % 977).cast("string")
    told = F.when(k % 4 == 0, F.concat(q, F.lit(",00"))).when(k % 4 == 1, F.concat(q, F.lit("k"))).when(k % 4 == 2, F.concat(F.lit(" "), q, F.lit("M"))).otherwise("many")
    return t(spark, d, "orders").select(k.alias("id"), T.parse_count(told).alias("parsed"))


@query("first_numbers", f"WITH {ADS} SELECT ad, TRY_CAST(replace(regexp_extract(body, '(\\d[\\d,]*)', 1), ',', '') AS DOUBLE) AS n FROM ad")
def first_numbers(spark: SparkSession, d: str) -> DataFrame:
    """X15."""
    return ads(spark, d).select("ad", T.first_number(F.col("body"), r"(\d[\d,]*)").alias("n"))


@query("title_cases", "SELECT p_partkey AS id, array_to_string(list_transform(string_split(x, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title FROM (SELECT p_partkey, p_name || ' ' || p_type AS x FROM part)")
def title_cases(spark: SparkSession, d: str) -> DataFrame:
    """X10."""
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.title_case(F.concat_ws(" ", "p_name", "p_type")).alias("title"))


@query("session_ids", "SELECT c_custkey AS id, CASE WHEN x = '' THEN 'session' ELSE x END AS session FROM (SELECT c_custkey, substr(regexp_replace(regexp_replace(CASE WHEN c_custkey % 10 = 0 THEN '//' ELSE c_name || ' / ' || c_mktsegment || ' !' END, '[^\\w._~]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) AS x FROM customer)")
def session_ids(spark: SparkSession, d: str) -> DataFrame:
    """X31."""
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k.alias("id"), T.session_id(F.when(k % 10 == 0, "//").otherwise(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit(" !")))).alias("session"))


_COMPANY = "CASE k % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' WHEN 2 THEN ' Ltd' WHEN 3 THEN '® Corp' ELSE '' END"
_FOLD_COMPANY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '(?i)[,\\s]+(?:" + rules.LEGAL_FORMS.replace("\n", "").replace("'", "''") + ")\\s*$', ''), '[®™©]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("company_names", f"SELECT k AS id, {_FOLD_COMPANY.format(x='x')} AS folded, replace({_FOLD_COMPANY.format(x='x')}, ' ', '') = replace({_FOLD_COMPANY.format(x='y')}, ' ', '') AS same FROM (SELECT k, s_name || {_COMPANY} AS x, CASE WHEN k % 2 = 0 THEN upper(replace(s_name, '#', ' ')) ELSE s_name || 'x' END AS y FROM (SELECT s_suppkey AS k, s_name FROM supplier))")
def company_names(spark: SparkSession, d: str) -> DataFrame:
    """X26, X27."""
    k, n = F.col("s_suppkey"), F.col("s_name")
    form = F.element_at(F.array(*[F.lit(x) for x in (" Inc.", ", LLC", " Ltd", "® Corp", "")]), (k % 5 + 1).cast("int"))
    x, y = F.concat(n, form), F.when(k % 2 == 0, F.upper(F.replace(n, F.lit("#"), F.lit(" ")))).otherwise(F.concat(n, F.lit("x")))
    return t(spark, d, "supplier").select(k.alias("id"), T.company_name(x).alias("folded"), T.names_match(x, y).alias("same"))


@query("name_filters", "SELECT p_partkey AS id, length(x) BETWEEN 3 AND 90 AND NOT regexp_matches(x, '(?i)^(home|shop|cart|menu|search|login|account|about|contact|blog|faq|sale|new|all)$') AND NOT regexp_matches(x, '(?i)(add to cart|view all|learn more|read more|shop now|see all|sign up|subscribe)') AS product, length(x) BETWEEN 4 AND 60 AND lower(x) <> lower(p_name) AND NOT regexp_matches(x, '(?i)^(gift card|e-?gift|sample|bundle|subscription|shop all|all products)') AS useful FROM (SELECT *, CASE p_size % 6 WHEN 0 THEN 'Shop' WHEN 1 THEN 'Gift card ' || p_name WHEN 2 THEN p_name || ' - add to cart' ELSE p_name END AS x FROM part)")
def name_filters(spark: SparkSession, d: str) -> DataFrame:
    """F7, F8."""
    s, n = F.col("p_size") % 6, F.col("p_name")
    x = F.when(s == 0, "Shop").when(s == 1, F.concat(F.lit("Gift card "), n)).when(s == 2, F.concat(n, F.lit(" - add to cart"))).otherwise(n)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.product_name(x).alias("product"), T.useful_query(x, n).alias("useful"))


@query("anchor_points", f"SELECT x AS anchor, CASE WHEN x = '' THEN -4 WHEN regexp_matches(x, {sql_str('(?i)' + rules.GENERIC_ANCHORS)}) THEN -6 WHEN n > 8 THEN -2 ELSE 6 + CASE WHEN n <= 4 THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '^[A-Z0-9]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(x, '^.+[A-Z]') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(x, '[.!?]$') THEN 3 ELSE 0 END END AS points FROM (SELECT x, len(list_filter(string_split(x, ' '), lambda w: w <> '')) AS n FROM (SELECT DISTINCT trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM (SELECT unnest(['click here', 'Shop Now', p_name, p_brand || ' ' || p_name, p_type || '!', p_name || ' ' || p_name || ' ' || p_name || ' ' || p_name || ' ' || p_type, '']) AS x FROM part)))")
def anchor_points(spark: SparkSession, d: str) -> DataFrame:
    """X30."""
    n = F.col("p_name")
    each = F.array(F.lit("click here"), F.lit("Shop Now"), n, F.concat_ws(" ", "p_brand", n), F.concat("p_type", F.lit("!")), F.concat_ws(" ", n, n, n, n, "p_type"), F.lit(""))
    return t(spark, d, "part").select(F.explode(each).alias("anchor")).distinct().select("anchor", T.anchor_quality(F.col("anchor")).cast("long").alias("points"))


def _audience_rows() -> list[tuple[str, int, str, float]]:
    return [(a, k, term.rsplit(":", 1)[0], float(term.rsplit(":", 1)[1])) for k, (a, terms) in enumerate(rules.table(rules.AUDIENCES)) for term in terms.split(", ")]


_AUDIENCE_SQL = "(VALUES " + ", ".join(f"({sql_str(a)}, {k}, {sql_str(term)}, CAST({w} AS DOUBLE))" for a, k, term, w in _audience_rows()) + ") v(audience, pos, term, weight)"


@query("ad_audiences", f"WITH {ADS}, f AS (SELECT ad, regexp_replace(' ' || lower({_FLAT}) || ' ', '([^a-z0-9])', chr(2) || '\\1' || chr(2), 'g') AS padded FROM ad), lex AS (SELECT *, regexp_replace(lower(term), '([^a-z0-9])', chr(2) || '\\1' || chr(2), 'g') AS key FROM {_AUDIENCE_SQL}), h AS (SELECT ad, audience, pos, term, weight, CAST((length(padded) - length(replace(padded, chr(2) || key || chr(2), ''))) / (length(key) + 2) AS BIGINT) AS hits FROM f JOIN lex ON contains(padded, chr(2) || key || chr(2))), s AS (SELECT ad, audience, min(pos) AS pos, sum(least(3.0, 1 + log2(hits)) * weight) AS score FROM h GROUP BY 1, 2) SELECT ad AS id, audience, floor(score * 100 + 0.5) / 100 AS score FROM (SELECT *, row_number() OVER (PARTITION BY ad ORDER BY score DESC, pos) AS n FROM s) WHERE n = 1 AND score >= 4")
def ad_audiences(spark: SparkSession, d: str) -> DataFrame:
    """The built-in audiences over the ads' copy."""
    terms = C.audience_terms(spark)
    found = C.audience(C.term_hits(ads(spark, d).select(F.col("ad").alias("id"), T.normalise(F.col("body")).alias("text")), terms), terms)
    return found.select("id", "audience", (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score"))


@query("vocabulary_lines", "WITH s AS (SELECT c_nationkey AS brand, c_mktsegment AS term, floor(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) * 10 + 0.5) / 10 AS ad_share FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY ad_share DESC, term) AS place FROM s) SELECT brand, string_agg(term || ' (' || regexp_replace(CAST(ad_share AS VARCHAR), '\\.0$', '') || '%)', ' · ' ORDER BY place) AS summary FROM r WHERE place <= 3 GROUP BY brand")
def vocabulary_lines(spark: SparkSession, d: str) -> DataFrame:
    """X24."""
    from adlens.operators.rollup import mix

    s = mix(t(spark, d, "customer").select(F.col("c_nationkey").alias("brand"), F.col("c_mktsegment").alias("term")), ["brand"], "term").withColumnRenamed("share", "ad_share")
    s = s.withColumns({"words": F.lit(1), "avg_exposure": F.lit(0.0)})
    return V.summary(V.rank(s, ["brand"]), ["brand"], 3)


_DOCS = "ad AS (SELECT doc_id AS ad, text AS body FROM documents)"


@query("document_reading_ease", f"WITH {_DOCS}, {ease_sql('ad', 'ad')} SELECT ad AS doc_id, ease FROM re")
def document_reading_ease(spark: SparkSession, d: str) -> DataFrame:
    """X7, X8, A36 over the whole corpus."""
    return t(spark, d, "documents").select("doc_id", T.reading_ease(F.col("text")).alias("ease"))


@query("document_analysis", f"WITH {_DOCS}, {_angles_sql()}, {_awareness_sql()} SELECT ad AS doc_id, found[1].angle AS primary_angle, awareness, {_FORMAT} AS format, {_EMOTIONS} AS emotions, {_CTA} AS cta FROM ad JOIN ang USING (ad) JOIN aw USING (ad)")
def document_analysis(spark: SparkSession, d: str) -> DataFrame:
    """X23 over the whole corpus."""
    a = t(spark, d, "documents").select("doc_id", F.col("text").alias("body")).withColumns({"title": F.lit(""), "link_description": F.lit(""), "cta_text": F.lit("")})
    return X.analyse(a).select("doc_id", "primary_angle", "awareness", "format", F.array_join("emotions", ",").alias("emotions"), "cta")
