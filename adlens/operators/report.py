"""Reports: brand rows, the run's document, Markdown and HTML. Rollups are small by then: one row a brand or niche."""

from __future__ import annotations

import html as H
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.dims import rules
from adlens.functions import score as S
from adlens.operators import copy as X
from adlens.operators import rollup as R
from adlens.operators import vocabulary as V


def _list(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], name: str, most: int | None = None) -> DataFrame:
    """keys and one array of structs in a total order."""
    from pyspark.sql import Window

    placed = df.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    placed = placed.filter(F.col("place_") <= most) if most else placed
    got = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place_", F.struct(*columns).alias("v")))).alias("x"))
    return got.select(*keys, F.transform("x", lambda x: x["v"]).alias(name))


def brand_reports(brands: DataFrame, ads: DataFrame, as_of: str, least_days: int = 60) -> DataFrame:
    """One row a brand: exposure, top angle, breakdowns, hooks, creative signals, winners. brands: brand, brand_name,
    niche, sub_niche; ads: analysed ads (exposure, rank, angles array<struct<angle,label,..>>, awareness, format, hook,
    start, days, variants, active)."""
    keys = ["brand"]
    plain = ads.withColumn("angles", F.transform("angles", lambda a: a["angle"]))
    total = ads.groupBy("brand").agg(F.count("*").alias("total"), S.mean_tenths(F.col("exposure")).alias("exposure_score"))
    each = ads.select("brand", "exposure", F.explode("angles").alias("a")).select("brand", "exposure", F.col("a.angle").alias("angle"))
    parts = R.breakdown(each, total.select("brand", "total"), keys, "angle")
    out = brands.join(total.withColumnRenamed("total", "ad_count"), "brand", "left").join(R.top_angle(parts, keys), "brand", "left")
    out = out.join(_list(parts, keys, [F.desc("ad_count"), F.desc("avg_exposure"), F.col("angle")], ["angle", "ad_count", "share", "avg_exposure"], "angle_breakdown"), "brand", "left")
    for by in ("awareness", "format"):
        out = out.join(_list(R.mix(ads, keys, by), keys, [F.desc("n"), F.col(by)], [by, "n", "share"], f"{by}_breakdown"), "brand", "left")
    out = out.join(_list(ads, keys, [F.col("rank")], ["hook", "exposure"], "top_hooks", 10), "brand", "left")
    if "offers" in ads.columns:
        told = X.offer_counts(ads.withColumn("pos", F.col("rank")), keys)
        out = out.join(_list(told, keys, [F.col("place")], ["kind", "detail", "n"], "offers"), "brand", "left")
    if "url" in ads.columns:
        pages = R.landing_pages(plain, keys)
        shown = ["url", "ad_count", "share", "total_exposure", "median_exposure", "active_ads", "longest_run", *[c for c in ("funnel", "angles", "hooks", "variants") if c in pages.columns]]
        out = out.join(_list(pages, keys, [F.col("place")], shown, "landing_pages", 20), "brand", "left")
    signals = R.creative_signals(ads, F.lit(as_of).cast("timestamp"), keys).drop("ad_count")
    winners = R.proven_winners(plain, keys, least_days)
    out = out.join(signals, "brand", "left").join(winners.select("brand", "winners", "median_exposure", "pattern", *[c for c in ("ids", "formats", "funnels") if c in winners.columns]), "brand", "left")
    for by in ("media_type", "funnel"):
        if by in ads.columns:
            out = out.join(_list(R.mix(ads, keys, by), keys, [F.desc("n"), F.col(by)], [by, "n", "share"], f"{by}_mix"), "brand", "left")
    if "platforms" in ads.columns:
        each = ads.select("brand", F.explode(F.when(F.size("platforms") > 0, F.col("platforms")).otherwise(F.array(F.lit("unknown")))).alias("platform"))
        n = each.groupBy("brand", "platform").agg(F.count("*").alias("n")).join(total.select("brand", "total"), "brand").withColumn("share", S.share(F.col("n"), F.col("total")))
        out = out.join(_list(n, keys, [F.desc("n"), F.col("platform")], ["platform", "n", "share"], "platform_mix"), "brand", "left")
    return out.withColumns({"ad_count": F.coalesce("ad_count", F.lit(0)), "posture": F.coalesce("posture", F.lit("absent")), "scraped_at": F.lit(as_of)})


def with_details(reports: DataFrame, details: dict[str, tuple[DataFrame, list[str], list[Column]]]) -> DataFrame:
    """Brand rows with one array column for each detail: name -> (rows with brand, their columns, order). A brand without
    rows has null there."""
    for name, (rows, columns, order) in details.items():
        reports = reports.join(_list(rows, ["brand"], order, columns, name), "brand", "left")
    return reports


def brand_figures(reports: DataFrame) -> DataFrame:
    """What norms and deviations read of brand rows: the commerce, stack and lead angle of each, flat."""
    have = set(reports.columns)
    dotted = lambda c, f, kind: F.col(f"{c}.{f}").cast(kind) if c in have else F.lit(None).cast(kind)
    return reports.select(
        "brand", "brand_name", "niche", "ad_count", "posture", "posture_reason", "per_month", *[dotted("commerce", f, "double").alias(f) for f in ("price_median", "max_discount", "guarantee_days", "review_count")], dotted("commerce", "subscription", "boolean").alias("subscription"),
        dotted("tech_stack", "score", "double").alias("stack_score"), *[dotted("tech_stack", f, "boolean").alias(f) for f in ("paid_media", "reviews", "bnpl")], (F.col("tech_stack.all") if "tech_stack" in have else F.array().cast("array<string>")).alias("tools"),
        R.angle_label(F.get("angle_breakdown", F.lit(0))["angle"]).alias("lead_angle"),
    )


def niche_context(reports: DataFrame, signatures: DataFrame | None = None) -> dict[str, DataFrame]:
    """What only all brands together say: norms (with the niche's lead angle and share, and the share that is
    scaling), mixes of angles, formats, awareness, funnels and postures, tools, deviations, tiers, competitors with what they share, and of the
    vocabulary (signatures: niche, brand, term, ad_share, words) what a niche says and what sets a brand apart."""
    figures = brand_figures(reports)
    totals = reports.groupBy("niche").agg(F.sum("ad_count").alias("total"), F.count("*").alias("brands"))

    def mixed(column: str, by: str, n: str) -> DataFrame:
        each = reports.select("niche", F.explode(column).alias("x")).groupBy("niche", F.col(f"x.{by}").alias("key")).agg(F.sum(f"x.{n}").alias("n"))
        return each.join(totals, "niche").select("niche", F.lit(column.removesuffix("_breakdown").removesuffix("_mix")).alias("mix"), "key", "n", S.share(F.col("n"), F.col("total")).alias("share"))

    mixes = mixed("angle_breakdown", "angle", "ad_count")
    for column, by in (("awareness_breakdown", "awareness"), ("format_breakdown", "format"), ("funnel_mix", "funnel")):
        mixes = mixes.unionByName(mixed(column, by, "n")) if column in reports.columns else mixes
    postures = reports.groupBy("niche", F.col("posture").alias("key")).agg(F.count("*").alias("n")).join(totals, "niche").select("niche", F.lit("posture").alias("mix"), "key", "n", S.share(F.col("n"), F.col("brands")).alias("share"))
    lead = mixes.filter("mix = 'angle'").groupBy("niche").agg(F.min(F.struct((-F.col("n")).alias("neg"), "key", "share")).alias("x")).select("niche", R.angle_label(F.col("x.key")).alias("niche_lead_angle"), F.col("x.share").alias("niche_lead_share"))
    scaling = postures.filter("key = 'scaling'").select("niche", F.col("share").alias("scaling_share"))
    norms = R.norms(figures).join(lead, "niche", "left").join(scaling, "niche", "left")
    tiers = figures.join(norms.select("niche", "median_price_median"), "niche").select("brand", S.price_tier(F.col("price_median"), F.col("median_price_median")).alias("price_tier"))
    features = None
    for column, by in (("angle_breakdown", "angle"), ("format_breakdown", "format"), ("awareness_breakdown", "awareness")):
        own = reports.select("brand", F.explode(column).alias("x")).select("brand", F.concat(F.lit(f"{by}:"), f"x.{by}").alias("key"), F.col("x.share").alias("value"))
        features = own if features is None else features.union(own)
    rivals = R.competitors(features)
    alike = R.shared(features.filter("key like 'angle:%'"), rivals.select("brand", "other")).withColumn("shared", F.transform("shared", lambda k: R.angle_label(F.substring(k, 7, 99))))
    out = {"norms": norms, "mixes": mixes.unionByName(postures), "tools": R.common_tools(figures), "deviations": R.deviation_set(figures, norms), "tiers": tiers, "competitors": rivals.join(alike, ["brand", "other"], "left")}
    if signatures is not None:
        words = V.niche_vocabulary(signatures)
        out |= {"niche_vocabulary": words, "distinctive": V.distinctive(signatures, words)}
    return out


def run_totals(reports: DataFrame) -> DataFrame:
    """Brands, brands with ads, ads."""
    return reports.agg(F.count("*").alias("brands_profiled"), F.count_if(F.col("ad_count") > 0).alias("brands_with_ads"), F.coalesce(F.sum("ad_count"), F.lit(0)).alias("ads_analysed"))


def niche_tree(reports: DataFrame) -> DataFrame:
    """A row a niche: brands, ads and its sub-niches (array<struct<sub_niche, brands, ads>>, most brands first)."""
    subs = reports.groupBy("niche", "sub_niche").agg(F.count("*").alias("brands"), F.sum("ad_count").alias("ads"))
    listed = _list(subs, ["niche"], [F.desc("brands"), F.col("sub_niche")], ["sub_niche", "brands", "ads"], "subs")
    return subs.groupBy("niche").agg(F.sum("brands").alias("brands"), F.sum("ads").alias("ads")).join(listed, "niche", "left")


#: Brand rows that a run's document takes; a run has 500 at most.
MAX_REPORTS = 10_000


def run_report(reports: DataFrame, as_of: str, warnings: tuple[str, ...] = (), top_ads: list[dict] | None = None) -> dict:
    """The run's document, of MAX_REPORTS brands at most (more are refused). All of it reads the same
    relation of brand rows. top_ads: the best ads of all brands (W8)."""
    rows = [r.asDict(recursive=True) for r in reports.orderBy(F.desc("exposure_score"), "brand").limit(MAX_REPORTS + 1).collect()]
    if len(rows) > MAX_REPORTS:
        raise ValueError(f"more than {MAX_REPORTS} brands in one report")
    spark = reports.sparkSession
    held = spark.createDataFrame(reports.limit(0).toArrow()) if not rows else spark.createDataFrame([tuple(r.values()) for r in rows], reports.schema)
    parts = held.select("brand", "brand_name", "niche", F.explode("angle_breakdown").alias("a")).select("brand", "brand_name", "niche", "a.*")
    shares = parts.groupBy("niche", "angle").agg(F.sum("ad_count").alias("n"))
    totals = held.groupBy("niche").agg(F.sum("ad_count").alias("total"))
    used = shares.join(totals, "niche").select("niche", "angle", S.share(F.col("n"), F.col("total")).alias("share"))
    library = spark.createDataFrame([(key,) for key, *_ in rules.table(rules.ANGLES)], "angle string")
    signatures = None
    if "vocabulary" in held.columns:
        said = held.select("niche", "brand", F.explode("vocabulary").alias("w")).select("niche", "brand", "w.*")
        signatures = said.filter("slot = 'signature'")
    context = niche_context(held, signatures)

    def told(df: DataFrame, *order: Column | str) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]

    by_brand: dict[str, dict[str, list | str]] = {r["brand"]: {"deviations": [], "competitors": [], "distinctive": []} for r in rows}
    for name in ("deviations", "competitors", "distinctive"):
        for x in told(context[name], "brand", *(["place"] if name != "deviations" else ["signal"])) if name in context else ():
            by_brand[x["brand"]][name].append(x)
    tiers = {r["brand"]: r["price_tier"] for r in context["tiers"].collect()}
    names = {r["brand"]: r["brand_name"] for r in rows}
    brands = [r | by_brand[r["brand"]] | {"price_tier": tiers.get(r["brand"])} for r in rows]
    return {
        "generated_at": as_of, "brands_profiled": len(rows), "brands_with_ads": sum(r["ad_count"] > 0 for r in rows), "ads_analysed": sum(r["ad_count"] for r in rows), "niches": told(niche_tree(held), F.desc("brands"), "niche"),
        "leaderboard": told(R.leaderboard(parts), F.desc("ad_count"), "angle"), "niche_angles": told(R.niche_angles(parts, held), "niche", "place"), "whitespace": told(R.whitespace(used, totals, library), "niche", "place"),
        "competitors": told(context["competitors"], "brand", "place"), "benchmarks": told(context["norms"], F.desc("brand_count"), "niche"), "mixes": told(context["mixes"], "niche", "mix", F.desc("n"), "key"), "tools": told(context["tools"], "niche", "place"),
        "niche_vocabulary": told(context["niche_vocabulary"], "niche", "place") if signatures is not None else [], "top_ads": top_ads or [], "names": names, "warnings": list(warnings), "brands": brands,
    }


def pct(x: float | None) -> str:
    return "-" if x is None else f"{x:g}%"


def md(x: object) -> str:
    return str("" if x is None else x).replace("|", "\\|").replace("\n", " ")


def _grid(heads: tuple[str, ...], rows: list[tuple]) -> list[str]:
    """A Markdown table, nothing for no rows."""
    line = lambda cells: "| " + " | ".join(md(c) for c in cells) + " |"
    return [line(heads), line(("---",) * len(heads)), *map(line, rows), ""] if rows else []


def num(x: float | None) -> str:
    return "-" if x is None else f"{x:g}"


def _sections(run: dict) -> list[tuple[str, tuple[str, ...], list[tuple]]]:
    """What both renderings show of a run: title, heads, rows."""
    names = run.get("names", {})
    norms = [(b["niche"], b["brand_count"], b["ad_count"], *[num(b.get(c)) for c in ("median_ads_per_brand", "median_price_median", "median_max_discount", "median_guarantee_days", "median_review_count", "median_stack_score", "median_per_month")], *[pct(b.get(f"{c}_share")) for c in ("subscription", "paid_media", "reviews", "bnpl")]) for b in run["benchmarks"]]
    return [
        ("Niches", ("Niche", "Brands", "Ads", "Sub-niches"), [(n["niche"], n["brands"], n["ads"], ", ".join(f"{s['sub_niche']} ({s['brands']})" for s in n["subs"] or ())) for n in run.get("niches", ())]),
        ("Angles", ("Angle", "Ads", "Brands", "Exposure"), [(a["angle"], a["ad_count"], a["brand_count"], f"{a['avg_exposure']:g}") for a in run["leaderboard"]]),
        ("Angles by niche", ("Niche", "Angle", "Ads", "Share"), [(a["niche"], a["angle"], a["ad_count"], pct(a["share"])) for a in run.get("niche_angles", ())]),
        ("Open space", ("Niche", "Angle", "Share"), [(a["niche"], a["angle"], pct(a["share"])) for a in run.get("whitespace", ())]),
        ("Norms", ("Niche", "Brands", "Ads", "Median ads", "Price", "Discount", "Guarantee", "Reviews", "Stack", "Launches a month", "Subscription", "Paid media", "Review tool", "Pay later"), norms),
        ("Mixes", ("Niche", "Of", "Kind", "Number", "Share"), [(m["niche"], m["mix"], m["key"], m["n"], pct(m["share"])) for m in run.get("mixes", ()) if m["mix"] != "angle"]),
        ("Common tools", ("Niche", "Tool", "Brands"), [(x["niche"], x["tool"], pct(x["share"])) for x in run.get("tools", ())]),
        ("What a niche says", ("Niche", "Words", "Brands", "Share of brands"), [(w["niche"], w["term"], w["brand_count"], pct(w["brand_share"])) for w in run.get("niche_vocabulary", ())]),
        ("Best ads", ("Brand", "Ad", "Exposure", "Hook"), [(names.get(a["brand"], a["brand"]), a["ad_id"], num(a["exposure"]), a.get("hook")) for a in run.get("top_ads", ())]),
        ("Creative competitors", ("Brand", "Other", "Alike", "Shared angles"), [(names.get(c["brand"], c["brand"]), names.get(c["other"], c["other"]), pct(c["similarity"]), ", ".join(c.get("shared") or ())) for c in run.get("competitors", ())]),
    ]


def _brand_sections(b: dict) -> list[tuple[str, tuple[str, ...], list[tuple]]]:
    get = lambda name: b.get(name) or ()
    mixes = [(kind, x[by], x["n"], pct(x["share"])) for name, by, kind in (("media_type_mix", "media_type", "media"), ("platform_mix", "platform", "platform"), ("funnel_mix", "funnel", "funnel")) for x in get(name)]
    return [
        ("Off the niche's norm", ("Signal", "Here", "Niche", "Note"), [(d["signal"], d["value"], d["norm"], d["note"]) for d in get("deviations")]),
        ("Angles", ("Angle", "Ads", "Share", "Exposure"), [(a["angle"], a["ad_count"], pct(a["share"]), f"{a['avg_exposure']:g}") for a in get("angle_breakdown")]),
        ("Awareness", ("Stage", "Ads", "Share"), [(a["awareness"], a["n"], pct(a["share"])) for a in get("awareness_breakdown")]),
        ("Formats", ("Format", "Ads", "Share"), [(a["format"], a["n"], pct(a["share"])) for a in get("format_breakdown")]),
        ("Mixes", ("Of", "Kind", "Ads", "Share"), mixes),
        ("Recurring words", ("Where", "Words", "Ads", "Share"), [(w["slot"], w["term"], w["ad_count"], pct(w["ad_share"])) for w in get("vocabulary")]),
        ("Words that set it apart", ("Words", "Lift", "Share"), [(w["term"], num(w["lift"]), pct(w["ad_share"])) for w in get("distinctive")]),
        ("Offers", ("Kind", "Offer", "Ads"), [(o["kind"], o["detail"], o["n"]) for o in get("offers")]),
        ("Landing pages", ("Page", "Funnel", "Ads", "Share", "Exposure"), [(p["url"], p.get("funnel"), p["ad_count"], pct(p["share"]), f"{p['total_exposure']:g}") for p in get("landing_pages")]),
        ("Landing pages read", ("Page", "Shape", "Words", "Calls to act", "Match", "Note"), [(p["url"], p["shape"], p["words"], p["ctas"], pct(p["match"]), p["error"] or p["match_note"]) for p in get("teardowns")]),
        ("Published pages", ("Kind", "Pages", "Share"), [(k["kind"], k["count"], pct(k["share"])) for k in get("inventory")]),
        ("Published, not advertised", ("Kind", "Pages", "Such as"), [(g["kind"], g["count"], ", ".join(g["examples"] or ())) for g in get("gaps")]),
        ("Advertised, not published", ("Page",), [(u["url"],) for u in get("unlisted")]),
        ("Product pages", ("Page", "Title", "Price", "Reviews", "Guarantee"), [(p["url"], p["title"], num(p["price"]), num(p["review_count"]), num(p["guarantee_days"])) for p in get("product_pages")]),
        ("Checkout", ("Cart", "Free shipping over", "Ways to pay", "Pay later", "Return days"), [(c["cart_style"], num(c["free_shipping_over"]), ", ".join(c["payment_methods"] or ()), ", ".join(c["bnpl"] or ()), num(c["return_days"])) for c in get("checkout")]),
        ("Who is behind it", ("Status", "Confidence", "Legal entity", "To check"), [(r["status"], num(r["confidence"]), r["legal_entity"], r["review_reason"]) for r in get("resolution")]),
        ("Hooks", ("Hook", "Exposure"), [(h["hook"], f"{h['exposure']:g}") for h in get("top_hooks")]),
    ]


def _facts(b: dict) -> list[tuple[str, object]]:
    stack, shop = b.get("tech_stack") or {}, b.get("commerce") or {}
    facts = [("Niche", b.get("niche")), ("Sub-niche", b.get("sub_niche")), ("Audience", b.get("audience")), ("Confidence", b.get("confidence")), ("Platform", b.get("platform")), ("Price tier", b.get("price_tier")), ("Ads", b["ad_count"]), ("Exposure", b.get("exposure_score")), ("Top angle", b.get("top_angle"))]
    facts += [("Posture", b.get("posture")), ("Why", b.get("posture_reason")), ("Launched in 30 days", b.get("launched_30")), ("Per month", b.get("per_month")), ("Longest run", b.get("longest_run")), ("Winners", b.get("pattern"))]
    facts += [("Tools", ", ".join(stack.get("all") or ()) or None), ("Stack score", stack.get("score")), ("Median price", shop.get("price_median")), ("Guarantee days", shop.get("guarantee_days")), ("Reviews", shop.get("review_count"))]
    return [(k, v) for k, v in facts if v is not None]


def markdown(run: dict) -> str:
    """K3."""
    out = ["# Brand report", "", f"Generated {run['generated_at']}. {run['brands_profiled']} brands, {run['brands_with_ads']} with ads, {run['ads_analysed']} ads.", "", *[f"> {md(w)}" for w in run["warnings"]]]
    for title, heads, rows in _sections(run):
        out += [f"## {title}", "", *_grid(heads, rows)] if rows else []
    for b in run["brands"]:
        out += [f"## {md(b['brand_name'])}", "", *[f"- {k}: {md(v)}" for k, v in _facts(b)], ""]
        for title, heads, rows in _brand_sections(b):
            out += [f"### {title}", "", *_grid(heads, rows)] if rows else []
    return "\n".join(out)


def html(run: dict) -> str:
    """K4: one self-contained page, every value escaped."""
    e = lambda x: H.escape(str("" if x is None else x), quote=True)

    def grid(title: str, heads: tuple[str, ...], rows: list[tuple], level: int) -> str:
        head = "".join(f"<th>{e(h)}</th>" for h in heads)
        body = "".join("<tr>" + "".join(f"<td>{e(c)}</td>" for c in row) + "</tr>" for row in rows)
        return f"<h{level}>{e(title)}</h{level}><table><tr>{head}</tr>{body}</table>" if rows else ""

    def bars(b: dict) -> str:
        return "".join(f'<div class="b"><span style="width:{max(0, min(100, a["share"])):g}%"></span>{e(a["angle"])} {e(pct(a["share"]))}</div>' for a in b.get("angle_breakdown") or ())

    cards = [
        f"<section><h2>{e(b['brand_name'])}</h2><dl>{''.join(f'<dt>{e(k)}</dt><dd>{e(v)}</dd>' for k, v in _facts(b))}</dl>{bars(b)}{''.join(grid(*x, 3) for x in _brand_sections(b))}</section>"
        for b in run["brands"]
    ]
    style = "body{font:15px sans-serif;max-width:60em;margin:auto}table{border-collapse:collapse}td,th{padding:.2em .6em;text-align:left;border-bottom:1px solid #ccc}dt{float:left;min-width:10em;color:#555}.b span{display:inline-block;height:.7em;background:#47a;margin-right:.5em}"
    notes = "".join(f"<p class='w'>{e(w)}</p>" for w in run["warnings"])
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Brand report</title><style>{style}</style></head><body><h1>Brand report</h1><p>{e(run['generated_at'])}</p>{notes}{''.join(grid(*x, 2) for x in _sections(run))}{''.join(cards)}</body></html>"


def document(run: dict) -> str:
    """K2."""
    return json.dumps(run, default=str)


def reference_table(terms: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """K8: each group's terms of the largest weight, as one line."""
    lines = _list(terms, keys, [F.desc("weight"), F.col("term")], ["term"], "terms", most)
    return lines.select(*keys, F.array_join(F.transform("terms", lambda x: x["term"]), ", ").alias("terms"))


def write_rows(reports: DataFrame, path: str, run: str) -> None:
    """K1: adds a run's brand rows to the dataset; a run that is done again replaces its own."""
    from adlens.sources.store import append_run

    append_run(reports, path, run)
