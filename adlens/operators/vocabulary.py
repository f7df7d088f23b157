"""Recurring language: document frequency of n-grams, phrase folding, lift over the niche."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.dims.rules import STOPWORDS
from adlens.functions import score as S
from adlens.functions import text as T
from adlens.functions.lineage import written


#: How a text falls into sentences and tokens: as functions.text has it for columns. A line feed stands between sentences.
_STOP = re.compile("(?<=[.!?…])[\\s\ufeff]+(?=[A-Z0-9\"'“‘(])")
_QUOTES = str.maketrans("’‘`“”", "\'\'\'\"\"")
_THOUSANDS = re.compile(r"(?<=[0-9]),(?=[0-9]{3}(?![A-Za-z0-9_]))")
_TOKEN = re.compile(r"[a-z0-9'+-]+|\n")
#: Characters of texts that are counted together, and so what a task holds at a time.
_CHUNK = 1 << 22
#: Tokens of a group's list at most, as each of its texts carries the list; grams of a group with more go uncut.
_LISTED = 4000


def marked_tokens(text: str, fold: bool = True) -> list[str]:
    """The tokens of a text, thousands separators joined, with a line feed after each sentence."""
    own = _STOP.sub("\n", text.replace("\n", " ")).lower()
    if fold:
        own = T.without_accents(own).translate(_QUOTES).replace("_", " ")
    return [*_TOKEN.findall(_THOUSANDS.sub("", own)), "\n"]


def _levels(tokens: list[str], doc: np.ndarray, group: np.ndarray, most: int, kinds: Callable[[str], int], allowed: dict[int, list[str]]) -> Iterator[tuple]:
    """Of the texts' tokens (doc: the text of each; group: the group of each text), for every length of a gram: (texts, starts,
    of, terms): the grams of a group are numbered, and each of their occurrences is the text it stands in, in the order of the
    grams and then of the texts; starts: where each gram begins there; of: a text that holds it. kinds: what a token is: 0 no edge of
    a gram, 1 only a first word, 2 either, 3 a gram by itself, usable or not,
    below 0 none at all. allowed: of a group, the tokens that do not end a gram."""
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    ids, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    said = words.to_pylist()
    v, docs = len(said), len(group)
    kind = np.array([-1 if w == "\n" else kinds(w) for w in said], np.int8)[ids]
    good = np.array([len(w) >= 2 and not w.isdigit() for w in said])[ids]
    if allowed:
        at = {w: k for k, w in enumerate(said)}
        held = np.array([g * v + at[w] for g, own in allowed.items() for w in own if w in at], np.int64)
        bound = np.isin(group[doc], np.array(list(allowed), np.int64))
        kind[bound & ~np.isin(group[doc] * v + ids, held)] = -1
    p = np.flatnonzero(kind > 0)
    code, usable = group[doc[p]] * v + ids[p], good[p]
    for n in range(1, most + 1):
        if n > 1:
            # A sentence ends in a token that is none, so no place after a gram's last token lies outside.
            goes_on = kind[p + n - 1] >= 0
            p, last = p[goes_on], p[goes_on] + n - 1
            code, usable = gram[goes_on] * v + ids[last], usable[goes_on] | good[last]
        if not len(p):
            return
        order = np.argsort(code * docs + doc[p])
        ordered = code[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        gram = np.empty(len(p), np.int64)
        gram[order] = np.cumsum(new) - 1
        first = order[new]
        ends = kind[p[first] + n - 1]
        shown = usable[first] & (ends == 2) | (ends == 3)
        kept = order[np.repeat(shown, np.diff(np.r_[np.flatnonzero(new), len(p)]))]
        if not len(kept):
            continue
        first, k = p[first[shown]], gram[kept]
        terms = pc.binary_join_element_wise(*[words.take(pa.array(ids[first + i])) for i in range(n)], " ")
        yield doc[p[kept]], np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), doc[first], terms


def _counted(texts: DataFrame, keys: list[str], most: int, kinds: Callable[[str], int], fold: bool = True, allowed: bool = False) -> DataFrame:
    """keys, term, ads, n, tenths, rated: what `grams` gives. allowed: texts have a column of that name, a group's tokens that do
    not end a gram, joined by spaces; null where all are."""
    schema = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keys) + "term string, ads long, n long, tenths long, rated long"

    def count(part: pa.Table) -> Iterator[pa.RecordBatch]:
        own = [marked_tokens(x or "", fold) for x in part.column("text").to_pylist()]
        doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
        known: dict[tuple, int] = {}
        group = np.array([known.setdefault(k, len(known)) for k in zip(*[part.column(c).to_pylist() for c in keys], strict=True)], np.int64) if keys else np.zeros(len(own), np.int64)
        bound = {}
        if allowed:
            for g, at in zip(*np.unique(group, return_index=True), strict=True):
                if (said := part.column("allowed")[int(at)].as_py()) is not None:
                    bound[int(g)] = said.split(" ")
        tenths = part.column("tenths")
        rated, tenths = tenths.is_valid().to_numpy().astype(np.int64), pc.fill_null(tenths, 0).to_numpy()
        for at, starts, of, terms in _levels([t for x in own for t in x], doc, group, most, kinds, bound):
            once = np.r_[True, at[1:] != at[:-1]]
            once[starts] = True
            columns = [part.column(c).take(pa.array(of)) for c in keys] + [terms]
            columns += [pa.array(np.add.reduceat(x, starts)) for x in (once.astype(np.int64), np.ones(len(at), np.int64), tenths[at] * once, rated[at] * once)]
            yield from pa.table(columns, [*keys, "term", "ads", "n", "tenths", "rated"]).to_batches(65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            chunk = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy()) // _CHUNK
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):  # noqa: B905
                if b > a:
                    yield from count(whole.slice(a, b - a))

    more = ["allowed"] if allowed else []
    return texts.select(*keys, "text", F.round(F.col("exposure") * 10).cast("long").alias("tenths"), *more).mapInArrow(run, schema)


def _dealt(texts: DataFrame, *by: str) -> DataFrame:
    """A table may lie in one row group, which one task would read, so texts are dealt out anew; by ranges of the columns `by`, if any."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartitionByRange(tasks, *by) if by else texts.repartition(tasks)


def _edges(token: str) -> int:
    return 0 if token in _STOPS else 1 if token.isdigit() else 2


_STOPS = frozenset(STOPWORDS)


def summed(rows: DataFrame, keys: list[str], **figures: str) -> DataFrame:
    """keys, term and the sums of figures (name=column) of rows as `grams` gives them. Their parts are summed already, so they are
    dealt by term at once; a partial sum before that would meet few terms twice."""
    return rows.select(*keys, "term", *figures.values()).repartition(*keys, "term").groupBy(*keys, "term").agg(*[F.sum(c).alias(name) for name, c in figures.items()])


def grams(texts: DataFrame, keys: list[str], most: int = 4, fold: bool = True) -> DataFrame:
    """(keys, term, ads, n, tenths, rated): the 1..most-grams of the texts (keys, ad, text, exposure): in how many ads
    and how many times they stand there, and the sum of these ads' exposures, in tenths, over so many ads that have one. Grams do
    not cross sentences; none has a stop word at an edge or ends in a number, and one of its tokens is usable (two characters, not a
    number). Texts are counted some millions of characters at a time, by sorting numbers, so a term comes once for each such part, and
    its figures are to be summed; an ad is one row. fold=False takes the text as folded already."""
    return _counted(_dealt(texts), keys, most, _edges, fold)


def frequent_grams(texts: DataFrame, totals: DataFrame, keys: list[str], least: Column | int | None = None, most: int = 4) -> DataFrame:
    """`grams`, but only those that can reach their group's floor: a gram is in no more ads than any of its tokens, so the tokens are
    counted first, and a token below the floor ends every gram. A floor of a share of the ads leaves a list of tokens that is
    bounded by an ad's length over that share; it is joined to the texts by their keys. A floor of a few ads bounds nothing: such
    groups are for `grams`. totals: keys, total."""
    floor = least_ads(F.col("total")) if least is None else F.lit(least) if isinstance(least, int) else least
    tokens = _counted(_dealt(texts), keys, 1, lambda token: 3)
    often = summed(tokens, keys, ads="ads").join(totals.withColumn("floor", floor), keys).filter("ads >= floor")
    allowed = often.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("allowed"))
    return _counted(_dealt(texts.join(allowed, keys)), keys, most, _edges, allowed=True)


def without_names(rows: DataFrame, banned: DataFrame, keys: list[str]) -> DataFrame:
    """drops terms that are a banned name or made of banned tokens only. banned: keys, names array<string>."""
    names = F.coalesce("names", F.array().cast("array<string>"))
    held = F.array_contains(names, F.col("term")) | F.forall(F.split("term", " "), lambda t: F.array_contains(names, t))
    return rows.join(banned, keys, "left").filter(~held).drop("names")


def banned_names(brands: DataFrame, keys: list[str]) -> DataFrame:
    """keys, names: the folded names (column names array<string>) and their tokens of three characters and more."""
    folded = brands.select(*keys, F.explode("names").alias("name")).select(*keys, T.normalise(F.col("name")).alias("name")).filter("name != ''")
    each = folded.select(*keys, F.explode(F.concat(F.array("name"), F.filter(F.split("name", " "), lambda t: F.length(t) >= 3))).alias("name"))
    return each.groupBy(*keys).agg(F.collect_set("name").alias("names"))


def least_ads(total: Column) -> Column:
    """F15."""
    return F.greatest(F.lit(2), F.ceil(total * 0.15))


def term_stats(rows: DataFrame, totals: DataFrame, keys: list[str], least: Column | int | None = None) -> DataFrame:
    """Keys, term, ad_count, ad_share, total_count, avg_exposure (each ad once), words. rows: as `grams` gives them.
    totals: keys, total."""
    stats = summed(rows, keys, ad_count="ads", total_count="n", tenths="tenths", rated="rated").withColumn("avg_exposure", S.mean_of_tenths(F.col("tenths"), F.col("rated")))
    floor = least_ads(F.col("total")) if least is None else F.lit(least) if isinstance(least, int) else least
    return stats.join(totals, keys).filter(F.col("ad_count") >= floor).select(*keys, "term", "ad_count", S.share(F.col("ad_count"), F.col("total")).alias("ad_share"), "total_count", "avg_exposure", F.size(F.split("term", " ")).alias("words"))


def prefer_longer(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Drops a term that stands inside a longer one of nearly its own frequency."""
    parts = F.split("term", " ")
    n = F.size(parts)
    subs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(parts, i, k), " "))))
    # Each term sends itself and its sub-phrases once, so the statistics are worked out a single time.
    rest = [c for c in stats.columns if c not in (*keys, "term")]
    own = F.struct(F.col("term").alias("term"), F.struct(*rest).alias("own"), F.lit(None).cast("long").alias("longer"))
    told = F.transform(F.when(F.col("words") > 1, F.array_distinct(subs)).otherwise(F.array().cast("array<string>")), lambda s: F.struct(s.alias("term"), F.when(F.lit(False), F.struct(*rest)).alias("own"), F.col("ad_count").cast("long").alias("longer")))
    met = stats.select(*keys, F.explode(F.concat(F.array(own), told)).alias("x")).groupBy(*keys, F.col("x.term").alias("term")).agg(F.max("x.own").alias("own"), F.max("x.longer").alias("longer"))
    return met.filter("own is not null and (longer is null or own.ad_count > longer * 1.25)").select(*[F.col(c) if c in (*keys, "term") else F.col(f"own.{c}") for c in stats.columns])


def rank(stats: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """W7."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ad_share"), F.desc("words"), F.desc("avg_exposure"), "term"))
    out = stats.withColumn("place", place)
    return out.filter(F.col("place") <= most) if most else out


def drop_shifted(ranked: DataFrame, keys: list[str], most: int | Column) -> DataFrame:
    """In rank order, drops a term that is a kept one of equal frequency moved by a word; keeps the first `most`.

    What a term may clash with hangs on two hubs: the term without its first word, which others begin with, and the term
    without its last, which others end in. A round keeps every term that stands before all undecided ones on the other side
    of its hubs and drops what these reach; hubs only hand over their smallest places, so no pairs are made, and no task
    needs a brand's terms together. The result is the one that going through the terms in order would give."""
    parts = F.split("term", " ")
    own, ranked = [*keys, "ad_count", "words"], written(ranked, "fold-ranked")
    undecided = written(ranked.withColumn("words", F.size(parts)).filter("words > 1").select(*own, "term", "place"), "fold-open")
    kept = None

    def reached(terms: DataFrame, by: DataFrame) -> DataFrame:
        """terms with the smallest place of `by` on the other side of their hubs."""
        p = F.split("term", " ")
        sides = F.array(F.struct(F.lit(True).alias("ends"), F.array_join(F.slice(p, 2, 9), " ").alias("hub")), F.struct(F.lit(False).alias("ends"), F.array_join(F.slice(p, 1, F.size(p) - 1), " ").alias("hub")))
        spread = lambda df: df.select(*own, "term", "place", F.explode(sides).alias("x")).select(*own, "term", "place", "x.ends", "x.hub")
        hubs = spread(by).groupBy(*own, "hub").agg(F.min(F.when(F.col("ends"), F.col("place"))).alias("ending"), F.min(F.when(~F.col("ends"), F.col("place"))).alias("beginning"))
        met = spread(terms).join(hubs, [*own, "hub"], "left").withColumn("other", F.when(F.col("ends"), F.col("beginning")).otherwise(F.col("ending")))
        return met.groupBy(*own, "term", "place").agg(F.min("other").alias("other"))

    while not undecided.isEmpty():
        state = written(reached(undecided, undecided).withColumn("stays", F.coalesce(F.col("place") <= F.col("other"), F.lit(True))), "fold-round")
        first = state.filter("stays").select(*own, "term", "place")
        kept = first if kept is None else kept.union(first)
        rest = state.filter("not stays").select(*own, "term", "place")
        undecided = written(reached(rest, first).filter("other is null").select(*own, "term", "place"), "fold-open")
    single = ranked.filter(F.size(parts) <= 1)
    chosen = single if kept is None else single.unionByName(ranked.join(kept.select(*keys, "term"), [*keys, "term"], "left_semi").select(*ranked.columns))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    return chosen.withColumn("place", place).filter(F.col("place") <= most)


def refined(stats: DataFrame, keys: list[str], most: int, ahead: int = 400) -> DataFrame:
    """The first `most` of drop_shifted(rank(prefer_longer(stats))), from no more of each group's terms than these take. Whether a
    term stays hangs on terms before it and on longer ones of nearly its own frequency, so the first terms by share are judged like
    that, `ahead` of them and all of the last one's share; a group that keeps too few goes on with 16 times as many, up to all."""
    stats = written(stats, "refined-terms")
    levels = stats.groupBy(*keys, "ad_share").agg(F.count("*").alias("n"), F.min("ad_count").alias("low"))
    levels = written(levels.withColumn("reach", F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("ad_share")))), "refined-levels")
    out = None
    while not levels.isEmpty():
        cut = levels.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("reach") >= ahead, F.col("low"))), F.min("low")).alias("low"), F.min("low").alias("lowest"))
        near = stats.join(cut, keys).filter(F.col("ad_count") * 1.25 >= F.col("low"))
        ranked = rank(prefer_longer(near, keys).filter(F.col("ad_count") >= F.col("low")), keys)
        # Of a group without `most` terms and with some left, nothing is settled.
        chosen = written(drop_shifted(ranked, keys, most).withColumn("full", F.count("*").over(Window.partitionBy(*keys)) >= most), "refined-round")
        settled = chosen.filter(F.col("full") | (F.col("low") == F.col("lowest"))).select(*stats.columns, "place")
        out = settled if out is None else out.union(settled)
        done = cut.filter(F.col("low") == F.col("lowest")).select(*keys).union(chosen.filter("full").select(*keys)).distinct()
        levels, ahead = written(levels.join(done, keys, "left_anti"), "refined-levels"), ahead * 16
    return out if out is not None else stats.withColumn("place", F.lit(0)).limit(0)


def niche_vocabulary(signatures: DataFrame, most: int = 40) -> DataFrame:
    """(niche, term, brand_count, brand_share, avg_ad_share, place). signatures: niche, brand, term, ad_share;
    in a niche of three brands and more a term needs two."""
    brands = signatures.groupBy("niche").agg(F.countDistinct("brand").alias("brands"))
    own = signatures.groupBy("niche", "term", "brand").agg(F.max("ad_share").alias("ad_share"))
    t = own.groupBy("niche", "term").agg(F.count("*").alias("brand_count"), S.mean_tenths(F.col("ad_share")).alias("avg_ad_share")).join(brands, "niche")
    t = t.filter(F.col("brand_count") >= F.when(F.col("brands") >= 3, 2).otherwise(1)).withColumn("brand_share", S.share(F.col("brand_count"), F.col("brands"))).drop("brands")
    place = F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("brand_count"), F.desc("avg_ad_share"), "term"))
    return t.withColumn("place", place).filter(F.col("place") <= most)


def distinctive(signatures: DataFrame, niche: DataFrame, most: int = 8, unseen: float = 5.0) -> DataFrame:
    """Each brand's terms that over-index against the mean of the other brands of its niche. niche: what
    niche_vocabulary kept; a term it cut has the floor as its baseline."""
    kept = signatures.join(niche.select("niche", "term"), ["niche", "term"], "left_semi")
    w, tenths = Window.partitionBy("niche", "term"), F.round(F.col("ad_share") * 10).cast("long")
    base = kept.select("niche", "brand", "term", F.sum(tenths).over(w).alias("s"), F.count("*").over(w).alias("n"), tenths.alias("t"))
    twice, n = (F.col("s") - F.col("t")) * 2 + F.col("n") - 1, (F.col("n") - 1) * 2
    base = base.select("niche", "brand", "term", F.when(F.col("n") > 1, (twice - F.pmod(twice, n)) / n / 10).otherwise(0.0).alias("niche_ad_share"))
    joined = signatures.join(base, ["niche", "brand", "term"], "left").withColumn("niche_ad_share", F.coalesce("niche_ad_share", F.lit(0.0)))
    lifted = joined.withColumn("lift", S.js_round(F.col("ad_share") / F.greatest(F.lit(unseen), F.col("niche_ad_share")), 2)).filter("lift > 1.3 and ad_share >= 40")
    place = F.row_number().over(Window.partitionBy("niche", "brand").orderBy(F.desc("lift"), F.desc("words"), F.desc("ad_share"), "term"))
    return lifted.withColumn("place", place).filter(F.col("place") <= most)


def top_terms(texts: DataFrame, groups: DataFrame, keys: list[str], banned: DataFrame, banned_keys: list[str], ahead: int = 10) -> DataFrame:
    """Of each group the first `most` of its terms in `floor` ads and more, as `refined` gives them without banned names: term_stats'
    columns and place. texts: keys, ad, text, exposure; groups: keys, total, floor, most.

    All terms of all groups are many times the texts, so tokens are counted first. Where `ahead` times `most` of them that are terms stand in so
    many ads, only terms of that share and above are judged; what decides on them stands in at least four fifths of so many
    ads, and so does each of its tokens. A group that keeps too few goes on with 16 times as many, up to all of its terms. Texts
    are best sorted by group, as a group's tokens are then summed where they are counted."""
    tokens = _counted(texts, keys, 1, lambda token: 3).groupBy(*keys, "term").agg(F.sum("ads").alias("ads"))
    tokens = written(tokens.join(groups.select(*keys, "floor"), keys).filter("ads >= floor").drop("floor"), "vocabulary-tokens")
    terms = tokens.filter(~F.col("term").isin(*STOPWORDS) & (F.length("term") >= 2) & ~F.col("term").rlike("^[0-9]+$"))
    reach = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("ads")))
    levels = written(terms.groupBy(*keys, "ads").agg(F.count("*").alias("n")).withColumn("reach", reach), "vocabulary-levels")
    out, left = None, groups.select(*keys, "total", "floor", "most")
    while out is None or not left.isEmpty():
        enough = levels.join(left.select(*keys, "most"), keys).filter(F.col("reach") >= F.col("most") * ahead).groupBy(*keys).agg(F.max("ads").alias("enough"))
        # Terms of one rounded share are judged together; their ads differ by a thousandth of the group's at most.
        lower = F.floor((F.col("enough") - F.col("total") / 1000 - 1) / 1.25)
        now = written(left.join(enough, keys, "left").withColumn("need", F.greatest("floor", F.coalesce(lower, F.lit(0)))), "vocabulary-groups")
        often = tokens.join(now.select(*keys, "need"), keys).filter("ads >= need")
        sizes = often.groupBy(*keys).agg(F.count("*").alias("n"))
        lists = often.join(sizes.filter(F.col("n") <= _LISTED), keys).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("allowed"))
        lists = written(sizes.select(*keys).join(lists, keys, "left"), "vocabulary-lists")
        stats = term_stats(_counted(texts.join(lists, keys), keys, 4, _edges, allowed=True), now.select(*keys, "total", "need"), keys, F.col("need"))
        stats = written(without_names(stats, banned, banned_keys), "vocabulary-terms")
        ranked = rank(prefer_longer(stats, keys).join(now.select(*keys, "most", "enough", S.share(F.col("enough"), F.col("total")).alias("least")), keys).filter("enough is null or ad_share >= least"), keys)
        chosen = drop_shifted(ranked, keys, F.col("most")).withColumn("full", F.count("*").over(Window.partitionBy(*keys)) >= F.col("most"))
        chosen = written(chosen, "vocabulary-round")
        settled = chosen.filter("full or enough is null").select(*stats.columns, "place")
        out = settled if out is None else out.union(settled)
        left = written(now.filter("enough is not null").select(*left.columns).join(chosen.filter("full").select(*keys).distinct(), keys, "left_anti"), "vocabulary-left")
        ahead *= 16
    return out


def brand_vocabulary(ads: DataFrame, brands: DataFrame) -> DataFrame:
    """(brand, slot, term, ...) for the slots signature, hook, cta and angle:<key>, refined and ranked. ads: brand,
    ad, exposure, title, body, link_description, cta_text, hook, angles array<string>; brands: brand, names."""
    body = F.concat_ws(". ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "body", "link_description")])
    tail = T.let(T.sentences(F.col("body")), lambda x: F.array_join(F.slice(x, F.greatest(F.size(x) - 1, F.lit(1)), 2), " "))
    close = F.concat_ws(". ", F.nullif(tail, F.lit("")), *[F.when(F.col(c) != "", F.col(c)) for c in ("cta_text", "link_description")])
    # Written once, as the texts of the slots are read again and are twice as many characters.
    ads = ads.select("brand", "ad", "exposure", "title", "body", "link_description", "cta_text", "hook", "angles")
    ads = written(_dealt(ads, "brand", "ad").sortWithinPartitions("brand").select("brand", "ad", "exposure", "title", "body", "link_description", "hook", "angles", close.alias("close")), "vocabulary-ads")
    slots = F.array(*[F.struct(F.lit(slot).alias("slot"), text.alias("text")) for slot, text in (("signature", body), ("hook", F.col("hook")), ("cta", F.col("close")))])
    angles = F.transform("angles", lambda a: F.struct(F.concat(F.lit("angle:"), a).alias("slot"), F.concat_ws(". ", "title", "body").alias("text")))
    texts = ads.select("brand", "ad", "exposure", F.explode(F.concat(slots, F.coalesce(angles, F.array().cast("array<struct<slot: string, text: string>>")))).alias("x")).select("brand", "x.slot", "ad", "exposure", "x.text")
    keys = ["brand", "slot"]
    counts = ads.groupBy("brand").agg(F.count("*").alias("total"))
    fixed = counts.withColumn("slot", F.explode(F.array(*[F.lit(x) for x in ("signature", "hook", "cta")]))).select(*keys, "total")
    own = ads.select("brand", F.explode("angles").alias("a"), "ad").distinct().groupBy("brand", F.concat(F.lit("angle:"), "a").alias("slot")).agg(F.count("*").alias("total"))
    floor = F.when(F.col("slot") == "signature", least_ads(F.col("total"))).otherwise(F.greatest(F.lit(2), least_ads(F.col("total")) - 1))
    groups = fixed.withColumns({"floor": floor, "most": F.when(F.col("slot") == "signature", 40).otherwise(12)}).unionByName(own.withColumns({"floor": F.lit(2), "most": F.lit(6)}))
    return top_terms(texts, written(groups, "vocabulary-groups"), keys, banned_names(brands, ["brand"]), ["brand"])


def summary(stats: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Keys and one line of the first terms with their shares."""
    told = F.concat("term", F.lit(" ("), F.regexp_replace(F.col("ad_share").cast("string"), r"\.0$", ""), F.lit("%)"))
    own = stats.filter(F.col("place") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", told.alias("t")))).alias("x"))
    return own.select(*keys, F.array_join(F.transform("x", lambda x: x["t"]), " · ").alias("summary"))
