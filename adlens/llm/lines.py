"""Line dedup by a segment-partition edit join. DataFrame functions only.

Distinct lines are split into max_edits + 1 segments. Lines within that many edits share a segment of the shorter
one, at a place that the two lengths bound, so every line probes the index of segments with a few substrings of its
own (the multi-match-aware selection). Pairs that meet are verified by a banded bit-parallel edit distance. Keys on
which many lines meet are not paired: for one edit their lines are joined through deletion variants instead, which
is exact and linear in their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import cut, discard, free_name, text_of
from adlens.llm.components import components
from adlens.llm.spans import let

#: Shorter lines are compared by equality only.
MIN_CHARS = 24
MAX_EDITS = 1
#: A key on which index rows times probe rows come to more is not paired directly (for one edit).
HOT = 2500
#: The smaller side of a join is hashed where it has been shuffled to, at every size alike; the texts are never sorted.
JOIN = "shuffle_hash"


def _key(line: Column, length: Column, segment: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(segment), line.substr(start, size))


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i of `parts`; the last ones are a character longer where it does not divide."""
    size, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = F.greatest(F.lit(0), F.lit(i) - (parts - longer))
    return F.lit(i) * size + extra + 1, size + F.when(F.lit(i) >= parts - longer, 1).otherwise(0)


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    return [_key(line, length, i, *_segment(length, i, edits + 1)) for i in range(edits + 1)]


def probe_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """The substrings of a line that may equal a segment of a line shorter by 0 .. edits characters."""
    out = []
    for less in range(edits + 1):
        other = length - less
        for i in range(edits + 1):
            start, size = _segment(other, i, edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                at = start + shift
                out.append(F.when((at >= 1) & (at + size - 1 <= length), _key(line, other, i, at, size)))
    return out


def _trimmed(a: Column, b: Column) -> Column:
    """struct<a, b> without the first and the last half of the shorter string, where the two strings share them. Common
    ends do not change a distance."""

    def head(x: Column) -> Column:
        half = F.floor(F.least(F.length(x["a"]), F.length(x["b"])) / 2).cast("int")
        same = (half > 0) & (F.substr(x["a"], F.lit(1), half) == F.substr(x["b"], F.lit(1), half))
        return F.when(same, F.struct(F.substr(x["a"], half + 1).alias("a"), F.substr(x["b"], half + 1).alias("b"))).otherwise(x)

    def tail(x: Column) -> Column:
        n, m = F.length(x["a"]), F.length(x["b"])
        half = F.floor(F.least(n, m) / 2).cast("int")
        same = (half > 0) & (F.substr(x["a"], n - half + 1) == F.substr(x["b"], m - half + 1))
        return F.when(same, F.struct(F.substr(x["a"], F.lit(1), n - half).alias("a"), F.substr(x["b"], F.lit(1), m - half).alias("b"))).otherwise(x)

    def once(x: Column) -> Column:
        return let(head(x), tail)

    return let(let(let(F.struct(a.alias("a"), b.alias("b")), once), once), once)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within `edits` edits, by a bit vector over the band around the diagonal.

    The pattern is the longer string; bit k of a column stands for row (column - edits + k). Only zero or one carry
    leaves the band, so the words have 2 * edits + 1 bits. Halves that the strings share are cut off before, and the
    columns behind one that exceeds the bound are passed over: the distance along a diagonal never falls.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def decide(x: Column) -> Column:
        first = F.length(x["a"]) >= F.length(x["b"])
        longer, shorter = F.when(first, x["a"]).otherwise(x["b"]), F.when(first, x["b"]).otherwise(x["a"])
        gap = F.length(longer) - F.length(shorter)
        state = F.struct(F.lit((mask << edits) & mask).alias("vp"), F.lit(0).alias("vn"), gap.alias("d"), F.lit(0).alias("j"))

        def step(p: Column) -> Callable[[Column, Column], Column]:
            def one(s: Column, c: Column) -> Column:
                same = reduce(lambda y, k: y.bitwiseOR(F.when(F.get(p, s["j"] + (k - edits)) == c, 1 << k).otherwise(0)), range(width), F.lit(0))
                vp, vn = s["vp"], s["vn"]
                d0 = ((same.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(same).bitwiseOR(vn).bitwiseAND(F.lit(mask))

                def after(d0: Column) -> Column:
                    hp = vn.bitwiseOR(F.lit(mask) - d0.bitwiseOR(vp).bitwiseAND(F.lit(mask)))
                    hn = d0.bitwiseAND(vp)
                    down = F.shiftright(d0, 1)
                    return F.struct(
                        hn.bitwiseOR(F.lit(mask) - down.bitwiseOR(hp).bitwiseAND(F.lit(mask))).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"),
                        (s["d"] + F.when(F.getbit(d0.cast("long"), gap + edits) == 0, 1).otherwise(0)).alias("d"),
                        (s["j"] + 1).alias("j"),
                    )

                return F.when(s["d"] > edits, s).otherwise(let(d0, after))

            return one

        distance = let(F.split(longer, ""), lambda p: F.aggregate(F.split(shorter, ""), state, step(p), lambda s: s["d"]))
        return F.when(F.length(shorter) == 0, True).otherwise(distance <= edits)

    near = F.abs(F.length(a) - F.length(b)) <= edits
    return F.when(near, F.when(a == b, True).otherwise(let(_trimmed(a, b), decide))).otherwise(False)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, dh (a hash of the text), pos, line, len, h1, h2 of the lines that are not blank."""
    text = text_of(text_col)
    return (
        docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("dh"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .withColumn("len", F.length("line"))
        .filter(F.trim("line") != "")
        .withColumn("h1", F.xxhash64("line"))
        .withColumn("h2", F.xxhash64(F.lit(1), "line"))
    )


def links(lines: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """lines (line, h1, h2); distinct (id, h1, h2, len, keys i0.., p0..) -> (u, v) links between ids; where many lines
    meet, links that keep the connectivity."""
    keys = [c for c in distinct.columns if c[0] in "ip" and c[1:].isdigit()]
    rows = distinct.select("id", F.explode(F.array(*[F.struct(F.col(c).alias("key"), F.lit(c[0] == "p").alias("probe")) for c in keys])).alias("x")).select("id", "x.key", "x.probe").filter("key is not null")
    met = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_if("probe").alias("np"), F.count_if(~F.col("probe")).alias("ni"))
    met = cut(met.filter("lo < hi and np > 0 and ni > 0").select("key", (F.col("np") * F.col("ni") > HOT if edits == 1 else F.lit(False)).alias("hot")), "line-keys")
    rows = cut(rows.join(met.hint(JOIN), "key"), "line-rows")
    cool = rows.filter("not hot")
    left, right = cool.filter("not probe").select("key", F.col("id").alias("a")), cool.filter("probe").select("key", F.col("id").alias("b"))
    pairs = cut(left.join(right, "key").filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "line-pairs")
    crowd = rows.filter("hot").select(F.col("id")).distinct()
    needed = cut(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).union(crowd).distinct().join(distinct.select("id", "h1", "h2"), "id"), "line-needed")
    texts = cut(lines.select("h1", "h2", "line").join(needed.hint(JOIN), ["h1", "h2"]).groupBy("id").agg(F.min("line").alias("line")), "line-texts")
    a, b = texts.select(F.col("id").alias("u"), F.col("line").alias("la")), texts.select(F.col("id").alias("v"), F.col("line").alias("lb"))
    near = pairs.join(a, "u").join(b, "v").filter(within(F.col("la"), F.col("lb"), edits)).select("u", "v")
    if edits > 1:
        return near
    full = texts.join(crowd, "id")
    each = F.transform(F.sequence(F.lit(1), F.length("line")), lambda i: F.struct(i.alias("i"), F.xxhash64(F.concat(F.col("line").substr(F.lit(1), i - 1), F.substr("line", i + 1))).alias("h1"), F.xxhash64(F.lit(1), F.concat(F.col("line").substr(F.lit(1), i - 1), F.substr("line", i + 1))).alias("h2")))
    variants = full.select("id", F.explode(each).alias("x")).select("id", "x.*")
    least = variants.groupBy("i", "h1", "h2").agg(F.min("id").alias("v"), F.max("id").alias("hi")).filter("v < hi").drop("hi")
    changed = variants.join(least, ["i", "h1", "h2"]).filter("id != v").select(F.col("id").alias("u"), "v")
    shorter = variants.join(full.select(F.col("id").alias("v"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), ["h1", "h2"]).select(F.col("id").alias("u"), "v")
    return near.union(changed).union(shorter).distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with every line dropped of which an equal or near line stands earlier, and n_lines, n_removed put in.

    Lines are what line feeds separate; blank ones stay. Near is connectivity through links of at most max_edits edits
    between lines of min_chars characters and more; shorter ones go only where an equal one stands earlier. Earlier means a smaller id (null first), then a smaller hash of the text, then an
    earlier place. Rows that repeat id and text count as one document and keep the same lines. Null texts stay null
    with no lines; an empty text has one empty line. All other columns are kept; an existing n_lines or n_removed is
    replaced. An empty table gives an empty result.
    """
    lines = _lines(docs, id_col, text_col)
    index, probes = index_keys(F.col("line"), F.col("len"), max_edits), probe_keys(F.col("line"), F.col("len"), max_edits)
    named = {f"i{k}": x for k, x in enumerate(index)} | {f"p{k}": x for k, x in enumerate(probes)}
    named = {k: F.when(F.col("len") >= min_chars, x) for k, x in named.items()}
    narrow = cut(lines.select("doc", "dh", "pos", "len", "h1", "h2", *[x.alias(k) for k, x in named.items()]), "lines")
    distinct = narrow.groupBy("h1", "h2", "len").agg(F.count("*").alias("n"), *[F.max(k).alias(k) for k in named])
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()), "lines-distinct")
    found = components(links(lines, distinct, max_edits), "lines")
    classes = distinct.join(found, F.col("id") == F.col("node"), "left").filter("n > 1 or component is not null").select("h1", "h2", F.coalesce("component", "id").alias("class"))
    classes = cut(classes, "line-classes")
    hits = narrow.select("doc", "dh", "pos", "h1", "h2").join(classes.hint(JOIN), ["h1", "h2"]).select("class", F.struct("doc", "dh", "pos").alias("at"))
    hits = cut(hits, "line-hits")
    first = cut(hits.groupBy("class").agg(F.min("at").alias("first")), "line-first")
    extra = hits.join(first.hint(JOIN), "class").filter("at != first").select("at.*").distinct()
    extra = cut(extra.groupBy("doc", "dh").agg(F.collect_list("pos").alias("drop")), "line-drop")
    discard(narrow, distinct, classes, hits, first)
    text, kept_columns = F.col(text_col).cast("string"), docs.drop("n_lines", "n_removed")
    # The columns that are joined on get names that the table does not have.
    names = {c: free_name(kept_columns, f"line_dedup_{c}") for c in ("doc", "dh", "drop", "hash")}
    keyed = kept_columns.withColumn(names["hash"], F.xxhash64(text_of(text_col)))
    told = extra.select(*[F.col(c).alias(names[c]) for c in ("doc", "dh", "drop")]).hint(JOIN)
    out = keyed.join(told, (F.col(names["hash"]) == F.col(names["dh"])) & F.col(id_col).cast("long").eqNullSafe(F.col(names["doc"])), "left")
    split, drop = F.split(text, "\n"), F.col(names["drop"])
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), drop)
    kept = F.when(drop.isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    n_lines, gone = F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long"), F.coalesce(F.size(drop), F.lit(0)).cast("long")
    own = [F.col(c) if c != text_col else kept.alias(c) for c in kept_columns.columns]
    return out.select(*own, n_lines.alias("n_lines"), F.when(drop.isNull(), F.lit(0).cast("long")).otherwise(gone).alias("n_removed"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left, for every row of documents."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
