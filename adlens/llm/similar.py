"""Near-duplicate texts by SimHash and, for what it does not reach, an exact set-similarity join on word shingles.

Two texts link where their sets of shingles have a Jaccard similarity of 4/5 or more. Ball hashing of fingerprints of the
single words proposes pairs first (a changed word moves few bits of these, and most of those of five-word shingles). Long texts of one language
are close by these without being alike, so proposals whose sizes or MinHash sketches of the shingles are far apart are left to the join; the others are verified on whole sets, and
what they connect is not paired again. The join finds every other link. Sets are put in one order and a
prefix of each is its keys: of sets that alike, the prefixes share at least a known number of keys (the k-prefix
lemma), so pairs that share fewer are passed over and the others are verified on whole sets. No link is missed,
whatever the order is; common shingles, found in a sample of the texts, are put last only to keep few texts on a key. Keys on which many texts still
meet are not paired. Texts that share nothing but common shingles are classed by their whole common part: if the parts are equal,
two texts are alike where the other shingles of both come to a quarter of the part at most, so links to the text with
the fewest others keep the connectivity, and only the texts of a class that could reach another class go on, and meet
those whose counts allow it. These, and texts on a crowded key that the sample missed, are first linked to the smallest text of a key, and only those
that this leaves in different components are paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm import simhash
from adlens.llm.common import cut, discard, trimmed
from adlens.llm.components import components

SHINGLE = 5
SEED = 42
#: Words of a feature of the fingerprints, and the bits in which those of a proposed pair differ at most.
FEATURE = 1
RADIUS = 2
#: Bins of a sketch, and those in which a proposed pair must agree: at a similarity of 4/5 about 26 of 32 do, 18 or more in all but a few in
#: a thousand pairs. What a sketch misses the join finds, so it changes no result.
BINS = 32
AGREE = 18
#: Texts on a key beyond which its shingle counts as common and goes to the end of the order.
CROWD = 64
#: Common shingles are looked for in one text of so many, and that many of them are known at most; what is missed costs time
#: and changes no result.
SAMPLE = 16
COMMON = 100_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The ascending hashes of a text's distinct shingles; words as in simhash.fingerprint, a short text is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    found = [xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), SEED) for k in range(max(1, len(words) - size + 1))]
    return np.unique(np.array(found, dtype=np.uint64)).view(np.int64)


def split(found: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that are not common, and the common ones."""
    if not len(common):
        return found, found[:0]
    at = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return found[~at], found[at]


def sketch(found: np.ndarray) -> np.ndarray:
    """The least hash of a set in each of BINS ranges of hashes, cut to 31 bits; -1 for none."""
    hashes = found.view(np.uint64)
    width = 64 - (BINS - 1).bit_length()
    of = (hashes >> np.uint64(width)).astype(np.int64)
    at, first = np.unique(of, return_index=True)
    out = np.full(BINS, -1, np.int32)
    out[at] = (hashes[first] & np.uint64(0x7FFFFFFF)).astype(np.int32)
    return out


def prefix(rare: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set, common shingles last: as many as leave n // 16 + 1 shared keys for each similar set."""
    n = len(rare) + len(often)
    size = min(n, n - (4 * n + 4) // 5 + 1 + n // 16)
    return rare[:size], often[: max(0, size - len(rare))]


_ROW = "id long, fp long, sketch array<int>, n int, digest binary, c int, part binary, rare array<long>, often array<long>"


def _keyed(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """Of (id, text): the fingerprint, the sketch and the size of the set and a digest of it, the number of common shingles and a digest of them, the keys."""

    def digest(x: np.ndarray) -> bytes:
        return hashlib.blake2b(x.tobytes(), digest_size=16).digest()

    def arrays(found: list[np.ndarray], kind: pa.DataType | None = None) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [shingles(x.as_py()) for x in part.column(1)]
                halves = [split(x, common) for x in sets]
                keys = [prefix(*x) for x in halves]
                fps = np.array([simhash.fingerprint(x.as_py(), FEATURE) for x in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(fps), arrays([sketch(x) for x in sets], pa.int32()), pa.array([len(x) for x in sets], pa.int32()), pa.array([digest(x) for x in sets], pa.binary()), pa.array([len(x) for _, x in halves], pa.int32()),
                        pa.array([digest(x) for _, x in halves], pa.binary()), arrays([x for x, _ in keys]), arrays([x for _, x in keys]),
                    ],
                    [x.split()[0] for x in _ROW.split(", ")],
                )
        trimmed()

    return texts.select("id", "text").mapInArrow(run, _ROW)


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [shingles(x.as_py()) for x in part.column(1)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], ["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set array<long>")


def _common(texts: DataFrame) -> np.ndarray:
    """The ascending hashes of shingles that stand in about CROWD texts or more."""
    some = _sets(texts.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)).select(F.explode("set").alias("key"))
    often = some.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") >= max(2, CROWD // SAMPLE))
    return np.sort(often.orderBy(F.desc("m"), "key").select("key").limit(COMMON).toArrow()["key"].to_numpy())


def _shared(n: Column) -> Column:
    return F.floor(n / 16) + 1


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    needed = cut(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "similar-needed")
    # One plan at every size: Spark broadcasts the ids only below its own bound on their bytes.
    sets = cut(_sets(texts.join(needed, "id", "left_semi")), "similar-sets")
    both = pairs.join(sets.withColumnsRenamed({"id": "u", "set": "a"}), "u").join(sets.withColumnsRenamed({"id": "v", "set": "b"}), "v")
    out = cut(both.filter(F.size(F.array_intersect("a", "b")) * 9 >= (F.size("a") + F.size("b")) * 4).select("u", "v"), "similar-alike")
    discard(needed, sets)
    return out


def proposed(fps: DataFrame) -> DataFrame:
    """(id, fp) -> pairs (u, v) of ids, u < v, that connect all whose fingerprints are equal or link by ball hashing: of a fingerprint its
    smallest id stands for the others."""
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    links = simhash.fingerprint_links(least.select("fp"), RADIUS)
    a, b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_id")) for x in "uv")
    between = links.join(a, "u").join(b, "v").select(F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v"))
    return fps.join(least, "fp").filter("id != least").select(F.col("least").alias("u"), F.col("id").alias("v")).union(between)


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes allow a similarity of 4/5 and whose sketches (id, n, sketch) make it likely."""
    a, b = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "uv")
    agree = F.size(F.filter(F.zip_with("u_sketch", "v_sketch", lambda x, y: x == y), lambda x: x))
    near = (F.col("u_n") * 5 >= F.col("v_n") * 4) & (F.col("v_n") * 5 >= F.col("u_n") * 4)
    return pairs.join(a, "u").join(b, "v").filter(near & (agree >= AGREE)).select("u", "v")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component of found already."""
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of")) for x in "uv")
    placed = pairs.join(a, "u", "left").join(b, "v", "left")
    return placed.filter("u_of is null or v_of is null or u_of != v_of").select("u", "v")


def similar(docs: DataFrame, row_col: str = "row", text_col: str = "text") -> DataFrame:
    """(row, component) for each row of docs: texts connected by a similarity of 4/5 or more share a component.

    row_col must hold a distinct long in every row. Null, empty and white-space texts are alike. An empty table gives
    an empty result.
    """
    texts = docs.select(F.col(row_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(_keyed(texts, _common(texts)), "similar-rows")
    firsts = cut(rows.groupBy("digest").agg(F.min(F.struct("id", "fp", "sketch", "n", "c", "part", "rare", "often")).alias("x")).select("digest", "x.*"), "similar-firsts")
    of_row = cut(rows.select("id", "digest").join(firsts.select("digest", F.col("id").alias("first")), "digest").select("id", "first"), "similar-first")
    discard(rows)
    keys = firsts.select(F.explode("rare").alias("key"), "id", "n").withColumn("common", F.lit(False))
    keys = keys.union(firsts.select(F.explode("often").alias("key"), "id", "n").withColumn("common", F.lit(True)))
    met = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    at = cut(keys.join(met, "key").select("key", "id", "n", "common", (F.col("m") > CROWD).alias("hot")), "similar-met")
    fps = cut(firsts.select("id", "fp", "n", "sketch"), "similar-fps")
    classed = cut(firsts.filter(F.size("often") > 0).select("id", "part", "c", (F.col("n") - F.col("c")).alias("a")), "similar-classes")
    discard(firsts)

    guessed = cut(_likely(proposed(fps.select("id", "fp")), fps), "similar-proposed")
    known = _alike(guessed, texts)
    discard(fps, guessed)
    near = cut(components(known, "similar"), "similar-near")

    # Texts whose common parts are equal: links to the one with the fewest other shingles, and who could reach another class.
    least = classed.groupBy("part").agg(F.min(F.struct("a", "id")).alias("best")).select("part", F.col("best.a").alias("least"), F.col("best.id").alias("best"))
    classed = classed.join(least, "part").withColumn("linked", F.col("c") >= 4 * (F.col("a") + F.col("least")))
    inside = cut(classed.filter(F.col("linked") & (F.col("id") != F.col("best"))).select(F.col("id").alias("u"), F.col("best").alias("v")), "similar-inside")
    active = classed.filter((F.col("c") >= 4 * F.col("a")) & ((F.col("id") == F.col("best")) | ~F.col("linked"))).select("id", "c", "a")

    heat = at.groupBy("id").agg(F.count_if("hot").alias("h"), F.count_if(F.col("hot") & F.col("common")).alias("hc"))
    before, at = at, cut(at.join(heat, "id"), "similar-at")
    discard(before)

    def pairs_of(side: DataFrame, apart: Column, least: Column) -> DataFrame:
        a = side.select("key", F.struct(*[c for c in side.columns if c != "key"]).alias("a"))
        near = (F.col("a.n") * 5 >= F.col("b.n") * 4) & (F.col("b.n") * 5 >= F.col("a.n") * 4)
        met_ = a.join(a.withColumnRenamed("a", "b"), "key").filter((F.col("a.id") < F.col("b.id")) & near & apart)
        counted = met_.groupBy(F.col("a.id").alias("u"), F.col("b.id").alias("v")).agg(F.count("*").alias("shared"), F.first(least).alias("least"))
        return counted.filter("shared >= least").select("u", "v")

    asked = _shared(F.least("a.n", "b.n"))
    cool = at.filter("not hot").select("key", "id", "n", "h")
    # Keys the two share among the hot ones are at most the smaller of their hot keys.
    pairs = pairs_of(cool, F.lit(True), F.greatest(F.lit(1), asked - F.least("a.h", "b.h")))
    # Pairs without a cool key in common share hot ones only, as many as are asked for.
    crowded = at.filter(F.col("hot") & (F.col("h") >= _shared(F.ceil(F.col("n") * 4 / 5)))).select("key", "id", "n", "hc", "common")
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")
    # Where they share one that is not known as common, their counts and classes say nothing, and of the common keys they may share as many as both have.
    hot = crowded.filter("not common").withColumns({"c": none, "a": none}).drop("common")
    hot = hot.union(crowded.filter("common").join(active, "id").select("key", "id", "n", zero.alias("hc"), "c", "a"))
    hot = cut(hot, "similar-hot")

    def could(c: tuple[Column, Column], a: tuple[Column, Column]) -> Column:
        """Whether two texts that share common shingles only can be alike, by their counts; null: nothing is known."""
        return F.coalesce(5 * F.least(*c) >= 4 * (F.greatest(*c) + a[0] + a[1]), F.lit(True))

    star = hot.join(hot.groupBy("key").agg(F.min(F.struct("id", "c", "a")).alias("lo")), "key")
    star = star.filter((F.col("id") != F.col("lo.id")) & could((F.col("c"), F.col("lo.c")), (F.col("a"), F.col("lo.a"))))
    star = star.select(F.col("id").alias("u"), F.col("lo.id").alias("v")).distinct()
    met_pairs = cut(_apart(pairs.union(star).distinct(), near), "similar-pairs")
    links = cut(_alike(met_pairs, texts).union(inside).union(known), "similar-links")
    discard(at, met_pairs, inside, near)
    found = cut(components(links, "similar"), "similar-components")
    if not hot.isEmpty():
        placed = hot.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "n", "hc", "c", "a", F.coalesce("component", "id").alias("of"))
        split_ = placed.groupBy("key").agg(F.min("of").alias("c0"), F.max("of").alias("c1")).filter("c0 != c1").select("key")
        # A pair comes out once, on the least key of a kind that both have, and only if they can share as many as are asked for.
        every = hot.groupBy("id", F.col("c").isNull().alias("other")).agg(F.collect_set("key").alias("keys"))
        mine = placed.join(split_, "key").withColumn("other", F.col("c").isNull())
        side = mine.join(every, ["id", "other"]).select("key", F.struct("id", "n", "hc", "c", "a", "of", "keys").alias("a"))
        both = F.array_intersect(F.col("a.keys"), F.col("b.keys"))
        near = (F.col("a.n") * 5 >= F.col("b.n") * 4) & (F.col("b.n") * 5 >= F.col("a.n") * 4) & (F.col("a.id") < F.col("b.id")) & (F.col("a.of") != F.col("b.of"))
        fits = could((F.col("a.c"), F.col("b.c")), (F.col("a.a"), F.col("b.a"))) & (F.size(both) >= asked - F.least("a.hc", "b.hc")) & (F.array_min(both) == F.col("x.key"))
        rest = side.alias("x").join(side.withColumnRenamed("a", "b").alias("y"), (F.col("x.key") == F.col("y.key")) & near & fits)
        rest = cut(rest.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")), "similar-rest")
        found = cut(components(links.union(_alike(rest, texts)), "similar"), "similar-components")
    return of_row.join(found, F.col("first") == F.col("node"), "left").select(F.col("id").alias("row"), F.coalesce("component", "first").alias("component"))
