"""Removal of long repeated byte strings, exactly, by threshold-bounded interval expansion on a BWT.

A window is `length` bytes. Each belongs to the gram of the smallest hash in it (leftmost on ties), its anchor; equal windows
have equal anchors, so the windows of a document fall into segments, one for each anchor, and only segments with
the same anchor can share windows. Equal segments are collapsed by a 128-bit hash before any text moves. Where an
anchor has different segments, their distinct texts are gathered in shards of bounded size; in a shard, suffixes are
sorted to the window's length, and breadth-first backward extension on the Burrows-Wheeler transform of that order
yields the common prefixes by increasing value and stops at the length: what no boundary separates is repeated.
An anchor with too many different segments for a shard is settled by counting the hashes of its windows, which is
exact as well and linear in their number.

Passages of a number of words that stand in another text too, which may be shorter than such a string, are marked beside
it, not removed: the segments are then of words, and the windows of different segments are counted by their hashes.

The texts are numbered and laid out by that number once, in a bucketed table of the shared folder; whenever
something meets them again, only that other side is shuffled. Nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import cut, discard, laid_out, text_of

LENGTH = 400
#: Words of a passage that is marked where another text has it too, words of a gram for its anchors, and words that eight bytes
#: reach into at most, as each has a byte and a space.
WORDS = 50
WORD_GRAM = 8
SLACK = 4
#: Bytes of a gram for windows of LENGTH: long enough that only repeats share it, short enough that anchors stay rare.
GRAM = 64
#: Windows that are looked at together; longer texts go piece by piece.
PIECE = 1 << 22
#: Bytes of text in a shard, about, and different segments of one anchor that a shard takes.
SHARD_BYTES = 1 << 20
CROWD = 4096


def _gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """The hash of each gram, whose length is a power of two from 8 on."""
    padded = data + bytes(8)
    h, mul, size = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,)), np.uint64(0x9E3779B97F4A7C15), 8
    h = h[: len(data) - 7]
    while size < gram:  # two neighbours make one of twice the size
        h = ((h[: len(h) - size] ^ np.uint64(0x5851F42D4C957F2D)) * mul) ^ (h[size:] >> np.uint64(1)) ^ (h[size:] << np.uint64(63))
        size *= 2
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= mul
    return h ^ (h >> np.uint64(32))


def gram_of(length: int) -> int:
    """The largest power of two that is at most GRAM and a quarter of the window."""
    return 1 << max(3, min(GRAM, length // 4).bit_length() - 1)


def _anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of gram hashes: the anchor's place for each window of `width` grams, the windows at which it changes, the number of windows."""
    n = len(h) - width + 1
    place = np.arange(len(h), dtype=np.uint64)
    key = (h & ~np.uint64((1 << 23) - 1)) | place
    padded = np.concatenate((key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 23) - 1)).astype(np.int64)
    return at, np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))), n


def segments(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, first windows, last windows) of the segments of a text, in order."""
    out = []
    gram = gram_of(length)
    width = length - gram + 1
    for begin in range(0, len(data) - length + 1, PIECE):
        h = _gram_hashes(data[begin : begin + PIECE + length - 1], gram)
        at, lo, n = _anchors(h, width)
        out.append((h[at[lo]].view(np.int64), lo + begin, np.append(lo[1:], n) - 1 + begin))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def word_segments(data: bytes, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segments() of a text of words with one space between them and windows of that many words, 8 at least. Of a word of a gram
    the eight bytes from its start count, which reach into SLACK words at most, itself included."""
    if words < 8:
        raise ValueError("a passage has 8 words at least")
    out = []
    gram = 1 << (min(WORD_GRAM, words // 4).bit_length() - 1)
    width = words - gram + 1 - SLACK
    mul = np.uint64(0x9E3779B97F4A7C15)
    padded, n_words = data + bytes(8), len(starts) - 1
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    for begin in range(0, n_words - words + 1, PIECE):
        h, size = eight[starts[begin : min(n_words, begin + PIECE + words - 1) - SLACK]], 1
        h = (h ^ (h >> np.uint64(31))) * mul
        while size < gram:  # two neighbours make one of twice the size
            h = ((h[: len(h) - size] ^ np.uint64(0x5851F42D4C957F2D)) * mul) ^ (h[size:] >> np.uint64(1)) ^ (h[size:] << np.uint64(63))
            size *= 2
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        at, lo, n = _anchors(h, width)
        out.append((h[at[lo]].view(np.int64), lo + begin, np.append(lo[1:], n) - 1 + begin))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def _spaced(text: str) -> tuple[bytes, np.ndarray]:
    """The words of a text, between ASCII white space, with one space between them, and where each starts there; last, one
    past the end and its space."""
    data = b" ".join(text.encode("utf-8", "replace").split())
    return data, np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1, [len(data) + 1]))


def _pair(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(data)
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)


def _pairs(bodies: Iterator[bytes]) -> np.ndarray:
    """A row of two numbers for each body, 128 bits of its hash."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in bodies]), ">i8").astype(np.int64).reshape(-1, 2)


def _table(parts: list[tuple], schema: str) -> pa.RecordBatch:
    """Parts of columns of longs, put together."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., starts[1], ...: sizes[k] numbers from each start."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def repeated(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, for each of its bytes: whether a string of `length` bytes starts there that also starts
    anywhere else in the texts."""
    n_texts = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum()) + n_texts
    ends = np.cumsum(sizes + 1) - 1
    value = np.zeros(n, np.int64)
    body = np.ones(n, bool)
    body[ends] = False
    value[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + n_texts
    value[ends] = np.arange(n_texts)  # each text ends in a symbol of its own
    # The order of the suffixes by their first `length` symbols, by doubling.
    # Four symbols make the first key, and only rows that are still alike are sorted on.
    wide = 256 + n_texts
    rank, k = value, 1
    if wide < 1 << 15 and length >= 4:
        packed = np.append(value, np.full(3, -1)) + 1
        rank, k = ((packed[:n] * (wide + 1) + packed[1 : n + 1]) * (wide + 1) + packed[2 : n + 2]) * (wide + 1) + packed[3 : n + 3], 4
    order = np.argsort(rank, kind="stable")
    step = np.concatenate(([0], rank[order][1:] != rank[order][:-1])).cumsum()
    rank = np.empty(n, np.int64)
    rank[order] = step
    while k < length and step[-1] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + second
        tied = np.empty(n, bool)
        tied[:-1] = step[1:] == step[:-1]
        tied[-1] = False
        tied[1:] |= tied[:-1]
        at = np.flatnonzero(tied)
        order[at] = order[at][np.argsort(key[order[at]], kind="stable")]
        step = np.concatenate(([0], key[order][1:] != key[order][:-1])).cumsum()
        rank[order] = step
        k *= 2
    bwt = value[order - 1]
    back = np.empty(n, np.int64)  # the backward step from each row
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    bound = np.zeros(n + 1, bool)
    bound[0] = True
    count = np.bincount(bwt, minlength=n_texts + 256)
    stop = np.cumsum(count)[count > 0]
    bound[stop] = True
    lb, rb = stop - count[count > 0], stop - 1
    for _ in range(1, length):  # rows that a common prefix of fewer symbols parts
        one = lb == rb
        single = back[lb[one]]
        wide_lb, size = lb[~one], (rb - lb + 1)[~one]
        rows = _ragged(wide_lb, size)
        key = np.repeat(np.arange(len(size)), size) * (n_texts + 256) + bwt[rows]
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key)) - 1 if len(key) else first
        lb, rb = np.concatenate((single, back[rows[first]])), np.concatenate((single, back[rows[last]]))
        fresh = ~bound[rb + 1]
        lb, rb = lb[fresh], rb[fresh]
        if not len(lb):
            break
        bound[rb + 1] = True
    starts = np.flatnonzero(bound[:n])
    shared = np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))
    flag = np.zeros(n, bool)
    flag[order[shared]] = True
    return [flag[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last places of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


_SEGMENT = "row long, lo long, hi long, anchor long, s1 long, s2 long"
_CUT = "shard long, anchor long, s1 long, s2 long, n long, body binary"
_PART = "anchor long, s1 long, s2 long, lo long, hi long"


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """texts (row, text), laid out by row -> (row, lo, hi): runs of windows that start elsewhere too, not yet merged."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                if len(data) >= length:
                    anchors, lo, hi = segments(data, length)
                    hashes = _pairs(data[a : b + length] for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
                    parts.append((np.full(len(lo), row), lo, hi, anchors, hashes[:, 0], hashes[:, 1]))
                    size += len(lo)
                if size > 50_000:
                    yield _table(parts, _SEGMENT)
                    parts, size = [], 0
            yield _table(parts, _SEGMENT)

    found = cut(texts.filter(F.octet_length("text") >= length).select("row", "text").mapInArrow(split, _SEGMENT), "repeats-segments")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("s1").alias("a"), F.max("s1").alias("b"), F.min("s2").alias("c"), F.max("s2").alias("d"))
    # Written, so that the join deals both sides anew and a hot anchor can be split.
    anchors = cut(anchors.filter("n > 1").select("anchor", ((F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))).alias("same")), "repeats-anchors")
    # Few anchors are shared: they are the table, so the segments are not sorted.
    found = cut(found.join(anchors.hint("shuffle_hash"), "anchor"), "repeats-shared")
    mixed = found.filter("not same")
    distinct = mixed.groupBy("anchor", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi")).alias("at")).select("anchor", "s1", "s2", "n", "at.*")
    distinct = cut(distinct, "repeats-distinct")
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("m")).filter(F.col("m") > CROWD).select("anchor", F.lit(True).alias("crowd"))
    n_bytes = distinct.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + length), F.lit(0))).first()[0]
    shards = max(1, n_bytes // SHARD_BYTES)
    marked = distinct.join(crowded, "anchor", "left")
    wanted = marked.withColumn("shard", F.when(F.col("crowd"), -1).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))).groupBy("row").agg(F.collect_list(F.struct("shard", "anchor", "s1", "s2", "n", "lo", "hi")).alias("want"))
    there = texts.select("row", "text").join(wanted.hint("shuffle_hash"), "row")

    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for text, want in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                for w in want.as_py():
                    body = data[w["lo"] : w["hi"] + length]
                    rows.append((w["shard"], w["anchor"], w["s1"], w["s2"], w["n"], body))
                    size += len(body)
                if size > 1 << 24:
                    yield _batch(rows, _CUT)
                    rows, size = [], 0
            yield _batch(rows, _CUT)

    bodies = cut(there.select("text", "want").mapInArrow(carve, _CUT), "repeats-bodies")

    def expand(part: pa.Table) -> pa.Table:
        own = list(zip(*(part[c].to_pylist() for c in ("anchor", "s1", "s2", "n", "body")), strict=True))
        rows = []
        for (anchor, s1, s2, n, _), flag in zip(own, repeated([x[4] for x in own], length), strict=True):
            windows = len(flag) - length + 1
            rows += [(anchor, s1, s2, a, b) for a, b in ([(0, windows - 1)] if n > 1 else _runs(flag[:windows]))]
        return pa.Table.from_batches([_batch(rows, _PART)])

    by_bwt = bodies.filter("shard >= 0").groupBy("shard").applyInArrow(expand, _PART)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "anchor long, s1 long, s2 long, lo long, w1 long, w2 long"
        for batch in batches:
            rows = []
            for anchor, s1, s2, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows += [(anchor, s1, s2, k, *_pair(body[k : k + length])) for k in range(len(body) - length + 1)]
                if len(rows) > 100_000:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    crowd = bodies.filter("shard < 0")
    each = crowd.select("anchor", "s1", "s2", "body").mapInArrow(windows, "anchor long, s1 long, s2 long, lo long, w1 long, w2 long")
    often = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    by_count = each.join(often, ["w1", "w2"]).select("anchor", "s1", "s2", "lo", F.col("lo").alias("hi"))
    crowd_whole = crowd.filter("n > 1").select("anchor", "s1", "s2", F.lit(0).cast("long").alias("lo"), (F.octet_length("body") - length).cast("long").alias("hi"))
    parts = by_bwt.union(by_count).union(crowd_whole)
    parts = cut(parts.withColumnsRenamed({"lo": "a", "hi": "b"}), "repeats-parts")
    spans = mixed.join(parts, ["anchor", "s1", "s2"]).select("row", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
    return spans.union(found.filter("same").select("row", "lo", "hi"))


_PASSAGE = "row long, lo long, hi long, anchor long, s1 long, s2 long"
_WINDOW = "anchor long, s1 long, s2 long, k long, w1 long, w2 long, r0 long, r1 long"


def passages(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """texts (row, text), laid out by row -> (row, lo, hi): runs of places, counted in words, at which a passage of that many words starts
    that stands in another text too; not yet merged."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, starts = _spaced(text.as_py())
                if len(starts) > words:
                    anchors, lo, hi = word_segments(data, starts, words)
                    hashes = _pairs(data[p:q] for p, q in zip(starts[lo].tolist(), (starts[hi + words] - 1).tolist(), strict=True))
                    parts.append((np.full(len(lo), row), lo, hi, anchors, hashes[:, 0], hashes[:, 1]))
                    size += len(lo)
                if size > 50_000:
                    yield _table(parts, _PASSAGE)
                    parts, size = [], 0
            yield _table(parts, _PASSAGE)

    long_enough = texts.filter(F.octet_length("text") >= 2 * words - 1)
    found = cut(long_enough.select("row", "text").mapInArrow(split, _PASSAGE), "passages-segments")
    anchors = found.groupBy("anchor").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("s1").alias("a"), F.max("s1").alias("b"), F.min("s2").alias("c"), F.max("s2").alias("d"))
    anchors = cut(anchors.filter("r0 < r1").select("anchor", ((F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))).alias("same")), "passages-anchors")
    before, found = found, cut(found.join(anchors.hint("shuffle_hash"), "anchor"), "passages-shared")
    discard(before, anchors)
    mixed = found.filter("not same")
    distinct = mixed.groupBy("anchor", "s1", "s2").agg(F.min(F.struct("row", "lo", "hi")).alias("at"), F.max("row").alias("r1")).select("anchor", "s1", "s2", "at.*", "r1")
    wanted = distinct.groupBy("row").agg(F.collect_list(F.struct("anchor", "s1", "s2", "lo", "hi", "r1")).alias("want"))
    there = texts.join(wanted.hint("shuffle_hash"), "row").select("row", "text", "want")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for row, text, want in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, starts = _spaced(text.as_py())
                at = starts.tolist()
                for w in want.as_py():
                    lo, n = w["lo"], w["hi"] - w["lo"] + 1
                    hashes = _pairs(data[p : q - 1] for p, q in zip(at[lo : lo + n], at[lo + words : lo + words + n], strict=True))
                    of = [np.full(n, w[c]) for c in ("anchor", "s1", "s2")]
                    parts.append((*of, np.arange(n), hashes[:, 0], hashes[:, 1], np.full(n, row), np.full(n, w["r1"])))
                    size += n
                if size > 50_000:
                    yield _table(parts, _WINDOW)
                    parts, size = [], 0
            yield _table(parts, _WINDOW)

    each = cut(there.mapInArrow(windows, _WINDOW), "passages-windows")
    often = each.groupBy("w1", "w2").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1")).filter("r0 < r1").select("w1", "w2")
    places = each.join(often, ["w1", "w2"]).groupBy("anchor", "s1", "s2").agg(F.sort_array(F.collect_list("k")).alias("at"))
    # A run starts where the place before is missing and ends where the next one is.
    starts = F.filter("at", lambda k, i: (i == 0) | (F.get("at", i - 1) != k - 1))
    stops = F.filter("at", lambda k, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != k + 1))
    parts = cut(places.select("anchor", "s1", "s2", F.inline(F.arrays_zip(starts.alias("a"), stops.alias("b")))), "passages-parts")
    discard(each)
    spans = mixed.join(parts, ["anchor", "s1", "s2"]).select("row", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
    return spans.union(found.filter("same").select("row", "lo", "hi"))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False, words: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept binary if asked for; given words,
    then n_passage_words long, how many words lie in a passage of that many that another row has too).

    Every byte that a repeated string of `length` bytes covers is removed; matches lie within documents, and strings
    are judged on the input. Null texts count as empty. A row that repeats another is a repeat: both lose all that is
    long enough. An empty table gives an empty result; other columns are not read.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    texts = laid_out(numbered, "row", "repeats-texts")
    spans = repeated_windows(texts, length).withColumn("word", F.lit(False))
    if words:
        spans = spans.union(passages(texts, words).withColumn("word", F.lit(True)))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "word")).alias("spans"))
    out = OUT + ", kept binary" * with_kept + ", n_passage_words long" * bool(words)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = batch.column(2)
            flat, of = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            lo_, hi_, word = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.lexsort((hi_, lo_, word, of))
            ends = np.searchsorted(2 * of[order] + word[order], np.arange(2 * len(lists)), "right").tolist()
            spans_ = list(zip(lo_[order].tolist(), hi_[order].tolist(), strict=True))
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data = text.as_py().encode("utf-8", "replace")
                kept, at, runs = [], 0, 0
                for lo, hi in spans_[ends[2 * i - 1] if i else 0 : ends[2 * i]]:
                    kept.append(data[at : max(at, lo)])
                    runs += not at or lo > at
                    at = max(at, hi + length)
                left = b"".join([*kept, data[at:]])
                marked, end = 0, 0
                for lo, hi in spans_[ends[2 * i] : ends[2 * i + 1]]:
                    marked += max(0, hi + words - max(end, lo))
                    end = max(end, hi + words)
                rows.append((doc, len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest(), *[left] * with_kept, *[marked] * bool(words)))
                if len(rows) >= 2000:
                    yield _batch(rows, out)
                    rows = []
            yield _batch(rows, out)

    joined = texts.join(spans.hint("shuffle_hash"), "row", "left")
    return joined.select("doc", "text", "spans").mapInArrow(remove, out)
