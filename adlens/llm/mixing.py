"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. Each pattern offers its words up to `repeats` times
at a convex cost (a second copy costs more than a first), each source asks for its target, and the cheapest flow
says how many words every pattern gives. Inside a pattern the documents that get one copy more are the first in a
seeded hash order; the cut is found from sums over hash buckets, so no task sees a whole pattern. A document that does
not fit is left out and the rest is cut again behind it, until no document left fits the gap.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import cut, text_of

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BUCKETS = 4096
#: Documents at a cut that one task orders; where more lie there, the bucket is cut again by further bits of the hash.
FEW = 2000
#: Patterns are planned on the driver; more distinct ones than this are refused, not dropped.
MAX_PATTERNS = 100_000

_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: int = REPEATS) -> list[float]:
    """Shares of total by weight; a share above cap times its size stops there and the rest is shared again."""
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        share = {i: rest * weights[i] / weight for i in free} if weight else {}
        above = {i: float(cap * sizes[i]) for i in free if share.get(i, 0.0) > cap * sizes[i]}
        if not above:
            return [fixed[i] if i in fixed else share.get(i, 0.0) for i in range(len(sizes))]
        fixed |= above


def flow(patterns: Sequence[tuple[Sequence[int], int]], wanted: Sequence[int], repeats: int = REPEATS) -> list[int]:
    """The words each pattern (its sources, its size) gives so that the sources get what they want at least cost.

    A path's cost depends only on the copy it starts from, so the successive cheapest paths are the augmenting
    paths of one max-flow for each further copy, in that order.
    """
    given, sent = [0] * len(patterns), [dict.fromkeys(s, 0) for s, _ in patterns]
    left = list(wanted)
    into: list[set[int]] = [set() for _ in wanted]
    for copy in range(1, repeats + 1):
        while True:
            seen_p: dict[int, int | None] = {p: None for p, (s, n) in enumerate(patterns) if s and given[p] < copy * n}
            queue, seen_s, end = deque(seen_p), {}, None
            while queue and end is None:
                p = queue.popleft()
                for s in sent[p]:
                    if s not in seen_s:
                        seen_s[s] = p
                        if left[s] > 0:
                            end = s
                            break
                        for q in into[s]:
                            if q not in seen_p:
                                seen_p[q] = s
                                queue.append(q)
            if end is None:
                break
            path, s = [], end
            while True:
                p = seen_s[s]
                path.append((p, s))
                if (back := seen_p[p]) is None:
                    break
                s = back
            start = path[-1][0]
            amount = min([left[end], copy * patterns[start][1] - given[start], *(sent[p][seen_p[p]] for p, _ in path if seen_p[p] is not None)])
            for p, s in path:
                sent[p][s] += amount
                into[s].add(p)
                if (back := seen_p[p]) is not None:
                    sent[p][back] -= amount
                    if not sent[p][back]:
                        into[back].discard(p)
            given[start] += amount
            left[end] -= amount
    return given


def _narrowed(inside: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """inside (p, h, size, gap, before, ...), of each pattern the rows of one stretch of hashes: those of the part of it where the
    running sum crosses the gap, by the hash without its last `bits`; and the most rows that are left of a pattern."""
    part = F.shiftrightunsigned("h", bits).alias("part") if bits else F.col("h").alias("part")
    cut_ = inside.select("*", part)
    sums = cut_.groupBy("p", "part").agg(F.sum("size").alias("n"), F.count("*").alias("c"), F.first("gap").alias("gap"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("part"))
    at = F.min(F.when(F.col("upto") > F.col("gap"), F.struct("part", (F.col("upto") - F.col("n")).alias("before"), "c"))).alias("e")
    found = sums.withColumn("upto", upto).groupBy("p").agg(at).filter("e is not null").collect()
    here = inside.sparkSession.createDataFrame([(r.p, r.e.part, r.e.before) for r in found], "p long, part long, before long")
    return cut_.drop("before").join(F.broadcast(here), ["p", "part"]).drop("part"), max((r.e.c for r in found), default=0)


def _cuts(dealt: DataFrame, more: dict[int, int]) -> tuple[dict[int, list[tuple]], dict[int, int]]:
    """dealt (p, bucket, h, row, size), and the words that each pattern needs -> each pattern's stretches, and its gap.

    A stretch ends before (bucket, h, row), or never where that is null; its documents of at most `fits` words are
    taken. The document at its end does not fit the gap that is left, which is what the next stretch takes.
    """
    spark = dealt.sparkSession
    out: dict[int, list[tuple]] = {p: [] for p in more}
    gap, at = dict(more), dict.fromkeys(more, (-1, 0, 0))
    live = sorted(p for p in more if more[p] > 0)
    while live:
        now = spark.createDataFrame([(p, gap[p], *at[p]) for p in live], "p long, gap long, cb long, ch long, cr long")
        left = dealt.join(F.broadcast(now), "p").filter("size > 0 and size <= gap and struct(bucket, h, row) >= struct(cb, ch, cr)")
        so_far = Window.partitionBy("p").orderBy("bucket")
        sums = left.groupBy("p", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("c"), F.first("gap").alias("gap")).withColumn("upto", F.sum("n").over(so_far))
        edge = F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "c")))
        edges = {r.p: (r.e, r.n) for r in sums.groupBy("p").agg(edge.alias("e"), F.sum("n").alias("n")).collect()}
        crossed = {}
        if any(e for e, _ in edges.values()):
            edge_df = spark.createDataFrame([(p, e.bucket, e.before) for p, (e, _) in edges.items() if e], "p long, bucket long, before long")
            inside = left.join(F.broadcast(edge_df), ["p", "bucket"])
            most, bits = max(e.c for e, _ in edges.values() if e), 64 - BUCKETS.bit_length() + 1
            while most > FEW and bits:
                bits = max(0, bits - 12)
                inside, most = _narrowed(inside, bits)
            run = F.sum("size").over(Window.partitionBy("p").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0))
            first = inside.withColumn("run", F.col("before") + run).filter("run > gap").groupBy("p").agg(F.min(F.struct("bucket", "h", "row", (F.col("run") - F.col("size")).alias("taken"))).alias("x"))
            crossed = {r.p: r.x for r in first.collect()}
        for p in live:
            if p in crossed:
                x = crossed[p]
                out[p].append((x.bucket, x.h, x.row, gap[p]))
                gap[p], at[p] = gap[p] - x.taken, (x.bucket, x.h, x.row)
            else:
                out[p].append((None, None, None, gap[p]))
                gap[p] -= edges[p][1] if p in edges else 0
        live = [p for p in live if p in crossed and gap[p] > 0]
    return out, gap


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: id, pattern (sorted array of sources, a null source last), size, copies, taken,
    source_size and target of its first source, and the columns named in keep.

    sources is an array column; a document without any source (null or empty array) is taken zero times. Null and
    empty texts have size zero. Rows that repeat everything may be taken differently, like any other rows. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("id"),
            *[F.col(c).alias(f"keep_{c}") for c in keep],
            pattern.alias("pattern"),
            F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"),
        ),
        "mix",
    )
    found = rows.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} distinct sets of sources")
    found = sorted((([*r.pattern], r.n) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    names = sorted({s for p, _ in found for s in p}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for p, n in found:
        for s in p:
            sizes[place[s]] += n
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], float(sum(n for p, n in found if p)), repeats)
    given = flow([([place[s] for s in p], n) for p, n in found], [round(x) for x in want], repeats)
    plan = [
        (p, k, *(divmod(g, n) if n else (0, 0)), sizes[place[p[0]]] if p else None, want[place[p[0]]] if p else None)
        for k, ((p, n), g) in enumerate(zip(found, given, strict=True))
    ]
    plan_df = spark.createDataFrame(plan, "pattern array<string>, p long, whole long, more long, source_size long, target double")
    key = F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"})
    dealt = rows.withColumn("key", key).join(F.broadcast(plan_df.withColumn("key", key).drop("pattern")), "key").drop("key")
    dealt = dealt.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1).cast("long"))
    narrow = cut(dealt.filter("more > 0").select("p", "bucket", "h", "row", "size"), "mix-narrow")
    cuts, gaps = _cuts(narrow, {k: more for _, k, _, more, _, _ in plan if more > 0})
    stretches = spark.createDataFrame([(p, x) for p, x in cuts.items()], "p long, cuts array<struct<bucket: long, h: long, row: long, fits: long>>")

    def taken(df: DataFrame) -> DataFrame:
        here = F.struct("bucket", "h", "row")
        ahead = F.filter("cuts", lambda c: c["bucket"].isNull() | (here < F.struct(c["bucket"].alias("bucket"), c["h"].alias("h"), c["row"].alias("row"))))
        # Documents without words only count in the first stretch.
        fits = (F.col("size") <= F.get(ahead, F.lit(0))["fits"]) & ((F.col("size") > 0) | (F.size(ahead) == F.size("cuts")))
        return df.join(F.broadcast(stretches), "p", "left").withColumn("extra", F.coalesce(fits.cast("long"), F.lit(0))).drop("cuts")

    # Of the documents left none fits; the smallest is taken where that comes nearer.
    least = taken(narrow).filter("extra = 0 and size > 0").groupBy("p").agg(F.min(F.struct("size", "bucket", "h", "row")).alias("x")).collect()
    nearer = spark.createDataFrame([(r.x.row,) for r in least if r.x["size"] - gaps[r.p] < gaps[r.p]], "row long")
    dealt = taken(dealt).join(F.broadcast(nearer.withColumn("fills", F.lit(1))), "row", "left").withColumn("extra", F.col("extra") + F.coalesce("fills", F.lit(0)))
    copies = F.least(F.col("whole") + F.col("extra"), F.lit(repeats))
    return dealt.select(
        "id", *[F.col(f"keep_{c}").alias(c) for c in keep], "pattern", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )
