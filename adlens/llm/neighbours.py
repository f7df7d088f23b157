"""Near-duplicate embeddings by NN-descent, within labels.

Equal vectors are collapsed first. A first neighbour graph comes from random hyperplane buckets of bounded size; then
rounds of neighbours-of-neighbours joins refine it until few lists change. Links are the graph's edges at or above
the threshold. A list whose last entry still reaches the threshold is saturated: it is enlarged, filled from the buckets and
refined again, until it ends below the threshold. What is saturated at the widest is settled exactly, in blocks, against
all vectors of its label. Recall is audited for all rows whose id is divisible by 20, against all rows, in blocks; more buckets are
added while it is too low, and a final recall below LEAST_RECALL is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import cut, discard
from adlens.llm.components import components

THRESHOLD = 0.93
K = 8
#: A saturated list grows by this factor, up to the widest.
GROW = 4
WIDEST = 128
TREES = 3
MOST_TREES = 12
BITS = 24
#: Vectors in a bucket, about; larger buckets are dealt into several by a hash.
BLOCK = 512
#: Vectors of a label, and queries, that meet in one task.
ALL_BLOCK, QUERY_BLOCK = 8192, 2048
ROUNDS = 4
#: A round that changes less than this share of the list entries is the last.
SETTLED = 0.002
#: The audit asks for one row in so many (by id), and for this recall; below LEAST_RECALL the result is refused.
AUDIT = 20
RECALL = 0.98
LEAST_RECALL = 0.9

_EDGE = "v long, u long, s double"


def unit(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _edges(v: np.ndarray, u: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(u.astype(np.int64)), pa.array(s.astype(np.float64))], ["v", "u", "s"])


def _nearest(x: np.ndarray, rows: np.ndarray, asks: np.ndarray, width: int, floor: np.ndarray | None = None) -> pa.RecordBatch:
    """Of each row that asks its `width` best others among x, above its floor."""
    own = np.flatnonzero(asks)
    k = min(width, len(rows) - 1)
    if k < 1 or not len(own):
        return _edges(*[np.zeros(0)] * 3)
    s = x[own] @ x.T
    s[rows[own][:, None] == rows[None, :]] = -2
    at = np.argpartition(-s, k - 1, 1)[:, :k]
    best = np.take_along_axis(s, at, 1)
    good = (best > -2) & ((best > floor[own][:, None]) if floor is not None else True)
    i, j = np.nonzero(good)
    return _edges(rows[own][i], rows[at[i, j]], best[i, j])


def _top(edges: DataFrame, width: int = K) -> DataFrame:
    """The best `width` of each list. Only lists that may be as long get new entries, so shorter ones keep theirs."""
    once = edges.groupBy("v", "u").agg(F.max("s").alias("s"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).filter(F.col("k") <= width).drop("k")


def _buckets(vectors: DataFrame, trees: range, kind: str, wide: DataFrame | None = None, width: int = K) -> DataFrame:
    """Edges to the nearest in each bucket of each tree; with wide (v), of those vectors only, `width` each."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            codes = np.zeros((len(raw), len(trees)), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit([raw[k] for k in at], int(dim), kind)
                for k, tree in enumerate(trees):
                    planes = np.random.default_rng([tree, int(dim)]).standard_normal((int(dim), BITS))
                    codes[at, k] = (x @ planes > 0) @ (1 << np.arange(BITS)[::-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.tolist(), pa.list_(pa.int64()))], ["row", "codes"])

    coded = vectors.select("row", "vector", "dim").mapInArrow(code, "row long, codes array<long>")
    sizes = vectors.groupBy("label", "dim").agg(F.count("*").alias("n"))
    bits = sizes.select("label", "dim", F.least(F.greatest(F.ceil(F.log2(F.col("n") / (BLOCK / 2))), F.lit(0)), F.lit(BITS)).cast("int").alias("bits"))
    placed = (
        vectors.select("row", "label", "dim", "vector").join(coded, "row").join(bits, ["label", "dim"])
        .select("row", "label", "dim", "vector", "bits", F.posexplode("codes").alias("tree", "code"))
        .withColumn("bucket", F.floor(F.col("code") / F.pow(F.lit(2.0), BITS - F.col("bits"))).cast("long"))
    )
    placed = cut(placed.drop("bits", "code"), "knn-placed")
    full = placed.groupBy("label", "dim", "tree", "bucket").agg(F.count("*").alias("m")).filter(F.col("m") > 2 * BLOCK)
    full = cut(full, "knn-full")
    placed = placed.join(full, ["label", "dim", "tree", "bucket"], "left").withColumn("part", F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("row", "tree"), F.ceil(F.col("m") / BLOCK))))

    def near(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        x, rows = unit(part["vector"].to_pylist(), dim, kind), part["row"].to_numpy()
        return pa.Table.from_batches([_nearest(x, rows, part["asks"].to_numpy(), width)])

    asks = F.lit(True) if wide is None else F.coalesce("asks", F.lit(False))
    placed = placed if wide is None else placed.join(wide.select(F.col("v").alias("row"), F.lit(True).alias("asks")), "row", "left")
    return placed.select("label", "dim", "tree", "bucket", "part", "row", "vector", asks.alias("asks")).groupBy("label", "dim", "tree", "bucket", "part").applyInArrow(near, _EDGE)


def _refine(graph: DataFrame, vectors: DataFrame, kind: str, wide: DataFrame | None = None, width: int = K) -> DataFrame:
    """Edges better than the worst of a list, found among those that share a neighbour. With wide (v), only those vectors
    ask, for lists of `width`, and only what they are neighbours of brings others together."""
    full = F.lit(K) if wide is None else F.lit(width)
    floor = graph.groupBy("v").agg(F.when(F.count("*") >= full, F.min("s")).otherwise(F.lit(-2.0)).alias("floor"))
    if wide is not None:
        floor = floor.join(wide, "v")
    arcs = graph.select(F.col("v").alias("c"), F.col("u").alias("x"), F.lit(True).alias("own")).union(graph.select(F.col("u").alias("c"), F.col("v").alias("x"), F.lit(False)))
    arcs = arcs.groupBy("c", "x").agg(F.max("own").alias("own"))
    if wide is not None:
        arcs = arcs.join(wide.withColumnRenamed("v", "c"), "c", "left_semi")
    degree = cut(graph.groupBy(F.col("u").alias("c")).agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK), "knn-hubs")
    arcs = arcs.join(degree, "c", "left").withColumn("parts", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)))
    dealt = F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("x"), F.col("parts"))))
    arcs = arcs.select("c", "x", F.explode(dealt).alias("part"))
    there = arcs.join(vectors.select(F.col("row").alias("x"), "vector", "dim"), "x").join(floor.withColumnRenamed("v", "x"), "x", "left")
    there = there.withColumn("asks", F.lit(True) if wide is None else F.col("floor").isNotNull())

    def near(part: pa.Table) -> pa.Table:
        rows = part["x"].to_numpy()
        if len(rows) < 2:
            return pa.Table.from_batches([_edges(*[np.zeros(0)] * 3)])
        x = unit(part["vector"].to_pylist(), part["dim"][0].as_py(), kind)
        return pa.Table.from_batches([_nearest(x, rows, part["asks"].to_numpy(), width, part["floor"].fill_null(-2.0).to_numpy())])

    return there.groupBy("c", "part").applyInArrow(near, _EDGE)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links the number of its component; -1 where it has no link."""
    n, m = near.shape
    left, right = np.where(near.any(1), np.arange(n), n), np.full(m, n)
    while True:
        low = np.where(near, left[:, None], n).min(0)
        right = np.minimum(right, low)
        again = np.minimum(left, np.where(near, right[None, :], n).min(1))
        if (again == left).all():
            return np.where(left == n, -1, left), np.where(right == n, -1, right)
        left = again


def _against_all(queries: DataFrame, vectors: DataFrame, threshold: float, kind: str, links: bool) -> DataFrame:
    """queries (row, label, dim, vector) against all vectors of their label, in blocks: (v, u, n). links: every link from a
    query (n null). Else the partners of each query in each block as n, with their copies (u null), and as (v, u) a
    spanning forest of the links (n null), so that a crowd does not bring all its pairs."""
    key = ["label", "dim"]
    sizes = vectors.groupBy(*key).agg(F.ceil(F.count("*") / ALL_BLOCK).alias("blocks"))
    asked = queries.groupBy(*key).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    both = cut(sizes.join(asked, key), "knn-blocks")
    zero = F.lit(0).cast("long")
    own = queries.join(both, key).select(*key, F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("b"), F.pmod(F.xxhash64("row"), F.col("parts")).alias("q"), "row", "vector", zero.alias("copies"), F.lit(True).alias("asks"))
    rest = vectors.join(both, key).select(*key, F.pmod(F.xxhash64("row"), F.col("blocks")).alias("b"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("q"), "row", "vector", "copies", F.lit(False))

    def meet(part: pa.Table) -> pa.Table:
        asks, rows = part["asks"].to_numpy(), part["row"].to_numpy()
        x = unit(part["vector"].to_pylist(), part["dim"][0].as_py(), kind)
        a, b, r, w = rows[asks], rows[~asks], x[asks], part["copies"].to_numpy()[~asks]
        near = (r @ x[~asks].T >= threshold) & (a[:, None] != b[None, :])
        none = pa.nulls(0, pa.int64())
        if links:
            i, j = np.nonzero(near)
            return pa.table({"v": pa.array(a[i]), "u": pa.array(b[j]), "n": pa.nulls(len(i), pa.int64())})
        left, right = _forest(near)
        i, j = np.flatnonzero(left >= 0), np.flatnonzero(right >= 0)
        counts = near.astype(np.int64) @ w
        v = np.concatenate((a, a[i], b[j]))
        u = pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(a[left[i]]), pa.array(a[right[j]])])
        return pa.table({"v": pa.array(v), "u": u, "n": pa.chunked_array([pa.array(counts), pa.nulls(len(i) + len(j), pa.int64()), none])})

    return own.union(rest).groupBy(*key, "b", "q").applyInArrow(meet, "v long, u long, n long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of table: vec_id, n_links, component_id, kept, saturated (it was settled exactly), audited_recall (null where
    no audited vector has a link) and audited_links, the links it was measured on.

    A vector that is null, zero or empty or holds a null or a non-finite component, and one whose label is null, has
    no links and is its own component; vectors of different lengths do not link. Rows that repeat an id link like
    others; a row with a null id is never kept and has the component of what it reaches. An empty table gives an
    empty result; other columns are not read.
    """
    element = table.schema[vector_col].dataType.elementType.simpleString()  # type: ignore[attr-defined]
    kind = "<f4" if element == "float" else "<f8"
    raw = table.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("e"))
    clean = F.col("label").isNotNull() & F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(3)
            packed = [None if x is None else np.array(x, kind).tobytes() for x in e.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary()), pa.array([None if x is None else len(x) for x in e.to_pylist()], pa.int32())], ["at", "vec_id", "label", "vector", "dim"])

    label_type = table.schema[label_col].dataType.simpleString()
    rows = cut(raw.select("at", "vec_id", "label", F.when(clean, F.col("e")).alias("e")).mapInArrow(pack, f"at long, vec_id long, label {label_type}, vector binary, dim int"), "knn-rows")
    alike = rows.filter("vector is not null").groupBy("label", "dim", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min("at").alias("row"), F.max(F.col("vec_id") % AUDIT == 0).alias("audited"))
    vectors = cut(alike, "knn-vectors")

    graph, trees = None, 0
    while True:
        first = _buckets(vectors, range(trees, trees + TREES), kind)
        graph = cut(_top(first if graph is None else first.union(graph)), "knn-graph")
        entries = graph.count()
        for _ in range(ROUNDS):
            after = cut(_top(_refine(graph, vectors, kind).union(graph)), "knn-graph")
            changed = after.join(graph, ["v", "u"], "left_anti").count()
            discard(graph)
            graph = after
            if changed <= SETTLED * max(1, entries):
                break
        trees += TREES
        # Saturated lists grow, from the buckets and from neighbours of neighbours, until they end below the threshold.
        wider, width = graph, K
        full = cut(wider.filter(F.col("s") >= threshold).groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") >= width).select("v"), "knn-saturated")
        while width < WIDEST and not full.isEmpty():
            width *= GROW
            wider = cut(_top(_buckets(vectors, range(trees), kind, full, width).union(wider), width), "knn-wider")
            for _ in range(2):
                wider = cut(_top(_refine(wider, vectors, kind, full, width).union(wider), width), "knn-wider")
            full = cut(wider.filter(F.col("s") >= threshold).groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") >= width).select("v"), "knn-saturated")
        near = wider.filter(F.col("s") >= threshold)
        links = cut(near.select("v", "u").union(near.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "knn-links")
        crowd = vectors.join(full.withColumnRenamed("v", "row"), "row", "left_semi")
        settled = cut(_against_all(crowd, vectors, threshold, kind, False), "knn-settled")
        # What was settled is exact, so the audit asks about the others.
        asked = vectors.filter("audited").join(full.withColumnRenamed("v", "row"), "row", "left_anti")
        want = _against_all(asked, vectors, threshold, kind, True).select("v", "u")
        n, hit = want.join(links.withColumn("hit", F.lit(1)), ["v", "u"], "left").agg(F.count("*"), F.count("hit")).first()
        recall = hit / n if n else 1.0
        if recall >= RECALL or trees >= MOST_TREES:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"recall {recall:.3f} of the audited links is below {LEAST_RECALL}")
    links = cut(links.union(settled.filter("u is not null").select("v", "u")).distinct(), "knn-links")
    found = cut(components(links.select("v", "u").toDF("u", "v"), "knn"), "knn-components")
    member = cut(vectors.join(found, F.col("row") == F.col("node"), "left").select("row", "label", "dim", "vector", "copies", "least", F.coalesce("component", "row").alias("c")), "knn-members")
    enlarged = settled.filter("u is null").groupBy(F.col("v").alias("row")).agg(F.sum("n").alias("n_all"))
    near = near.select("v", "u").union(near.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    listed = near.join(member.select(F.col("row").alias("u"), "copies"), "u").groupBy(F.col("v").alias("row")).agg(F.sum("copies").alias("n_list"))
    first = member.groupBy("c").agg(F.min("least").alias("component_id"))
    done = (
        member.join(first, "c").join(listed, "row", "left").join(enlarged, "row", "left")
        .select("label", "dim", "vector", "component_id", (F.col("copies") - 1 + F.coalesce("n_all", "n_list", F.lit(0))).alias("n_links"), F.col("n_all").isNotNull().alias("saturated"))
    )
    # Equal vectors share the answer; the others are alone.
    out = rows.join(done.withColumnsRenamed({"label": "l", "dim": "d", "vector": "e"}), (F.col("vector") == F.col("e")) & (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")), "left")
    component = F.when(F.col("n_links").isNull() | (F.col("n_links") == 0), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.coalesce("saturated", F.lit(False)).alias("saturated"), F.lit(recall if n else None).cast("double").alias("audited_recall"), F.lit(n).cast("long").alias("audited_links"))
