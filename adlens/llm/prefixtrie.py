"""Prefix trie of conversations: succinct level-order tries of bounded shards, with the heavy upper levels merged apart.

A node is a distinct sequence of first turns. Its key is the exclusive-or of 128-bit hashes of its (position, turn) pairs, a
prefix scan that any stretch of a conversation can be worked on for by itself. Nodes are the groups of a key. Below a node
lie at most as many nodes as its members have turns left; where that is over SHARD_TURNS the node is heavy. What hangs on
heavy nodes are light subtrees: shards. A task takes some shards whole, lays them out as one LOUDS trie (bits in level
order, a label a node) and rolls its sums up in reverse level order. Heavy nodes then gather their shards' sums and each
other's, by doubling the distance gathered from in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm import scans
from adlens.llm.common import cut, discard, partitions_for

#: Turns left below a light node, at most.
SHARD_TURNS = 4_000
#: Nodes of a task, on average.
TASK_NODES = 100_000
#: Turns of a conversation whose hashes one task combines.
SLAB = 4096
#: Ids are put together by stretches of this many (a power of two, by its exponent) before the digest of a node's ends.
STRETCH_BITS = 12

_WORD = r"[^\x20\x09-\x0D]+"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, k1 long, k2 long, parent_conv_id long, top boolean, p1 long, p2 long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns_of(conversations: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """conversations (conv_id, turn, role, text) -> (conv, rank from 1, t1, t2, words) of every turn, and (conv, n).

    Turns are ordered by turn (null first), then role, then a hash of the text. Null roles and texts are empty; rows without a
    conv_id are left out. No task sees a whole conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    placed, n = scans.in_blocks(narrow, ["conv", "turn", "role", "tie"], rows, "trie-turns")
    inside = F.row_number().over(Window.partitionBy("block", "conv").orderBy("at"))
    ahead = scans.carried(placed.groupBy("block", "conv").agg(F.count("*").alias("n")), ["conv"], "block", {"n": "sum"}, n)
    ranked = placed.withColumn("inside", inside).join(ahead, ["block", "conv"])
    ranked = cut(ranked.select("conv", (F.col("inside") + F.coalesce("before_n", F.lit(0))).alias("rank"), "t1", "t2", "words"), "trie-ranked")
    discard(placed)
    return ranked, ranked.groupBy("conv").agg(F.max("rank").alias("n"))


def spliced(turns: DataFrame, convs: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of the conversation c - c % every in place of its own first h, where h is
    the CRC-32 of the decimal c modulo heads: its turns (conv, depth, t1, t2, words), and (conv, n)."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    base = F.col("conv") - F.col("conv") % every
    bases = convs.select(F.col("conv").alias("base"), F.least("n", F.lit(heads - 1)).alias("there"))
    plan = convs.select("conv", "n", h.alias("h"), base.alias("base")).join(bases, "base", "left").withColumn("p", F.least("h", F.coalesce("there", F.lit(0))))
    plan = cut(plan.select("conv", "base", "h", "p", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "trie-plan")
    own = turns.join(plan.select("conv", "h", "p"), "conv").filter("rank > h").select("conv", (F.col("rank") - F.col("h") + F.col("p")).alias("depth"), "t1", "t2", "words")
    first = turns.filter(F.col("rank") < heads).withColumnRenamed("conv", "base")
    head = plan.filter("p > 0").select("conv", "base", "p").join(first, "base").filter("rank <= p").select("conv", F.col("rank").alias("depth"), "t1", "t2", "words")
    return own.unionByName(head), plan.select("conv", "n")




@dataclass
class Louds:
    """A forest in level order under one root. bits: for the root and then each node a 1 for each child and a 0. order: the
    row of each node. parent: the place of each node's parent, -1 for the root, read off the bits. levels: where each starts."""

    bits: np.ndarray
    order: np.ndarray
    parent: np.ndarray
    children: np.ndarray
    levels: list[int]

    @classmethod
    def build(cls, above: np.ndarray, level: np.ndarray, name: np.ndarray) -> Louds:
        """above: the row of each row's parent, -1 for tops; level: its depth below its top; name: what orders siblings."""
        n, place, order, levels = len(above), np.empty(len(above), np.int64), [], [0]
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            rows = by_level[lo:hi]
            under = np.where(above[rows] < 0, -1, place[above[rows]])
            rows = rows[np.lexsort((name[rows], under))]
            place[rows] = np.arange(levels[-1], levels[-1] + len(rows))
            order.append(rows)
            levels.append(levels[-1] + len(rows))
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        under = np.where(above[order] < 0, -1, place[above[order]]) if n else order
        children = np.bincount(under + 1, minlength=n + 1)
        bits = np.ones(2 * n + 1, np.uint8)
        bits[np.cumsum(children) + np.arange(n + 1)] = 0
        zeros = np.cumsum(bits == 0)
        return cls(bits, order, zeros[bits == 1] - 1, children[1:], levels)

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """The sum of values, in level order, over each node's subtree."""
        total = values.astype(np.int64)
        for lo, hi in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(total, self.parent[lo:hi], total[lo:hi])
        return total


def _forest(rows: pd.DataFrame) -> Louds:
    """rows (k1, k2, p1, p2, level, conv_id) as a trie; siblings are ordered by their smallest member."""
    keys = rows[["k1", "k2"]].assign(row=np.arange(len(rows)))
    above = rows[["p1", "p2"]].merge(keys, how="left", left_on=["p1", "p2"], right_on=["k1", "k2"])["row"].fillna(-1).to_numpy(np.int64)
    level = rows["level"].to_numpy(np.int64)
    return Louds.build(np.where(level == 0, -1, above), level, rows["conv_id"].to_numpy(np.int64))


def _shards(table: pa.Table) -> pa.Table:
    rows = table.to_pandas()
    trie = _forest(rows)
    rows = rows.iloc[trie.order]
    conv = rows["conv_id"].to_numpy(np.int64)
    inner = trie.parent >= 0
    parent = pa.array(conv[np.where(inner, trie.parent, 0)], pa.int64(), mask=~inner)
    leaves = trie.rolled_up(trie.children == 0)
    saved = trie.rolled_up((rows["n_convs"].to_numpy(np.int64) - 1) * rows["words"].to_numpy(np.int64))
    own = {c: pa.array(rows[c].to_numpy(np.int64)) for c in ("conv_id", "depth", "k1", "k2", "p1", "p2", "n_convs")}
    made = {"parent_conv_id": parent, "top": pa.array(~inner), "n_children": pa.array(trie.children.astype(np.int64)), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved)}
    return pa.table({c.split()[0]: (own | made)[c.split()[0]] for c in _NODE.split(", ")})


def _layout(table: pa.Table) -> pa.Table:
    rows = table.to_pandas()
    trie = _forest(rows)
    labels = rows[["t1", "t2"]].to_numpy(np.int64)[trie.order]
    return pa.table({"part": pa.array([int(rows["part"].iloc[0])], pa.int64()), "n_nodes": pa.array([len(rows)], pa.int64()), "louds": pa.array([np.packbits(trie.bits).tobytes()], pa.binary()), "labels": pa.array([labels.astype("<i8").tobytes()], pa.binary())})


@dataclass(frozen=True)
class Trie:
    """nodes: all but the root. heavy: those of them that are merged apart. light: the others, with the part they lie in and
    their level there. ends: the key of the node where each conversation ends (zeros: the root)."""

    nodes: DataFrame
    heavy: DataFrame
    light: DataFrame
    ends: DataFrame
    root: tuple[int, int] | None

    def shards(self) -> DataFrame:
        """(part, n_nodes, louds, labels): each part's bits, packed, and two 64-bit hashes of each node's last turn, in level
        order. Sums and structure of the light subtrees can be read from these alone."""
        return self.light.groupBy("part").applyInArrow(_layout, "part long, n_nodes long, louds binary, labels binary")


def build(turns: DataFrame, convs: DataFrame) -> Trie:
    """turns (conv, depth from 1 without gaps, t1, t2, words), convs (conv, n: its turns) -> the trie of their prefixes."""
    mixed = [F.xxhash64(F.lit(seed), "depth", "t1", "t2") for seed in (1, 2)]
    slab = F.floor((F.col("depth") - 1) / SLAB)
    hashed = turns.join(convs, "conv").select("conv", "depth", "t1", "t2", "words", "n", slab.alias("slab"), mixed[0].alias("x1"), mixed[1].alias("x2"))
    root = convs.agg(F.min("conv"), F.count("*"), F.max("n")).first()
    n_slabs = -(-(root[2] or 0) // SLAB)
    so_far = Window.partitionBy("conv", "slab").orderBy("depth")
    keyed = hashed.select("*", *[F.bit_xor(f"x{k}").over(so_far).alias(f"k{k}") for k in (1, 2)])
    if n_slabs > 1:  # conversations that go on in a second slab start from what the first hands over
        whole = hashed.groupBy("conv", "slab").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
        ahead = scans.carried(whole, ["conv"], "slab", {"x1": "xor", "x2": "xor"}, n_slabs).select("conv", "slab", "before_x1", "before_x2")
        joined = keyed.join(ahead, ["conv", "slab"])
        keyed = joined.withColumns({f"k{k}": F.col(f"k{k}").bitwiseXOR(F.coalesce(f"before_x{k}", F.lit(0))) for k in (1, 2)})
    paths = cut(keyed.select("conv", "depth", "t1", "t2", "words", "n", "k1", "k2", *[F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)]), "trie-paths")
    same = [F.first(c).alias(c) for c in ("t1", "t2", "words", "p1", "p2")]
    nodes = cut(paths.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *same, F.sum(F.col("n") - F.col("depth")).alias("left")), "trie-nodes")
    heavy = nodes.filter(F.col("left") > SHARD_TURNS)
    # A conversation lies in the shard of its first light node. A node's smallest member has all nodes above it on its path.
    where = F.min(F.struct("depth", "k1", "k2")).alias("top")
    tops = paths.join(heavy.select("depth", "k1", "k2"), ["depth", "k1", "k2"], "left_anti").groupBy("conv").agg(where)
    n_parts = partitions_for(nodes.sparkSession, nodes.count(), TASK_NODES)
    light = nodes.filter(F.col("left") <= SHARD_TURNS).join(tops.withColumnRenamed("conv", "conv_id"), "conv_id")
    light = light.select(F.pmod(F.xxhash64("top"), F.lit(n_parts)).alias("part"), (F.col("depth") - F.col("top.depth")).alias("level"), "conv_id", "depth", "k1", "k2", "p1", "p2", "t1", "t2", "n_convs", "words")
    zero = F.lit(0).cast("long")
    ends = paths.filter("depth = n").select("depth", "k1", "k2", "conv").unionByName(convs.filter("n = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv"))
    return Trie(nodes, heavy, light, ends, (root[0], root[1]) if root[1] else None)


def _ends(trie: Trie) -> DataFrame:
    """(depth, k1, k2, ends_sha256). Ids come in strings of a stretch each; a node's strings go through one digest in order, which is
    the one thing here that cannot be split, and is held a batch at a time."""
    node = ["depth", "k1", "k2"]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    strings = trie.ends.groupBy(*node, F.shiftright("conv", STRETCH_BITS).alias("stretch")).agg(ids.alias("ids"))
    dealt = strings.repartition(*node).sortWithinPartitions(*node, "stretch")
    schema = "depth long, k1 long, k2 long, ends_sha256 string"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()

        def done(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*node, "ends_sha256"])

        for batch in batches:
            out = []
            for *key, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield done(out)
        if at is not None:
            yield done([(*at, digest.hexdigest())])

    return dealt.mapInArrow(digests, schema)


def _merged(trie: Trie, done: DataFrame) -> DataFrame:
    """The heavy nodes and the root, with the sums of the shards below them and of each other."""
    conv, n = trie.root
    spark = done.sparkSession
    heavy = trie.heavy.select("conv_id", "depth", "k1", "k2", "p1", "p2", "n_convs", "words")
    first = spark.createDataFrame([(conv, 0, 0, 0, None, None, n, 0)], "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, n_convs long, words long")
    at = lambda depth, a, b: F.struct(depth.cast("long").alias("depth"), F.col(a).alias("k1"), F.col(b).alias("k2"))
    up = F.when(F.col("depth") > 0, at(F.col("depth") - 1, "p1", "p2"))
    upper = heavy.unionByName(first).select("conv_id", "n_convs", "words", at(F.col("depth"), "k1", "k2").alias("node"), up.alias("up"))
    below = done.filter("top").groupBy(at(F.col("depth") - 1, "p1", "p2").alias("node")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    within = upper.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("uppers"))
    none = F.lit(0).cast("long")
    own = upper.join(below, "node", "left").join(within, "node", "left").withColumn("n_children", F.coalesce("tops", none) + F.coalesce("uppers", none))
    reps = upper.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    own = own.join(reps, "up", "left").select(
        "node", F.col("up").alias("jump"), "conv_id", "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("l", none)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("s", none)).alias("saved_tokens"),
    )
    own = cut(own, "trie-upper")
    # After k rounds each node holds the sums over all nodes less than 2**k below it, and `jump` is 2**k above it.
    for _ in range(int(own.agg(F.max("node.depth")).first()[0]).bit_length()):
        gathered = own.filter("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        further = own.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        before, joined = own, own.join(gathered, "node", "left").join(further, "jump", "left")
        own = cut(joined.select("node", F.col("next").alias("jump"), "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("l", none)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", none)).alias("saved_tokens")), "trie-upper")
        discard(before)
    return own


def rollups(trie: Trie) -> DataFrame:
    """One row for each node, the root at depth 0 among them: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. No conversations, no nodes."""
    spark = trie.nodes.sparkSession
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if trie.root is None:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in columns) + ", ends_sha256 string")
    done = cut(trie.light.groupBy("part").applyInArrow(_shards, _NODE), "trie-light")
    upper = _merged(trie, done)
    flat = upper.select("conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"))
    tops = flat.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    light = done.join(tops, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    every = light.select(*columns, "k1", "k2").unionByName(flat)
    return every.join(_ends(trie), ["depth", "k1", "k2"], "left").select(*columns, F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
