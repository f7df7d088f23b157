"""Transaction log reassembly: who survives, and what the shared store holds after each epoch.

The log is put into blocks by position. A change is decided by the next control record of its run: a rollback or an abort
undoes it, a commit applies it, and behind a savepoint no rollback reaches it any more, so the run's next end decides.
Windows over the runs of a block find that record, a scan over the blocks finds it where it lies in a later one. Applied
changes shrink to the last writer of each key in a commit, then in an epoch, then in a block of epochs; a parallel prefix
over the blocks' maps gives the store at the start of each block, and all blocks replay at once from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm import scans
from adlens.llm.common import cut

COMMITS = 16
#: Epochs that are replayed one after another from a checkpoint.
EPOCHS_PER_BLOCK = 32
KINDS = ("commit", "abort", "savepoint", "rollback", "change")


@dataclass(frozen=True)
class Reassembled:
    """undone (id, why, by, key, value): changes that were not applied; by is the id of the record that undid them, null for
    the end of the log. epochs (epoch). writes (block, epoch, key, value): the last write of a key in an epoch, a null value
    being a deletion. checkpoints (block, key, value): what the store holds before the first epoch of a block."""

    undone: DataFrame
    epochs: DataFrame
    writes: DataFrame
    checkpoints: DataFrame


def _block_of(epoch: str = "epoch") -> Column:
    return F.floor((F.col(epoch) - 1) / EPOCHS_PER_BLOCK)


def _starts(maps: DataFrame, n: int) -> DataFrame:
    """maps (block, key, w): a block's last write of a key -> (block, key, w): the last write before each of the n blocks.

    A write holds up to the next one of its key, so the prefix is one lead over the writes and a sequence of blocks. It is
    taken inside groups of FAN blocks, which start with the prefix over the groups before them."""
    inside = maps.withColumn("over", F.floor(F.col("block") / scans.FAN))
    if n > scans.FAN:
        tops = inside.groupBy("over", "key").agg(F.max_by("w", "block").alias("w"))
        above = _starts(tops.withColumnRenamed("over", "block"), -(-n // scans.FAN))
        inside = inside.unionByName(above.select((F.col("block") * scans.FAN - 1).alias("block"), "key", "w", F.col("block").alias("over")))
    following = F.lead("block").over(Window.partitionBy("over", "key").orderBy("block"))
    last = F.least(following, (F.col("over") + 1) * scans.FAN - 1, F.lit(n - 1))
    held = inside.withColumn("last", last).filter("last > block")
    return held.select(F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("block"), "key", "w").filter("w.value is not null")


def reassemble(log: DataFrame, rows: int, commits: int = COMMITS) -> Reassembled:
    """log (id long, source string, kind of KINDS, key, value), about `rows` rows, read by ascending id.

    Every source, null among them, runs its own transactions. Of equal ids the order is by source (null first), kind, key
    and a hash of the value; rows that agree in all of these do the same, in whatever order. Rows without an id or a kind are no records and
    are left out; a change without a key is one of the key null. A null value deletes its key. An empty log gives no epochs.
    """
    run = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    records = log.filter("id is not null and kind is not null").select(F.col("id").cast("long").alias("id"), run.alias("run"), "kind", "key", "value", F.xxhash64("value").alias("tie"))
    placed, n = scans.in_blocks(records, ["id", "run", "kind", "key", "tie"], rows, "log-blocks")

    # Commits are ranked over the whole log, and every so many of them end an epoch.
    done = placed.filter("kind = 'commit'").select("at", "block")
    ahead = scans.carried(done.groupBy("block").agg(F.count("*").alias("n")), [], "block", {"n": "sum"}, n)
    rank = F.row_number().over(Window.partitionBy("block").orderBy("at")) + F.coalesce("before_n", F.lit(0))
    ranked = cut(done.join(ahead, "block").select("at", rank.alias("rank")).withColumn("epoch", F.floor((F.col("rank") - 1) / commits) + 1), "log-commits")
    n_epochs = -(-ranked.count() // commits)

    # The next control record, and the next end, of the same run.
    here = F.struct("at", "kind", "id")
    control, end = F.when(F.col("kind") != "change", here), F.when(F.col("kind").isin("commit", "abort"), here)
    behind = Window.partitionBy("block", "run").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    changes = placed.select("*", F.last(control, True).over(behind).alias("next"), F.last(end, True).over(behind).alias("finish")).filter("kind = 'change'")
    first = placed.groupBy("block", "run").agg(F.min(control).alias("control"), F.min(end).alias("end")).withColumn("back", n - 1 - F.col("block"))
    later = scans.carried(first, ["run"], "back", {"control": "last", "end": "last"}, n).select("block", "run", "before_control", "before_end")
    found = F.coalesce("next", "before_control")
    decided = F.when(found["kind"] == "savepoint", F.coalesce("finish", "before_end")).otherwise(found)
    decided = cut(changes.join(later, ["block", "run"]).select("id", "key", "value", "at", decided.alias("by")), "log-decided")
    undone = decided.filter("by is null or by.kind != 'commit'").select("id", F.coalesce("by.kind", F.lit("abort")).alias("why"), F.col("by.id").alias("by"), "key", "value")

    last = decided.filter("by.kind = 'commit'").groupBy(F.col("by.at").alias("commit"), "key").agg(F.max_by(F.struct("value"), "at").alias("w"))
    in_epoch = last.join(ranked.withColumnRenamed("at", "commit"), "commit").groupBy("epoch", "key").agg(F.max_by("w", "rank").alias("w"))
    writes = cut(in_epoch.withColumn("block", _block_of()), "log-writes")
    maps = writes.groupBy("block", "key").agg(F.max_by("w", "epoch").alias("w"))
    starts = cut(_starts(maps, -(-n_epochs // EPOCHS_PER_BLOCK)).select("block", "key", F.col("w.value").alias("value")), "log-checkpoints")
    return Reassembled(undone, ranked.select("epoch").distinct(), writes.select("block", "epoch", "key", F.col("w.value").alias("value")), starts)


def replay(log: Reassembled, measure: str = "value") -> DataFrame:
    """(epoch, n, total): after each epoch the number of stored keys, and the sum of `measure`, an SQL expression of `value`
    that gives a long, over them. Each block starts from its checkpoint."""
    start = log.checkpoints.select("block", (F.col("block") * EPOCHS_PER_BLOCK).alias("epoch"), "key", "value")
    known = start.unionByName(log.writes).select("block", "epoch", "key", F.when(F.col("value").isNotNull(), F.expr(measure).cast("long")).alias("m"), F.col("value").isNotNull().cast("long").alias("held"))
    before = Window.partitionBy("block", "key").orderBy("epoch")
    steps = known.select(
        "block", "epoch", (F.col("held") - F.coalesce(F.lag("held").over(before), F.lit(0))).alias("n"), (F.coalesce("m", F.lit(0)) - F.coalesce(F.lag("m").over(before), F.lit(0))).alias("total")
    )
    empty = log.epochs.select(_block_of().alias("block"), "epoch", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    sums = steps.unionByName(empty).groupBy("block", "epoch").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    so_far = Window.partitionBy("block").orderBy("epoch")
    states = sums.select("block", "epoch", F.sum("n").over(so_far).alias("n"), F.sum("total").over(so_far).alias("total"))
    return states.filter(F.col("epoch") > F.col("block") * EPOCHS_PER_BLOCK).select("epoch", "n", "total")


def store_after(log: Reassembled, epoch: int) -> DataFrame:
    """(key, value): what the store holds after an epoch from 1 on, from the checkpoint of its block."""
    block = (epoch - 1) // EPOCHS_PER_BLOCK
    start = log.checkpoints.filter(F.col("block") == block).select(F.lit(0).cast("long").alias("epoch"), "key", "value")
    since = log.writes.filter((F.col("block") == block) & (F.col("epoch") <= epoch)).select("epoch", "key", "value")
    last = start.unionByName(since).groupBy("key").agg(F.max_by(F.struct("value"), "epoch").alias("w"))
    return last.select("key", "w.value").filter("value is not null")


def log_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs as log records (id, source, kind, key, value): what a document does hangs on the CRC-32 of its id; the value of a
    change is the CRC-32 of `key:text`, null where the text is null or a label says that it is toxic."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    kinds = F.array(*[F.lit(k) for k in ("commit", "commit", "abort", "savepoint", "savepoint", "rollback", "rollback")])
    kind = F.when(h.isNotNull(), F.coalesce(F.get(kinds, (h % 41).cast("int")), F.lit("change")))
    key = (F.floor(h / 100) % 3000).cast("long")
    held = F.crc32(F.concat_ws(":", key.cast("string"), F.col("text").cast("string")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), kind.alias("kind"), key.alias("key"), F.when(F.col("text").isNotNull(), held).alias("value"))
    rows = rows.select("id", "source", "kind", F.when(F.col("kind") == "change", F.col("key")).alias("key"), F.when(F.col("kind") == "change", F.col("value")).alias("value"))
    toxic = labels.filter("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.lit(1).alias("toxic")).distinct()
    # A merge join at every size: the toxic ids grow with the input, and are not to be broadcast.
    joined = rows.filter("id is not null").join(toxic.hint("merge"), "id", "left")
    return joined.select("id", "source", "kind", "key", F.when(F.col("toxic").isNull(), F.col("value")).alias("value"))
