"""Order over a whole table without a task that sees all of it: numbered blocks, and prefix scans over them in a tree.

A window over all rows, or over the rows of one hot key, goes through one task. Here the rows are put into blocks by range,
each block is worked on by itself, and what a block hands to those behind it is scanned with a fixed fan-out: groups of FAN
blocks, groups of FAN groups, and so on, so that no task of a scan reads more than FAN rows of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import cut, partitions_for

#: Rows of a key that one task of a scan reads.
FAN = 1024
#: Rows that a block holds where the table is large.
ROWS_PER_BLOCK = 1_000_000


def in_blocks(df: DataFrame, order: Sequence[str], rows: int, name: str) -> tuple[DataFrame, int]:
    """df written with a long `at`, ascending in the order named, and the long `block` that `at` falls in, from 0; and the
    number of blocks. Rows that agree in all columns of the order get different places, in no certain order. Null sorts first."""
    n = partitions_for(df.sparkSession, rows, ROWS_PER_BLOCK)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    found = placed.withColumn("block", F.shiftright("at", 33))
    found.written_at = placed.written_at  # for discard()
    return found, n


_OVER = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "xor": F.bit_xor}


def carried(groups: DataFrame, by: Sequence[str], at: str, values: Mapping[str, str], n: int) -> DataFrame:
    """groups, one row for each (by, at) with at from 0 to n - 1, and for each value a column `before_<value>` over the rows of
    the same `by` with a smaller at: their "last" value that is not null, their "sum" or their "xor" (null where there are none).

    The columns of `by` hold no null."""
    up = f"{at}_over"
    before = Window.partitionBy(*by, up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = groups.withColumn(up, F.floor(F.col(at) / FAN))
    local = inside.select("*", *[_OVER[how](F.col(c)).over(before).alias(f"before_{c}") for c, how in values.items()])
    if n <= FAN:
        return local.drop(up)

    def whole(c: str, how: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))) if how == "last" else _OVER[how](F.col(c))

    above = carried(inside.groupBy(*by, up).agg(*[whole(c, how).alias(c) for c, how in values.items()]), by, up, values, -(-n // FAN))
    joined = local.join(above.select(*by, up, *[F.col(f"before_{c}").alias(f"above_{c}") for c in values]), [*by, up])

    def both(c: str, how: str) -> Column:
        a, b = F.col(f"above_{c}"), F.col(f"before_{c}")
        met = {"last": b, "sum": a + b, "xor": a.bitwiseXOR(b)}[how]
        return F.coalesce(met, b, a)

    return joined.select(*groups.columns, *[both(c, how).alias(f"before_{c}") for c, how in values.items()])
