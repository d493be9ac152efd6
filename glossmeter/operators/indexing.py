"""Positions without a single-task window.

``row_number() over (partition by lang order by id)`` puts a whole language into one task, and
one language may hold most rows. Here the order key is cut into fixed-width blocks: rows are
numbered inside ``(group, block)``, and each block starts at the sum of the row counts of the
blocks before it. A block of a unique key holds at most ``2**block_bits`` rows, however skewed
the groups are, and the table of block sizes is that many times smaller than the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BLOCK_BITS = 20


def _starts(sizes: DataFrame, group: Sequence[str], block_bits: int, levels: int) -> DataFrame:
    """Rows of the group before each block: exclusive running sum of the sizes ``_n``."""
    if levels <= 1:
        before = (Window.partitionBy(*group).orderBy("_block")
                  .rowsBetween(Window.unboundedPreceding, -1))
        return sizes.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # Many blocks: number them block-wise too.
    upper = sizes.withColumn("_upper", F.shiftright("_block", block_bits))
    inside = (Window.partitionBy(*group, "_upper").orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = upper.select(*group, "_upper", "_block",
                         F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_local"))
    sums = upper.groupBy(*group, "_upper").agg(F.sum("_n").alias("_n")).withColumnRenamed("_upper", "_block")
    starts = _starts(sums, group, block_bits, levels - 1).withColumnRenamed("_block", "_upper")
    return (local.join(starts, [*group, "_upper"])
            .select(*group, "_block", (F.col("_local") + F.col("_start")).alias("_start")))


def number_rows(rows: DataFrame, group: Sequence[str], order: str, name: str,
                block_bits: int = BLOCK_BITS, levels: int = 1) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by an integer column.

    ``levels=2`` suits sparse keys (hashes), where blocks are many and nearly empty.
    Group columns must not be null.
    """
    blocked = rows.withColumn("_block", F.shiftright(F.col(order).cast("bigint"), block_bits))
    sizes = blocked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = _starts(sizes, group, block_bits, levels)
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    numbered = blocked.withColumn("_rn", F.row_number().over(inside) - 1)
    return (numbered.join(starts, [*group, "_block"])
            .withColumn(name, (F.col("_rn") + F.col("_start")).cast("bigint"))
            .drop("_block", "_rn", "_start"))


def concat_splits(rows: DataFrame, group: Sequence[str], split: str, order: str, name: str,
                  block_bits: int = BLOCK_BITS) -> DataFrame:
    """Number rows over several splits laid end to end in the order of the split column."""
    inner = number_rows(rows, [*group, split], order, "_at", block_bits)
    sizes = rows.groupBy(*group, split).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*group).orderBy(split).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (inner.join(starts, [*group, split])
            .withColumn(name, (F.col("_at") + F.col("_base")).cast("bigint"))
            .drop("_at", "_base"))
