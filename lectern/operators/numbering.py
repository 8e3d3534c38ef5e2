"""Running sums over long groups in two levels: within a partition of the sorted rows, and over the partitions of a group.

A window over a group sorts all of it in one task. Here rows are dealt by ranges of (group, order), so that a group of any
size spans as many tasks as it needs; a group's partitions have one sum each, and only those are summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def running_sums(rows: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with columns of sums over the rows of their group up to and with their own, in ``order``; nulls count 0.

    Rows that tie in ``order`` are summed in some order that is the same for all sums. A null group is a group; an empty table stays empty.
    """
    # Ties are parted by their place in the input, so that many of them need not stay in one partition.
    keys = [group, *order, "__tie"]
    own = rows.withColumns({f"__own_{c}": F.coalesce(x.cast("long"), F.lit(0)) for c, x in sums.items()}).withColumn("__tie", F.monotonically_increasing_id())
    dealt = own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt.drop(*sums), "dealt")
    parts = dealt.groupBy(group, "__part").agg(*[F.sum(f"__own_{c}").alias(f"__sum_{c}") for c in sums])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums])
    inner = Window.partitionBy("__part", group).orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({f"__in_{c}": F.sum(f"__own_{c}").over(inner) for c in sums})
    both = local.join(parts, (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    kept = [c for c in rows.columns if c not in sums]
    return both.select(*kept, *[(F.col(f"__in_{c}") + F.col(f"__before_{c}")).alias(c) for c in sums])


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """``rows`` with their 1-based place in their group, as ``sessions.numbered`` gives it, for groups of any size."""
    return running_sums(rows, group, order, {name: F.lit(1)})


def seen_so_far(rows: DataFrame, group: str, item: str, order: list[str], name: str = "sources") -> DataFrame:
    """``rows`` with the number of different items that their group has shown up to them; the first of an item is found by a minimum, not by a window."""
    at = F.struct(*order)
    first = rows.groupBy(group, item).agg(F.min(at).alias("__first")).select(F.col(group).alias("__g"), F.col(item).alias("__i"), "__first")
    marked = rows.join(first, F.col(group).eqNullSafe(F.col("__g")) & F.col(item).eqNullSafe(F.col("__i")) & at.eqNullSafe(F.col("__first")), "left")
    return running_sums(marked.withColumn("__fresh", F.col("__first").isNotNull()).drop("__g", "__i", "__first"), group, order, {name: F.col("__fresh").cast("int")}).drop("__fresh")
