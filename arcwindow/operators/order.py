"""Running totals over a global order, without one task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arcwindow.plans.scratch import cut_lineage


def row_numbers(df: DataFrame, order: list, name: str, compression: str | None = None) -> DataFrame:
    """Add the place of each row along ``order`` (a unique key), from 1, with one shuffle.

    Rows are range-partitioned and sorted, numbered by their position in the partition, and
    written; on reading, the number of rows in the partitions before is added. What is
    broadcast has one row per partition.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), place.alias("_place")),
        compression,
    )
    per_part = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, (F.col("_place") + F.col("_before")).alias(name))


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column], compression: str | None = None) -> DataFrame:
    """Add inclusive running sums along ``order`` (a unique key), in two levels.

    Rows are range-partitioned by the key; each partition is summed on its own, and the
    totals of the partitions before it are added. The partitioning is written to the
    checkpoint folder first, since a range partitioning that is computed again may put
    its borders elsewhere. What is broadcast has one row per partition.
    """
    amounts = {f"_x{i}": c for i, c in enumerate(totals.values())}
    names = dict(zip(totals, amounts))
    placed = cut_lineage(
        df.select("*", *[c.cast("bigint").alias(a) for a, c in amounts.items()])
        .repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id()),
        compression,
    )
    per_part = placed.groupBy("_part").agg(*[F.sum(a).alias(a) for a in amounts])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_o{a}") for a in amounts]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(F.broadcast(offsets), "_part")
    return summed.select(
        *df.columns,
        *[(F.sum(a).over(inside) + F.col(f"_o{a}")).alias(name) for name, a in names.items()],
    )
