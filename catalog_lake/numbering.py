"""Gapless global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catalog_lake.session import materialise


def number_rows(df: DataFrame, order: list[Column], name: str = "global_row", start: int = 0, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's place, counted from ``start``, when sorted by ``order``.

    Rows are dealt to sorted ranges and written once to the shared folder, so that a lost executor
    can't draw other range bounds half-way; each range's count gives its offset. The table of offsets
    has one row per range. ``order`` should be total: rows that tie in all of it get numbers in an
    unspecified order. NULL keys sort as ``order`` says. An empty table stays empty.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    local = F.monotonically_increasing_id()
    staged = materialise(
        ranged.sortWithinPartitions(*order).withColumn("__range", F.shiftright(local, 33)).withColumn("__place", local.bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    counts = staged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    # one row per range partition, whose number is a session setting: small whatever the data
    return staged.join(F.broadcast(offsets), "__range").withColumn(name, (F.lit(start) + F.col("__offset") + F.col("__place")).cast("bigint")).drop("__range", "__place", "__rows", "__offset")
