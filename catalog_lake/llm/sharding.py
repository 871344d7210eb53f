"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2**bits`` levels: a value's level is the middle of the share of rows up
to it, so that a dimension of few values spreads over the whole range of levels, too, and takes part in the
curve's first turns. Shares are exact and of whole values: a combining aggregate counts the rows of each value,
the distinct values are sorted in ranges and their counts summed up range by range, and levels are joined back by value
(a value that many rows have is a hot key of that join, which Spark splits). The levels of a row give its place on
the Hilbert curve, rows are numbered in curve order without a single-task sort, and the sequence is cut into
runs whose row counts differ by one at most. Rows near on the curve are near in every dimension, so that a file of one run has
narrow minima and maxima in all of them and a filter on any of them skips files.

Law: ``rows``. Equal texts needn't meet in a shard: a group of copies larger than a shard couldn't.
Defined cases: NULL values come before all others of a dimension; strings are ordered by their UTF-8 bytes, numbers, fractions
too, by size; a NULL text has size 8 and checksum 0; identical rows get neighbouring slots, and may lie in several
tasks, rows that tie in all columns of the order any of them; very long texts count whole; an empty table gives an empty
result; other columns of the input, whatever their names, are not touched. Rerunning on the same rows gives the same shards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from catalog_lake.numbering import number_rows
from catalog_lake.session import materialise

#: Levels per dimension are 2 to this power.
BITS = 6
SHARDS = 24


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points given as an (n, dimensions) array of levels."""
    x = np.array(levels, dtype=np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):  # undo the excess turns, high bits first
        low = q - 1
        for d in range(dims):
            hit = (x[d] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):  # Gray code across the dimensions
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> b) & 1)
    return index


def value_levels(df: DataFrame, column: str, total: int, bits: int = BITS) -> DataFrame:
    """``column``'s distinct values (in a column of that name) and level, the middle of their share of ``total`` rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__rows"))
    order = F.col(column).asc_nulls_first()
    here = F.monotonically_increasing_id()
    ranged = counts.repartitionByRange(order).sortWithinPartitions(order).withColumns({"__range": F.shiftright(here, 33), "__place": here})
    ranged = materialise(ranged, "values")  # so that a lost executor can't draw other ranges
    within = F.sum("__rows").over(W.partitionBy("__range").orderBy("__place"))
    ranges = ranged.groupBy("__range").agg(F.sum("__rows").alias("__of_range"))  # a row for each shuffle partition
    before = F.coalesce(F.sum("__of_range").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("__within", within).join(F.broadcast(ranges.select("__range", before.alias("__before"))), "__range")
    middle = 2 * (F.col("__before") + F.col("__within")) - F.col("__rows")
    return placed.select(column, F.least(F.floor(middle * (1 << bits) / (2 * max(total, 1))), F.lit((1 << bits) - 1)).cast("bigint").alias("level"))


def curve_places(df: DataFrame, dimensions: Sequence[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df``, which should be stored, plus the row's place on the curve through the quantised ``dimensions``."""
    total, placed = df.count(), df
    for i, c in enumerate(dimensions):
        levels = value_levels(df, c, total, bits).select(F.col(c).alias("__value"), F.col("level").alias(f"__level{i}"))
        placed = placed.join(levels, placed[c].eqNullSafe(levels["__value"]), "left").drop("__value")

    @F.pandas_udf("bigint")
    def place(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    found = [f"__level{i}" for i in range(len(dimensions))]
    return placed.withColumn(name, place(*found)).drop(*found)


def hilbert_shards(df: DataFrame, dimensions: Sequence[str], tie: Sequence[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` plus curve, shard (0 to shards - 1) and slot (gapless from 0 within a shard).

    Rows are ordered by curve place, then ``tie``. Only ``df``'s columns are shuffled: project texts away
    first and join them back, or write with ``write_shards``.
    """
    # a number for every row ends ties, so that identical rows may lie in several ranges
    df = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "metadata")
    total = df.count()
    placed = curve_places(df, dimensions, bits)
    numbered = number_rows(placed, [F.col("curve"), *(F.col(c).asc_nulls_last() for c in tie), F.col("__row")], "__rank").drop("__row")
    shard = F.expr(f"__rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return numbered.withColumn("shard", shard).withColumn("slot", F.col("__rank") - first).withColumn("shard", F.col("shard").cast("int")).drop("__rank")


def write_shards(placed: DataFrame, path: str) -> None:
    """Parquet files by shard, each a run of slots in order; a large shard is written by several tasks."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", "source", "lang", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    placed = hilbert_shards(narrow, ("source", "lang", "size"), ("doc_id", "size", "text_crc32"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
