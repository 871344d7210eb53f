"""Which rows of an index which models have, by bitmaps over row numbers.

A bitmap has a bit for each of 32,768 neighbouring rows; tasks build those of their rows before anything is
shuffled, so that what moves is a bitmap for each model, shard and block of rows, never a pair of keys. Blocks in
which all bitmaps are equal are done; only others are taken apart, in chunks of 64 bytes, then bytes, then bits.

Defined cases: row numbers are 0 or more; rows without one are in no bitmap; a row that occurs twice counts once; empty
tables have no blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ["listing_id", "image_id"]
BLOCK_ROWS, BLOCK_BYTES, CHUNK_BYTES = 32_768, 4_096, 64


def row_bitmaps(df: DataFrame, by: Sequence[str] = (), row: str = "global_row") -> DataFrame:
    """(by, block, bits): the row numbers that occur, a bitmap for each block of 32,768."""
    after = F.col(row) + 1  # blocks of 32,768 begin at 1
    return df.filter(F.col(row) >= 0).groupBy(*by, F.bitmap_bucket_number(after).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(after)).alias("bits"))


def bits_by_model(index: DataFrame, vectors: DataFrame, models: Sequence[str], by: Sequence[str] = (), row: str = "global_row") -> DataFrame:
    """(by, block, indexed, m0, m1, ...): bitmaps of the index and of each model; NULL where there is no row."""
    kept = vectors.filter(F.col("model").isin(*models)).select(*by, row, "model")
    sides = index.select(*by, row, F.lit(None).cast("string").alias("model")).unionByName(kept)
    each = row_bitmaps(sides, [*by, "model"], row)
    return each.groupBy(*by, "block").agg(
        F.max(F.when(F.col("model").isNull(), F.col("bits"))).alias("indexed"),
        *(F.max(F.when(F.col("model") == m, F.col("bits"))).alias(f"m{i}") for i, m in enumerate(models)),
    )


def differs(sides: Sequence[str]) -> Column:
    """Whether one of the models' bits aren't the index's."""
    found = F.lit(False)
    for side in sides:
        found = found | ~F.col(side).eqNullSafe(F.col("indexed"))
    return found


def cut(sides: Sequence[str], at: str, width: int) -> list[Column]:
    return [F.col(side).substr(F.col(at) * width + 1, F.lit(width)).alias(side) for side in sides]


def missing_rows(index: DataFrame, vectors: DataFrame, models: Sequence[str], row: str = "global_row") -> DataFrame:
    """(row, missing): rows of the index that lack a model, with the sorted list of those they lack."""
    names = sorted(models)
    sides = [f"m{i}" for i in range(len(names))]
    blocks = bits_by_model(index, vectors, names, row=row).filter(F.col("indexed").isNotNull() & differs(sides))
    chunks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_BYTES // CHUNK_BYTES - 1))))
    chunks = chunks.select("block", "chunk", *cut(["indexed", *sides], "chunk", CHUNK_BYTES)).filter(differs(sides))
    octets = chunks.withColumn("octet", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_BYTES - 1)))).select("block", "chunk", "octet", *cut(["indexed", *sides], "octet", 1))
    number = lambda side: F.coalesce(F.conv(F.hex(F.col(side)), 16, 10).cast("int"), F.lit(0)).alias(side)
    octets = octets.filter(differs(sides)).select("block", "chunk", "octet", *map(number, ["indexed", *sides]))
    bits = octets.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).filter(F.getbit("indexed", "bit") == 1)
    lacking = F.array_compact(F.array(*(F.when(F.getbit(side, "bit") == 0, F.lit(m)) for side, m in zip(sides, names, strict=True))))
    place = (F.col("block") - 1) * BLOCK_ROWS + (F.col("chunk") * CHUNK_BYTES + F.col("octet")) * 8 + F.col("bit")
    return bits.select(place.cast("bigint").alias(row), lacking.alias("missing")).filter(F.size("missing") > 0)


def incomplete_rows(index: DataFrame, vectors: DataFrame, models: Sequence[str], row: str = "global_row") -> DataFrame:
    """(KEYS, missing) of the index's rows that lack a model; a row without a number lacks them all."""
    gaps = missing_rows(index, vectors, models, row)
    every = F.array(*(F.lit(m) for m in sorted(models)))
    return index.join(gaps, row).select(*KEYS, "missing").unionByName(index.filter(F.col(row).isNull()).select(*KEYS, every.alias("missing")))


def embedded_rows(index: DataFrame, vectors: DataFrame, models: Sequence[str], active_only: bool = True, row: str = "global_row") -> DataFrame:
    """KEYS of the rows (of the last shard) that every model has."""
    rows = index.join(index.agg(F.max("shard").alias("shard")), "shard", "left_semi") if active_only else index
    rows = rows.filter(F.col(row).isNotNull())
    return rows.join(missing_rows(rows, vectors, models, row), row, "left_anti").select(*KEYS).distinct()


def check_shard_rows(index: DataFrame, vectors: DataFrame, models: Sequence[str], row: str = "global_row") -> DataFrame:
    """(shard, indexed, least, most, outcome): whether all models that occur in a shard have the index's rows.

    Beyond counts, ``different rows`` are equal counts of other rows than the index has.
    """
    sides = [f"m{i}" for i in range(len(models))]
    blocks = bits_by_model(index, vectors, models, ["shard"], row)
    count = lambda side: F.sum(F.bitmap_count(F.coalesce(F.col(side), F.lit(b""))))
    counts = [F.nullif(count(side), F.lit(0)).alias(side) for side in sides]
    same = [F.bool_and(F.col(side).eqNullSafe(F.col("indexed"))).alias(f"same_{side}") for side in sides]
    shards = blocks.groupBy("shard").agg(count("indexed").alias("indexed"), *counts, *same)
    agree = F.lit(True)
    for side in sides:
        agree = agree & (F.col(side).isNull() | F.col(f"same_{side}"))
    least, most = (F.array_min(F.array(*sides)), F.array_max(F.array(*sides)))
    outcome = (
        F.when(least.isNull() & (F.col("indexed") == 0), "empty").when(least.isNull(), "no vectors").when(least != most, "different counts")
        .when(least != F.col("indexed"), "count mismatch").when(~agree, "different rows").otherwise("consistent")
    )
    return shards.select("shard", "indexed", least.alias("least"), most.alias("most"), outcome.alias("outcome"))


def row_consistency(index: DataFrame, vectors: DataFrame, image_models: Sequence[str], text_models: Sequence[str], row: str = "global_row") -> DataFrame:
    """(indexed, images_apart, texts_apart, index_apart, consistent), one row.

    ``apart`` are the rows that some but not all have of the image models, of the text models, and of the
    image models with the index. A listed model without vectors lacks all rows.
    """
    parts = {"images": list(image_models), "texts": list(text_models), "index": [*image_models, None]}
    within = [F.when(F.coalesce(F.col("model").isin([m for m in of if m]), F.lit(False)) | (F.col("model").isNull() & F.lit(None in of)), F.lit(part)) for part, of in parts.items()]
    kept = vectors.filter(F.col("model").isin(parts["images"] + parts["texts"])).select(row, "model")
    each = row_bitmaps(index.select(row, F.lit(None).cast("string").alias("model")).unionByName(kept), ["model"], row)
    shared = each.withColumn("part", F.explode(F.array_compact(F.array(*within)))).groupBy("part", "block").agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_and_agg("bits")).alias("common"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("some"),
        F.max(F.when(F.col("model").isNull(), F.bitmap_count("bits"))).alias("indexed"),
    )
    whole = F.lit(0)
    for part, of in parts.items():
        whole = F.when(F.col("part") == part, F.lit(len(of))).otherwise(whole)
    lost = F.col("some") - F.when(F.col("n") == whole, F.col("common")).otherwise(0)
    apart = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, lost)), F.lit(0)).alias(f"{part}_apart")
    found = shared.agg(F.coalesce(F.sum("indexed"), F.lit(0)).alias("indexed"), *map(apart, parts))
    return found.withColumn("consistent", (F.col("images_apart") == 0) & (F.col("texts_apart") == 0) & (F.col("index_apart") == 0))
