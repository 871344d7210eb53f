"""Quality and monitoring: counts and consistency reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from catalog_lake.functions.columns import missing

BYTE_TOLERANCE = 1 << 20
#: Metadata directories that inventories leave out.
METADATA_DIRS = (".Spotlight-V100", ".fseventsd", ".TemporaryItems", ".Trashes")


def status_counts(image_status: DataFrame) -> DataFrame:
    """One row: rows by status, total, downloaded (2), pending (0)."""
    by = [F.count_if(F.col("download_done") == s).alias(f"status_{s}" if s >= 0 else "status_dead") for s in (-1, 0, 1, 2, 3, 4)]
    return image_status.agg(*by, F.count(F.lit(1)).alias("total"), F.count_if(F.col("download_done") == 2).alias("downloaded"), F.count_if(F.col("download_done") == 0).alias("pending"))


def missing_primary(image_status: DataFrame) -> DataFrame:
    """One row: listings without a primary image, of all listings."""
    by = image_status.groupBy("listing_id").agg(F.max(F.coalesce("is_primary", F.lit(0))).alias("p"))
    return by.agg(F.count_if(F.col("p") != 1).alias("missing"), F.count(F.lit(1)).alias("listings"))


def missing_url_count(image_status: DataFrame) -> DataFrame:
    return image_status.agg(F.count_if(missing(F.col("url"))).alias("missing"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def compare_inventories(src: DataFrame, dst: DataFrame, exclude: Sequence[str] = METADATA_DIRS, tolerance: int = BYTE_TOLERANCE) -> DataFrame:
    """One row: counts and bytes of two file inventories (name, size), their differences, and ok."""

    def total(df: DataFrame, side: str) -> DataFrame:
        kept = df.filter(~F.arrays_overlap(F.split("name", "/"), F.array(*(F.lit(e) for e in exclude))))
        return kept.agg(F.count(F.lit(1)).alias(f"{side}_files"), F.coalesce(F.sum("size"), F.lit(0)).alias(f"{side}_bytes"))

    both = total(src, "src").crossJoin(total(dst, "dst"))  # one row each
    both = both.withColumns({"delta_files": F.col("src_files") - F.col("dst_files"), "delta_bytes": F.col("src_bytes") - F.col("dst_bytes")})
    return both.withColumn("ok", (F.col("delta_files") == 0) & (F.abs("delta_bytes") <= tolerance))


def embedding_progress(image_status: DataFrame, vectors: DataFrame) -> DataFrame:
    """(model, vectors, ready): vectors per model, and images that are ready to embed."""
    ready = image_status.agg(F.count_if(F.col("download_done") == 2).alias("ready"))
    return vectors.groupBy("model").agg(F.count(F.lit(1)).alias("vectors")).crossJoin(ready)


def index_consistency(index: DataFrame, vectors: DataFrame, image_models: Sequence[str], text_models: Sequence[str]) -> DataFrame:
    """One row: whether image models agree, text models agree, and images equal the index."""
    counts = vectors.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    some = lambda f, models: f(F.when(F.col("model").isin(*models), F.col("n")))
    found = counts.agg(some(F.min, image_models).alias("image_least"), some(F.max, image_models).alias("image_most"), some(F.min, text_models).alias("text_least"), some(F.max, text_models).alias("text_most"))
    joined = found.crossJoin(index.agg(F.count(F.lit(1)).alias("indexed")))
    return joined.select(
        "indexed", "image_least", "image_most", "text_least", "text_most",
        F.col("image_least").eqNullSafe(F.col("image_most")).alias("images_agree"), F.col("text_least").eqNullSafe(F.col("text_most")).alias("texts_agree"),
        F.coalesce(F.col("image_least") == F.col("indexed"), F.lit(False)).alias("index_agrees"),
    )
