"""Migrations of listing metadata: nested images, primary flags, rows of image status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog_lake.functions.columns import missing

#: Ages of listings in scope.
WHEN_MADE = ("made_to_order", "2020_2026", "2010_2019", "2000_2009", "2000_2006", "2007_2009")
LEAST_PRICE = 50.0
IMAGE = "struct<image_id:bigint,hex:string,suffix:string,is_primary:boolean,bg_removed:boolean>"


def nest_images(meta: DataFrame) -> DataFrame:
    """images from the flat fields, and outcome: converted, already_new, or skipped (error entries)."""
    flat = F.when(F.coalesce("image_id", F.lit(0)) != 0, F.array(F.struct("image_id", "hex", "suffix", F.lit(None).cast("boolean").alias("is_primary"), F.lit(None).cast("boolean").alias("bg_removed")))).otherwise(F.array())
    outcome = F.when(F.col("error").isNotNull(), "skipped").when(F.col("images").isNotNull(), "already_new").otherwise("converted")
    images = F.when(F.col("outcome") == "converted", flat.cast(f"array<{IMAGE}>")).otherwise(F.col("images"))
    return meta.withColumn("outcome", outcome).withColumn("images", images).drop("image_id", "hex", "suffix")


def flag_first_image(meta: DataFrame) -> DataFrame:
    """is_primary true on the first image unless set; outcome: updated, already, no_images."""
    first = F.try_element_at("images", F.lit(1))
    outcome = F.when(first.isNull(), "no_images").when(first["is_primary"].isNotNull(), "already").otherwise("updated")
    flagged = F.transform("images", lambda x, i: F.when((i == 0) & x["is_primary"].isNull(), x.withField("is_primary", F.lit(True))).otherwise(x))
    return meta.withColumn("outcome", outcome).withColumn("images", F.when(F.col("outcome") == "updated", flagged).otherwise(F.col("images")))


def to_image_status(meta: DataFrame, prices: DataFrame, files: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Status rows: one per usable image of listings in scope, one listing-level row (image 0, not to download) for the others."""
    known = prices.select("listing_id", (F.coalesce("price_amount", F.lit(0)) / F.coalesce(F.nullif("price_divisor", F.lit(0)), F.lit(100))).alias("__listed"))
    rows = meta.filter("error is null").join(known, "listing_id", "left").withColumn("price", F.coalesce("__listed", "price"))
    rows = rows.withColumn("__pass", F.coalesce(F.col("when_made").isin(*WHEN_MADE) & (F.col("price") >= LEAST_PRICE), F.lit(False)))
    outside = rows.filter("not __pass").select("listing_id", F.lit(0).cast("bigint").alias("image_id"), F.lit(0).alias("is_primary"), F.lit(0).alias("to_download"), "price", F.lit(0).alias("downloaded"), F.lit(0).alias("bg_removed"))
    images = rows.filter("__pass").select("listing_id", "price", "background_removed", F.posexplode("images").alias("pos", "image"))
    usable = images.filter((F.coalesce("image.image_id", F.lit(0)) != 0) & ~missing(F.col("image.hex")) & ~missing(F.col("image.suffix"))).withColumn("image_id", F.col("image.image_id"))
    there = files.filter((F.col("ext") == "jpg") & (F.col("size") > least_bytes)).select("listing_id", "image_id").distinct().withColumn("__there", F.lit(True))
    joined = usable.join(there, ["listing_id", "image_id"], "left").withColumn("downloaded", F.coalesce("__there", F.lit(False)))
    inside = joined.select(
        "listing_id", "image_id", (F.coalesce("image.is_primary", F.lit(False)) | (F.col("pos") == 0)).cast("int").alias("is_primary"), F.lit(1).alias("to_download"), "price",
        F.col("downloaded").cast("int").alias("downloaded"), (F.col("downloaded") & F.coalesce("image.bg_removed", "background_removed", F.lit(False))).cast("int").alias("bg_removed"),
    )
    return outside.unionByName(inside)
