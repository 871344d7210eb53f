"""Payloads to rows: projections of nested listing, shop and review payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from catalog_lake.functions.columns import flag

LISTING_FLAGS = ("is_customizable", "is_personalizable", "should_auto_renew")
#: Columns of listings_static that are taken over as they are, in order.
LISTING_COLUMNS = (
    "title description creation_timestamp listing_type processing_min processing_max who_made when_made item_weight "
    "item_weight_unit item_length item_width item_height item_dimensions_unit language taxonomy_id production_partners"
).split()


def listing_static_rows(payload: DataFrame, snapshot_ts: int) -> DataFrame:
    """One row per payload; flags 1 or 0, missing lists empty."""
    return payload.select(
        "listing_id",
        F.lit(snapshot_ts).cast("bigint").alias("snapshot_timestamp"),
        "shop_id",
        *LISTING_COLUMNS,
        *(flag(F.col(c)).alias(c) for c in LISTING_FLAGS),
        *(F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("tags", "materials")),
    )


def listing_dynamic_rows(payload: DataFrame, snapshot_ts: int) -> DataFrame:
    """State, counters and price of a snapshot; a missing price is NULL in all three columns."""
    return payload.select(
        "listing_id",
        F.lit(snapshot_ts).cast("bigint").alias("snapshot_timestamp"),
        "state",
        "ending_timestamp",
        "quantity",
        "num_favorers",
        "views",
        F.col("price.amount").alias("price_amount"),
        F.col("price.divisor").alias("price_divisor"),
        F.col("price.currency_code").alias("price_currency"),
    )


def shop_static_rows(payload: DataFrame, snapshot_ts: int) -> DataFrame:
    return payload.select(
        "shop_id", F.lit(snapshot_ts).cast("bigint").alias("snapshot_timestamp"), "create_date", "url", flag(F.col("is_shop_us_based")).alias("is_shop_us_based"), "shipping_from_country_iso", "shop_location_country_iso"
    )


def shop_dynamic_rows(payload: DataFrame, snapshot_ts: int) -> DataFrame:
    return payload.select(
        "shop_id", F.lit(snapshot_ts).cast("bigint").alias("snapshot_timestamp"), "update_date", "listing_active_count", flag(F.col("accepts_custom_requests")).alias("accepts_custom_requests"),
        "num_favorers", "transaction_sold_count", "review_average", "review_count",
    )


def review_rows(payload: DataFrame) -> DataFrame:
    return payload.select("shop_id", "listing_id", "buyer_user_id", "rating", "review", "language", "create_timestamp")


def image_rows(payload: DataFrame) -> DataFrame:
    """(listing_id, image_id, is_primary, url, ord) for each image with an id; rank defaults to 1, url to empty."""
    exploded = payload.select("listing_id", "ord", F.posexplode("images").alias("pos", "image"))
    kept = exploded.filter(F.coalesce(F.col("image.listing_image_id"), F.lit(0)) != 0)
    return kept.select(
        "listing_id",
        F.col("image.listing_image_id").alias("image_id"),
        (F.coalesce(F.col("image.rank"), F.lit(1)) == 1).cast("int").alias("is_primary"),
        F.coalesce(F.col("image.url_570xN"), F.lit("")).alias("url"),
        F.struct("ord", "pos").alias("ord"),
    )


def drop_imageless_pages(payload: DataFrame) -> DataFrame:
    """Pages in which some listing has an image; a page without any is skipped whole. Pages are small."""
    has = F.max(F.coalesce(F.size("images"), F.lit(0)) > 0).over(W.partitionBy("page"))
    return payload.withColumn("__has", has).filter("__has").drop("__has")


def first_image(payload: DataFrame) -> DataFrame:
    """(listing_id, image_id, url, reason): the first image, or reason ``no_images``."""
    first = F.try_element_at("images", F.lit(1))
    return payload.select("listing_id", first["listing_image_id"].alias("image_id"), first["url_570xN"].alias("url"), F.when(first.isNull(), "no_images").alias("reason"))


def ingest_stats(classified: DataFrame) -> DataFrame:
    """Rows by class (new, update, skip), new ones also by whether they have images."""
    return classified.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
