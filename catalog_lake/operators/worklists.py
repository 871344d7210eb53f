"""Work lists: what needs fetching, downloading, embedding. Set differences as semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog_lake.functions.columns import FAILED_IMAGE, missing
from catalog_lake.numbering import number_rows

DAY = 86_400
#: Files of so many bytes or fewer aren't embedded.
LEAST_EMBED_BYTES = 1024


def shops_to_fetch(listings_static: DataFrame, shops_static: DataFrame, now: int) -> DataFrame:
    """(shop_id, is_new): shops of listings seen in 7 days, less shops fetched in 5."""
    active = listings_static.filter(F.col("last_dynamic_ts") > now - 7 * DAY).select("shop_id").distinct()
    recent = shops_static.filter(F.col("last_dynamic_ts") > now - 5 * DAY).select("shop_id")
    known = shops_static.select("shop_id", F.lit(False).alias("__new"))
    left = active.filter("shop_id is not null").join(recent, "shop_id", "left_anti").join(known, "shop_id", "left")
    return left.select("shop_id", F.coalesce("__new", F.lit(True)).alias("is_new"))


def shops_for_reviews(shops_static: DataFrame, reviews: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """Shops fetched in 30 days with a changed or unknown previous review count, no review in 30 days, and not done."""
    since = now - 30 * DAY
    recent = reviews.groupBy("shop_id").agg(F.max("create_timestamp").alias("__last")).filter(F.col("__last") > since)
    changed = F.col("prev_review_count").isNull() | (F.col("prev_review_count") != F.col("curr_review_count"))
    listed = shops_static.filter((F.col("last_dynamic_ts") > since) & changed).select("shop_id")
    return listed.join(recent, "shop_id", "left_anti").join(done.select("shop_id"), "shop_id", "left_anti")


def pending_downloads(image_status: DataFrame) -> DataFrame:
    return image_status.filter((F.col("download_done") == 0) & ~missing(F.col("url"))).select("listing_id", "image_id", "url")


def listings_missing_urls(image_status: DataFrame) -> DataFrame:
    return image_status.filter((F.col("download_done") == 0) & missing(F.col("url"))).select("listing_id").distinct()


def embed_candidates(image_status: DataFrame, embedded: DataFrame, files: DataFrame, exclude: DataFrame, least: int = LEAST_EMBED_BYTES) -> DataFrame:
    """Downloaded images, neither embedded nor claimed, with ready: whether a large enough file is there."""
    keys = ["listing_id", "image_id"]
    wanted = image_status.filter("download_done = 2").select(*keys).join(embedded.select(*keys), keys, "left_anti").join(exclude.select(*keys), keys, "left_anti")
    there = files.filter(F.col("size") > least).select(*keys).distinct().withColumn("__there", F.lit(True))
    return wanted.join(there, keys, "left").select(*keys, F.coalesce("__there", F.lit(False)).alias("ready"))


def embed_ready(image_status: DataFrame, embedded: DataFrame, files: DataFrame, limit: int, exclude: DataFrame) -> DataFrame:
    """The first ``limit`` ready images in key order."""
    return embed_candidates(image_status, embedded, files, exclude).filter("ready").select("listing_id", "image_id").orderBy("listing_id", "image_id").limit(limit)


def full_batches(ready: DataFrame, batch_size: int) -> DataFrame:
    """ready plus batch and pos, in key order; an incomplete last batch is left out."""
    total = ready.count()
    numbered = number_rows(ready, [F.col("listing_id"), F.col("image_id")], "__n")
    full = total // batch_size * batch_size
    return numbered.filter(F.col("__n") < full).select("listing_id", "image_id", F.expr(f"__n div {batch_size}").alias("batch"), F.expr(f"__n % {batch_size}").alias("pos"))


def movable_nonprimary(image_status: DataFrame, limit: int | None = None) -> DataFrame:
    rows = image_status.filter("is_primary = 0 and download_done = 2").select("listing_id", "image_id")
    return rows if limit is None else rows.orderBy("listing_id", "image_id").limit(limit)


def listings_missing_shop(meta: DataFrame) -> DataFrame:
    return meta.filter("error is null and shop_id is null").select("listing_id")


def unsynced_shops(meta: DataFrame, synced: DataFrame) -> DataFrame:
    return meta.filter("error is null and shop_id is not null").select("shop_id").distinct().join(synced.select("shop_id"), "shop_id", "left_anti")


def failed_entries(meta: DataFrame) -> DataFrame:
    return meta.filter(F.col("image_id") == FAILED_IMAGE).select("listing_id")


def new_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    return ids.select("listing_id").distinct().join(known.select("listing_id"), "listing_id", "left_anti")


def shop_backlog(listings: DataFrame, meta: DataFrame, files: DataFrame) -> DataFrame:
    """Per shop: listings, have (an entry and a non-empty file), need, complete."""
    entries = meta.filter("error is null").select("listing_id").distinct().withColumn("__meta", F.lit(True))
    there = files.filter("size > 0").select("listing_id").distinct().withColumn("__file", F.lit(True))
    joined = listings.select("listing_id", "shop_id").join(entries, "listing_id", "left").join(there, "listing_id", "left")
    have = F.count_if(F.col("__meta") & F.col("__file"))
    counted = joined.groupBy("shop_id").agg(F.count(F.lit(1)).alias("listings"), have.alias("have"))
    return counted.withColumn("need", F.col("listings") - F.col("have")).withColumn("complete", F.col("need") == 0)
