"""Merge and history: insert-or-ignore, staleness, upserts, latest and previous snapshots.

Keys are hash-partitioned once per merge; latest-per-key aggregates combine before the shuffle. "First"
always means least by an explicit order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catalog_lake.functions.columns import empty_to_null, missing

STALE_SECONDS = 432_000
DEFAULT_WATERMARK = 946_684_800
REVIEWS_PER_SHOP = 10_000
#: Parts of a shop whose reviews are numbered apart.
SALTS = 32


def firsts(incoming: DataFrame, keys: Sequence[str], ord_: str = "ord") -> DataFrame:
    """The row of least order per key: one combining aggregate."""
    rest = [c for c in incoming.columns if c not in keys]
    grouped = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ord_)).alias("__row"))
    return grouped.select(*keys, "__row.*").select(*incoming.columns)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], not_null: Sequence[str] = (), ord_: str = "ord") -> DataFrame:
    """existing, and of incoming the first row per key that isn't stored. NULL in a key or in not_null drops a row."""
    valid = incoming.dropna(subset=[*keys, *not_null])
    new = firsts(valid, keys, ord_).join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def staleness_gate(listings_static: DataFrame, incoming: DataFrame, snapshot_ts: int | Column, max_age: int = STALE_SECONDS) -> DataFrame:
    """incoming with class: new (unknown), update (older than max_age, strictly), skip (fresh, or not the first of its id in the run)."""
    now = snapshot_ts if isinstance(snapshot_ts, Column) else F.lit(snapshot_ts)
    seen = F.row_number().over(W.partitionBy("listing_id").orderBy("ord"))
    known = listings_static.select("listing_id", F.coalesce("last_dynamic_ts", F.lit(0)).alias("__last"))
    joined = incoming.withColumn("__seen", seen).join(known, "listing_id", "left")
    kind = F.when(F.col("__seen") > 1, "skip").when(F.col("__last").isNull(), "new").when(now - F.col("__last") > max_age, "update").otherwise("skip")
    return joined.withColumn("class", kind).drop("__seen", "__last")


def append_reviews(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return insert_or_ignore(existing, incoming, ("shop_id", "listing_id", "create_timestamp"))


def reviews_after_watermark(incoming: DataFrame, last_ts: DataFrame, default: int = DEFAULT_WATERMARK, most: int = REVIEWS_PER_SHOP) -> DataFrame:
    """Per shop, in payload order, the reviews before the first that isn't newer than the watermark; at most ``most``, the paging limit of a fetch.

    The first old review of a shop is a combining aggregate. What comes before it is numbered in SALTS parts
    of a shop first: a review among the shop's first ``most`` is among those of its part, so that the shop's
    own window sees SALTS * most rows at most. Reviews without a shop count as one shop.
    """
    marked = incoming.join(last_ts.select("shop_id", "last_ts"), "shop_id", "left")
    old = F.coalesce("create_timestamp", F.lit(0)) <= F.coalesce("last_ts", F.lit(default))
    stops = marked.filter(old).groupBy(F.col("shop_id").alias("__shop")).agg(F.min("ord").alias("__stop"))
    fresh = incoming.join(stops, F.col("shop_id").eqNullSafe(F.col("__shop")), "left").filter("__stop is null or ord < __stop")
    number = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("ord"))
    parts = fresh.withColumn("__salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS))).withColumn("__n", number("shop_id", "__salt")).filter(F.col("__n") <= most)
    return parts.withColumn("__n", number("shop_id")).filter(F.col("__n") <= most).select(*incoming.columns)


def upsert_images(image_status: DataFrame, incoming: DataFrame) -> DataFrame:
    """is_primary from the last incoming row; a missing stored url takes the first non-empty incoming one; status is kept, 0 for new keys."""
    keys = ["listing_id", "image_id"]
    url = empty_to_null(F.col("url"))
    new = incoming.groupBy(*keys).agg(F.max_by("is_primary", "ord").alias("__primary"), F.min_by(url, F.when(url.isNotNull(), F.col("ord"))).alias("__url"), F.lit(True).alias("__in"))
    merged = image_status.withColumn("__stored", F.lit(True)).join(new, keys, "full_outer")
    stored_url = F.when(missing(F.col("url")), F.coalesce("__url", "url", F.when(F.col("__stored").isNull(), F.lit("")))).otherwise(F.col("url"))
    return merged.select(*keys, F.when(F.col("__in"), F.col("__primary")).otherwise(F.col("is_primary")).alias("is_primary"), stored_url.alias("url"), F.coalesce("download_done", F.lit(0)).alias("download_done"))


def fill_missing_urls(image_status: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows with their missing urls filled, and repaired (whether a row was)."""
    keys = ["listing_id", "image_id"]
    url = empty_to_null(F.col("url"))
    new = incoming.filter(url.isNotNull()).groupBy(*keys).agg(F.min_by(url, "ord").alias("__url"))
    joined = image_status.join(new, keys, "left").withColumn("repaired", missing(F.col("url")) & F.col("__url").isNotNull())
    return joined.withColumn("url", F.when(F.col("repaired"), F.col("__url")).otherwise(F.col("url"))).drop("__url")


def backfill_last_ts(static: DataFrame, dynamic: DataFrame, key: str) -> DataFrame:
    last = dynamic.groupBy(key).agg(F.max("snapshot_timestamp").alias("__last"))
    return static.drop("last_dynamic_ts").join(last, key, "left").withColumn("last_dynamic_ts", F.coalesce("__last", F.lit(0)).cast("bigint")).drop("__last")


def backfill_review_counts(shops_static: DataFrame, shops_dynamic: DataFrame) -> DataFrame:
    """curr_ and prev_review_count: of the newest and second newest snapshot, larger id first in ties."""
    place = F.row_number().over(W.partitionBy("shop_id").orderBy(F.desc("snapshot_timestamp"), F.desc("id")))
    two = shops_dynamic.select("shop_id", "review_count", place.alias("__k")).filter("__k <= 2")
    counts = two.groupBy("shop_id").agg(F.max(F.when(F.col("__k") == 1, F.col("review_count"))).alias("curr_review_count"), F.max(F.when(F.col("__k") == 2, F.col("review_count"))).alias("prev_review_count"))
    return shops_static.drop("curr_review_count", "prev_review_count").join(counts, "shop_id", "left")


def shift_review_counts(shops_static: DataFrame, new_dynamic: DataFrame) -> DataFrame:
    """The new snapshots applied in order: prev becomes the old curr, curr the new count, last_dynamic_ts the snapshot's time."""
    kept = shops_static.select("shop_id", F.col("curr_review_count").alias("review_count"), F.lit(None).cast("bigint").alias("snapshot_timestamp"), F.lit(None).cast("bigint").alias("id"))
    every = kept.unionByName(new_dynamic.select("shop_id", "review_count", "snapshot_timestamp", "id"))
    order = W.partitionBy("shop_id").orderBy(F.asc_nulls_first("snapshot_timestamp"), F.asc_nulls_first("id"))
    shifted = every.withColumn("__prev", F.lag("review_count").over(order)).filter("id is not null")
    last = shifted.groupBy("shop_id").agg(F.max_by(F.struct("__prev", "review_count", "snapshot_timestamp"), F.struct("snapshot_timestamp", "id")).alias("__l"))
    joined = shops_static.join(last, "shop_id", "left")
    pick = lambda new, old: F.when(F.col("__l").isNotNull(), F.col(f"__l.{new}")).otherwise(F.col(old)).alias(old)
    rest = [c for c in shops_static.columns if c not in ("prev_review_count", "curr_review_count", "last_dynamic_ts")]
    return joined.select(*rest, pick("__prev", "prev_review_count"), pick("review_count", "curr_review_count"), pick("snapshot_timestamp", "last_dynamic_ts"))


def touch_last_ts(static: DataFrame, new_dynamic: DataFrame, key: str) -> DataFrame:
    last = new_dynamic.groupBy(key).agg(F.max("snapshot_timestamp").alias("__last"))
    return static.join(last, key, "left").withColumn("last_dynamic_ts", F.coalesce("__last", "last_dynamic_ts")).drop("__last")


def review_watermarks(old: DataFrame, fetched: DataFrame) -> DataFrame:
    new = fetched.groupBy("shop_id").agg(F.max("create_timestamp").alias("last_ts")).filter("last_ts is not null")
    return new.unionByName(old.join(new, "shop_id", "left_anti"))


def latest_snapshot(dynamic: DataFrame, key: str, ts: str = "snapshot_timestamp", tie: str = "id") -> DataFrame:
    """The newest row per key, by one combining aggregate."""
    rest = [c for c in dynamic.columns if c != key]
    return dynamic.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("__row")).select(key, "__row.*").select(*dynamic.columns)


def snapshot_series(dynamic: DataFrame, key: str, metrics: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Ordered snapshots with the change of each metric against the one before."""
    w = W.partitionBy(key).orderBy(*order)
    return dynamic.withColumns({f"{m}_change": F.col(m) - F.lag(m).over(w) for m in metrics})


def set_status(image_status: DataFrame, keys: DataFrame, to: int, only_from: int | None = None, clear_url: bool = False) -> DataFrame:
    """Rows of the key list get status ``to``, if they have ``only_from`` where given."""
    marked = image_status.join(keys.select("listing_id", "image_id").distinct().withColumn("__hit", F.lit(True)), ["listing_id", "image_id"], "left")
    hit = F.coalesce("__hit", F.lit(False)) & (F.lit(True) if only_from is None else F.col("download_done").eqNullSafe(F.lit(only_from)))
    marked = marked.withColumn("__hit", hit).withColumn("download_done", F.when(F.col("__hit"), F.lit(to)).otherwise(F.col("download_done")))
    if clear_url:
        marked = marked.withColumn("url", F.when(~F.col("__hit"), F.col("url")))
    return marked.select(*image_status.columns)


def drop_dead(image_status: DataFrame) -> DataFrame:
    return image_status.filter(~F.col("download_done").eqNullSafe(F.lit(-1)))
