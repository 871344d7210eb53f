"""Image life cycle: reconcile status with files on disk, rebuild it, plan renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from catalog_lake.functions.columns import missing

#: A file of so many bytes or fewer is a failed download.
LEAST_BYTES = 1000
KEYS = ["listing_id", "image_id"]


def reconcile_downloads(image_status: DataFrame, files: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """image_status with its new status and action (NULL: untouched).

    Status 1: a large jpg is done, a small one dead, none leaves it. Status 0 with a url: a large jpg is
    done; else it becomes 1, ``reconciled`` if a marker is there, else ``marker_created``.
    """
    by_key = files.groupBy(*KEYS).agg(F.max(F.when(F.col("ext") == "jpg", F.col("size"))).alias("__jpg"), F.coalesce(F.bool_or(F.col("ext") == "dl"), F.lit(False)).alias("__dl"))
    joined = image_status.join(by_key, KEYS, "left")
    done, jpg = F.col("download_done"), F.col("__jpg")
    pending = (done == 0) & ~missing(F.col("url"))
    action = (
        F.when((done == 1) & (jpg > least), "downloaded").when((done == 1) & jpg.isNotNull(), "dead").when(pending & (jpg > least), "downloaded")
        .when(pending & F.coalesce("__dl", F.lit(False)), "reconciled").when(pending, "marker_created")
    )
    status = F.when(F.col("action") == "downloaded", 2).when(F.col("action") == "dead", -1).when(F.col("action").isNotNull(), 1).otherwise(done)
    return joined.withColumn("action", action).withColumn("download_done", status).drop("__jpg", "__dl")


def action_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter("action is not null").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def rebuild_status(image_status: DataFrame, files: DataFrame, index: DataFrame, models: Sequence[str]) -> DataFrame:
    """All pairs known or on disk, with downloaded, background_removed and one flag per model, from what is there."""
    on_disk = files.filter("ext = 'jpg'").select(*KEYS).distinct().withColumn("__disk", F.lit(1))
    indexed = index.select(*KEYS).distinct().withColumn("__index", F.lit(1))
    every = image_status.select(*KEYS).join(on_disk, KEYS, "full_outer").join(indexed, KEYS, "left")
    flags = [F.coalesce("__index", F.lit(0)).alias(name) for name in ("background_removed", *(f"embed_{m}" for m in models))]
    return every.select(*KEYS, F.coalesce("__disk", F.lit(0)).alias("downloaded"), *flags)


def orphan_files(files: DataFrame, meta: DataFrame) -> DataFrame:
    return files.select(*KEYS).distinct().join(meta.select("listing_id"), "listing_id", "left_anti").select(*KEYS)


def rename_plan(meta: DataFrame, files: DataFrame) -> DataFrame:
    """(listing_id, old_name, new_name, class) for listing-named files: renamed, already_new, missing or no_images."""
    first = meta.select("listing_id", F.try_element_at("images", F.lit(1))["image_id"].alias("__image"))
    named = first.select("listing_id", F.concat(F.col("listing_id").cast("string"), F.lit(".jpg")).alias("old_name"), F.concat_ws("_", F.col("listing_id").cast("string"), F.concat(F.col("__image").cast("string"), F.lit(".jpg"))).alias("new_name"), "__image")
    there = files.select("name").distinct()
    joined = named.join(there.withColumnRenamed("name", "old_name").withColumn("__old", F.lit(True)), "old_name", "left").join(there.withColumnRenamed("name", "new_name").withColumn("__new", F.lit(True)), "new_name", "left")
    kind = F.when(F.col("__image").isNull(), "no_images").when(F.col("__new"), "already_new").when(F.col("__old"), "renamed").otherwise("missing")
    return joined.select("listing_id", "old_name", F.when(F.col("__image").isNotNull(), F.col("new_name")).alias("new_name"), kind.alias("class"))


def listing_image(files: DataFrame) -> DataFrame:
    """(listing_id, first_name, names) of names ``{listing}_{image}.jpg``, or the legacy ``{listing}.jpg`` where there is none."""
    form = r"^(\d+)(_\d+)?\.jpg$"
    parsed = files.filter(F.col("name").rlike(form)).select("name", F.regexp_extract("name", form, 1).cast("bigint").alias("listing_id"), (F.regexp_extract("name", form, 2) != "").alias("__new"))
    grouped = parsed.groupBy("listing_id").agg(F.min(F.when(F.col("__new"), F.col("name"))).alias("__first"), F.min(F.when(~F.col("__new"), F.col("name"))).alias("__legacy"), F.sort_array(F.collect_set(F.when(F.col("__new"), F.col("name")))).alias("names"))
    return grouped.select("listing_id", F.coalesce("__first", "__legacy").alias("first_name"), F.when(F.size("names") > 0, F.col("names")).otherwise(F.array("__legacy")).alias("names"))
