"""Counts of a job, taken in the pass that writes its rows.

A job's rows are observed where they are written, so that its report costs no further pass. The counts are of the
write's last stage, in which a task that runs again counts once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from catalog_lake.operators import images, merge, migrate, worklists
from catalog_lake.session import materialise


def written_with_counts(df: DataFrame, counts: Mapping[str, Column], keep: Column | None = None, kind: str = "reported") -> tuple[DataFrame, dict[str, int]]:
    """``df``, or its rows that ``keep`` holds for, written and read back, and the aggregates ``counts`` over all of its rows. An empty table counts 0."""
    observation = Observation()
    observed = df.observe(observation, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in counts.items()))
    stored = materialise(observed if keep is None else observed.filter(keep), kind)
    return stored, {name: observation.get.get(name, 0) for name in counts}


def _each(column: str, values: Sequence[str]) -> dict[str, Column]:
    return {v: F.count_if(F.col(column) == v) for v in values}


def staleness(classified: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Classified listings, and how many are new, update and skip."""
    return written_with_counts(classified, _each("class", ("new", "update", "skip")))


def drop_dead(image_status: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The status without dead images, and how many went and stayed."""
    dead = F.col("download_done").eqNullSafe(F.lit(-1))
    return written_with_counts(image_status, {"deleted": F.count_if(dead), "kept": F.count_if(~dead)}, keep=~dead)


def fill_missing_urls(image_status: DataFrame, incoming: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    return written_with_counts(merge.fill_missing_urls(image_status, incoming), {"repaired": F.count_if("repaired"), "rows": F.count(F.lit(1))})


def embed_candidates(image_status: DataFrame, embedded: DataFrame, files: DataFrame, exclude: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The images that can be embedded, and how many of the wanted ones can't for lack of a file."""
    wanted = worklists.embed_candidates(image_status, embedded, files, exclude)
    return written_with_counts(wanted, {"ready": F.count_if("ready"), "missing": F.count_if(~F.col("ready"))}, keep=F.col("ready"))


def rebuild_status(image_status: DataFrame, files: DataFrame, index: DataFrame, models: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """The rebuilt status, and how many pairs it has, how many with each flag."""
    flags = ("downloaded", "background_removed", *(f"embed_{m}" for m in models))
    rebuilt = images.rebuild_status(image_status, files, index, models)
    return written_with_counts(rebuilt, {"pairs": F.count(F.lit(1))} | {f: F.sum(f) for f in flags})


def rename_plan(meta: DataFrame, files: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    return written_with_counts(images.rename_plan(meta, files), _each("class", ("renamed", "already_new", "missing", "no_images")))


def flag_first_image(meta: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    return written_with_counts(migrate.flag_first_image(meta), _each("outcome", ("updated", "already", "no_images")))
