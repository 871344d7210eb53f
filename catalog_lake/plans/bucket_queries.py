"""Merges and work lists over bucketed tables: the same rows, without a shuffle of what is stored."""

from __future__ import annotations

from uuid import uuid4

from catalog_lake.operators import images, merge, vectors, worklists
from catalog_lake.plans.merge_queries import READY
from catalog_lake.plans.registry import ORACLES, query
from catalog_lake.session import materialise
from catalog_lake.sources.buckets import joined_by_bucket, write_bucketed

BUCKETS = 8


def bucketed(df, name: str):
    return write_bucketed(df, f"{name}_{uuid4().hex}", BUCKETS)


def joined(t, plan, *tables):
    """``plan`` of the bucketed tables, run while buckets are joined."""
    with joined_by_bucket(t._spark):
        return materialise(plan(*tables), "bucketed")


@query("b5_upsert_bucketed")
def b5(t):
    return joined(t, merge.upsert_images, bucketed(t.image_status, "image_status"), t.incoming_images)


@query("d1_reconcile_bucketed")
def d1(t):
    return joined(t, images.reconcile_downloads, bucketed(t.image_status, "image_status"), bucketed(t.files, "files"))


@query("c5_candidates_bucketed", f"with {READY} select *, true as ready from ready")
def c5(t):
    status = bucketed(t.image_status, "image_status")
    index, files = bucketed(t.image_index.filter("listing_id % 5 > 0"), "image_index"), bucketed(t.files, "files")
    return joined(t, worklists.embed_candidates, status, index, files, status.filter("listing_id % 7 = 0")).filter("ready")


@query("g8_dedup_bucketed")
def g8(t):
    given = t.vectors.select("listing_id", "image_id", "label")
    return joined(t, vectors.dedup_new, bucketed(given, "manifest"), bucketed(given.filter("image_id % 4 = 0"), "embedded"))


ORACLES |= {"b5_upsert_bucketed": ORACLES["b5_upsert_images"], "d1_reconcile_bucketed": ORACLES["d1_reconcile_downloads"], "g8_dedup_bucketed": ORACLES["g8_dedup_new"]}
