"""Catalogue operators on the boundary rows that decide their results."""

import hashlib
import io
import json
import os
import struct
import tarfile
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog_lake.functions import columns as C
from catalog_lake.numbering import number_rows
from catalog_lake.operators import archive, bitmaps, images, merge, migrate, pricing, quality, search, vectors, worklists
from catalog_lake.plans import source_queries
from catalog_lake.sources import readers
from tests.conftest import rows

NOW = 10_000_000
STATUS = "listing_id bigint, image_id bigint, is_primary int, url string, download_done int"


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# ---- merge


def test_insert_or_ignore_keeps_the_stored_and_the_first(spark):
    old = frame(spark, [(1, "old")], "k bigint, v string")
    new = frame(spark, [(1, "x", 0), (2, "first", 1), (2, "second", 2), (None, "y", 3), (3, None, 4)], "k bigint, v string, ord int")
    once = merge.insert_or_ignore(old, new, ["k"], ["v"])
    assert rows(once) == [(1, "old"), (2, "first")]
    assert rows(merge.insert_or_ignore(once, new, ["k"], ["v"])) == rows(once)


def test_staleness_is_strict_and_once_per_run(spark):
    known = frame(spark, [(1, NOW - 432_000), (2, NOW - 432_001), (5, None)], "listing_id bigint, last_dynamic_ts bigint")
    new = frame(spark, [(1, 0), (2, 1), (3, 2), (3, 3), (5, 4)], "listing_id bigint, ord int")
    assert rows(merge.staleness_gate(known, new, NOW), "listing_id", "ord", "class") == [(1, 0, "skip"), (2, 1, "update"), (3, 2, "new"), (3, 3, "skip"), (5, 4, "update")]


def test_reviews_stop_at_the_first_old_one(spark):
    new = frame(spark, [(1, 0, 200), (1, 1, 50), (1, 2, 300), (2, 0, None), (2, 1, 10**9), (3, 0, 946_684_800), (4, 0, 946_684_801)], "shop_id bigint, ord int, create_timestamp bigint")
    marks = frame(spark, [(1, 100)], "shop_id bigint, last_ts bigint")
    assert rows(merge.reviews_after_watermark(new, marks), "shop_id", "ord") == [(1, 0), (4, 0)]
    many = spark.range(10_050).select(F.lit(1).alias("shop_id"), F.col("id").alias("ord"), F.lit(2_000_000_000).alias("create_timestamp"))
    kept = merge.reviews_after_watermark(many, marks)
    assert kept.count() == 10_000 and kept.agg(F.max("ord")).first()[0] == 9_999
    unknown = frame(spark, [(None, 0, 10**9), (None, 1, 5), (None, 2, 10**9)], "shop_id bigint, ord int, create_timestamp bigint")
    assert rows(merge.reviews_after_watermark(unknown, marks), "ord") == [(0,)]


def test_upsert_of_images(spark):
    stored = frame(spark, [(1, 1, 0, None, 2), (1, 2, 1, "", 3), (1, 3, 1, "kept", 4), (1, 4, 1, None, 0)], STATUS)
    new = frame(spark, [(1, 1, 1, "", 0), (1, 1, 0, "a", 1), (1, 1, 1, "b", 2), (1, 2, 0, None, 3), (1, 3, 0, "z", 4), (2, 1, 1, None, 5), (2, 2, 0, "n", 6)], "listing_id bigint, image_id bigint, is_primary int, url string, ord int")
    once = merge.upsert_images(stored, new)
    assert rows(once) == sorted([(1, 1, 1, "a", 2), (1, 2, 0, "", 3), (1, 3, 0, "kept", 4), (1, 4, 1, None, 0), (2, 1, 1, "", 0), (2, 2, 0, "n", 0)], key=repr)
    assert rows(merge.upsert_images(once, new)) == rows(once)


def test_review_counts_follow_ties_and_shifts(spark):
    shops = frame(spark, [(1, None, None, 5), (2, 3, 4, 6)], "shop_id bigint, prev_review_count bigint, curr_review_count bigint, last_dynamic_ts bigint")
    snaps = frame(spark, [(1, 1, 10, 7), (2, 1, 10, 8), (3, 1, 9, 1), (4, 2, 20, 9)], "id bigint, shop_id bigint, snapshot_timestamp bigint, review_count bigint")
    filled = merge.backfill_review_counts(shops, snaps).select("shop_id", "curr_review_count", "prev_review_count")
    assert rows(filled) == [(1, 8, 7), (2, 9, None)]
    assert rows(merge.shift_review_counts(shops, snaps), "shop_id", "prev_review_count", "curr_review_count", "last_dynamic_ts") == [(1, 7, 8, 10), (2, 4, 9, 20)]


# ---- work lists


def test_shops_for_reviews_has_three_valued_logic(spark):
    shops = frame(spark, [(1, NOW, None, 3), (2, NOW, 3, 3), (3, NOW, 3, None), (4, NOW, 3, 4), (5, NOW, None, None), (6, NOW - 30 * 86_400, None, 1)], "shop_id bigint, last_dynamic_ts bigint, prev_review_count bigint, curr_review_count bigint")
    reviews = frame(spark, [(4, NOW - 30 * 86_400), (5, NOW - 30 * 86_400 + 1)], "shop_id bigint, create_timestamp bigint")
    assert rows(worklists.shops_for_reviews(shops, reviews, frame(spark, [], "shop_id bigint"), NOW)) == [(1,), (4,)]


def test_shops_to_fetch_are_disjoint_from_recent_ones(spark):
    listings = frame(spark, [(1, NOW), (2, NOW), (3, NOW - 7 * 86_400), (None, NOW)], "shop_id bigint, last_dynamic_ts bigint")
    shops = frame(spark, [(2, NOW - 5 * 86_400), (4, NOW)], "shop_id bigint, last_dynamic_ts bigint")
    assert rows(worklists.shops_to_fetch(listings, shops, NOW)) == [(1, True), (2, False)]


def test_embed_ready_needs_more_than_1024_bytes(spark):
    status = frame(spark, [(i, 1, 1, "u", 2) for i in range(6)], STATUS)
    files = frame(spark, [(0, 1, 1024), (1, 1, 1025), (2, 1, 5000), (3, 1, 5000)], "listing_id bigint, image_id bigint, size bigint")
    pair = lambda *ids: frame(spark, [(i, 1) for i in ids], "listing_id bigint, image_id bigint")
    assert rows(worklists.embed_ready(status, pair(2), files, 10, pair(5))) == [(1, 1), (3, 1)]
    batches = worklists.full_batches(pair(*range(10)), 4)
    assert rows(batches, "listing_id", "batch", "pos") == sorted([(i, i // 4, i % 4) for i in range(8)], key=repr)


# ---- images and migrations


def test_reconcile_boundaries(spark):
    status = frame(spark, [(1, 1, 1, "u", 1), (2, 1, 1, "u", 1), (3, 1, 1, "u", 1), (4, 1, 1, "u", 0), (5, 1, 1, "u", 0), (6, 1, 1, "u", 0), (7, 1, 1, None, 0), (8, 1, 1, "u", 3)], STATUS)
    files = frame(spark, [(1, 1, "jpg", 1001), (2, 1, "jpg", 1000), (4, 1, "jpg", 1001), (5, 1, "jpg", 1000), (5, 1, "dl", 0), (7, 1, "jpg", 9999), (8, 1, "jpg", 9999)], "listing_id bigint, image_id bigint, ext string, size bigint")
    assert rows(images.reconcile_downloads(status, files), "listing_id", "download_done", "action") == sorted(
        [(1, 2, "downloaded"), (2, -1, "dead"), (3, 1, None), (4, 2, "downloaded"), (5, 1, "reconciled"), (6, 1, "marker_created"), (7, 0, None), (8, 3, None)], key=repr
    )


def test_names_and_addresses(spark):
    names = ["12_34.jpg", "12.jpg", "a_1.jpg", "1_2_3.jpg", "1_2.dl", "1_2.png", "99999999999999999999_1.jpg", None]
    found = [r[0] and tuple(r[0]) for r in frame(spark, [(n,) for n in names], "n string").select(C.parse_image_name(F.col("n"))).collect()]
    assert found == [(12, 34, "jpg"), None, None, None, (1, 2, "dl"), None, None, None]
    url = frame(spark, [(1, "ab1", 7, "x9"), (1, None, 7, "x9"), (1, "ab1", C.FAILED_IMAGE, "x9")], "s bigint, h string, i bigint, x string").select(C.build_cdn_url("h.example", *map(F.col, "shix")).alias("u"))
    made = url.first()[0]
    assert [r[0] for r in url.collect()][1:] == [None, None]
    assert tuple(frame(spark, [(made,)], "u string").select(C.parse_cdn_url(F.col("u"))).first()[0]) == ("ab1", "x9")
    parts = [r[0] for r in frame(spark, [("12_3.jpg",), ("1234567_8.jpg",)], "n string").select(C.file_partition(F.col("n"))).collect()]
    assert parts == [123 % 8, 12345 % 8]


def test_listing_texts(spark):
    given = [("T", '["a","b"]'), ("T", "[]"), ("", '["a"]'), (None, None), ("T", "broken"), ("T", '[1,"x"]'), ("T", None), ("T", '["oak, solid","glass"]'), ("", '["a,b"]'), ("T", '["q\\"1, 2\\"", "[z]"]'), ("T", '[["a"]]'), ("T", '["a",null]'), ("T", '[null]'), ("T", '{"a":"b"}'), ("T", ' [ "a" , "b" ] ')]
    found = [r[0] for r in frame(spark, given, "t string, m string").select(C.listing_text(F.col("t"), F.col("m"))).collect()]
    assert found == ["T. a, b", "T", "a", "", "T", "T", "T", "T. oak, solid, glass", "a,b", 'T. q"1, 2", [z]', "T", "T", "T", "T", "T. a, b"]


def test_migration_to_image_status(spark):
    image = lambda i, h="h", s="s": (i, h, s, None, None)
    schema = f"listing_id bigint, error string, when_made string, price double, background_removed boolean, images array<{migrate.IMAGE}>"
    meta = frame(spark, [(1, None, "made_to_order", 50.0, True, [image(10), image(11, None), image(12)]), (2, None, "made_to_order", 49.99, None, [image(20)]), (3, None, "1990s", 99.0, None, []), (4, "gone", None, None, None, None), (5, None, "2010_2019", None, None, []), (6, None, "2010_2019", 60.0, None, [])], schema)
    prices = frame(spark, [(6, 10, 100)], "listing_id bigint, price_amount bigint, price_divisor bigint")
    files = frame(spark, [(1, 10, "jpg", 1001), (1, 12, "jpg", 1000)], "listing_id bigint, image_id bigint, ext string, size bigint")
    found = rows(migrate.to_image_status(meta, prices, files), "listing_id", "image_id", "is_primary", "to_download", "downloaded", "bg_removed")
    assert found == sorted([(1, 10, 1, 1, 1, 1), (1, 12, 0, 1, 0, 0), (2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0)], key=repr)


# ---- pricing


def test_every_price_has_one_interval(spark):
    units = pricing.crawl_units(frame(spark, [(1, "t", [0.0, 5.0, 9.99, 1e6])], "taxonomy_id bigint, name string, price_breaks array<double>"))
    assert rows(units, "unit", "min_price", "max_price") == [(0, 0.0, 5.0), (1, 5.01, 9.99), (2, 10.0, None)]
    prices = frame(spark, [(1, c / 100) for c in (0, 499, 500, 501, 999, 1000, 10**9)], "taxonomy_id bigint, price double")
    assert [r[0] for r in pricing.assign_price_bucket(prices, units).orderBy("price").select("unit").collect()] == [0, 0, 0, 1, 1, 2, 2]
    counts = pricing.bucket_counts(prices.filter("price < 9"), units, cap=3)
    assert rows(counts, "unit", "n", "at_cap") == [(0, 3, True), (1, 1, False), (2, 0, False)]


def test_break_search(spark):
    assert pricing.grown_breaks(np.array([100]), np.array([5000]), 5000) == [0.0, 1e6]
    same = pricing.grown_breaks(np.array([700, 5_000_000]), np.array([9000, 1]), 5000)
    assert same[0] == 0 and same[-1] == 1e6 and same == sorted(same)
    cents = np.arange(100, 50_100)
    breaks = pricing.grown_breaks(cents, np.ones(50_000, dtype=int), 5000)
    edges = np.searchsorted(cents, np.round(np.array(breaks) * 100).astype(int), side="right")
    assert (np.diff(edges)[:-1] < 5000).all()
    halves = pricing.halved_breaks(cents, np.ones(50_000, dtype=int), 8000)
    assert (np.diff(np.searchsorted(cents, np.array(halves) * 100, side="right")) <= 8000).all()
    assert pricing.halved_breaks(np.array([250]), np.array([10**6]), 8000)[-1] == 1e6


def counting(prices):
    """Listings between two prices in cents, both included, by looking at each."""
    return lambda low, high: sum(low <= p <= high for p in prices)


def grown_by_hand(prices, target):
    inside, top = counting(prices), max(prices)
    if len(prices) <= target:
        return [0.0, 1e6]
    cents, nearest = lambda x: int(x * 100 + 1e-6), lambda x: round(x * 100)
    breaks, low, high = [0.0], 0.0, 5.0
    while True:
        while inside(nearest(low), cents(high)) < target and high < top / 100:
            high *= 1.10
        if high >= top / 100:
            return [*breaks, 1e6]
        while inside(nearest(low), cents(high)) >= target:
            high *= 0.99
        assert high >= low, "the data give every interval some room"
        breaks.append(max(round(high, 2), round(low, 2)))
        low = round(breaks[-1] + 0.01, 2)
        high = low * 1.10


def halved_by_hand(prices, target):
    def cut(low, high):
        inside = counting([p for p in prices if low * 100 < p <= high * 100])
        count = inside(0, 10**9)
        if count <= target:
            return []
        a, b = max(low, 0.0), high
        for _ in range(15):
            middle = (a + b) / 2
            gap = inside(0, round(middle * 100)) - count // 2
            if abs(gap) < 200:
                break
            a, b = (middle, b) if gap < 0 else (a, middle)
        half = float(round(middle))
        return [*cut(low, half), half, *cut(half, high)] if max(low, 0.0) < half < high else []

    return [0.0, *cut(-0.01, 1e6), 1e6]


def test_break_searches_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    prices = np.round(rng.lognormal(4, 0.8, 4_000) * 100).astype(int).tolist()
    listings = frame(spark, [(1, p / 100) for p in prices] + [(1, None), (None, 5.0), (2, 7.5)], "taxonomy_id bigint, price double")
    grown = dict(map(tuple, pricing.price_breaks_grow(listings, 300).collect()))
    assert grown == {1: grown_by_hand(prices, 300), 2: [0.0, 1e6]} and len(grown[1]) > 8
    halved = dict(map(tuple, pricing.price_breaks_halve(listings, 500).collect()))
    assert halved == {1: halved_by_hand(prices, 500), 2: [0.0, 1e6]} and len(halved[1]) > 6


def test_taxonomy_tree(spark):
    nodes = frame(spark, [(1, None, "r", 0), (2, 1, "a", 1), (3, 1, "b", 0), (4, 2, "c", 0), (9, None, "x", 0)], "id bigint, parent_id bigint, name string, ord int")
    assert [(r["id"], r["depth"]) for r in pricing.descendants(nodes, 1).orderBy("path").collect()] == [(1, 0), (3, 1), (2, 1), (4, 2)]
    assert rows(pricing.leaves(nodes, 1), "id") == [(3,), (4,)]


def test_trees_have_no_limit_of_rows(spark):
    n = 1_000_100  # more than a recursive query gives
    wide = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.lit(0)).cast("bigint").alias("parent_id"), F.lit("n").alias("name"), F.lit(7).alias("ord"))
    assert pricing.descendants(wide, 0).agg(F.count("id"), F.max("depth"), F.max("path")).collect() == [(n, 1, "/000007")]
    assert pricing.descendants(wide, -1).count() == 0


def test_leaves_of_many_rows(spark):
    n = 1_000_100
    wide = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.lit(0)).cast("bigint").alias("parent_id"), F.lit("n").alias("name"), F.lit(7).alias("ord"))
    assert pricing.leaves(wide, 0).agg(F.count("id"), F.min("id")).collect() == [(n - 1, 1)]


def test_a_node_below_itself_is_an_error(spark):
    ring = frame(spark, [(1, 3, "a", 0), (2, 1, "b", 0), (3, 2, "c", 0)], "id bigint, parent_id bigint, name string, ord int")
    with pytest.raises(Exception, match="below itself: 1"):
        pricing.descendants(ring, 1)


# ---- vectors and search


def test_numbering_is_gapless_in_any_partitioning(spark):
    for n in (1, 3, 17):
        found = number_rows(spark.range(1000).repartition(n), [F.col("id").desc()], "k", 5, partitions=n).orderBy("k").collect()
        assert [(r["id"], r["k"]) for r in found] == [(999 - i, i + 5) for i in range(1000)]
    assert number_rows(spark.range(0), [F.col("id")], "k").count() == 0


def test_appending_crosses_shards(spark):
    index = frame(spark, [(i, 0, i) for i in range(8)], "listing_id bigint, image_id bigint, global_row bigint")
    new = frame(spark, [(i, 1) for i in range(12)], "listing_id bigint, image_id bigint")
    found = vectors.append_to_shards(index, new, ["listing_id"], 10).orderBy("global_row").collect()
    assert [r["global_row"] for r in found] == list(range(20)) and [r["shard"] for r in found] == [0] * 10 + [1] * 10 and all(r["final"] for r in found)


def test_shard_checks(spark):
    index = frame(spark, [(0,)] * 3 + [(1,)] * 2 + [(2,)], "shard int")
    found = frame(spark, [(0, m) for m in "ab" for _ in range(3)] + [(1, "a"), (1, "a"), (1, "b"), (3, "a")], "shard int, model string")
    assert rows(vectors.check_shards(index, found), "shard", "outcome") == [(0, "consistent"), (1, "different counts"), (2, "no vectors"), (3, "count mismatch")]
    assert rows(vectors.check_shards(index, found, exclude=["b"]).filter("shard = 1"), "outcome") == [("consistent",)]


def test_encoders_keep_undecodable_inputs(spark):
    def load():
        return lambda inputs: [None if x == b"bad" else np.array([3.0, 4.0]) if x else np.array([1.0, 0.0]) for x in inputs]

    given = frame(spark, [(1, 1, b"ok"), (2, 1, b"bad")], "listing_id bigint, image_id bigint, content binary")
    found = rows(vectors.embed(given, load, "m", 2).withColumn("x", F.round(F.col("embedding")[0].cast("double"), 3)), "listing_id", "x", "decoded")
    assert found == [(1, 0.6, True), (2, 1.0, False)]


def test_text_embeddings_and_hashes_equal_brute_force(spark):
    def load():
        return lambda inputs: [np.array([len(x) + 1.0, x.count("a"), 2.0]) for x in inputs]

    index = frame(spark, [(1, 1), (1, 2), (2, 1), (3, 1)], "listing_id bigint, image_id bigint")
    texts = frame(spark, [(1, "banana"), (2, None)], "listing_id bigint, text string")
    found = vectors.embed_text(index, texts, load, "m", 3, batch=2)
    want = {}
    for listing, text in ((1, "banana"), (2, ""), (3, "")):
        v = np.array([len(text) + 1.0, text.count("a"), 2.0])
        want[listing] = (v / np.sqrt((v * v).sum())).astype("<f4")
    got = found.collect()
    assert len(got) == 4 and all(np.array_equal(np.array(r["embedding"], dtype="<f4"), want[r["listing_id"]]) and r["decoded"] for r in got)
    digest = lambda v: hashlib.md5(struct.pack(f"<{len(v)}f", *v)).hexdigest()[:12]
    hashed = found.withColumn("hash", vectors.vector_hash("embedding"))
    assert all(r["hash"] == digest(r["embedding"]) for r in hashed.collect())
    assert rows(frame(spark, [(None,), ([],)], "v array<float>").select(vectors.vector_hash("v"))) == sorted([(None,), (digest([]),)], key=repr)
    stored = hashed.withColumn("hash", F.when(F.col("listing_id") == 2, "0" * 12).otherwise(F.col("hash"))).filter("listing_id < 3")
    assert rows(vectors.verify_hashes(stored, found), "listing_id", "image_id", "model", "stored", "found") == [(2, 1, "m", "0" * 12, digest(want[2]))]


def test_unknown_listings_and_details(spark):
    corpus = frame(spark, [(1, "m"), (1, "n"), (2, "m")], "listing_id bigint, model string")
    assert rows(search.unknown_listings(corpus, frame(spark, [(1,), (5,), (5,), (None,)], "listing_id bigint"))) == sorted([(5,), (None,)], key=repr)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    data = [("a", i // 2, i, i % 3, rng.integers(-2, 3, size=4).astype(float).tolist()) for i in range(60)]
    corpus = frame(spark, data, "model string, listing_id bigint, image_id bigint, shard int, embedding array<double>")
    queries = corpus.filter("image_id < 5").select(F.col("image_id").alias("query_id"), "model", "embedding").unionByName(frame(spark, [(9, "none", [0.0] * 4)], "query_id bigint, model string, embedding array<double>"))
    want = set()
    for q in range(5):
        scored = sorted((-float(np.dot(data[q][4], e)), lid, iid) for _, lid, iid, _, e in data)
        want |= {(q, k + 1, lid, iid) for k, (_, lid, iid) in enumerate(scored[:7])}
    for f in (search.top_k, search.top_k_sharded):
        assert {tuple(r) for r in f(queries, corpus, 7).select("query_id", "rank", "listing_id", "image_id").collect()} == want
    assert search.top_k(queries, corpus, 1000).count() == 5 * 60


def test_pruned_search_is_exact_and_passes_shards_over(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 4
    data = [("m", i, i * 2, i % 12, np.round(10 * centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(600)]
    data += [("n", i, i, 20 + i % 2, rng.integers(-9, 9, size=8).astype(float).tolist()) for i in range(7)] + [data[5]] * 3
    corpus = frame(spark, data, "model string, listing_id bigint, image_id bigint, shard bigint, embedding array<double>")
    queries = corpus.filter("listing_id < 12").dropDuplicates(["model", "listing_id"]).select(F.col("listing_id").alias("query_id"), "model", "embedding")
    bounds = search.shard_bounds(corpus)
    for k in (1, 9, 70, 2000):
        found, visits = search.top_k_pruned(queries, corpus, bounds, k)
        assert rows(found.drop("score")) == rows(search.top_k(queries, corpus, k).drop("score"))
        seen = visits.filter("model = 'm'").agg(F.sum("visited"), F.sum("shards")).first()
        assert seen[1] == 12 * 12 and (seen[0] == seen[1] if k == 2000 else seen[0] < seen[1] / 2)


def test_consensus_counts_appearances(spark):
    results = frame(spark, [(1, "a", 1, 7, 1, 0.9), (1, "a", 2, 7, 2, 0.7), (1, "a", 3, 8, 1, 0.6), (1, "b", 1, 8, 1, 0.2)], "query_id bigint, model string, rank bigint, listing_id bigint, image_id bigint, score double")
    assert rows(search.consensus(results).withColumn("mean_score", F.round("mean_score", 3))) == [(1, 7, 2, 0.8, 1), (1, 8, 2, 0.4, 2)]
    with pytest.raises(ValueError, match="mean or max"):
        search.fuse(results, "min")


# ---- archives


def test_offsets_equal_those_of_tar_files(spark, tmp_path):
    sizes = [0, 1, 512, 513, 7000]
    members = frame(spark, [("t.tar", k, f"{k}_1.jpg", b"x" * n) for k, n in enumerate(sizes)], "tar_name string, pos int, member string, content binary")
    folder = str(tmp_path / "tars")
    assert rows(archive.pack_tars(members, folder), "tar_name", "members") == [("t.tar", 5)]
    with tarfile.open(f"{folder}/t.tar") as tar:
        want = [(m.name, m.offset) for m in tar]
    planned = archive.member_offsets(members.withColumn("size", F.length("content")))
    assert rows(planned, "member", "offset") == sorted(want, key=repr)
    scanned = archive.scan_tars(members, folder)
    assert rows(scanned, "member", "offset") == sorted(want, key=repr)
    assert rows(archive.check_tars(scanned, members, folder, 5), "outcome") == [("valid",)]
    assert rows(archive.check_tars(scanned, members.withColumn("content", F.lit(b"?")), folder, 5), "outcome") == [("corrupt",)]


def test_tars_are_streamed_in_small_batches(spark, tmp_path):
    body = F.expr("cast(rpad('', int(1000 + id % 7), cast(id as string)) as binary)")
    members = spark.range(900).select(F.format_string("t%d.tar", F.col("id") % 3).alias("tar_name"), (900 - F.col("id")).alias("pos"), F.format_string("%d.jpg", "id").alias("member"), body.alias("content"))
    folder = str(tmp_path / "tars")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(archive.pack_tars(members.repartition(5), folder), "tar_name", "members") == [(f"t{k}.tar", 300) for k in range(3)]
        with tarfile.open(f"{folder}/t1.tar") as tar:
            assert tar.getnames() == [f"{i}.jpg" for i in range(898, 0, -3)]
        read = archive.read_members(archive.scan_tars(members, folder), folder)
        assert rows(read) == rows(members, "tar_name", "member", "content")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wrong = frame(spark, [("t1.tar", "other", 0)], "tar_name string, member string, offset bigint")
    assert rows(archive.read_members(wrong, folder)) == [("t1.tar", "other", None)]
    empty = frame(spark, [("n.tar", 0, "a", None)], "tar_name string, pos int, member string, content binary")
    assert rows(archive.pack_tars(empty, folder), "members") == [(1,)] and rows(archive.scan_tars(empty, folder), "size") == [(0,)]
    assert archive.pack_tars(empty.limit(0), folder).count() == 0


def test_tars_from_the_hundred_thousandth_on_have_names_of_their_own(spark):
    index = spark.range(40).select((F.lit(9_999) + F.col("id").cast("int").bitwiseAND(1)).alias("shard"), F.expr("id div 2").alias("shard_row"), F.col("id").alias("listing_id"), F.lit(1).alias("image_id"))
    batches = archive.tar_batches(index, 2, 20)
    names = sorted({r[0] for r in batches.select("tar_name").collect()})
    assert names == sorted(f"imageall_{k:05d}.tar" for k in range(99_990, 100_010))
    # names cut to five digits would make the last tar there those of all ten
    done = batches.filter("batch = 100000").select("tar_name").distinct()
    ready = archive.ready_batches(batches.filter("shard = 10000"), done, index)
    assert rows(ready, "batch") == [(k,) for k in range(100_001, 100_010)]
    assert rows(archive.member_offsets(batches.withColumns({"pos": F.expr("shard_row % 2"), "size": F.lit(1)})), "offset") == [(0,)] * 20 + [(1024,)] * 20


def test_headers_are_those_of_tarfile(tmp_path):
    names, sizes = ["a", "b" * 100, "\u00e9.jpg", "x/" * 60 + "y", "7_1.jpg"], np.array([0, 1, 512, 7000, (1 << 33) - 1])
    blocks = archive.tar_headers(names, sizes)
    for k, (name, size) in enumerate(zip(names, sizes, strict=True)):
        info, block = tarfile.TarInfo(name), blocks[k * 512 : (k + 1) * 512]
        info.size = int(size)
        assert block == info.tobuf(tarfile.USTAR_FORMAT)
        assert archive.plain_header(block) == (None if len(name) > 100 else (name, size))
    # other members than plain files, and a broken header, are left to tarfile
    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        for name in ("1_1.jpg", "l" * 150, "2_1.jpg"):
            info = tarfile.TarInfo(name)
            info.size = 600
            tar.addfile(info, io.BytesIO(bytes(600)))
    with tarfile.open(tmp_path / "t.tar") as tar:
        want = [(m.name, m.offset, m.size) for m in tar]
    listed = lambda: archive.list_tar(pa.OSFile(str(tmp_path / "t.tar")))
    assert len(want) == 3 and listed() == want
    raw = bytearray((tmp_path / "t.tar").read_bytes())
    raw[0] ^= 1
    (tmp_path / "t.tar").write_bytes(raw)
    with pytest.raises(tarfile.ReadError):
        listed()


def test_ready_batches_stop_at_the_first_gap(spark):
    batches = frame(spark, [(0, b, f"t{b}", b, 1) for b in range(5)], "shard int, batch int, tar_name string, listing_id bigint, image_id bigint")
    files = frame(spark, [(i, 1) for i in (1, 2, 4)], "listing_id bigint, image_id bigint")
    assert rows(archive.ready_batches(batches, frame(spark, [("t0",)], "tar_name string"), files), "batch") == [(1,), (2,)]


def test_primary_names_sort_as_strings(spark):
    new = frame(spark, [(9,), (10,), (100,)], "listing_id bigint")
    found = archive.primary_batches(new, frame(spark, [("primary_00004.tar",)], "tar_name string"), 2).orderBy("tar_name", "pos").collect()
    assert [(r["member"], r["tar_name"]) for r in found] == [("10.jpg", "primary_00005.tar"), ("100.jpg", "primary_00005.tar"), ("9.jpg", "primary_00006.tar")]


def test_inventories_agree_within_the_tolerance(spark):
    make = lambda size: frame(spark, [("a/b.jpg", size), (".Trashes/x", 5)], "name string, size bigint")
    assert [quality.compare_inventories(make(0), make(n)).first()["ok"] for n in (1 << 20, (1 << 20) + 1)] == [True, False]


# ---- sources


def test_legacy_metadata_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "new_path", lambda session, kind: str(tmp_path / kind))
    meta = spark.range(90_000).selectExpr("id as listing_id", "if(id % 11 = 0, 'not found', null) as error", "id % 97 as shop_id", "id * 10 as image_id", "1.5D as price")
    found = source_queries.s7(SimpleNamespace(_spark=spark, legacy_meta=meta))
    assert found.count() == 90_000 and found.filter("error is not null").count() == 8_182
    files = spark.read.text(str(tmp_path / "metadata" / "*"), wholetext=True)
    assert max(len(json.loads(r["value"])) for r in files.collect()) == 10_000 and files.count() == 9


def test_readers(spark, tmp_path):
    def put(name, value):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    index = put("image_index_2.json", [[1, 2, 0, "h1", "h2"], [3, 4]])
    assert rows(readers.read_image_index(spark, index, 10), "shard", "shard_row", "global_row", "listing_id", "hashes") == sorted([(2, 0, 20, 1, ["h1", "h2"]), (2, 1, 21, 3, [])], key=repr)
    assert rows(readers.read_offset_index(spark, put("tar_index.json", {"tars": {"t": {"a": 0, "b": 512}}, "reverse": {}}))) == [("t", "a", 0), ("t", "b", 512)]
    legacy = readers.read_legacy_metadata(spark, put("meta.json", {"1": {"shop_id": 5, "images": []}, "2": "not found", "3": 99}))
    assert rows(legacy, "listing_id", "error", "shop_id", "image_id") == sorted([(1, None, 5, None), (2, "not found", None, None), (3, None, None, 99)], key=repr)
    assert rows(readers.read_taxonomy_config(spark, put("tax.json", {"taxonomies": [{"id": 1, "name": "n", "price_breaks": [0, 2.5]}]}))) == [(1, "n", [0.0, 2.5])]
    put("files/1_2.jpg", "abc")
    put("files/other.txt", "")
    put("files/7/3_4.dl", "")
    put("files/7/deep/5_6.jpg", "xy")
    inventory = readers.read_file_inventory(spark, str(tmp_path / "files"))
    assert rows(inventory, "name", "listing_id", "size") == sorted([("1_2.jpg", 1, 3), ("other.txt", None, 0), ("3_4.dl", 3, 0), ("5_6.jpg", 5, 2)], key=repr)
    assert rows(readers.read_file_inventory(spark, f"file://{tmp_path}/files/7", str(tmp_path / "files/7/deep")), "name") == [("3_4.dl",), ("5_6.jpg",), ("5_6.jpg",)]
    put("batches/b1/manifest.json", [[1, 10], [2, 20]])
    put("batches/b1/listings.json", {"1": "text"})
    np.save(tmp_path / "batches/b1/clip.npy", np.eye(2, dtype=np.float32))
    assert rows(readers.read_batch_results(spark, str(tmp_path / "batches")), "pos", "listing_id", "model", "embedding", "text") == sorted([(0, 1, "clip", [1.0, 0.0], "text"), (1, 2, "clip", [0.0, 1.0], None)], key=repr)
    payload = readers.read_payloads(spark, put("p.json", '{"listing_id": 1, "price": {"amount": 5}, "images": [{"listing_image_id": 9}]}'), "listing")
    assert payload.first()["price"]["amount"] == 5 and payload.first()["title"] is None
    shards = frame(spark, [(0, 1, 1, 3, 4, ["b"]), (0, 0, 0, 1, 2, ["a"])], "shard int, shard_row bigint, global_row bigint, listing_id bigint, image_id bigint, hashes array<string>")
    readers.write_image_index(shards, str(tmp_path / "written"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "written")).collect()] == [["1", "2", "0", "a"], ["3", "4", "1", "b"]]
    readers.write_table(shards, str(tmp_path / "t"), ("shard",))
    assert readers.read_table(spark, str(tmp_path / "t")).count() == 2


# ---- bitmaps


def test_bitmaps_find_rows_across_blocks(spark):
    """Rows at the edges of blocks, chunks and bytes; repeated rows; a row without a number; a model without rows; a row beyond the index."""
    places = [0, 1, 7, 8, 511, 512, 32_767, 32_768, 100_000]
    index = frame(spark, [(p, p + 1, p, p // 50_000) for p in [*places, 7]] + [(5, 5, None, 0)], "listing_id bigint, image_id bigint, global_row bigint, shard bigint")
    have = {"a": places, "b": [0, 8, 511, 32_768, 99_999]}
    vectors_of = frame(spark, [(m, p, p // 50_000) for m, ps in have.items() for p in [*ps, ps[0]]], "model string, global_row bigint, shard bigint")
    want = [(p, [m for m in ("a", "b", "c") if p not in have.get(m, [])]) for p in places]
    assert rows(bitmaps.missing_rows(index, vectors_of, ["c", "a", "b"])) == sorted(((p, m) for p, m in want if m), key=repr)
    found = rows(bitmaps.incomplete_rows(index, vectors_of, ["a", "b"]))
    assert found == sorted([(p, p + 1, ["b"]) for p in [*places, 7] if p not in have["b"]] + [(5, 5, ["a", "b"])], key=repr)
    assert rows(bitmaps.embedded_rows(index, vectors_of, ["a", "b"], active_only=False)) == sorted([(p, p + 1) for p in places if p in have["b"]], key=repr)
    assert rows(bitmaps.embedded_rows(index, vectors_of, ["a"])) == [(100_000, 100_001)]
    # 9 rows of the index; images a and b differ in 5 of the index's rows and in 99,999
    assert rows(bitmaps.row_consistency(index, vectors_of, ["a", "b"], ["a"])) == [(9, 6, 0, 6, False)]
    assert rows(bitmaps.row_consistency(index, vectors_of, ["a"], ["a"])) == [(9, 0, 0, 0, True)]
    empty = index.limit(0)
    assert rows(bitmaps.missing_rows(empty, vectors_of, ["a"])) == [] and rows(bitmaps.row_consistency(empty, vectors_of.limit(0), ["a"], ["b"])) == [(0, 0, 0, 0, True)]


def test_bitmaps_tell_shards_with_other_rows(spark):
    index = frame(spark, [(s * 10 + i, s) for s in range(5) for i in range(3)], "global_row bigint, shard bigint")
    kept = {0: ([0, 1, 2], [0, 1, 2]), 1: ([0, 1], [0, 1, 2]), 2: ([0, 1], [0, 1]), 3: ([0, 1, 5], [0, 1, 2]), 5: ([0], [0])}
    found = frame(spark, [(m, s * 10 + i, s) for s, sides in kept.items() for m, side in zip("ab", sides, strict=True) for i in side], "model string, global_row bigint, shard bigint")
    want = [(0, 3, 3, 3, "consistent"), (1, 3, 2, 3, "different counts"), (2, 3, 2, 2, "count mismatch"), (3, 3, 3, 3, "different rows"), (4, 3, None, None, "no vectors"), (5, 0, 1, 1, "count mismatch")]
    assert rows(bitmaps.check_shard_rows(index, found, ["a", "b"])) == sorted(want, key=repr)


def test_bitmaps_shuffle_no_keys(spark):
    """Before the exchange tasks have made bitmaps: what is aggregated after it is a bitmap for each model and block."""
    vectors_of = spark.range(100_000).selectExpr("id as global_row", "if(id % 2 = 0, 'a', 'b') as model")
    index = spark.range(100_000).selectExpr("id as global_row")
    plan = bitmaps.bits_by_model(index, vectors_of, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan and "Join" not in plan
