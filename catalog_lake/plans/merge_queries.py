"""Queries of ingest, merge and history, and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_lake.operators import ingest, merge, reports, worklists
from catalog_lake.plans.fixtures import EVENTS_NOW, NOW
from catalog_lake.plans.registry import query

PAGE = 100


def payloads(t):
    """Listing payloads with nested price and images, built from part and lineitem."""
    images = t.line_order.filter("ord = 1").groupBy("listing_id").agg(
        F.sort_array(F.collect_list(F.struct(F.when(F.col("image_id") != 3, F.col("image_id") + F.col("listing_id") * 10).alias("listing_image_id"), F.when(F.col("l_tax") > 0.01, F.concat(F.lit("u"), F.col("l_suppkey").cast("string"))).alias("url_570xN"), F.when(F.col("image_id") > 1, F.col("image_id").cast("int")).alias("rank")))).alias("images")
    )
    p = t.listings.join(images, "listing_id", "left")
    return p.select(
        F.expr(f"cast(listing_id div {PAGE} as int)").alias("page"), F.col("listing_id").cast("int").alias("ord"), "listing_id", "shop_id", "title",
        F.when(F.col("listing_id") % 3 > 0, F.col("listing_id") % 3 == 1).alias("is_customizable"), F.lit(None).cast("boolean").alias("is_personalizable"), F.lit(True).alias("should_auto_renew"),
        *(F.lit(None).cast("string").alias(c) for c in ("description", "listing_type", "who_made", "when_made", "item_weight_unit", "item_dimensions_unit", "language", "production_partners")),
        *(F.lit(None).cast("double").alias(c) for c in ("item_weight", "item_length", "item_width", "item_height")),
        *(F.lit(None).cast("bigint").alias(c) for c in ("creation_timestamp", "processing_min", "processing_max", "ending_timestamp")),
        "taxonomy_id", F.when(F.col("listing_id") % 4 > 0, F.array("brand", "kind")).alias("materials"), F.lit(None).cast("array<string>").alias("tags"), F.lit("active").alias("state"),
        F.col("listing_id").alias("quantity"), (F.col("listing_id") * 2).alias("num_favorers"), (F.col("listing_id") * 3).alias("views"),
        F.when(F.col("listing_id") % 5 > 0, F.struct(F.round(F.col("price") * 100).cast("bigint").alias("amount"), F.lit(100).cast("bigint").alias("divisor"), F.lit("USD").alias("currency_code"))).alias("price"), "images",
    )


@query(
    "a1_listing_static_rows",
    f"""select listing_id, cast({NOW} as bigint) as snapshot_timestamp, shop_id, title, taxonomy_id, cast(case when listing_id % 3 = 1 then 1 else 0 end as int) as is_customizable,
    cast(0 as int) as is_personalizable, cast(case when listing_id % 4 > 0 then 2 else 0 end as bigint) as n_materials, cast(0 as bigint) as n_tags from listings""",
)
def a1(t):
    rows = ingest.listing_static_rows(payloads(t), NOW)
    return rows.select("listing_id", "snapshot_timestamp", "shop_id", "title", "taxonomy_id", "is_customizable", "is_personalizable", F.size("materials").cast("bigint").alias("n_materials"), F.size("tags").cast("bigint").alias("n_tags"))


@query(
    "a2_listing_dynamic_rows",
    f"""select listing_id, cast({NOW} as bigint) as snapshot_timestamp, 'active' as state, cast(null as bigint) as ending_timestamp, listing_id as quantity, listing_id * 2 as num_favorers, listing_id * 3 as views,
    case when listing_id % 5 > 0 then cast(round(price * 100) as bigint) end as price_amount, case when listing_id % 5 > 0 then cast(100 as bigint) end as price_divisor,
    case when listing_id % 5 > 0 then 'USD' end as price_currency from listings""",
)
def a2(t):
    return ingest.listing_dynamic_rows(payloads(t), NOW)


def shop_payloads(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("shop_id"), F.lit(1).cast("bigint").alias("create_date"), F.col("s_name").alias("url"), F.when(F.col("s_nationkey") > 3, F.col("s_nationkey") > 12).alias("is_shop_us_based"), F.lit("US").alias("shipping_from_country_iso"),
        F.col("s_nationkey").cast("string").alias("shop_location_country_iso"), F.lit(2).cast("bigint").alias("update_date"), F.col("s_suppkey").alias("listing_active_count"), (F.col("s_nationkey") % 2 == 0).alias("accepts_custom_requests"),
        F.col("s_suppkey").alias("num_favorers"), F.col("s_suppkey").alias("transaction_sold_count"), F.col("s_acctbal").alias("review_average"), F.col("s_suppkey").alias("review_count"),
    )


@query("a3_shop_static_rows", f"select s_suppkey as shop_id, cast({NOW} as bigint) as snapshot_timestamp, cast(1 as bigint) as create_date, s_name as url, cast(case when s_nationkey > 12 then 1 else 0 end as int) as is_shop_us_based, 'US' as shipping_from_country_iso, cast(s_nationkey as string) as shop_location_country_iso from supplier")
def a3(t):
    return ingest.shop_static_rows(shop_payloads(t), NOW)


@query("a4_shop_dynamic_rows", f"select s_suppkey as shop_id, cast({NOW} as bigint) as snapshot_timestamp, cast(2 as bigint) as update_date, s_suppkey as listing_active_count, cast(case when s_nationkey % 2 = 0 then 1 else 0 end as int) as accepts_custom_requests, s_suppkey as num_favorers, s_suppkey as transaction_sold_count, s_acctbal as review_average, s_suppkey as review_count from supplier")
def a4(t):
    return ingest.shop_dynamic_rows(shop_payloads(t), NOW)


@query("a5_review_rows", "select shop_id, listing_id, listing_id as buyer_user_id, rating, cast(null as string) as review, 'en' as language, create_timestamp from reviews")
def a5(t):
    return ingest.review_rows(t.reviews.select("*", F.col("listing_id").alias("buyer_user_id"), F.lit(None).cast("string").alias("review"), F.lit("en").alias("language")))


@query(
    "a6_image_rows",
    """select l.listing_id, o.image_id + l.listing_id * 10 as image_id, cast(case when o.image_id = 1 then 1 else 0 end as int) as is_primary,
    case when o.l_tax > 0.01 then concat('u', cast(o.l_suppkey as string)) else '' end as url from listings l join line_order o on o.listing_id = l.listing_id where o.ord = 1 and o.image_id <> 3""",
)
def a6(t):
    return ingest.image_rows(payloads(t)).drop("ord")


@query(
    "a7_drop_imageless_pages",
    """with has as (select distinct listing_id from line_order), pages_ok as (select distinct l.listing_id DIV 100 as page from listings l join has on has.listing_id = l.listing_id where l.listing_id DIV 100 % 5 <> 3 and l.listing_id % 2 = 0)
    select listing_id, cast(listing_id DIV 100 as int) as page from listings where listing_id DIV 100 in (select page from pages_ok)""",
)
def a7(t):
    """Listings of odd ids, and all of each fifth page, come without images."""
    with_images = (F.col("page") % 5 != 3) & (F.col("listing_id") % 2 == 0)
    return ingest.drop_imageless_pages(payloads(t).withColumn("images", F.when(with_images, F.col("images")))).select("listing_id", "page")


@query(
    "a8_first_image",
    """with f as (select listing_id, min(case when image_id = 3 then 0 else image_id end) as low, max(case when image_id = 3 then 1 else 0 end) as has3 from line_order where ord = 1 group by listing_id)
    select l.listing_id, case when has3 = 0 then low + l.listing_id * 10 end as image_id, case when f.listing_id is null then 'no_images' end as reason from listings l left join f on f.listing_id = l.listing_id""",
)
def a8(t):
    return ingest.first_image(payloads(t)).drop("url")


GATE_NOW = EVENTS_NOW - 9 * 86400
#: Stored stamps of known listings: exactly at the limit, a second over it, fresh, or the newest before the run.
GATE = f"""gate_in as (select id as ord, listing_id, snapshot_timestamp from listing_snapshots where snapshot_timestamp > {EVENTS_NOW - 10 * 86400}),
    gate_known as (select listing_id, cast(case listing_id % 6 when 1 then {GATE_NOW - 432_000} when 4 then {GATE_NOW - 432_001} when 5 then max(snapshot_timestamp) - 432000 else max(snapshot_timestamp) end as bigint) as last_dynamic_ts
    from listing_snapshots where snapshot_timestamp <= {EVENTS_NOW - 10 * 86400} and listing_id % 3 > 0 group by listing_id)"""
GATED = f"""select i.*, case when row_number() over (partition by i.listing_id order by ord) > 1 then 'skip' when k.listing_id is null then 'new' when {GATE_NOW} - k.last_dynamic_ts > 432000 then 'update' else 'skip' end as class
    from gate_in i left join gate_known k on k.listing_id = i.listing_id"""


def gated(t):
    s = t.listing_snapshots
    incoming = s.filter(F.col("snapshot_timestamp") > EVENTS_NOW - 10 * 86400).select(F.col("id").alias("ord"), "listing_id", "snapshot_timestamp")
    newest, kind = F.max("snapshot_timestamp"), F.col("listing_id") % 6
    last = F.when(kind == 1, GATE_NOW - merge.STALE_SECONDS).when(kind == 4, GATE_NOW - merge.STALE_SECONDS - 1).when(kind == 5, newest - merge.STALE_SECONDS).otherwise(newest)
    known = s.filter((F.col("snapshot_timestamp") <= EVENTS_NOW - 10 * 86400) & (F.col("listing_id") % 3 > 0)).groupBy("listing_id").agg(last.cast("bigint").alias("last_dynamic_ts"))
    return merge.staleness_gate(known, incoming, GATE_NOW)


def counted(t, counts):
    """A report's counts as one row."""
    return t._spark.createDataFrame([tuple(counts.values())], ", ".join(f"`{k}` bigint" for k in counts))


@query("a9_ingest_report", f"with {GATE}, gated as ({GATED}) select " + ", ".join(f"count(*) filter (where class = '{c}') as \"{c}\"" for c in ("new", "update", "skip")) + " from gated")
def a9_report(t):
    return counted(t, reports.staleness(gated(t))[1])


@query("a9_ingest_stats", f"with {GATE}, gated as ({GATED}) select class, count(*) as n from gated group by class")
def a9(t):
    return ingest.ingest_stats(gated(t))


@query(
    "b1_insert_or_ignore",
    """with stored as (select listing_id, image_id, l_quantity as q from line_order where ord = 1 and listing_id % 3 = 0), incoming as (select listing_id, image_id, l_quantity as q, ord from line_order where l_quantity > 5)
    select * from stored union all select listing_id, image_id, q from (select *, row_number() over (partition by listing_id, image_id order by ord) as k from incoming) x
    where k = 1 and not exists (select 1 from stored s where s.listing_id = x.listing_id and s.image_id = x.image_id)""",
)
def b1(t):
    rows = t.line_order.select("listing_id", "image_id", F.col("l_quantity").alias("q"), "ord")
    return merge.insert_or_ignore(rows.filter("ord = 1 and listing_id % 3 = 0").drop("ord"), rows.filter("q > 5"), ("listing_id", "image_id"))


@query("b2_staleness_gate", f"with {GATE} {GATED}")
def b2(t):
    return gated(t)


@query(
    "b3_append_reviews",
    """with stored as (select shop_id, listing_id, create_timestamp, min(ord) as ord from reviews where ord % 2 = 0 group by 1, 2, 3), first as (select *, row_number() over (partition by shop_id, listing_id, create_timestamp order by ord) as k from reviews)
    select shop_id, listing_id, create_timestamp, rating from (select r.* from reviews r join stored s on s.ord = r.ord) a
    union all select shop_id, listing_id, create_timestamp, rating from first f where k = 1 and not exists (select 1 from stored s where s.shop_id = f.shop_id and s.listing_id = f.listing_id and s.create_timestamp = f.create_timestamp)""",
)
def b3(t):
    stored = merge.firsts(t.reviews.filter("ord % 2 = 0"), ("shop_id", "listing_id", "create_timestamp"))
    return merge.append_reviews(stored.drop("ord"), t.reviews)


WATERMARKS = "marks as (select shop_id, 820454400 + shop_id * 86400 as last_ts from shops where shop_id % 4 > 0)"


@query(
    "b4_reviews_after_watermark",
    f"""with {WATERMARKS}, x as (select r.*, case when coalesce(create_timestamp, 0) <= coalesce(m.last_ts, 946684800) then 1 else 0 end as old,
    row_number() over (partition by r.shop_id order by ord) as n from reviews r left join marks m on m.shop_id = r.shop_id),
    y as (select *, max(old) over (partition by shop_id order by ord rows unbounded preceding) as stop from x) select ord, shop_id, listing_id, create_timestamp, rating from y where stop = 0 and n <= 10000""",
)
def b4(t):
    marks = t.shops.filter("shop_id % 4 > 0").select("shop_id", (F.col("shop_id") * 86400 + 820454400).alias("last_ts"))
    return merge.reviews_after_watermark(t.reviews, marks)


@query(
    "b5_upsert_images",
    """with i as (select listing_id, image_id, arg_max(is_primary, ord) as p, arg_min(url, ord) filter (where url <> '') as u from incoming_images group by 1, 2)
    select coalesce(s.listing_id, i.listing_id) as listing_id, coalesce(s.image_id, i.image_id) as image_id, case when i.listing_id is not null then i.p else s.is_primary end as is_primary,
    case when s.url <> '' then s.url else coalesce(i.u, s.url, case when s.listing_id is null then '' end) end as url, coalesce(s.download_done, 0) as download_done
    from image_status s full join i on i.listing_id = s.listing_id and i.image_id = s.image_id""",
)
def b5(t):
    return merge.upsert_images(t.image_status, t.incoming_images)


@query(
    "b6_fill_missing_urls",
    """with i as (select listing_id, image_id, arg_min(url, ord) as u from incoming_images where url <> '' group by 1, 2)
    select s.listing_id, s.image_id, is_primary, case when coalesce(s.url, '') = '' and u is not null then u else s.url end as url, download_done, coalesce(s.url, '') = '' and u is not null as repaired
    from image_status s left join i on i.listing_id = s.listing_id and i.image_id = s.image_id""",
)
def b6(t):
    return merge.fill_missing_urls(t.image_status, t.incoming_images)


@query("b6_repaired_report", "with i as (select distinct listing_id, image_id from incoming_images where url <> '') select count(*) filter (where coalesce(s.url, '') = '' and i.listing_id is not null) as repaired, count(*) as \"rows\" from image_status s left join i on i.listing_id = s.listing_id and i.image_id = s.image_id")
def b6_report(t):
    return counted(t, reports.fill_missing_urls(t.image_status, t.incoming_images)[1])


@query("b7_backfill_last_ts", "select l.listing_id, title, cast(coalesce(max(snapshot_timestamp), 0) as bigint) as last_dynamic_ts from listings l left join line_snapshots s on s.listing_id = l.listing_id group by l.listing_id, title")
def b7(t):
    return merge.backfill_last_ts(t.listings.select("listing_id", "title"), t.line_snapshots, "listing_id")


TWO = "select shop_id, review_count, row_number() over (partition by shop_id order by snapshot_timestamp desc, id desc) as k from shop_snapshots"


@query("b8_backfill_review_counts", f"with two as ({TWO}) select s.shop_id, name, max(case when k = 1 then review_count end) as curr_review_count, max(case when k = 2 then review_count end) as prev_review_count from shops s left join two on two.shop_id = s.shop_id and k <= 2 group by s.shop_id, name")
def b8(t):
    return merge.backfill_review_counts(t.shops.select("shop_id", "name"), t.shop_snapshots)


@query(
    "b9_shift_review_counts",
    f"""with two as ({TWO}), x as (select shop_id, max(case when k = 1 then review_count end) as c1, max(case when k = 2 then review_count end) as c2, max(k) as n from two where k <= 2 group by shop_id),
    l as (select shop_id, max(snapshot_timestamp) as ts from shop_snapshots group by shop_id)
    select s.shop_id, name, case when x.shop_id is null then prev_review_count when n = 1 then curr_review_count else c2 end as prev_review_count, case when x.shop_id is null then curr_review_count else c1 end as curr_review_count,
    coalesce(l.ts, s.last_dynamic_ts) as last_dynamic_ts from shops s left join x on x.shop_id = s.shop_id left join l on l.shop_id = s.shop_id""",
)
def b9(t):
    return merge.shift_review_counts(t.shops, t.shop_snapshots)


@query("b10_touch_last_ts", "with l as (select listing_id, max(snapshot_timestamp) as ts from line_snapshots where quantity > 40 group by listing_id) select x.listing_id, coalesce(ts, last_dynamic_ts) as last_dynamic_ts from listings x left join l on l.listing_id = x.listing_id")
def b10(t):
    return merge.touch_last_ts(t.listings.select("listing_id", "last_dynamic_ts"), t.line_snapshots.filter("quantity > 40"), "listing_id")


@query("b11_review_watermarks", f"with {WATERMARKS}, n as (select shop_id, max(create_timestamp) as last_ts from reviews where rating = 1 group by shop_id) select * from n union all select * from marks where shop_id not in (select shop_id from n)")
def b11(t):
    marks = t.shops.filter("shop_id % 4 > 0").select("shop_id", (F.col("shop_id") * 86400 + 820454400).alias("last_ts"))
    return merge.review_watermarks(marks, t.reviews.filter("rating = 1"))


@query("b12_latest_snapshot", "select id, listing_id, snapshot_timestamp, quantity from (select *, row_number() over (partition by listing_id order by snapshot_timestamp desc, id desc) as k from line_snapshots) x where k = 1")
def b12(t):
    return merge.latest_snapshot(t.line_snapshots, "listing_id")


@query("b12_snapshot_series", "select id, listing_id, views, views - lag(views) over (partition by listing_id order by snapshot_timestamp, id) as views_change from listing_snapshots")
def b12_series(t):
    return merge.snapshot_series(t.listing_snapshots, "listing_id", ["views"], ["snapshot_timestamp", "id"]).select("id", "listing_id", "views", "views_change")


@query("b13_set_status", "select listing_id, image_id, is_primary, url, case when download_done = 2 and listing_id % 5 = 0 then 3 else download_done end as download_done from image_status")
def b13(t):
    return merge.set_status(t.image_status, t.image_index.filter("listing_id % 5 = 0"), 3, only_from=2)


@query("b14_deleted_report", "select count(*) filter (where download_done = -1) as deleted, count(*) filter (where download_done <> -1) as kept from image_status")
def b14_report(t):
    return counted(t, reports.drop_dead(t.image_status)[1])


@query("b14_drop_dead", "select * from image_status where download_done <> -1")
def b14(t):
    return merge.drop_dead(t.image_status)


@query(
    "c1_shops_to_fetch",
    f"""select shop_id, not exists (select 1 from shops s where s.shop_id = x.shop_id) as is_new from (select distinct shop_id from listings where last_dynamic_ts > {NOW - 7 * 86400}
    ) x where shop_id not in (select shop_id from shops where last_dynamic_ts > {NOW - 5 * 86400})""",
)
def c1(t):
    return worklists.shops_to_fetch(t.listings, t.shops, NOW)


@query(
    "c2_shops_for_reviews",
    f"""select shop_id from shops where last_dynamic_ts > {NOW - 30 * 86400} and (prev_review_count is null or prev_review_count <> curr_review_count)
    and shop_id not in (select shop_id from reviews group by shop_id having max(create_timestamp) > {NOW - 30 * 86400}) and shop_id % 10 > 0""",
)
def c2(t):
    return worklists.shops_for_reviews(t.shops, t.reviews, t.shops.filter("shop_id % 10 = 0"), NOW)


@query("c3_pending_downloads", "select listing_id, image_id, url from image_status where download_done = 0 and url <> ''")
def c3(t):
    return worklists.pending_downloads(t.image_status)


@query("c4_listings_missing_urls", "select distinct listing_id from image_status where download_done = 0 and coalesce(url, '') = ''")
def c4(t):
    return worklists.listings_missing_urls(t.image_status)


READY = """ready as (select s.listing_id, s.image_id from image_status s where download_done = 2 and not exists (select 1 from image_index i where i.listing_id = s.listing_id and i.image_id = s.image_id and i.listing_id % 5 > 0)
    and s.listing_id % 7 > 0 and exists (select 1 from files f where f.listing_id = s.listing_id and f.image_id = s.image_id and size > 1024))"""


def ready(t):
    """Four fifths of the listings are embedded."""
    return t.image_status, t.image_index.filter("listing_id % 5 > 0"), t.files, t.image_status.filter("listing_id % 7 = 0")


@query("c5_embed_ready", f"with {READY} select * from ready order by listing_id, image_id limit 500")
def c5(t):
    status, index, files, claimed = ready(t)
    return worklists.embed_ready(status, index, files, 500, claimed)


@query(
    "c5_embed_report",
    """with w as (select s.*, exists (select 1 from files f where f.listing_id = s.listing_id and f.image_id = s.image_id and size > 1024) as there from image_status s where download_done = 2 and s.listing_id % 7 > 0 and s.listing_id % 5 = 0)
    select count(*) filter (where there) as ready, count(*) filter (where not there) as missing from w""",
)
def c5_report(t):
    return counted(t, reports.embed_candidates(*ready(t))[1])


@query("c6_full_batches", f"with {READY}, n as (select *, row_number() over (order by listing_id, image_id) - 1 as n, count(*) over () as total from ready) select listing_id, image_id, n DIV 64 as batch, n % 64 as pos from n where n < total DIV 64 * 64")
def c6(t):
    status, index, files, claimed = ready(t)
    return worklists.full_batches(worklists.embed_candidates(status, index, files, claimed).filter("ready"), 64)


@query("c7_movable_nonprimary", "select listing_id, image_id from image_status where is_primary = 0 and download_done = 2")
def c7(t):
    return worklists.movable_nonprimary(t.image_status)


@query("c8_listings_missing_shop", "select listing_id from legacy_meta where error is null and shop_id is null")
def c8(t):
    return worklists.listings_missing_shop(t.legacy_meta)


@query("c8_unsynced_shops", "select distinct shop_id from legacy_meta where error is null and shop_id is not null and shop_id not in (select shop_id from shops where shop_id % 2 = 0)")
def c8_shops(t):
    return worklists.unsynced_shops(t.legacy_meta, t.shops.filter("shop_id % 2 = 0"))


@query("c9_failed_entries", "select listing_id from legacy_meta where image_id = 9999999999")
def c9(t):
    return worklists.failed_entries(t.legacy_meta)


@query("c10_new_ids", "select distinct listing_id from line_order where listing_id not in (select listing_id from listings)")
def c10(t):
    return worklists.new_ids(t.line_order, t.listings)


@query(
    "c11_shop_backlog",
    """with x as (select l.shop_id, exists (select 1 from legacy_meta m where m.error is null and m.listing_id = l.listing_id) and exists (select 1 from files f where f.size > 0 and f.listing_id = l.listing_id) as have from listings l)
    select shop_id, count(*) as listings, count(*) filter (where have) as have, count(*) filter (where not have) as need, count(*) filter (where not have) = 0 as complete from x group by shop_id""",
)
def c11(t):
    return worklists.shop_backlog(t.listings, t.legacy_meta, t.files)
