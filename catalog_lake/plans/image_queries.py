"""Queries of the image life cycle, migrations, pricing, archives and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalog_lake.functions import columns as C
from catalog_lake.operators import archive, images, migrate, pricing, quality, reports
from catalog_lake.plans.merge_queries import counted
from catalog_lake.plans.registry import query

RECONCILED = """f as (select listing_id, image_id, max(case when ext = 'jpg' then size end) as jpg, bool_or(ext = 'dl') as dl from files group by 1, 2),
    r as (select s.*, case when download_done = 1 and jpg > 1000 then 'downloaded' when download_done = 1 and jpg is not null then 'dead' when download_done = 0 and url <> '' and jpg > 1000 then 'downloaded'
    when download_done = 0 and url <> '' and coalesce(dl, false) then 'reconciled' when download_done = 0 and url <> '' then 'marker_created' end as action
    from image_status s left join f on f.listing_id = s.listing_id and f.image_id = s.image_id)"""


@query("d1_reconcile_downloads", f"with {RECONCILED} select listing_id, image_id, is_primary, url, case when action = 'downloaded' then 2 when action = 'dead' then -1 when action is not null then 1 else download_done end as download_done, action from r")
def d1(t):
    return images.reconcile_downloads(t.image_status, t.files)


@query("d1_action_counts", f"with {RECONCILED} select action, count(*) as n from r where action is not null group by action")
def d1_counts(t):
    return images.action_counts(images.reconcile_downloads(t.image_status, t.files))


REBUILT = """disk as (select listing_id, image_id from files where ext = 'jpg'), e as (select listing_id, image_id from image_status where listing_id % 6 > 0 union select * from disk),
    rebuilt as (select e.*, cast(case when d.listing_id is not null then 1 else 0 end as int) as downloaded, cast(case when i.listing_id is not null then 1 else 0 end as int) as background_removed,
    cast(case when i.listing_id is not null then 1 else 0 end as int) as embed_clip from e left join disk d on d.listing_id = e.listing_id and d.image_id = e.image_id
    left join image_index i on i.listing_id = e.listing_id and i.image_id = e.image_id and i.listing_id % 5 > 0)"""


def rebuilding(t):
    """The status lacks every sixth listing, the index every fifth."""
    return t.image_status.filter("listing_id % 6 > 0"), t.files, t.image_index.filter("listing_id % 5 > 0"), ["clip"]


@query("d2_rebuild_status", f"with {REBUILT} select * from rebuilt")
def d2(t):
    return images.rebuild_status(*rebuilding(t))


@query("d2_rebuild_report", f"with {REBUILT} select count(*) as pairs, cast(sum(downloaded) as bigint) as downloaded, cast(sum(background_removed) as bigint) as background_removed, cast(sum(embed_clip) as bigint) as embed_clip from rebuilt")
def d2_report(t):
    return counted(t, reports.rebuild_status(*rebuilding(t))[1])


@query("d3_orphan_files", "select distinct listing_id, image_id from files where listing_id not in (select listing_id from legacy_meta)")
def d3(t):
    return images.orphan_files(t.files, t.legacy_meta)


@query(
    "d4_parse_image_name",
    r"""with n as (select concat(cast(listing_id as string), case when image_id = 1 then '-' else '_' end, cast(image_id as string), case when image_id = 2 then '.png' else '.jpg' end) as name from line_order where ord = 1)
    select name, case when regexp_matches(name, '^(\d+)_(\d+)\.(jpg|dl)$') then cast(regexp_extract(name, '^(\d+)_(\d+)\.(jpg|dl)$', 1) as bigint) end as listing_id,
    case when regexp_matches(name, '^(\d+)_(\d+)\.(jpg|dl)$') then cast(regexp_extract(name, '^(\d+)_(\d+)\.(jpg|dl)$', 2) as bigint) end as image_id from n""",
)
def d4(t):
    sep, end = F.when(F.col("image_id") == 1, "-").otherwise("_"), F.when(F.col("image_id") == 2, ".png").otherwise(".jpg")
    named = t.line_order.filter("ord = 1").select(F.concat(F.col("listing_id").cast("string"), sep, F.col("image_id").cast("string"), end).alias("name"))
    parsed = named.withColumn("p", C.parse_image_name(F.col("name")))
    return parsed.select("name", "p.listing_id", "p.image_id")


@query("d5_file_partition", r"select name, cast(cast(substr(case when length(regexp_replace(name, '\D', '', 'g')) < 5 then lpad(regexp_replace(name, '\D', '', 'g'), 5, '0') else regexp_replace(name, '\D', '', 'g') end, 1, 5) as int) % 8 as int) as part from files")
def d5(t):
    return t.files.select("name", C.file_partition(F.col("name")).alias("part"))


def nested(t, flagged: int = 6):
    """Legacy entries with an array of images: none, one or two; flagged where ``flagged`` divides the id."""
    image = lambda k: F.struct((F.col("listing_id") * 10 + k).alias("image_id"), F.concat(F.lit("ab"), F.col("listing_id").cast("string")).alias("hex"), F.when(F.col("listing_id") % 13 > k, F.col("suffix")).alias("suffix"), F.when(F.col("listing_id") % flagged == 0, F.lit(k == 1)).alias("is_primary"), F.when(F.col("listing_id") % 4 == 0, F.lit(True)).alias("bg_removed"))
    size = F.col("listing_id") % 3
    none = F.array().cast(f"array<{migrate.IMAGE}>")
    return t.legacy_meta.withColumn("images", F.when(size == 0, none).when(size == 1, F.array(image(0))).otherwise(F.array(image(0), image(1))))


PLAN = """m as (select listing_id, concat(cast(listing_id as string), '.jpg') as old_name, case when listing_id % 3 > 0 then concat(cast(listing_id as string), '_', cast(listing_id * 10 as string), '.jpg') end as new_name from legacy_meta),
    have as (select case when listing_id % 2 = 0 then concat(cast(listing_id as string), '.jpg') else concat(cast(listing_id as string), '_', cast(listing_id * 10 as string), '.jpg') end as name from legacy_meta where listing_id % 5 > 0),
    planned as (select m.*, case when new_name is null then 'no_images' when new_name in (select name from have) then 'already_new' when old_name in (select name from have) then 'renamed' else 'missing' end as class from m)"""


def planning(t):
    have = t.legacy_meta.filter("listing_id % 5 > 0").select(F.expr("if(listing_id % 2 = 0, concat(listing_id, '.jpg'), concat(listing_id, '_', listing_id * 10, '.jpg'))").alias("name"))
    return nested(t), have


@query("d6_rename_plan", f"with {PLAN} select * from planned")
def d6(t):
    return images.rename_plan(*planning(t))


@query("d6_rename_report", f"with {PLAN} select " + ", ".join(f"count(*) filter (where class = '{c}') as {c}" for c in ("renamed", "already_new", "missing", "no_images")) + " from planned")
def d6_report(t):
    return counted(t, reports.rename_plan(*planning(t))[1])


URL = "concat('https://x/r/il/', case when c_custkey % 3 > 0 then 'ab12' else 'zz' end, '/', cast(c_custkey as string), '/il_570xN.', cast(c_custkey as string), '_', case when c_custkey % 5 > 0 then 'k9f' else 'K' end, '.jpg')"


@query("d7_parse_cdn_url", f"with u as (select c_custkey, {URL} as url from customer) select c_custkey, case when c_custkey % 3 > 0 and c_custkey % 5 > 0 then 'ab12' end as hex, case when c_custkey % 3 > 0 and c_custkey % 5 > 0 then 'k9f' end as suffix from u")
def d7(t):
    return t.customer.select("c_custkey", C.parse_cdn_url(F.expr(URL)).alias("p")).select("c_custkey", "p.hex", "p.suffix")


@query("d8_build_cdn_url", "select listing_id, case when shop_id is not null and image_id is not null and image_id <> 9999999999 then concat('https://img.example/', cast(shop_id as string), '/r/il/', hex, '/', cast(image_id as string), '/il_570xN.', cast(image_id as string), '_', suffix, '.jpg') end as url from legacy_meta")
def d8(t):
    return t.legacy_meta.select("listing_id", C.build_cdn_url("img.example", F.col("shop_id"), F.col("hex"), F.col("image_id"), F.col("suffix")).alias("url"))


@query("d9_listing_image", "select listing_id, min(name) as first_name, cast(count(*) as bigint) as n from files where ext = 'jpg' group by listing_id")
def d9(t):
    return images.listing_image(t.files).select("listing_id", "first_name", F.size("names").cast("bigint").alias("n"))


@query("e1_nest_images", "select listing_id, case when error is not null then 'skipped' else 'converted' end as outcome, cast(case when error is not null then -1 when image_id is not null then 1 else 0 end as bigint) as n, case when error is null then image_id end as image_id from legacy_meta")
def e1(t):
    rows = migrate.nest_images(t.legacy_meta.withColumn("images", F.lit(None).cast(f"array<{migrate.IMAGE}>")))
    return rows.select("listing_id", "outcome", F.coalesce(F.size("images"), F.lit(-1)).cast("bigint").alias("n"), F.try_element_at("images", F.lit(1))["image_id"].alias("image_id"))


@query("e2_flag_first_image", "select listing_id, case when listing_id % 3 = 0 then 'no_images' when listing_id % 4 = 0 then 'already' else 'updated' end as outcome, case when listing_id % 3 > 0 then case when listing_id % 4 = 0 then false else true end end as first from legacy_meta")
def e2(t):
    return migrate.flag_first_image(nested(t, 4)).select("listing_id", "outcome", F.try_element_at("images", F.lit(1))["is_primary"].alias("first"))


@query("e2_flag_report", "select count(*) filter (where listing_id % 3 > 0 and listing_id % 4 > 0) as updated, count(*) filter (where listing_id % 3 > 0 and listing_id % 4 = 0) as already, count(*) filter (where listing_id % 3 = 0) as no_images from legacy_meta")
def e2_report(t):
    return counted(t, reports.flag_first_image(nested(t, 4))[1])


@query(
    "e3_to_image_status",
    """with p as (select m.*, coalesce(case when listing_id % 7 = 0 then c_nationkey * 1000 / 100.0 end, price) as pr from legacy_meta m where error is null),
    q as (select *, coalesce(when_made in ('made_to_order', '2010_2019') and pr >= 50, false) as ok from p),
    i as (select q.*, k, listing_id * 10 + k as img from q, (values (0), (1)) v(k) where ok and k < listing_id % 3 and listing_id % 13 > k),
    d as (select listing_id as l, listing_id * 10 as img from legacy_meta where listing_id % 2 = 0)
    select listing_id, cast(0 as bigint) as image_id, cast(0 as int) as is_primary, cast(0 as int) as to_download, pr as price, cast(0 as int) as downloaded, cast(0 as int) as bg_removed from q where not ok
    union all select i.listing_id, i.img, cast(case when k = 0 or (listing_id % 6 = 0 and k = 1) then 1 else 0 end as int), cast(1 as int), pr, cast(case when d.l is not null then 1 else 0 end as int),
    cast(case when d.l is not null and (listing_id % 4 = 0 or background_removed) then 1 else 0 end as int) from i left join d on d.l = i.listing_id and d.img = i.img""",
)
def e3(t):
    meta = nested(t)
    prices = t.legacy_meta.filter("listing_id % 7 = 0").select("listing_id", (F.col("c_nationkey") * 1000).alias("price_amount"), F.lit(100).alias("price_divisor"))
    files = t.legacy_meta.filter("listing_id % 2 = 0").select("listing_id", (F.col("listing_id") * 10).alias("image_id"), F.lit("jpg").alias("ext"), F.lit(1001).alias("size"))
    return migrate.to_image_status(meta, prices, files)


def nodes(t):
    """A tree over the parts' ids: node n is below n div 3."""
    return t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 3")).alias("parent_id"), F.col("p_name").alias("name"), F.expr("cast(p_partkey % 3 as int)").alias("ord")).filter("id > 0 or parent_id is null")


@query(
    "f1_descendants",
    """with recursive tree as (select p_partkey as id, p_name as name, 0 as depth, '' as path from part where p_partkey = 4 union all
    select p.p_partkey, p.p_name, t.depth + 1, concat(t.path, '/', lpad(cast(p.p_partkey % 3 as string), 6, '0')) from part p join tree t on p.p_partkey DIV 3 = t.id where p.p_partkey > 0) select * from tree""",
)
def f1(t):
    return pricing.descendants(nodes(t), 4)


@query("f2_leaves", "with recursive tree as (select cast(4 as bigint) as id, 0 as depth union all select p.p_partkey, t.depth + 1 from part p join tree t on p.p_partkey DIV 3 = t.id where p.p_partkey > 0) select t.id, p_name as name from tree t join part on p_partkey = t.id where depth > 0 and t.id not in (select p_partkey DIV 3 from part where p_partkey > 0)")
def f2(t):
    return pricing.leaves(nodes(t), 4)


def config(t):
    """Breaks 0, 900 + k, 950, 1,000,000 for taxonomy k + 1; two breaks for every fifth."""
    return t.price_breaks.select("taxonomy_id", "name", F.when(F.col("k") % 5 == 0, F.array(F.lit(0.0), F.lit(1e6))).otherwise(F.array(F.lit(0.0), F.lit(900.0) + F.col("k"), F.lit(950.0), F.lit(1e6))).alias("price_breaks"))


UNITS = """units as (select taxonomy_id, name, k, cast(u as int) as unit, case u when 0 then 0.0 when 1 then round(900.0 + k + 0.01, 2) else 950.01 end as min_price,
    case when k % 5 = 0 then null when u = 0 then 900.0 + k when u = 1 then 950.0 end as max_price from price_breaks, (values (0), (1), (2)) v(u) where k % 5 > 0 or u = 0)"""


@query("f3_crawl_units", f"with {UNITS} select taxonomy_id, unit, case when k % 5 = 0 then name else concat(name, ' (unit ', cast(unit as string), ')') end as label, cast(min_price as double) as min_price, cast(max_price as double) as max_price from units")
def f3(t):
    return pricing.crawl_units(config(t))


@query("f4_assign_price_bucket", f"with {UNITS} select l.listing_id, l.taxonomy_id, l.price, u.unit from listings l left join units u on u.taxonomy_id = l.taxonomy_id and l.price >= cast(u.min_price as double) and l.price <= coalesce(cast(u.max_price as double), 1e300)")
def f4(t):
    return pricing.assign_price_bucket(t.listings.select("listing_id", "taxonomy_id", "price"), pricing.crawl_units(config(t)))


@query("f5_bucket_counts", f"with {UNITS} select u.taxonomy_id, u.unit, count(l.listing_id) as n, count(l.listing_id) >= 20 as at_cap from units u left join listings l on u.taxonomy_id = l.taxonomy_id and l.price >= cast(u.min_price as double) and l.price <= coalesce(cast(u.max_price as double), 1e300) group by 1, 2")
def f5(t):
    return pricing.bucket_counts(t.listings, pricing.crawl_units(config(t)), cap=20)


@query("f6_taxonomy_counts", "with e as (select taxonomy_id, count(*) as n, cast(case when count(*) > 40 then 1 else 0 end as bigint) as over_low, cast(case when count(*) > 45 then 1 else 0 end as bigint) as over_high from listings group by 1) select * from e union all select null, cast(sum(n) as bigint), cast(sum(over_low) as bigint), cast(sum(over_high) as bigint) from e")
def f6(t):
    return pricing.taxonomy_counts(t.listings, (40, 45))


def priced_lines(t):
    return t.lineitem.select((F.col("l_linenumber") % 3).cast("bigint").alias("taxonomy_id"), (F.col("l_extendedprice") / 50).alias("price"))


GROWN, HALVED, NEAR, HALVINGS = 500, 1500, 200, 15
#: Each taxonomy's prices in cents with the listings up to each, as two lists; a search looks counts up there.
PRICES = """priced as (select cast(l_linenumber % 3 as bigint) as taxonomy_id, l_extendedprice / 50 as price from lineitem), h as (select taxonomy_id, cast(round(price * 100) as bigint) as cents, count(*) as n from priced group by 1, 2),
    c as (select taxonomy_id, list(cents order by cents) as cents, [0] || list(upto order by cents) as upto from (select taxonomy_id, cents, cast(sum(n) over (partition by taxonomy_id order by cents) as bigint) as upto from h) x group by 1)"""
#: Listings of the intervals between found breaks (taxonomy_id, br).
LOADS = f"""units as (select taxonomy_id, u, case when u = 1 then br[u] else round(br[u] + 0.01, 2) end as low, br[u + 1] as high from (select taxonomy_id, br, unnest(range(1, len(br))) as u from breaks) x)
    select u.taxonomy_id, cast(u - 1 as int) as unit, count(p.price) as n, count(p.price) >= {pricing.PAGING_CAP} as at_cap from units u left join priced p on p.taxonomy_id = u.taxonomy_id and round(p.price, 2) >= low and (round(p.price, 2) <= high or high >= {pricing.UNBOUNDED}) group by 1, 2"""


def upto(cents: str) -> str:
    """SQL: listings at or under a number of cents."""
    return f"upto[len(list_filter(cents, lambda y: y <= {cents})) + 1]"


@query(
    "f7_price_breaks_grow",
    f"""with recursive {PRICES},
    s as (select taxonomy_id, 0.0::double as low, 5.0::double as high, case when upto[-1] <= {GROWN} then 'done' else 'grow' end as phase, case when upto[-1] <= {GROWN} then [0.0::double, {pricing.UNBOUNDED}] else [0.0::double] end as br from c
      union all select taxonomy_id,
        case when phase = 'shrink' and n < {GROWN} then round(split + 0.01, 2) else low end,
        case when phase = 'grow' and n < {GROWN} and high < highest then high * 1.10 when phase = 'grow' then high when n >= {GROWN} then high * 0.99 else round(split + 0.01, 2) * 1.10 end,
        case when phase = 'grow' and n < {GROWN} and high < highest then 'grow' when phase = 'grow' and high >= highest then 'done' when phase = 'grow' or n >= {GROWN} then 'shrink' else 'grow' end,
        case when phase = 'grow' and high >= highest then br || [{pricing.UNBOUNDED}] when phase = 'shrink' and n < {GROWN} then br || [split] else br end
      from (select *, greatest(round(case when high < low then coalesce(cents[len(list_filter(upto, lambda y: y < under + {GROWN})) - 1] / 100, low) else high end, 2), round(low, 2)) as split
        from (select s.*, c.cents, c.upto, c.cents[-1] / 100 as highest, {upto("cast(round(low * 100) as bigint) - 1")} as under, {upto("cast(floor(high * 100 + 1e-6) as bigint)")} - {upto("cast(round(low * 100) as bigint) - 1")} as n
          from s join c on c.taxonomy_id = s.taxonomy_id where phase <> 'done') x) y),
    breaks as (select taxonomy_id, br from s where phase = 'done'), {LOADS}""",
)
def f7(t):
    lines = priced_lines(t)
    return pricing.interval_loads(lines, pricing.price_breaks_grow(lines, GROWN))


@query(
    "f8_price_breaks_halve",
    f"""with recursive {PRICES},
    s as (select taxonomy_id, -0.01::double as low, {pricing.UNBOUNDED}::double as high, upto[-1] as n, 0.0::double as a, {pricing.UNBOUNDED}::double as b, 0 as step, null::double as half from c where upto[-1] > {HALVED}
      union all select * from (select taxonomy_id,
        case when k = 2 then middle else low end as low, case when k = 1 then middle else high end as high, case k when 1 then upto_middle - upto_low when 2 then upto_high - upto_middle else n end as n,
        case when k = 2 then middle when k = 1 then greatest(low, 0) when gap < 0 then (a + b) / 2 else a end as a, case when k = 1 then middle when k = 2 then high when gap < 0 then b else (a + b) / 2 end as b,
        case when k = 0 then step + 1 else 0 end as step, case when k = 3 then middle end as half
      from (select *, {upto("cast(round_even(middle * 100, 0) as bigint)")} as upto_middle, {upto("cast(round_even(high * 100, 0) as bigint)")} as upto_high
        from (select *, case when found then round_even((a + b) / 2, 0) end as middle from (select *, abs(gap) < {NEAR} or step = {HALVINGS - 1} as found
          from (select *, {upto("cast(round_even((a + b) / 2 * 100, 0) as bigint)")} - upto_low - n // 2 as gap
            from (select s.*, c.cents, c.upto, {upto("cast(round_even(low * 100, 0) as bigint)")} as upto_low from s join c on c.taxonomy_id = s.taxonomy_id where half is null) x1) x2) x3) x4) x5, (values (0), (1), (2), (3)) v(k)
      where case when k = 0 then not found else found and greatest(low, 0) < middle and middle < high end) z where half is not null or n > {HALVED}),
    breaks as (select c.taxonomy_id, [0.0::double] || coalesce(list(distinct half order by half) filter (where half is not null), []) || [{pricing.UNBOUNDED}] as br from c left join s on s.taxonomy_id = c.taxonomy_id group by 1), {LOADS}""",
)
def f8(t):
    lines = priced_lines(t)
    return pricing.interval_loads(lines, pricing.price_breaks_halve(lines, HALVED))


@query("f9_listing_price", "select l_orderkey, l_linenumber, l_quantity, coalesce(case when l_tax > 0.01 then l_quantity end, 0) / coalesce(nullif(case when l_discount > 0.01 then l_linenumber - 1 end, 0), 100) as price from lineitem")
def f9(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", C.listing_price(F.expr("case when l_tax > 0.01 then l_quantity end"), F.expr("case when l_discount > 0.01 then l_linenumber - 1 end")).alias("price"))


@query("f10_in_scope", "select listing_id from legacy_meta where when_made in ('made_to_order', '2010_2019') and cast(c_nationkey as bigint) + 1 in (select taxonomy_id from price_breaks where k % 2 = 0)")
def f10(t):
    meta = t.legacy_meta.withColumn("taxonomy_id", F.col("c_nationkey").cast("bigint") + 1)
    return pricing.in_scope(meta, t.price_breaks.filter("k % 2 = 0"), migrate.WHEN_MADE).select("listing_id")


@query("f11_max_price", "select p.taxonomy_id, coalesce(max(price), 1000000.0) as max_price from (select taxonomy_id + 30 as taxonomy_id from price_breaks) p left join listings l on l.taxonomy_id = p.taxonomy_id group by 1")
def f11(t):
    return pricing.max_price(t.listings, t.price_breaks.select((F.col("taxonomy_id") + 30).alias("taxonomy_id")))


BATCHES = "batches as (select *, shard * 10 + shard_row DIV 100 as batch from shard_index qualify count(*) over (partition by shard, shard * 10 + shard_row DIV 100) = 100), named as (select *, concat('imageall_', lpad(cast(batch as string), 5, '0'), '.tar') as tar_name from batches)"


def batches(t):
    return archive.tar_batches(t.shard_index, 100, 1000)


@query("i1_tar_batches", f"with {BATCHES} select * from named")
def i1(t):
    return batches(t)


THERE = """there as (select listing_id, image_id from files union select listing_id, image_id from image_status where download_done >= 0 or url is not null
    union select listing_id, image_id from incoming_images where url is not null)"""


def there(t):
    """Images with a file on disk, and those that were fetched or have an address to fetch from, of the whole tables."""
    status = t.image_status.filter("download_done >= 0 or url is not null")
    parts = [t.files, status, t.incoming_images.filter("url is not null")]
    return reduce(DataFrame.unionByName, (p.select("listing_id", "image_id") for p in parts))


@query(
    "i2_ready_batches",
    f"""with {BATCHES}, done as (select distinct tar_name from named where batch % 10 < 2), {THERE}, c as (select shard, batch, tar_name, bool_and(s.listing_id is not null) as full_ from named n left join there s on s.listing_id = n.listing_id and s.image_id = n.image_id group by 1, 2, 3),
    x as (select *, max(case when tar_name not in (select tar_name from done) then 1 else 0 end) over (partition by shard order by batch rows unbounded preceding) as begun from c),
    y as (select *, max(case when begun = 1 and not full_ then 1 else 0 end) over (partition by shard order by batch rows unbounded preceding) as stopped from x) select shard, batch, tar_name from y where begun = 1 and stopped = 0""",
)
def i2(t):
    b = batches(t)
    done = b.filter("batch % 10 < 2").select("tar_name").distinct()
    return archive.ready_batches(b, done, there(t))


MEMBERS = f"{BATCHES}, members as (select tar_name, shard_row % 100 as pos, listing_id, image_id, (listing_id * 37 + image_id * 511) % 3000 as size from named)"
OFFSETS = "offsets as (select *, cast(coalesce(sum(512 + (size + 511) DIV 512 * 512) over (partition by tar_name order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ from members)"


def members(t):
    return batches(t).select("tar_name", F.expr("shard_row % 100").alias("pos"), "listing_id", "image_id", F.expr("(listing_id * 37 + image_id * 511) % 3000").alias("size"))


@query("i3_member_offsets", f"""with {MEMBERS}, {OFFSETS} select tar_name, pos, listing_id, image_id, size, offset_ as "offset" from offsets""")
def i3(t):
    return archive.member_offsets(members(t))


@query("i4_i5_pack_scan_tars", f"""with {MEMBERS}, {OFFSETS} select tar_name, concat(cast(listing_id as string), '_', cast(image_id as string), '.jpg') as member, offset_ as "offset", size from offsets""")
def i4(t):
    def use(m, folder):
        stored(packed(m, folder))
        return archive.scan_tars(m, folder)

    return archive.in_rounds(members(t), use)


def member():
    return F.format_string("%d_%d.jpg", "listing_id", "image_id")


def body():
    return F.coalesce(F.expr("cast(rpad('', int(size), cast(listing_id as string)) as binary)"), F.lit(b""))


def packed(m, folder):
    """Tars of members, whose contents are built from their keys."""
    return archive.pack_tars(m.withColumn("member", member()), folder, body())


def stored(df) -> None:
    """Run a writer to its end."""
    df.write.format("noop").mode("overwrite").save()


@query(
    "i6_check_tars",
    f"""with {MEMBERS}, m as (select *, cast(substr(tar_name, 10, 5) as int) % 10 as kind from members where pos < 99 or cast(substr(tar_name, 10, 5) as int) % 10 <> 4)
    select tar_name, count(*) as members, cast(case when kind = 3 then 10 else 0 end as bigint) as corrupt, case kind when 3 then 'corrupt' when 4 then 'wrong_count' else 'valid' end as outcome from m group by tar_name, kind""",
)
def i6(t):
    """Of ten tars one lacks its last member, and one has other contents than its sources."""
    kind = F.substring("tar_name", 10, 5).cast("int") % 10

    def use(m, folder):
        stored(packed(m.filter((F.col("pos") < 99) | (kind != 4)), f"{folder}/tars"))
        scanned = archive.scan_tars(m, f"{folder}/tars")
        scanned.write.parquet(f"{folder}/scan")
        sources = m.select("tar_name", member().alias("member"), F.when(kind == 3, F.concat(body(), F.lit(b"x"))).otherwise(body()).alias("content"))
        return archive.check_tars(t._spark.read.schema(scanned.schema).parquet(f"{folder}/scan"), sources, f"{folder}/tars", expected=100, sample=10)

    return archive.in_rounds(members(t), use)


@query("i7_mark_tarred", f"with {BATCHES} select s.listing_id, s.image_id, is_primary, url, case when download_done = 2 and n.listing_id is not null then 3 else download_done end as download_done from image_status s left join named n on n.listing_id = s.listing_id and n.image_id = s.image_id and n.batch % 10 < 5")
def i7(t):
    b = batches(t)
    return archive.mark_tarred(t.image_status, b, b.filter("batch % 10 < 5").select("tar_name").distinct())


@query(
    "i7_finalize_shards",
    f"""with {BATCHES}, full_ as (select shard from shard_index group by shard having count(*) = 1000), final_ as (select distinct listing_id, image_id from shard_index where shard in (select shard from full_) and shard % 2 = 0)
    select s.listing_id, s.image_id, is_primary, case when f.listing_id is null then url end as url, case when f.listing_id is null then download_done else 4 end as download_done from image_status s left join final_ f on f.listing_id = s.listing_id and f.image_id = s.image_id""",
)
def i7_final(t):
    b = batches(t)
    return archive.finalize_shards(t.image_status, t.shard_index, b, b.filter("shard % 2 = 0").select("tar_name"), 1000, 100)


@query("i8_primary_map", "select listing_id, max(image_id) as image_id from image_status where is_primary = 1 group by listing_id")
def i8(t):
    return archive.primary_map(t.image_status)


@query("i9_new_primaries", "select listing_id, max(image_id) as image_id from image_status where is_primary = 1 and listing_id not in (select listing_id from listings) group by listing_id")
def i9(t):
    return archive.new_primaries(archive.primary_map(t.image_status), t.listings)


@query("i10_locate_in_tars", f"""with {MEMBERS}, {OFFSETS}, p as (select listing_id, max(image_id) as image_id from image_status where is_primary = 1 group by listing_id) select p.*, o.tar_name, o.offset_ as "offset", o.tar_name is not null as found from p left join offsets o on o.listing_id = p.listing_id and o.image_id = p.image_id""")
def i10(t):
    return archive.locate_in_tars(archive.primary_map(t.image_status), archive.member_offsets(members(t)))


@query("i11_primary_batches", "with p as (select distinct listing_id, concat(cast(listing_id as string), '.jpg') as member from image_status where is_primary = 1), n as (select *, row_number() over (order by member) - 1 as n from p) select listing_id, member, n % 250 as pos, concat('primary_', lpad(cast(n DIV 250 + 8 as string), 5, '0'), '.tar') as tar_name from n")
def i11(t):
    return archive.primary_batches(archive.primary_map(t.image_status), t.region.select(F.format_string("primary_%05d.tar", F.col("r_regionkey") + 3).alias("tar_name")), 250)


@query("i12_read_members", f"with {MEMBERS} select tar_name, concat(cast(listing_id as string), '_', cast(image_id as string), '.jpg') as member, size from members")
def i12(t):
    def use(m, folder):
        stored(packed(m, folder))
        wanted = m.select("tar_name", member().alias("member"))
        return archive.read_members(archive.scan_tars(m, folder).join(wanted, ["tar_name", "member"]), folder).select("tar_name", "member", F.length("content").cast("bigint").alias("size"))

    return archive.in_rounds(members(t), use)


@query("j1_status_counts", "select " + ", ".join(f"count(*) filter (where download_done = {s}) as {n}" for s, n in ((-1, "status_dead"), (0, "status_0"), (1, "status_1"), (2, "status_2"), (3, "status_3"), (4, "status_4"), (2, "downloaded"), (0, "pending"))) + ", count(*) as total from image_status")
def j1(t):
    return quality.status_counts(t.image_status)


@query("j2_missing_primary", "with b as (select listing_id, max(is_primary) as p from image_status group by 1) select count(*) filter (where p <> 1) as missing, count(*) as listings from b")
def j2(t):
    return quality.missing_primary(t.image_status)


@query("j3_missing_url_count", "select count(*) as missing from image_status where coalesce(url, '') = ''")
def j3(t):
    return quality.missing_url_count(t.image_status)


COUNTED = ("listings", "listing_snapshots", "shops", "shop_snapshots", "reviews")


@query("j4_table_counts", " union all ".join(f"""select '{n}' as name, count(*) as "rows" from {n}""" for n in COUNTED))
def j4(t):
    return quality.table_counts({n: getattr(t, n) for n in COUNTED})


@query(
    "j5_compare_inventories",
    """with a as (select count(*) as src_files, cast(sum(size) as bigint) as src_bytes from files), b as (select count(*) as dst_files, cast(sum(size) as bigint) as dst_bytes from files where listing_id % 50 > 0)
    select *, src_files - dst_files as delta_files, src_bytes - dst_bytes as delta_bytes, src_files = dst_files and abs(src_bytes - dst_bytes) <= 1048576 as ok from a, b""",
)
def j5(t):
    return quality.compare_inventories(t.files, t.files.filter("listing_id % 50 > 0"))
