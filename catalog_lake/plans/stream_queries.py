"""Queries of the streaming jobs: a given table is read as a stream, and what the job wrote is returned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from catalog_lake.functions.columns import file_partition
from catalog_lake.operators import archive
from catalog_lake.plans.fixtures import EVENTS_NOW, dialect
from catalog_lake.plans.registry import query
from catalog_lake.session import new_path
from catalog_lake.sources import readers
from catalog_lake.sources.versions import VersionedTable
from catalog_lake.streaming import jobs

#: Parts of a stored table.
PARTS = 8
IMAGE_KEYS, REVIEW_KEYS = ("listing_id", "image_id"), ("shop_id", "listing_id", "create_timestamp")
#: Images in tars: no job but an upsert or a repair changes them.
COLD = "download_done >= 3"
STATUS = "listing_id bigint, image_id bigint, is_primary int, url string, download_done int"


def stream(t, name: str) -> DataFrame:
    """A table as a stream, by a pattern: Spark's source takes a plain path for a folder, and a table may be one file."""
    schema = t._spark.read.parquet(f"{t._dir}/{name}.parquet").schema
    return t._spark.readStream.schema(schema).parquet(f"{t._dir}/[{name[0]}]{name[1:]}.parquet")


def drained(writer, spark, schema) -> DataFrame:
    """Run a stream to its end and read what it wrote."""
    out = new_path(spark, "stream")
    writer.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query(
    "k1_stream_staleness",
    """with recursive e as (select user_id as listing_id, event_id as ord, TS(ts) as snapshot_ts, TS(ts) * 100000000 + event_id as k from events),
    taken as (select listing_id, min(k) as k, 'new' as class from e group by listing_id
      union all select t.listing_id, min(e.k), 'update' from taken t join e on e.listing_id = t.listing_id and e.snapshot_ts - t.k DIV 100000000 > 432000 group by t.listing_id)
    select e.listing_id, ord, snapshot_ts, coalesce(class, 'skip') as class from e left join taken on taken.listing_id = e.listing_id and taken.k = e.k""",
)
def k1(t):
    rows = stream(t, "events").select(F.col("user_id").alias("listing_id"), F.col("event_id").alias("ord"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("snapshot_ts"))
    classified = jobs.stream_staleness(rows)
    return drained(classified.writeStream, t._spark, classified.schema)


#: Snapshots up to this time are in the store, for two listings of three; later ones are streamed.
SPLIT = EVENTS_NOW - 10 * 86400


@query(
    "k1_stream_staleness_stored",
    f"""with recursive s as (select user_id as listing_id, event_id as ord, TS(ts) as snapshot_ts, TS(ts) * 100000000 + event_id as k from events),
    e as (select * from s where snapshot_ts > {SPLIT}), stored as (select listing_id, max(snapshot_ts) as last from s where snapshot_ts <= {SPLIT} and listing_id % 3 > 0 group by 1),
    taken as (select e.listing_id, min(k) as k, case when last is null then 'new' else 'update' end as class from e left join stored on stored.listing_id = e.listing_id where last is null or snapshot_ts - last > 432000 group by e.listing_id, last
      union all select t.listing_id, min(e.k), 'update' from taken t join e on e.listing_id = t.listing_id and e.snapshot_ts - t.k DIV 100000000 > 432000 group by t.listing_id)
    select e.listing_id, ord, snapshot_ts, coalesce(class, 'skip') as class from e left join taken on taken.listing_id = e.listing_id and taken.k = e.k""",
)
def k1_stored(t):
    """The store has the newest earlier snapshot of its listings; the rest of the events arrives as a stream."""
    columns = lambda df: df.select(F.col("user_id").alias("listing_id"), F.col("event_id").alias("ord"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("snapshot_ts"))
    stored = columns(t.events).filter((F.col("snapshot_ts") <= SPLIT) & (F.col("listing_id") % 3 > 0)).groupBy("listing_id").agg(F.max("snapshot_ts").alias("last_dynamic_ts"))
    classified = jobs.stream_staleness(columns(stream(t, "events")).filter(F.col("snapshot_ts") > SPLIT), listings_static=stored)
    return drained(classified.writeStream, t._spark, classified.schema)


INCOMING = "select l_orderkey as listing_id, cast(l_linenumber as bigint) as image_id, l_partkey * 100000 + l_suppkey as ord, cast(l_suppkey % 2 as int) as is_primary, case when l_suppkey % 3 > 0 then concat('u', cast(l_suppkey as string)) end as url from lineitem"


def streamed_images(t):
    return stream(t, "lineitem").select(
        F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").cast("bigint").alias("image_id"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("ord"),
        (F.col("l_suppkey") % 2).cast("int").alias("is_primary"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("u"), F.col("l_suppkey").cast("string"))).alias("url"),
    )


@query("k2_stream_upsert_images", f"with i as ({INCOMING}) select listing_id, image_id, arg_max(is_primary, ord) as is_primary, coalesce(arg_min(url, ord) filter (where url is not null), '') as url, cast(0 as int) as download_done from i group by 1, 2")
def k2(t):
    table = VersionedTable(t._spark, new_path(t._spark, "status"), STATUS, IMAGE_KEYS, PARTS)
    jobs.stream_upsert_images(streamed_images(t), table, new_path(t._spark, "progress")).awaitTermination()
    return table.read()


@query(
    "k2_stream_upsert_stored",
    f"""with i as (select listing_id, image_id, arg_max(is_primary, ord) as p, arg_min(url, ord) filter (where url is not null) as u from ({INCOMING}) x where image_id <> 2 or listing_id % 3 > 0 group by 1, 2),
    s as (select * from image_status where image_id < 6)
    select coalesce(s.listing_id, i.listing_id) as listing_id, coalesce(s.image_id, i.image_id) as image_id, case when i.listing_id is not null then i.p else s.is_primary end as is_primary,
    case when s.url <> '' then s.url else coalesce(i.u, s.url, case when s.listing_id is null then '' end) end as url, coalesce(s.download_done, 0) as download_done
    from s full join i on i.listing_id = s.listing_id and i.image_id = s.image_id""",
)
def k2_stored(t):
    """The store lacks the sixth and seventh images, the stream the second one of every third listing; finished images of the store lie apart."""
    table = VersionedTable(t._spark, new_path(t._spark, "status"), STATUS, IMAGE_KEYS, PARTS, cold=COLD)
    table.write(t.image_status.filter("image_id < 6"), -1)
    jobs.stream_upsert_images(streamed_images(t).filter("image_id <> 2 or listing_id % 3 > 0"), table, new_path(t._spark, "progress")).awaitTermination()
    return table.read()


@query("k3_stream_append_reviews", "select distinct shop_id, listing_id, create_timestamp from reviews")
def k3(t):
    rows = stream(t, "orders").select((F.col("o_custkey") % 97).alias("shop_id"), F.col("o_custkey").alias("listing_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("create_timestamp"), F.col("o_orderkey").alias("ord"))
    table = VersionedTable(t._spark, new_path(t._spark, "reviews"), "shop_id bigint, listing_id bigint, create_timestamp bigint", REVIEW_KEYS, PARTS)
    jobs.stream_append_reviews(rows, table, new_path(t._spark, "progress")).awaitTermination()
    return table.read()


@query("k3_stream_recent_reviews", "select distinct shop_id, listing_id, create_timestamp from reviews")
def k3_recent(t):
    rows = stream(t, "orders").select((F.col("o_custkey") % 97).alias("shop_id"), F.col("o_custkey").alias("listing_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("create_timestamp"))
    kept = jobs.stream_recent_reviews(rows, "4000 days").select("shop_id", "listing_id", "create_timestamp")
    return drained(kept.writeStream, t._spark, kept.schema)


@query(
    "k3_stream_after_watermark",
    """with r as (select o_custkey as shop_id, o_orderkey as ord, TS(o_orderdate) as create_timestamp from orders),
    x as (select *, max(case when create_timestamp <= 946684800 then 1 else 0 end) over (partition by shop_id order by ord rows unbounded preceding) as stop from r) select shop_id, ord, create_timestamp from x where stop = 0""",
)
def k3_newer(t):
    created = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    rows = stream(t, "orders").select(F.col("o_custkey").alias("shop_id"), F.col("o_custkey").alias("listing_id"), created.alias("create_timestamp"), F.col("o_orderkey").alias("ord"))
    kept = jobs.stream_after_watermark(rows).select("shop_id", "ord", "create_timestamp")
    return drained(kept.writeStream, t._spark, kept.schema)


@query(
    "k3_stream_after_stored_watermark",
    """with r as (select o_custkey as shop_id, o_orderkey as ord, TS(o_orderdate) as create_timestamp from orders),
    x as (select *, max(case when create_timestamp <= case when shop_id % 4 > 0 then 757382400 + shop_id % 97 * 864000 else 946684800 end then 1 else 0 end) over (partition by shop_id order by ord rows unbounded preceding) as stop from r) select shop_id, ord, create_timestamp from x where stop = 0""",
)
def k3_stored(t):
    """Three shops of four have a stored watermark between 1994 and 1996."""
    created = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    marks = t.orders.select(F.col("o_custkey").alias("shop_id")).distinct().filter("shop_id % 4 > 0").withColumn("last_ts", F.expr("757382400 + shop_id % 97 * 864000"))
    rows = stream(t, "orders").select(F.col("o_custkey").alias("shop_id"), F.col("o_custkey").alias("listing_id"), created.alias("create_timestamp"), F.col("o_orderkey").alias("ord"))
    kept = jobs.stream_after_watermark(rows, marks).select("shop_id", "ord", "create_timestamp")
    return drained(kept.writeStream, t._spark, kept.schema)


@query(
    "k4_stream_reconcile",
    """with f as (select l_orderkey as listing_id, cast(l_linenumber as bigint) as image_id, max(case when l_suppkey % 3 > 0 then cast(floor(l_extendedprice) as bigint) % 3000 end) as jpg, bool_or(l_suppkey % 3 = 0) as dl from lineitem group by 1, 2)
    select s.listing_id, s.image_id, is_primary, url, case when download_done = 1 and jpg > 1000 then 2 when download_done = 1 and jpg is not null then -1 when download_done = 0 and url <> '' and jpg > 1000 then 2 when download_done = 0 and url <> '' then 1 else download_done end as download_done
    from image_status s left join f on f.listing_id = s.listing_id and f.image_id = s.image_id""",
)
def k4(t):
    jpg = F.col("l_suppkey") % 3 > 0
    files = stream(t, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").cast("bigint").alias("image_id"), F.when(jpg, "jpg").otherwise("dl").alias("ext"), F.when(jpg, F.floor("l_extendedprice").cast("bigint") % 3000).otherwise(0).alias("size"))
    table = VersionedTable(t._spark, new_path(t._spark, "status"), STATUS, IMAGE_KEYS, PARTS, cold=COLD)
    table.write(t.image_status, -1)
    jobs.stream_reconcile(files, table, new_path(t._spark, "progress")).awaitTermination()
    return table.read()


RECONCILE = "case when download_done = 1 and {0} > 1000 then 2 when download_done = 1 and {0} is not null then -1 when download_done = 0 and url <> '' and {0} > 1000 then 2 when download_done = 0 and url <> '' then 1 else download_done end"
FOLDER_STATUS = "select p_partkey as listing_id, cast(1 as bigint) as image_id, cast(1 as int) as is_primary, case when p_partkey % 11 > 0 then concat('u', cast(p_partkey as string)) else '' end as url, cast(p_size as int) % 5 - 1 as download_done from part"


def write_files(files, folder: str) -> None:
    """Files (name, size) of zeros in a folder for each of eight parts of their names."""

    def run(frames):
        fs, base = archive.open_store(folder)
        for frame in frames:
            for name, size, part in frame[["name", "size", "part"]].itertuples(index=False):
                fs.create_dir(f"{base}/{part}", recursive=True)
                with fs.open_output_stream(f"{base}/{part}/{name}") as sink:
                    sink.write(bytes(size))
            yield pd.DataFrame({"n": [len(frame)]})

    files.withColumn("part", file_partition(F.col("name"))).mapInPandas(run, "n bigint").write.format("noop").mode("overwrite").save()


@query(
    "k4_stream_folders",
    f"""with s as ({FOLDER_STATUS}), f as (select p_partkey, case when p_partkey % 3 > 0 then cast(floor(p_retailprice) as bigint) % 3000 end as jpg, p_partkey % 2 as wave from part),
    x as (select s.listing_id, image_id, is_primary, url, jpg, wave, {RECONCILE.format("case when wave = 0 then jpg end")} as download_done from s join f on f.p_partkey = s.listing_id),
    y as (select x.*, case when listing_id % 9 = 1 and jpg is not null then 2000 when wave = 1 then jpg when listing_id % 8 = 0 and jpg is not null then 2000 end as jpg2 from x)
    select listing_id, image_id, is_primary, url, {RECONCILE.format("jpg2")} as download_done from y""",
)
def k4_folders(t):
    """Files arrive in two waves, those of even listings first; in the second some of these are written again at another size. Each wave is a listing of the folders, and the second finds what differs."""
    spark, folder, snapshots, progress = t._spark, new_path(t._spark, "images"), new_path(t._spark, "listings"), new_path(t._spark, "progress")
    p = F.col("p_partkey")
    jpg = t.part.filter(p % 3 > 0).select(p, F.format_string("%d_1.jpg", p).alias("name"), (F.floor("p_retailprice") % 3000).cast("int").alias("size"))
    markers = t.part.filter(p % 5 == 0).select(p, F.format_string("%d_1.dl", p).alias("name"), F.lit(0).alias("size"))
    table = VersionedTable(spark, new_path(spark, "status"), STATUS, IMAGE_KEYS, PARTS, cold=COLD)
    table.write(spark.sql(dialect(FOLDER_STATUS, spark=True).replace("from part", "from {part}"), part=t.part), -1)
    again = jpg.withColumn("size", F.when((p % 9 == 1) | ((p % 2 == 0) & (p % 8 == 0)), 2000).otherwise(F.col("size")))
    for wave in (jpg.filter(p % 2 == 0).unionByName(markers), again.filter((p % 2 == 1) | (p % 9 == 1) | (p % 8 == 0))):
        write_files(wave, folder)
        found = readers.stream_file_inventory(spark, snapshots, folder).filter("change <> 'gone'")
        jobs.stream_reconcile(found, table, progress).awaitTermination()
    return table.read()
