"""Queries of the sources and sinks: files are written from the given tables and read back."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from catalog_lake.functions.columns import FAILED_IMAGE
from catalog_lake.numbering import number_rows
from catalog_lake.operators import archive, ingest
from catalog_lake.operators.merge import insert_or_ignore
from catalog_lake.plans.fixtures import NOW
from catalog_lake.plans.image_queries import MEMBERS, OFFSETS, config, members, packed, stored
from catalog_lake.plans.merge_queries import payloads
from catalog_lake.plans.registry import ORACLES, query
from catalog_lake.session import new_path
from catalog_lake.sources import readers
from catalog_lake.sources.versions import VersionedTable

#: Tars of one offset index.
INDEXED_TARS = 100
#: Most entries of one file of legacy metadata.
LEGACY_ENTRIES = 10_000


@query("s1_read_payloads")
def s1(t):
    path = new_path(t._spark, "payloads")
    payloads(t).write.json(path)
    return ingest.listing_dynamic_rows(readers.read_payloads(t._spark, path, "listing"), NOW)


ORACLES["s1_read_payloads"] = ORACLES["a2_listing_dynamic_rows"]


@query("s2_write_read_table", "select listing_id, title, price, taxonomy_id from listings")
def s2(t):
    path = new_path(t._spark, "table")
    readers.write_table(t.listings.select("listing_id", "title", "price", "taxonomy_id"), path, ("taxonomy_id",))
    return readers.read_table(t._spark, path).withColumn("taxonomy_id", F.col("taxonomy_id").cast("bigint"))


@query("s2_versioned_merge", "select listing_id, title, case when listing_id % 3 > 0 then price else price + 1 end as price from listings")
def s2_merge(t):
    """Two thirds of the listings are stored; all come again at another price, of which the new ones are taken."""
    rows = t.listings.select("listing_id", "title", "price")
    table = VersionedTable(t._spark, new_path(t._spark, "versions"), "listing_id bigint, title string, price double", ("listing_id",), 8)
    table.write(rows.filter("listing_id % 3 > 0"), 0)
    again = rows.withColumns({"price": F.col("price") + 1, "ord": F.col("listing_id")})
    table.merge(again, lambda stored, new: insert_or_ignore(stored, new, ("listing_id",)))
    return table.read()


@query("s2_versioned_deletion", "select * from image_status where download_done <> -1 and listing_id % 4 > 0")
def s2_deletion(t):
    """Dead images and all of every fourth listing are deleted from a stored status whose finished rows lie apart."""
    table = VersionedTable(t._spark, new_path(t._spark, "versions"), "listing_id bigint, image_id bigint, is_primary int, url string, download_done int", ("listing_id", "image_id"), 8, cold="download_done >= 3")
    table.write(t.image_status, 0)
    table.delete(t.image_status.filter("download_done = -1 or listing_id % 4 = 0"))
    return table.read()


#: Vectors of one batch of results.
BATCH = 1_000


def write_batches(vectors, folder: str):
    """Finished batches of (batch, listing_id, image_id, embedding, text): a folder each, with manifest, texts and one matrix."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("image_id")
        fs, base = archive.open_store(folder)
        name = f"{base}/batch_{frame['batch'].iloc[0]}"
        fs.create_dir(name, recursive=True)
        matrix = io.BytesIO()
        np.save(matrix, np.stack(frame["embedding"].to_numpy()).astype(np.float32))
        texts = {str(k): v for k, v in frame[["listing_id", "text"]].itertuples(index=False)}
        files = {"manifest.json": json.dumps(frame[["listing_id", "image_id"]].to_numpy().tolist()).encode(), "listings.json": json.dumps(texts).encode(), "given.npy": matrix.getvalue()}
        for file, content in files.items():
            with fs.open_output_stream(f"{name}/{file}") as sink:
                sink.write(content)
        return pd.DataFrame({"rows": [len(frame)]})

    return vectors.groupBy("batch").applyInPandas(run, "rows bigint")


@query("s6_read_batch_results", "select concat('batch_', cast(image_id DIV 1000 as string)) as batch, row_number() over (partition by image_id DIV 1000 order by image_id) - 1 as pos, listing_id, image_id, 'given' as model, round(cast(embedding[1] as double), 4) as first, cast(len(embedding) as bigint) as dim, first_value(cast(label as string)) over (partition by image_id DIV 1000, listing_id order by image_id) as text from vectors")
def s6(t):
    folder = new_path(t._spark, "batches")
    given = t.vectors.select(F.expr(f"image_id div {BATCH}").alias("batch"), "listing_id", "image_id", "embedding", F.first(F.col("label").cast("string")).over(W.partitionBy(F.expr(f"image_id div {BATCH}"), "listing_id").orderBy("image_id")).alias("text"))
    write_batches(given, folder).write.format("noop").mode("overwrite").save()
    found = readers.read_batch_results(t._spark, folder)
    return found.select("batch", F.col("pos").cast("bigint").alias("pos"), "listing_id", "image_id", "model", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"), F.size("embedding").cast("bigint").alias("dim"), "text")


@query("s3_s9_image_index", "select cast(shard as int) as shard, shard_row, global_row, listing_id, image_id, concat('h', cast(listing_id as string), ',', 'k') as hashes from shard_index")
def s3(t):
    path = new_path(t._spark, "index")
    readers.write_image_index(t.shard_index.withColumn("hashes", F.array(F.concat(F.lit("h"), F.col("listing_id").cast("string")), F.lit("k"))), path)
    return readers.read_image_index(t._spark, path, 1000).withColumn("hashes", F.array_join("hashes", ","))


@query("s4_read_offset_index", f"""with {MEMBERS}, {OFFSETS} select tar_name, concat(cast(listing_id as string), '_', cast(image_id as string), '.jpg') as member, offset_ as "offset" from offsets""")
def s4(t):
    path = new_path(t._spark, "offsets")
    rows = archive.member_offsets(members(t)).groupBy("tar_name").agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("%d_%d.jpg", "listing_id", "image_id"), "offset"))).alias("m"))
    number = F.expr(f"cast(substr(tar_name, 10, 5) as int) div {INDEXED_TARS}")  # a file for so many tars
    files = rows.groupBy(number.alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("tar_name", "m"))).alias("tars"))
    files.select(F.to_json(F.struct("tars")).alias("value"), "part").write.partitionBy("part").text(path)
    return readers.read_offset_index(t._spark, f"{path}/*")


@query("s5_read_file_inventory", f"with {MEMBERS}, s as (select tar_name as name, sum(512 + (size + 511) DIV 512 * 512) + 1024 as n from members group by 1) select name, cast(null as bigint) as listing_id, cast((n + 10239) DIV 10240 * 10240 as bigint) as size from s")
def s5(t):
    def use(m, folder):
        stored(packed(m, folder))
        return readers.read_file_inventory(t._spark, folder).select("name", "listing_id", "size")

    return archive.in_rounds(members(t), use)


@query("s7_read_legacy_metadata", "select listing_id, error, case when error is null and image_id is distinct from 9999999999 then shop_id end as shop_id, case when error is null then image_id end as image_id from legacy_meta")
def s7(t):
    path = new_path(t._spark, "metadata")
    entry = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).when(F.col("image_id") == FAILED_IMAGE, F.col("image_id").cast("string")).otherwise(F.to_json(F.struct("shop_id", "image_id", "price")))
    value = F.when(F.col("error").isNotNull(), F.concat(F.lit('"'), F.col("error"), F.lit('"'))).otherwise(entry)
    numbered = number_rows(t.legacy_meta, [F.col("listing_id")], "n")
    lines = numbered.groupBy(F.expr(f"n div {LEGACY_ENTRIES}").alias("part")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("listing_id").cast("string"), F.lit('":'), value)), ","), F.lit("}")).alias("value"))
    lines.write.partitionBy("part").text(path)
    return readers.read_legacy_metadata(t._spark, f"{path}/*").select("listing_id", "error", "shop_id", "image_id")


@query("s8_read_taxonomy_config", "select taxonomy_id, name, cast(case when k % 5 = 0 then 2 else 4 end as bigint) as n from price_breaks")
def s8(t):
    path = new_path(t._spark, "taxonomy")
    rows = config(t).agg(F.collect_list(F.struct(F.col("taxonomy_id").alias("id"), "name", "price_breaks")).alias("taxonomies"))  # configuration: a row per taxonomy
    rows.write.json(path)
    return readers.read_taxonomy_config(t._spark, path).select("taxonomy_id", "name", F.size("price_breaks").cast("bigint").alias("n"))
