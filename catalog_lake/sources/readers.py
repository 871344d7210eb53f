"""Sources and sinks: payloads, catalogue tables, positional and offset indexes, file inventories, batch results."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from catalog_lake.functions.columns import parse_image_name
from catalog_lake.session import materialise
from catalog_lake.sources.inventory import inventory

LISTING = (
    "page INT, ord INT, listing_id BIGINT, shop_id BIGINT, title STRING, description STRING, creation_timestamp BIGINT, is_customizable BOOLEAN, "
    "is_personalizable BOOLEAN, listing_type STRING, tags ARRAY<STRING>, materials ARRAY<STRING>, processing_min INT, processing_max INT, who_made STRING, "
    "when_made STRING, item_weight DOUBLE, item_weight_unit STRING, item_length DOUBLE, item_width DOUBLE, item_height DOUBLE, item_dimensions_unit STRING, "
    "should_auto_renew BOOLEAN, language STRING, taxonomy_id BIGINT, production_partners STRING, state STRING, ending_timestamp BIGINT, quantity BIGINT, "
    "num_favorers BIGINT, views BIGINT, price STRUCT<amount: BIGINT, divisor: BIGINT, currency_code: STRING>, "
    "images ARRAY<STRUCT<listing_image_id: BIGINT, url_570xN: STRING, rank: INT>>"
)
SHOP = (
    "shop_id BIGINT, create_date BIGINT, url STRING, is_shop_us_based BOOLEAN, shipping_from_country_iso STRING, shop_location_country_iso STRING, update_date BIGINT, "
    "listing_active_count BIGINT, accepts_custom_requests BOOLEAN, num_favorers BIGINT, transaction_sold_count BIGINT, review_average DOUBLE, review_count BIGINT"
)
REVIEW = "ord INT, shop_id BIGINT, listing_id BIGINT, buyer_user_id BIGINT, rating INT, review STRING, language STRING, create_timestamp BIGINT"
PAYLOADS = {"listing": LISTING, "shop": SHOP, "review": REVIEW}
LEGACY_ENTRY = (
    "shop_id BIGINT, when_made STRING, price DOUBLE, background_removed BOOLEAN, image_id BIGINT, hex STRING, suffix STRING, "
    "images ARRAY<STRUCT<image_id: BIGINT, hex: STRING, suffix: STRING, is_primary: BOOLEAN, bg_removed: BOOLEAN>>"
)


def read_payloads(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """Landed JSON payloads, one object a line; fields that are absent are NULL."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(PAYLOADS[kind]).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet; with partition columns only the partitions that df has are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# ---- large JSON files, read in splits


def cut_text(spark: SparkSession, path: str, separator: str, recursive: bool = False) -> DataFrame:
    """(file, block, at, piece): files cut at each separator, stored. Pieces are in order by block, where a split begins, and at.

    Spark's text reader splits a file anywhere and gives each piece to the split that it begins in, so that one large
    file is read by many tasks and no row holds more than a piece.
    """
    text = spark.read.option("lineSep", separator).option("recursiveFileLookup", recursive).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return materialise(text.select(*place, F.col("value").alias("piece")), "pieces")


def _before(blocks: DataFrame, value: str, fold: Callable) -> DataFrame:
    """``blocks``, a row for each split, plus __before: ``fold`` of the values of the file's earlier splits."""
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("__before", fold(value).over(earlier))


def _whole_quotes(piece: Column, what: str) -> Column:
    """The piece, or an error where a separator lay within a string: then it has a string's begin or end only."""
    plain = F.when(F.contains(piece, F.lit("\\")), F.regexp_replace(piece, r"\\.", "")).otherwise(piece)
    quotes = F.char_length(plain) - F.char_length(F.replace(plain, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 0, piece).otherwise(F.raise_error(F.concat(F.lit(f"a string of the {what} has a separator: "), F.left(piece, F.lit(80)))))


def read_image_index(spark: SparkSession, path: str, shard_rows: int = 500_000) -> DataFrame:
    """(shard, shard_row, global_row, listing_id, image_id, hashes) of index files: one array of entries, or an entry a line.

    The shard is the number in the file's name or its partition folder's, 0 if there is none. Files are read in
    splits, cut at closing brackets; entries have numbers and hexadecimal strings, no brackets. An entry's row is
    counted: those of the splits before its own, and those before it there.
    """
    pieces = cut_text(spark, path, "]", recursive=True)
    piece = F.col("piece")
    # an opening bracket and nothing else is the begin of an empty file's array
    found = pieces.filter(F.contains(piece, F.lit("[")) & ~piece.rlike(r"^[^\n,\[]*\[\s*$")).withColumn("piece", _whole_quotes(piece, "index"))
    counts = _before(found.groupBy("file", "block").agg(F.min("at").alias("__first"), F.count(F.lit(1)).alias("__rows")), "__rows", F.sum)
    shard = F.coalesce(*(F.regexp_extract("file", form, 1).try_cast("int") for form in (r"(\d+)\.json$", r"/shard=(\d+)/")), F.lit(0))
    entry = F.from_json(F.concat(F.lit("["), F.substring_index("piece", "[", -1), F.lit("]")), "array<string>")
    row = (F.coalesce("__before", F.lit(0)) + F.col("at") - F.col("__first")).cast("bigint")
    rows = found.join(counts, ["file", "block"]).select(shard.alias("shard"), row.alias("shard_row"), entry.alias("e"))
    field = lambda k: F.get("e", F.lit(k)).try_cast("bigint")
    return rows.select("shard", "shard_row", (F.col("shard") * shard_rows + F.col("shard_row")).alias("global_row"), field(0).alias("listing_id"), field(1).alias("image_id"), F.expr("slice(e, 4, greatest(size(e) - 3, 0))").alias("hashes"))


def read_offset_index(spark: SparkSession, path: str) -> DataFrame:
    """(tar_name, member, offset) of tar indexes.

    Files are read in splits, cut at commas; names have none. A member belongs to the object that was opened last: in
    its split, or else in the splits before. The map from members to tars says the same once more and is passed over.
    """
    string = r'"(?:[^"\\]|\\.)*"'
    name = r'"((?:[^"\\]|\\.)*)"\s*:\s*'
    # an object's begin, at most with its first member, in either map
    opens = name + rf"\{{\s*(?:{string}\s*:\s*(?:\d+|\[\s*{string}))?[\s}}]*$"
    text = lambda column: F.when(~F.contains(column, F.lit("\\")), column).otherwise(F.get_json_object(F.concat(F.lit('{"k":"'), column, F.lit('"}')), "$.k"))
    piece = F.col("piece")
    number = name + r"(\d+)[\s}]*$"
    pieces = cut_text(spark, path, ",").withColumn("piece", _whole_quotes(piece, "offset index"))
    opened = F.when(F.contains(piece, F.lit("{")), F.nullif(F.regexp_extract(piece, opens, 1), F.lit("")))
    offset = F.nullif(F.regexp_extract(piece, number, 2), F.lit("")).cast("bigint")
    marked = pieces.select("file", "block", "at", "piece", opened.alias("opened"), offset.alias("offset"))
    last = lambda column: F.last(column, ignorenulls=True)
    blocks = _before(marked.groupBy("file", "block").agg(F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("at"))).alias("__last")), "__last", last).drop("__last")
    here = last("opened").over(W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    rows = marked.withColumn("__here", here).filter("offset is not null").join(blocks, ["file", "block"])
    return rows.select(text(F.coalesce("__here", "__before")).alias("tar_name"), text(F.regexp_extract(piece, number, 1)).alias("member"), "offset").filter("tar_name <> 'reverse'")


def _named(listed: DataFrame, *more: str) -> DataFrame:
    parsed = listed.withColumn("p", parse_image_name(F.col("name")))
    return parsed.select(*more, "name", "p.listing_id", "p.image_id", "p.ext", "size", "mtime")


def read_file_inventory(spark: SparkSession, *folders: str, slices: int = 1) -> DataFrame:
    """(name, listing_id, image_id, ext, size, mtime) of all files below the folders, empty ones too; ids are NULL for other names.

    Each direct subfolder is a task, or ``slices`` tasks that share its names out; images belong into subfolders
    (``file_partition``). Contents aren't read. Spark's binary file source leaves out empty files, and download markers are empty.
    """
    return _named(inventory(spark, list(folders), slices))


def stream_file_inventory(spark: SparkSession, snapshots: str, *folders: str, slices: int = 1) -> DataFrame:
    """(change, name, listing_id, image_id, ext, size, mtime) as a stream: what differs between listings of the folders; change is added, changed or gone.

    Listings are kept below ``snapshots``, a folder of this stream alone that all tasks share. A trigger is a listing.
    """
    return _named(inventory(spark, list(folders), slices, snapshots), "change")


def read_batch_results(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, pos, listing_id, image_id, model, embedding, text) of finished batches: manifest.json, listings.json and one .npy per model."""
    batch = F.element_at(F.split(F.input_file_name(), "/"), -2)
    manifest = spark.read.text(f"{folder}/*/manifest.json", wholetext=True).select(batch.alias("batch"), F.posexplode(F.from_json("value", "array<array<bigint>>")).alias("pos", "e"))
    manifest = manifest.select("batch", "pos", F.col("e")[0].alias("listing_id"), F.col("e")[1].alias("image_id"))
    texts = spark.read.text(f"{folder}/*/listings.json", wholetext=True).select(batch.alias("batch"), F.explode(F.from_json("value", "map<string, string>")).alias("k", "text"))
    texts = texts.select("batch", F.col("k").try_cast("bigint").alias("listing_id"), "text")

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame[["path", "content"]].itertuples(index=False):
                matrix = np.load(io.BytesIO(content)).astype(np.float32)
                *_, name, file = path.split("/")
                yield pd.DataFrame({"batch": name, "model": file.removesuffix(".npy"), "pos": np.arange(len(matrix), dtype=np.int32), "embedding": list(matrix)})

    matrices = spark.read.format("binaryFile").load(f"{folder}/*/*.npy").select("path", "content").mapInPandas(load, "batch string, model string, pos int, embedding array<float>")
    return matrices.join(manifest, ["batch", "pos"]).join(texts, ["batch", "listing_id"], "left").select("batch", "pos", "listing_id", "image_id", "model", "embedding", "text")


def read_legacy_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per listing: the fields of an object entry, an error string, or a bare image id (shop NULL).

    Files are read in splits, cut at commas; a piece that begins with a number in quotes and a colon begins an entry, as
    no inner object has such keys and quotes within strings are escaped. Pieces of an entry meet by its number: entries that
    began in the splits before, and up to the piece in its own.
    """
    begins = r'^\s*\{?\s*"(\d+)"\s*:\s*'
    pieces = cut_text(spark, path, ",").withColumn("__begins", F.col("piece").rlike(begins).cast("bigint"))
    blocks = _before(pieces.groupBy("file", "block").agg(F.sum("__begins").alias("__n")), "__n", F.sum)
    blocks = blocks.withColumn("__entries", F.sum("__n").over(W.partitionBy("file"))).drop("__n")
    here = F.sum("__begins").over(W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    numbered = pieces.withColumn("__here", here).join(blocks, ["file", "block"]).withColumn("entry", F.col("__here") + F.coalesce("__before", F.lit(0))).filter("entry > 0")
    joined = numbered.groupBy("file", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))), lambda p: p["piece"]), ",").alias("text"), (F.first("__entries") == F.col("entry")).alias("last"))
    value = F.regexp_replace("text", begins, "")
    entries = joined.select(F.regexp_extract("text", begins, 1).alias("k"), F.when(F.col("last"), F.regexp_replace(value, r"\}\s*$", "")).otherwise(value).alias("v"))
    kind = F.when(F.col("v").rlike(r"^\s*\{"), "object").when(F.col("v").rlike(r"^\s*\d+\s*$"), "number").otherwise("error")
    parsed = entries.select(F.col("k").try_cast("bigint").alias("listing_id"), "v", kind.alias("kind"), F.from_json("v", LEGACY_ENTRY).alias("s"))
    image = F.when(F.col("kind") == "number", F.trim("v").try_cast("bigint")).otherwise(F.col("s.image_id"))
    error = F.get_json_object(F.concat(F.lit('{"k":'), "v", F.lit("}")), "$.k")
    return parsed.select("listing_id", F.when(F.col("kind") == "error", error).alias("error"), "s.shop_id", "s.when_made", "s.price", "s.background_removed", image.alias("image_id"), "s.hex", "s.suffix", "s.images")


def read_taxonomy_config(spark: SparkSession, path: str) -> DataFrame:
    """(taxonomy_id, name, price_breaks)."""
    config = spark.read.schema("taxonomies ARRAY<STRUCT<id: BIGINT, name: STRING, price_breaks: ARRAY<DOUBLE>>>").json(path, multiLine=True)
    return config.select(F.explode("taxonomies").alias("t")).select(F.col("t.id").alias("taxonomy_id"), "t.name", "t.price_breaks")


def write_image_index(index: DataFrame, path: str) -> None:
    """Per shard, lines ``[listing, image, row, hashes...]`` in row order; index has shard, shard_row, global_row and hashes."""
    line = F.to_json(F.concat(F.array(*(F.col(c).cast("string") for c in ("listing_id", "image_id", "global_row"))), F.col("hashes")))
    rows = index.select("shard", "shard_row", line.alias("value"))
    rows.repartition("shard").sortWithinPartitions("shard", "shard_row").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)
