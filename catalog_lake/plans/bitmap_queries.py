"""Queries of indexes and models compared by bitmaps of rows; a vector's image_id is its row."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_lake.operators import bitmaps
from catalog_lake.plans.registry import query
from catalog_lake.plans.vector_queries import PARTS

HEAD, TAIL = "image_id % 3 > 0", "image_id % 5 > 0"


def index_rows(t):
    return t.vectors.select("listing_id", "image_id", F.col("image_id").alias("global_row"), F.expr("image_id div 100").alias("shard"))


def model_rows(t, **kept: str):
    """(model, global_row, shard) of the three models, each with the rows that its condition keeps."""
    rows = t.vectors.select("image_id", F.col("image_id").alias("global_row"), F.expr("image_id div 100").alias("shard"))
    each = [rows.filter(kept.get(m, "true")).withColumn("model", F.lit(m)) for m in PARTS]
    return each[0].unionByName(each[1]).unionByName(each[2]).drop("image_id")


@query("g7_incomplete_rows", "select listing_id, image_id, case when image_id % 3 = 0 and image_id % 5 = 0 then 'head,tail' when image_id % 3 = 0 then 'head' else 'tail' end as missing from vectors where image_id % 3 = 0 or image_id % 5 = 0")
def g7(t):
    return bitmaps.incomplete_rows(index_rows(t), model_rows(t, head=HEAD, tail=TAIL), list(PARTS)).withColumn("missing", F.array_join("missing", ","))


@query(
    "g11_check_shard_rows",
    """with v as (select image_id DIV 50 as shard, count(*) as n, count(*) filter (where image_id % 3 > 0) as thirds, count(*) filter (where image_id % 10 > 0) as tenths, count(*) filter (where image_id % 10 <> 1) as others from vectors group by 1),
    m as (select *, case shard % 5 when 0 then thirds when 3 then tenths else n end as x, case when shard % 5 = 3 then others when shard % 5 <> 2 then n end as rest, case shard % 5 when 1 then tenths when 2 then null when 3 then others else n end as h from v)
    select shard, x as indexed, least(h, rest) as least, greatest(h, rest) as most,
    case when h is null then 'no vectors' when h <> rest then 'different counts' when h <> x then 'count mismatch' when shard % 5 = 3 then 'different rows' else 'consistent' end as outcome from m""",
)
def g11(t):
    """Of each five shards one has an index of two thirds, one a model with gaps, one no vectors, one an index that leaves out other rows than the models do."""
    shard = F.expr("global_row div 50")
    index = index_rows(t).withColumn("shard", shard).filter("case shard % 5 when 0 then global_row % 3 > 0 when 3 then global_row % 10 > 0 else true end")
    models = model_rows(t).withColumn("shard", shard).filter("case shard % 5 when 1 then model <> 'head' or global_row % 10 > 0 when 2 then false when 3 then global_row % 10 <> 1 else true end")
    return bitmaps.check_shard_rows(index, models, list(PARTS))


@query("g12_embedded_rows", "select listing_id, image_id from vectors where image_id DIV 100 = (select max(image_id DIV 100) from vectors) and image_id % 3 > 0 and image_id % 5 > 0")
def g12(t):
    return bitmaps.embedded_rows(index_rows(t), model_rows(t, head=HEAD, tail=TAIL), list(PARTS))


@query("j7_row_consistency", "select count(*) as indexed, count(*) filter (where image_id % 3 = 0) as images_apart, cast(0 as bigint) as texts_apart, count(*) filter (where image_id % 3 = 0) as index_apart, false as consistent from vectors")
def j7(t):
    return bitmaps.row_consistency(index_rows(t), model_rows(t, head=HEAD, tail=TAIL), ["full", "head"], ["tail"])
