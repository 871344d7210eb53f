"""The catalogue's logical tables as projections of the given tables, in SQL that Spark and DuckDB both run.

``TS(x)`` stands for seconds since 1970 of a timestamp, ``DIV`` for integer division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog_lake.numbering import number_rows

#: 2001-11-05 00:00 UTC, just after the newest ship date, and 2024-01-31 after the newest event.
NOW, EVENTS_NOW = 1_004_918_400, 1_706_659_200
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES: dict[str, str] = {
    "part_last": "select l_partkey, max(TS(l_shipdate)) as last_ts from lineitem group by l_partkey",
    "listings": """select p_partkey as listing_id, p_partkey % 97 as shop_id, p_name as title, p_brand as brand, p_type as kind, cast(p_size as bigint) as taxonomy_id,
        p_retailprice as price, last_ts as last_dynamic_ts, p_type as tags, p_brand as materials from part left join part_last on l_partkey = p_partkey""",
    "listing_snapshots": "select event_id as id, user_id as listing_id, TS(ts) as snapshot_timestamp, event_type as state, cast(round(value * 100) as bigint) as views from events",
    "line_snapshots": """select row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as id,
        l_partkey as listing_id, TS(l_shipdate) as snapshot_timestamp, cast(l_quantity as bigint) as quantity from lineitem""",
    "shop_snapshots": "select event_id as id, user_id as shop_id, TS(ts) as snapshot_timestamp, cast(floor(value) as bigint) as review_count from events",
    "shops": """select s_suppkey as shop_id, s_name as name, case when s_suppkey % 3 = 0 then 1004918400 - 86400 * (s_suppkey % 40) when s_suppkey % 3 = 1 then 1004918400 - 3600 * s_suppkey end as last_dynamic_ts,
        case when s_suppkey % 4 > 0 then cast(s_suppkey % 5 as bigint) end as prev_review_count, case when s_suppkey % 7 > 0 then cast(s_suppkey % 3 as bigint) end as curr_review_count from supplier""",
    "reviews": """select o_orderkey as ord, o_custkey % 97 as shop_id, o_custkey as listing_id, TS(o_orderdate) as create_timestamp,
        cast(substr(o_orderpriority, 1, 1) as int) as rating from orders""",
    "line_order": """select l_orderkey as listing_id, cast(l_linenumber as bigint) as image_id, l_suppkey, l_quantity, l_tax, l_discount, l_extendedprice,
        row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as ord from lineitem""",
    "image_status": """select listing_id, image_id, cast(case when image_id = 1 and l_suppkey % 9 > 0 then 1 else 0 end as int) as is_primary,
        case when l_tax < 0.02 then null when l_tax < 0.03 then '' else concat('http://i/', cast(listing_id as string), '/', cast(image_id as string)) end as url,
        cast(l_quantity as int) % 6 - 1 as download_done from line_order where ord = 1""",
    "incoming_images": """select listing_id, case when listing_id % 3 = 0 then image_id + 100 else image_id end as image_id, ord, cast(case when l_suppkey % 2 = 0 then 1 else 0 end as int) as is_primary,
        case when l_discount < 0.02 then null when l_discount < 0.03 then '' else concat('http://n/', cast(ord as string), '/', cast(l_suppkey as string)) end as url from line_order""",
    "files": """select listing_id, image_id, 'jpg' as ext, cast(floor(l_extendedprice) as bigint) % 3000 as size, concat(cast(listing_id as string), '_', cast(image_id as string), '.jpg') as name
        from line_order where ord = 1 and l_suppkey % 3 > 0
        union all select listing_id, image_id, 'dl', cast(0 as bigint), concat(cast(listing_id as string), '_', cast(image_id as string), '.dl') from line_order where ord = 1 and l_suppkey % 5 = 0""",
    "image_index": """select listing_id, image_id, row_number() over (order by listing_id, image_id) - 1 as global_row from line_order where ord = 1""",
    "shard_index": """select listing_id, image_id, global_row, global_row DIV 1000 as shard, global_row % 1000 as shard_row from image_index""",
    "legacy_meta": """select c_custkey as listing_id, case when c_custkey % 11 = 0 then 'not found' end as error, case when c_custkey % 7 > 0 then c_custkey % 97 end as shop_id,
        case c_custkey % 4 when 0 then 'made_to_order' when 1 then '2010_2019' when 2 then '1990s' end as when_made, abs(c_acctbal) / 20 as price, c_custkey % 3 = 0 as background_removed,
        case c_custkey % 5 when 0 then cast(9999999999 as bigint) when 1 then null else c_custkey * 10 end as image_id, concat('ab', cast(c_custkey as string)) as hex, c_mktsegment as suffix, c_nationkey from customer""",
    "price_breaks": """select cast(n_nationkey as bigint) + 1 as taxonomy_id, n_name as name, n_nationkey as k from nation""",
    "vectors": "select vec_id DIV 2 as listing_id, vec_id as image_id, embedding, label from embeddings",
}


def dialect(sql: str, spark: bool) -> str:
    sql = re.sub(r"TS\(([^()]*)\)", r"cast(cast(\1 as timestamp) as bigint)" if spark else r"cast(floor(epoch(\1)) as bigint)", sql)
    sql = sql.replace(" DIV ", " div " if spark else " // ")
    return sql if spark else re.sub(r"\bas string\b", "as varchar", sql)


def uses(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table, or a given one."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "image_index":  # numbered without a single-task window
        pairs = fixture(spark, sf_dir, "line_order").filter("ord = 1").select("listing_id", "image_id")
        return number_rows(pairs, [F.col("listing_id"), F.col("image_id")], "global_row")
    sql = dialect(FIXTURES[name], spark=True)
    needed = {n: fixture(spark, sf_dir, n) for n in uses(sql, [*BASE, *FIXTURES]) if n != name and re.search(rf"\b(from|join) {n}\b", sql)}
    for n in needed:
        sql = re.sub(rf"(?<=from |join ){n}\b", f"{{{n}}}", sql)
    return spark.sql(sql, **needed)


def with_fixtures(sql: str) -> str:
    """DuckDB SQL with the logical tables that it names as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in uses(text, FIXTURES):
            if n not in order and text is not FIXTURES[n]:
                need(FIXTURES[n])
                order.append(n)

    need(sql)
    body = sql.strip()
    head = ", ".join(f"{n} as ({FIXTURES[n]})" for n in order)
    if body.lower().startswith("with recursive "):
        return dialect(f"with recursive {head}{', ' if head else ''}{body[15:]}", spark=False)
    if body.lower().startswith("with "):
        return dialect(f"with {head}{', ' if head else ''}{body[5:]}", spark=False)
    return dialect((f"with {head} " if head else "") + body, spark=False)
