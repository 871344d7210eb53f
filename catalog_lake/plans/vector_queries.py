"""Queries of texts, embeddings, shards and similarity search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog_lake.functions import columns as C
from catalog_lake.operators import merge, quality, search, vectors
from catalog_lake.plans.registry import query
from catalog_lake.session import materialise

#: Three models over the given vectors: all dimensions, the first and the second half.
PARTS = {"full": (1, 64), "head": (1, 32), "tail": (33, 32)}


def corpus(t):
    """(model, listing_id, image_id, row, shard, embedding): unit vectors of the three models."""
    rows = t.vectors.select("listing_id", "image_id", F.col("image_id").alias("row"), F.expr("image_id div 100").alias("shard"), "embedding", "label")
    each = [rows.withColumn("model", F.lit(m)).withColumn("embedding", C.normalize(F.slice("embedding", a, n))) for m, (a, n) in PARTS.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


CORPUS = "corpus as (" + " union all ".join(
    f"select '{m}' as model, listing_id, image_id, list_transform(cast(embedding as double[])[{a}:{a + n - 1}], lambda x: x / sqrt(list_inner_product(cast(embedding as double[])[{a}:{a + n - 1}], cast(embedding as double[])[{a}:{a + n - 1}]))) as e from vectors" for m, (a, n) in PARTS.items()
) + ")"
#: Queries: every vector whose id is divisible by 100, against all rows.
QUERIES = "queries as (select image_id as query_id, model, e from corpus where image_id % 100 = 0)"
RANKED = """scored as (select query_id, q.model, listing_id, image_id, list_inner_product(q.e, c.e) as score from queries q join corpus c on c.model = q.model),
    ranked as (select *, row_number() over (partition by query_id, model order by score desc, listing_id, image_id) as rank from scored)"""


def searched(t, k: int):
    c = corpus(t)
    queries = c.filter("image_id % 100 = 0").select(F.col("image_id").alias("query_id"), "model", "embedding")
    return search.top_k(queries, c, k)


@query("g1_listing_text", "select listing_id, case listing_id % 4 when 0 then title when 1 then title || '. ' || brand || ', \"' || kind || '\", [x]' when 2 then brand when 3 then title end as text from listings")
def g1(t):
    materials = F.expr("case listing_id % 4 when 0 then null when 1 then to_json(array(brand, concat('\"', kind, '\", [x]'))) when 2 then to_json(array(brand)) else if(listing_id % 8 = 3, '[1, \"x\"]', '[[\"x\"]]') end")
    return t.listings.select("listing_id", C.listing_text(F.expr("if(listing_id % 4 = 2, '', title)"), materials).alias("text"))


@query("g2_normalize", "select image_id, round(list_inner_product(cast(embedding as double[])[1:32], cast(embedding as double[])[1:32]), 6) as before, cast(1.0 as double) as after from vectors")
def g2(t):
    unit = C.normalize(F.slice("embedding", 1, 32))
    return t.vectors.select("image_id", F.round(C.squared_norm(F.slice("embedding", 1, 32)), 6).alias("before"), F.round(C.squared_norm(unit), 6).alias("after"))


def letters():
    """A deterministic encoder for tests and queries: counts of letters."""

    def encode(inputs: list) -> list:
        return [None if x is None else np.bincount(np.frombuffer(x if isinstance(x, bytes) else x.encode(), dtype=np.uint8) % 16, minlength=16) + 0.5 for x in inputs]

    return encode


#: The letters encoder in SQL: shares of the bytes' low halves, which are each second digit of the text in hex.
LETTERS = """halves as (select *, regexp_replace(hex(encode(text)), '.(.)', '\\1', 'g') as h from texts),
    counted as (select *, list_transform(range(16), lambda d: length(h) - length(replace(h, substr('0123456789ABCDEF', cast(d + 1 as int), 1), '')) + 0.5) as c from halves),
    encoded as (select *, list_transform(c, lambda x: cast(x as double) / sqrt(list_sum(list_transform(c, lambda y: cast(y as double) * cast(y as double))))) as e from counted)"""
PARTS_OF = "round(e[1], 2) as first, round(list_sum(e), 2) as total"


def parts_of(embedded):
    return F.round(embedded[0].cast("double"), 2).alias("first"), F.round(F.aggregate(embedded, F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total")


@query("g3_embed", f"with texts as (select doc_id, coalesce(text, '') as text, text is not null as decoded from documents), {LETTERS} select doc_id as listing_id, cast(1 as bigint) as image_id, 'letters' as model, cast(16 as int) as dim, {PARTS_OF}, decoded from encoded")
def g3(t):
    images = t.documents.select(F.col("doc_id").alias("listing_id"), F.lit(1).cast("bigint").alias("image_id"), F.encode("text", "UTF-8").alias("content"))
    return vectors.embed(images, letters, "letters", 16).select("listing_id", "image_id", "model", F.size("embedding").alias("dim"), *parts_of(F.col("embedding")), "decoded")


@query("g4_embed_text", f"with texts as (select o.listing_id, o.image_id, coalesce(l.title, '') as text from line_order o left join listings l on l.listing_id = o.listing_id where o.ord = 1), {LETTERS} select listing_id, image_id, cast(16 as int) as dim, {PARTS_OF}, true as decoded from encoded")
def g4(t):
    texts = t.listings.select("listing_id", F.col("title").alias("text"))
    index = t.line_order.filter("ord = 1").select("listing_id", "image_id")
    return vectors.embed_text(index, texts, letters, "letters", 16).select("listing_id", "image_id", F.size("embedding").alias("dim"), *parts_of(F.col("embedding")), "decoded")


def hashed(vectors: str, keys: str) -> str:
    """SQL for hashes of a table's vectors e: the bits of each 32-bit float by arithmetic (sign, exponent, fraction), their bytes from the last, MD5."""
    return f"""x as (select {keys}, unnest(e) as v, unnest(range(1, len(e) + 1)) as i from {vectors}), magnitude as (select *, abs(cast(v as double)) as d from x), rough as (select *, case when d > 0 then floor(log2(d)) end as e0 from magnitude),
    exponent as (select *, e0 + case when d >= pow(2, e0 + 1) then 1 when d < pow(2, e0) then -1 else 0 end as e1 from rough),
    bits as (select *, case when v < 0 then 2147483648 else 0 end + case when d = 0 then 0 when e1 < -126 then cast(d * pow(2, 149) as bigint) else cast(e1 + 127 as bigint) * 8388608 + cast((d / pow(2, e1) - 1) * 8388608 as bigint) end as b from exponent),
    digits as (select *, printf('%08x', b) as h from bits), hashes as (select {keys}, substr(md5(unhex(string_agg(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2), '' order by i))), 1, 12) as hash from digits group by {keys})"""


@query("g5_vector_hash", f"with given as (select image_id, embedding as e from vectors), {hashed('given', 'image_id')} select image_id, hash from hashes")
def g5(t):
    return t.vectors.select("image_id", vectors.vector_hash("embedding").alias("hash"))


@query("g6_validate_batch", "with n as (select count(*) as expected, count(*) filter (where image_id % 9 > 0) as n9 from vectors) select 'full' as model, expected, expected as \"rows\", cast(64 as int) as least_dim, cast(64 as int) as most_dim, 'valid' as outcome from n union all select 'head', expected, expected, 32, 32, 'wrong_dim' from n union all select 'tail', expected, n9, 32, 32, 'wrong_count' from n union all select 'other', expected, 0, null, null, 'missing' from n")
def g6(t):
    spec = t._spark.createDataFrame([("full", 64, True), ("head", 64, True), ("tail", 32, True), ("other", 8, True)], "model string, dim int, required boolean")
    return vectors.validate_batch(t.vectors, corpus(t).filter("model <> 'tail' or image_id % 9 > 0"), spec)


@query("g7_incomplete_embeddings", "select listing_id, image_id, case when image_id % 3 = 0 and image_id % 5 = 0 then 'head,tail' when image_id % 3 = 0 then 'head' else 'tail' end as missing from vectors where image_id % 3 = 0 or image_id % 5 = 0")
def g7(t):
    some = corpus(t).filter("not (model = 'head' and image_id % 3 = 0) and not (model = 'tail' and image_id % 5 = 0)")
    return vectors.incomplete_embeddings(t.vectors, some, list(PARTS)).withColumn("missing", F.array_join("missing", ","))


@query("g8_dedup_new", "select listing_id, image_id, label from vectors where image_id % 4 > 0")
def g8(t):
    return vectors.dedup_new(t.vectors.select("listing_id", "image_id", "label"), t.vectors.filter("image_id % 4 = 0"))


@query(
    "g9_append_to_shards",
    """with n as (select listing_id, image_id, row_number() over (order by listing_id, image_id) - 1 as k from line_order where ord = 1 and listing_id % 5 = 1), s as (select count(*) as n from image_index),
    e as (select listing_id, image_id, global_row from image_index union all select listing_id, image_id, k + s.n from n, s), c as (select count(*) as total from e)
    select e.*, global_row DIV 1000 as shard, global_row % 1000 as shard_row, (global_row DIV 1000 + 1) * 1000 <= total as final from e, c""",
)
def g9(t):
    return vectors.append_to_shards(t.image_index, t.line_order.filter("ord = 1 and listing_id % 5 = 1").select("listing_id", "image_id"), ["listing_id", "image_id"], 1000)


@query("g10_shard_summary", 'select shard, count(*) as "rows", count(*) >= 1000 as final, shard = max(shard) over () as active from shard_index group by shard')
def g10(t):
    return vectors.shard_summary(t.shard_index, 1000)


@query(
    "g11_check_shards",
    """with v as (select image_id DIV 100 as shard, count(*) as n, count(*) filter (where image_id % 50 > 0) as head from vectors where image_id DIV 100 <> 2 group by 1), i as (select image_id DIV 100 as shard, count(*) as n from vectors where image_id DIV 100 % 3 > 0 or image_id % 7 > 0 group by 1)
    select coalesce(i.shard, v.shard) as shard, coalesce(i.n, 0) as indexed, case when v.shard = 1 then head else v.n end as least, v.n as most,
    case when v.shard is null then 'no vectors' when v.shard = 1 then 'different counts' when v.n <> coalesce(i.n, 0) then 'count mismatch' else 'consistent' end as outcome from v full join i on i.shard = v.shard""",
)
def g11(t):
    index = t.vectors.filter("image_id div 100 % 3 > 0 or image_id % 7 > 0").select(F.expr("image_id div 100").alias("shard"))
    return vectors.check_shards(index, corpus(t).filter("shard <> 2 and not (model = 'head' and shard = 1 and image_id % 50 = 0)"))


@query("g12_embedded_pairs", "select listing_id, image_id from shard_index where shard = (select max(shard) from shard_index)")
def g12(t):
    return vectors.embedded_pairs(t.shard_index)


@query("g13_verify_hashes", f"""with {CORPUS}, given as (select model, listing_id, image_id, cast(e as float[]) as e from corpus where image_id % 10 = 0), {hashed('given', 'model, listing_id, image_id')} select listing_id, image_id, model, hash as found, '000000000000' as stored from hashes where hash <> '000000000000'""")
def g13(t):
    c = corpus(t).select("model", "listing_id", "image_id", F.col("embedding").cast("array<float>").alias("embedding"))
    stored = c.select("model", "listing_id", "image_id", F.when(F.col("image_id") % 10 == 0, "000000000000").otherwise(vectors.vector_hash("embedding")).alias("hash"))
    return vectors.verify_hashes(stored, c)


@query("h1_top_k", f"with {CORPUS}, {QUERIES}, {RANKED} select query_id, model, rank, listing_id, image_id, round(score, 6) as score from ranked where rank <= 10")
def h1(t):
    return searched(t, 10).withColumn("score", F.round("score", 6))


@query("h2_top_k_sharded", f"with {CORPUS}, {QUERIES}, {RANKED} select query_id, model, rank, listing_id, image_id, round(score, 6) as score from ranked where rank <= 10")
def h2(t):
    c = corpus(t)
    return search.top_k_sharded(c.filter("image_id % 100 = 0").select(F.col("image_id").alias("query_id"), "model", "embedding"), c, 10).withColumn("score", F.round("score", 6))


def pruned(t):
    """Shards are labels here: each holds the vectors of one."""
    rows = t.vectors.select("listing_id", "image_id", F.col("label").cast("bigint").alias("shard"), "embedding")
    each = [rows.withColumn("model", F.lit(m)).withColumn("embedding", C.normalize(F.slice("embedding", a, n))) for m, (a, n) in PARTS.items()]
    c = materialise(each[0].unionByName(each[1]).unionByName(each[2]), "corpus")
    queries = c.filter("image_id % 100 = 0").select(F.col("image_id").alias("query_id"), "model", "embedding")
    return search.top_k_pruned(queries, c, search.shard_bounds(c), 10)


@query("h2_top_k_pruned", f"with {CORPUS}, {QUERIES}, {RANKED} select query_id, model, rank, listing_id, image_id, round(score, 6) as score from ranked where rank <= 10")
def h2_pruned(t):
    return pruned(t)[0].withColumn("score", F.round("score", 6))


@query("h3_query_by_listing", f"with {CORPUS} select listing_id as query_id, model, round(list_sum(arg_min(e, image_id)), 6) as total from corpus where listing_id % 50 = 7 group by 1, 2")
def h3(t):
    c = corpus(t)
    found = search.query_by_listing(c, c.filter("listing_id % 50 = 7").select("listing_id"))
    return found.select("query_id", "model", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("h3_unknown_listings", "select listing_id from listings where listing_id not in (select listing_id from vectors)")
def h3_unknown(t):
    return search.unknown_listings(t.vectors, t.listings)


@query(
    "h4_fuse",
    f"""with {CORPUS}, cells as (select listing_id, model, generate_subscripts(e, 1) as pos, unnest(e) as x from corpus), m as (select listing_id, model, pos, avg(x) as x from cells group by 1, 2, 3)
    select listing_id as query_id, model, round(sum(x) / sqrt(sum(x * x)), 5) as total, cast(count(*) as bigint) as dim from m group by 1, 2""",
)
def h4(t):
    fused = search.fuse(corpus(t).select(F.col("listing_id").alias("query_id"), "model", "embedding"))
    return fused.select("query_id", "model", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("embedding").cast("bigint").alias("dim"))


CONSENSUS = """agreed as (select query_id, listing_id, count(*) as appearances, avg(score) as mean_score from ranked where rank <= 20 group by 1, 2 having count(*) >= 2),
    placed as (select *, row_number() over (partition by query_id order by appearances desc, round(mean_score, 6) desc, listing_id) as place from agreed)"""


@query("h5_consensus", f"with {CORPUS}, {QUERIES}, {RANKED}, {CONSENSUS} select query_id, listing_id, appearances, round(mean_score, 6) as mean_score, place from placed")
def h5(t):
    return search.consensus(searched(t, 40), 2, 20).withColumn("mean_score", F.round("mean_score", 6))


@query("h6_locate", f"with {CORPUS}, {QUERIES}, {RANKED} select query_id, model, rank, listing_id, image_id, case when image_id % 2 = 0 then concat('t', cast(image_id DIV 50 as string)) end as tar, case when image_id % 2 = 0 then image_id * 512 end as tar_offset, case when listing_id % 3 = 0 then 'p0' end as primary_tar, case when listing_id % 3 = 0 then listing_id * 512 end as primary_offset from ranked where rank <= 5")
def h6(t):
    index = t.vectors.filter("image_id % 2 = 0").select("listing_id", "image_id", F.expr("concat('t', image_id div 50)").alias("tar_name"), (F.col("image_id") * 512).alias("offset"))
    primary = t.vectors.filter("listing_id % 3 = 0").select("listing_id").distinct().select("listing_id", F.lit("p0").alias("tar_name"), (F.col("listing_id") * 512).alias("offset"))
    return search.locate(searched(t, 5), index, primary).drop("score")


ENRICHED = f"""with {CORPUS}, {QUERIES}, {RANKED}, {CONSENSUS}, latest as (select listing_id, state, views, row_number() over (partition by listing_id order by snapshot_timestamp desc, id desc) as k from listing_snapshots)
    select query_id, p.listing_id, appearances, place, l.title, l.price, l.tags, l.materials, l.shop_id, v.state, v.views, s.name from placed p left join listings l on l.listing_id = p.listing_id
    left join latest v on v.listing_id = p.listing_id and v.k = 1 left join shops s on s.shop_id = l.shop_id"""


@query("h7_search", ENRICHED)
def h7(t):
    agreed = search.consensus(searched(t, 40), 2, 20).drop("mean_score")
    latest = merge.latest_snapshot(t.listing_snapshots, "listing_id").select("listing_id", "state", "views")
    return search.enrich(agreed, t.listings, latest, t.shops.select("shop_id", "name"))


@query("h8_oversample", f"with {CORPUS}, {QUERIES}, {RANKED} select query_id, model, rank, listing_id, image_id, rank <= 8 as shown from ranked where rank <= 16")
def h8(t):
    c = corpus(t)
    return search.oversampled(c.filter("image_id % 100 = 0").select(F.col("image_id").alias("query_id"), "model", "embedding"), c, 8).drop("score")


@query("j6_embedding_progress", "with r as (select count(*) as ready from image_status where download_done = 2), n as (select count(*) as n, count(*) filter (where image_id % 7 > 0) as m from vectors) select 'full' as model, n as vectors, ready from n, r union all select 'head', m, ready from n, r union all select 'tail', n, ready from n, r")
def j6(t):
    return quality.embedding_progress(t.image_status, corpus(t).filter("model <> 'head' or image_id % 7 > 0"))


@query("j7_index_consistency", "select count(*) as indexed, count(*) filter (where image_id % 7 > 0) as image_least, count(*) as image_most, count(*) as text_least, count(*) as text_most, false as images_agree, true as texts_agree, false as index_agrees from vectors")
def j7(t):
    return quality.index_consistency(t.vectors, corpus(t).filter("model <> 'head' or image_id % 7 > 0"), ["full", "head"], ["tail"])
