"""Exact similarity search over several models, and the consensus of their rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from catalog_lake.session import materialise

#: Bytes of query vectors that each task may hold; above it queries are searched in parts.
QUERY_BYTES = 64 << 20
RESULT = "query_id bigint, model string, listing_id bigint, image_id bigint, score double"
RESULT_COLUMNS = ("query_id", "model", "listing_id", "image_id", "score")


def _query_parts(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts of at most about QUERY_BYTES, by hash of their ids."""
    size = queries.agg(F.sum(F.size("embedding") * 8)).first()[0] or 0
    parts = max(1, -(-size // QUERY_BYTES))
    return [queries] if parts == 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k) for k in range(parts)]


def _held(queries: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the queries of each model; QUERY_BYTES at most."""
    rows = queries.select("query_id", "model", "embedding").collect()
    own = {model: [r for r in rows if r["model"] == model] for model in {r["model"] for r in rows}}
    return {model: (np.array([r["query_id"] for r in found], dtype=np.int64), np.array([r["embedding"] for r in found], dtype=np.float64)) for model, found in own.items()}


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what can still be among the k best of each column, ties at the edge included."""
    return np.nonzero(scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]) if len(scores) > k else tuple(x.ravel() for x in np.indices(scores.shape))


def local_top_k(queries: DataFrame, corpus: DataFrame, k: int, chosen: dict[tuple[str, int], np.ndarray] | None = None) -> DataFrame:
    """Per task and model the k best rows of each query: block products of the corpus with the queries, which every task holds.

    ``chosen`` has the queries, by place, that search a (model, shard); others don't. Without it all search all.
    """
    shared = queries.sparkSession.sparkContext.broadcast((_held(queries), chosen))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, wanted = shared.value
        best: dict[str, pd.DataFrame] = {}
        for frame in frames:
            for key, part in frame.groupby("model" if wanted is None else ["model", "shard"]):
                model = key if wanted is None else key[0]
                if model not in held or wanted is not None and key not in wanted:
                    continue
                ids, matrix = held[model]
                if wanted is not None:
                    ids, matrix = ids[wanted[key]], matrix[wanted[key]]
                scores = np.stack(part["embedding"].to_numpy()).astype(np.float64) @ matrix.T
                at, q = _best(scores, k)
                new = pd.DataFrame({"query_id": ids[q], "listing_id": part["listing_id"].to_numpy()[at], "image_id": part["image_id"].to_numpy()[at], "score": scores[at, q]})
                merged = pd.concat([best[model], new] if model in best else [new], ignore_index=True)
                merged = merged.sort_values(["query_id", "score", "listing_id", "image_id"], ascending=[True, False, True, True], kind="stable")
                best[model] = merged.groupby("query_id", sort=False).head(k)
        for model, frame in best.items():
            yield frame.assign(model=model)[["query_id", "model", "listing_id", "image_id", "score"]]

    columns = ["model", "listing_id", "image_id", "embedding", *(["shard"] if chosen is not None else [])]
    return corpus.select(*columns).mapInPandas(run, RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id", "model").orderBy(F.desc("score"), "listing_id", "image_id"))
    return found.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("query_id", "model", "rank", "listing_id", "image_id", "score")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, model, rank, listing_id, image_id, score): the k rows of highest inner product per query and model.

    The corpus isn't shuffled; each task returns k rows a query at most. Ties are ranked by ids. Models
    without corpus give nothing; a small corpus gives all its rows.
    """
    found = None
    for part in _query_parts(queries):
        local = local_top_k(part, corpus, k)
        found = local if found is None else found.unionByName(local)
    return _ranked(found, k)


def top_k_sharded(queries: DataFrame, corpus: DataFrame, k: int = 100) -> DataFrame:
    """As ``top_k`` with the corpus dealt by shard, so that a task's rows are of one shard."""
    return top_k(queries, corpus.repartition("shard"), k)


# ---- exact search of few shards


def shard_bounds(corpus: DataFrame) -> DataFrame:
    """(model, shard, rows, centre, radius): the mean vector of each shard, and how far its farthest vector is from that. Two aggregates over the corpus."""
    cells = corpus.select("model", "shard", F.posexplode("embedding").alias("pos", "x")).groupBy("model", "shard", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    centres = cells.groupBy("model", "shard").agg(F.max("n").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("centre"))
    centres = materialise(centres, "centres")  # a row for each model and shard
    gap = F.aggregate(F.zip_with("embedding", "centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    radii = corpus.select("model", "shard", "embedding").join(centres, ["model", "shard"]).groupBy("model", "shard").agg(F.sqrt(F.max(gap)).alias("radius"))
    return materialise(centres.join(radii, ["model", "shard"]), "bounds")


def query_bounds(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """(query_id, place, model, shard, rows, most): no row of the shard has a higher inner product with the query than ``most``; place is the query's in ``_held``."""
    shared = queries.sparkSession.sparkContext.broadcast(_held(queries))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for model, part in frame.groupby("model"):
                if model in shared.value:
                    ids, matrix = shared.value[model]
                    norms = np.linalg.norm(matrix, axis=1)
                    for shard, rows, centre, radius in part[["shard", "rows", "centre", "radius"]].itertuples(index=False):
                        most = matrix @ np.asarray(centre) + norms * radius
                        yield pd.DataFrame({"query_id": ids, "place": np.arange(len(ids)), "model": model, "shard": shard, "rows": rows, "most": most + 1e-9 * (1 + np.abs(most))})

    return bounds.mapInPandas(run, "query_id bigint, place bigint, model string, shard bigint, rows bigint, most double")


def _search(queries: DataFrame, corpus: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query in the shards that pairs (place, model, shard) name, stored. Other shards aren't read where the corpus is partitioned by them."""
    chosen = {(r["model"], r["shard"]): np.array(r["places"]) for r in pairs.groupBy("model", "shard").agg(F.sort_array(F.collect_list("place")).alias("places")).collect()}  # QUERY_BYTES at most, as top_k_pruned cuts queries
    if not chosen:
        return queries.sparkSession.createDataFrame([], RESULT)
    shards = sorted({shard for _, shard in chosen})
    return materialise(_ranked(local_top_k(queries, corpus.filter(F.col("shard").isin(shards)), k, chosen), k).select(*RESULT_COLUMNS), "found")


def top_k_pruned(queries: DataFrame, corpus: DataFrame, bounds: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """The rows of ``top_k`` from as few shards as the bounds allow, and (query_id, model, shards, visited).

    bounds are ``shard_bounds`` of this corpus. First each query searches the shards of the highest bounds that hold k rows
    between them. Its k-th score there can only rise, so that shards whose bound is below it hold none of its k best; the
    others are searched next. Shards of similar vectors have small radii and are passed over, mixed ones aren't.
    """
    size = queries.agg(F.sum(F.size("embedding") * 8).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    shards = bounds.select("shard").distinct().count()
    parts = max(1, -(-(size["bytes"] or 0) // QUERY_BYTES), -(-size["n"] * shards * 8 // QUERY_BYTES))
    results, visits = None, None
    for part in range(parts):
        own = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        limits = materialise(query_bounds(own, bounds), "query-bounds")
        by_query = W.partitionBy("query_id", "model")
        order = by_query.orderBy(F.desc("most"), "shard").rowsBetween(W.unboundedPreceding, -1)
        marked = materialise(limits.withColumn("first", F.coalesce(F.sum("rows").over(order), F.lit(0)) < k), "query-bounds")
        found = _search(own, corpus, marked.filter("first"), k)
        worst = found.groupBy("query_id", "model").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        rest = marked.filter("not first").join(worst, ["query_id", "model"]).filter((F.col("n") < k) | (F.col("most") >= F.col("worst")))
        rest = materialise(rest.select("query_id", "place", "model", "shard"), "rest")
        merged = found.unionByName(_search(own, corpus, rest, k))
        seen = marked.filter("first").select("query_id", "model", "shard").unionByName(rest.select("query_id", "model", "shard")).groupBy("query_id", "model").agg(F.count(F.lit(1)).alias("visited"))
        counts = limits.groupBy("query_id", "model").agg(F.count(F.lit(1)).alias("shards")).join(seen, ["query_id", "model"])
        results, visits = (merged, counts) if results is None else (results.unionByName(merged), visits.unionByName(counts))
    return _ranked(results, k), visits


def query_by_listing(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, model, embedding): the vector of each listing's first row in each model; query_id is the listing."""
    wanted = corpus.join(ids.select("listing_id").distinct(), "listing_id", "left_semi")
    return wanted.groupBy("listing_id", "model").agg(F.min_by("embedding", "row").alias("embedding")).select(F.col("listing_id").alias("query_id"), "model", "embedding")


def unknown_listings(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("listing_id").distinct().join(corpus.select("listing_id"), "listing_id", "left_anti")


def fuse(query_images: DataFrame, how: str = "mean") -> DataFrame:
    """One unit vector per query and model from those of several images: element-wise mean or max, then normalised."""
    if how not in ("mean", "max"):
        raise ValueError(f"how must be mean or max, not {how!r}")
    combine = F.avg if how == "mean" else F.max
    cells = query_images.select("query_id", "model", F.posexplode("embedding").alias("pos", "x")).groupBy("query_id", "model", "pos").agg(combine(F.col("x").cast("double")).alias("x"))
    vectors = cells.groupBy("query_id", "model").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    return vectors.select("query_id", "model", F.transform("cells", lambda c: F.when(F.col("norm") > 0, c["x"] / F.col("norm")).otherwise(c["x"])).alias("embedding"))


def consensus(results: DataFrame, min_models: int = 2, top_n: int = 50) -> DataFrame:
    """(query_id, listing_id, appearances, mean_score, place): listings by how often they are among the first top_n of a model."""
    grouped = results.filter(F.col("rank") <= top_n).groupBy("query_id", "listing_id").agg(F.count(F.lit(1)).alias("appearances"), F.avg("score").alias("mean_score"))
    order = W.partitionBy("query_id").orderBy(F.desc("appearances"), F.desc(F.round("mean_score", 6)), "listing_id")
    return grouped.filter(F.col("appearances") >= min_models).withColumn("place", F.row_number().over(order).cast("bigint"))


def oversampled(queries: DataFrame, corpus: DataFrame, k: int, factor: int = 2) -> DataFrame:
    """What an interactive search fetches: factor * k rows per model, of which ``shown`` are the first k."""
    return top_k(queries, corpus, factor * k).withColumn("shown", F.col("rank") <= k)


def locate(results: DataFrame, tar_index: DataFrame, primary_index: DataFrame) -> DataFrame:
    """Archive and offset of each result in the full archive and in that of primary images."""
    full = tar_index.select("listing_id", "image_id", F.col("tar_name").alias("tar"), F.col("offset").alias("tar_offset"))
    primary = primary_index.select("listing_id", F.col("tar_name").alias("primary_tar"), F.col("offset").alias("primary_offset"))
    return results.join(full, ["listing_id", "image_id"], "left").join(primary, "listing_id", "left")


def enrich(results: DataFrame, listings: DataFrame, latest: DataFrame, shops: DataFrame) -> DataFrame:
    """Results with title, price, tags and materials of the listing, its latest metrics, and its shop."""
    return results.join(listings.select("listing_id", "title", "price", "tags", "materials", "shop_id"), "listing_id", "left").join(latest, "listing_id", "left").join(shops, "shop_id", "left")
