"""Embeddings: pluggable encoders, validation, shards of fixed size, consistency checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from catalog_lake.numbering import number_rows

SHARD_ROWS = 500_000
KEYS = ["listing_id", "image_id"]
#: An encoder gets a list of inputs (image bytes or texts) and returns one float row of ``dim`` for each; None marks an input it can't decode.
Encoder = Callable[[list], "list[np.ndarray | None]"]


def embed(df: DataFrame, encoder: Callable[[], Encoder], model: str, dim: int, column: str = "content", batch: int = 32, placeholder: object = b"") -> DataFrame:
    """KEYS, model, embedding (unit length), decoded: a map over Arrow batches.

    ``encoder`` is called once per Python worker to load the model. An input that can't be decoded is
    encoded as the placeholder, kept, and flagged.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        blank = None
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                rows = encode(part[column].tolist())
                if any(r is None for r in rows) and blank is None:
                    blank = encode([placeholder])[0]
                fixed = np.stack([np.asarray(blank if r is None else r, dtype=np.float64).reshape(dim) for r in rows])
                length = np.linalg.norm(fixed, axis=1, keepdims=True)
                unit = np.divide(fixed, length, out=np.zeros_like(fixed), where=length > 0).astype(np.float32)
                yield pd.DataFrame({"listing_id": part["listing_id"].to_numpy(), "image_id": part["image_id"].to_numpy(), "model": model, "embedding": list(unit), "decoded": [r is not None for r in rows]})

    return df.select(*KEYS, column).mapInPandas(run, "listing_id bigint, image_id bigint, model string, embedding array<float>, decoded boolean")


def embed_text(df: DataFrame, texts: DataFrame, encoder: Callable[[], Encoder], model: str, dim: int, batch: int = 32) -> DataFrame:
    """As ``embed``, over each image's listing text; a missing text is empty."""
    joined = df.select(*KEYS).join(texts.select("listing_id", "text"), "listing_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return embed(joined, encoder, model, dim, "text", batch, "")


@F.pandas_udf(T.StringType())
def vector_hash(vectors: pd.Series) -> pd.Series:
    """First 12 hex digits of the MD5 of the vector as little-endian 32-bit floats."""
    return vectors.map(lambda v: hashlib.md5(np.asarray(v, dtype="<f4").tobytes()).hexdigest()[:12], na_action="ignore")


def validate_batch(manifest: DataFrame, vectors: DataFrame, spec: DataFrame) -> DataFrame:
    """(model, expected, rows, least_dim, most_dim, outcome) for each model of spec (model, dim, required)."""
    found = vectors.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"))
    expected = manifest.agg(F.count(F.lit(1)).alias("expected"))
    joined = spec.join(found, "model", "left").crossJoin(expected)  # one row on the right
    outcome = (
        F.when(F.col("rows").isNull() & F.col("required"), "missing").when(F.col("rows").isNull(), "absent").when(F.col("rows") != F.col("expected"), "wrong_count")
        .when((F.col("least_dim") != F.col("dim")) | (F.col("most_dim") != F.col("dim")), "wrong_dim").otherwise("valid")
    )
    return joined.select("model", "expected", F.coalesce("rows", F.lit(0)).alias("rows"), "least_dim", "most_dim", outcome.alias("outcome"))


def incomplete_embeddings(index: DataFrame, vectors: DataFrame, models: Sequence[str]) -> DataFrame:
    """Indexed images that lack a model, with the sorted list of those they lack."""
    has = vectors.filter(F.col("model").isin(*models)).groupBy(*KEYS).agg(F.collect_set("model").alias("__has"))
    wanted = F.array(*(F.lit(m) for m in sorted(models)))
    joined = index.select(*KEYS).join(has, KEYS, "left")
    return joined.select(*KEYS, F.array_except(wanted, F.coalesce("__has", F.array().cast("array<string>"))).alias("missing")).filter(F.size("missing") > 0)


def dedup_new(manifest: DataFrame, embedded: DataFrame) -> DataFrame:
    return manifest.join(embedded.select(*KEYS).distinct(), KEYS, "left_anti").select(*manifest.columns)


def append_to_shards(index: DataFrame, new: DataFrame, order: Sequence[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """index (KEYS, global_row) and the new rows behind it, in order, without gaps; with shard, shard_row and final."""
    start = index.agg(F.coalesce(F.max("global_row") + 1, F.lit(0))).first()[0]
    numbered = number_rows(new, [F.col(c) for c in order], "global_row", start)
    every = index.select(*KEYS, "global_row").unionByName(numbered.select(*KEYS, "global_row"))
    total = index.count() + new.count()
    return every.withColumns({"shard": F.expr(f"global_row div {shard_rows}"), "shard_row": F.expr(f"global_row % {shard_rows}"), "final": F.expr(f"(global_row div {shard_rows} + 1) * {shard_rows} <= {total}")})


def shard_summary(index: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, rows, final, active): the last shard is active; a full one is final."""
    counts = index.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    last = counts.agg(F.max("shard").alias("__last"))
    return counts.crossJoin(last).select("shard", "rows", (F.col("rows") >= shard_rows).alias("final"), (F.col("shard") == F.col("__last")).alias("active"))


def check_shards(index: DataFrame, vectors: DataFrame, exclude: Sequence[str] = (), active_only: bool = False) -> DataFrame:
    """(shard, indexed, least, most, outcome): whether all models have as many rows as the index."""
    by_model = vectors.filter(~F.col("model").isin(*exclude)) if exclude else vectors
    counts = by_model.groupBy("shard", "model").agg(F.count(F.lit(1)).alias("n")).groupBy("shard").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    joined = index.groupBy("shard").agg(F.count(F.lit(1)).alias("indexed")).join(counts, "shard", "full_outer").withColumn("indexed", F.coalesce("indexed", F.lit(0)))
    if active_only:
        joined = joined.join(joined.agg(F.max("shard").alias("shard")), "shard", "left_semi")
    outcome = (
        F.when(F.col("least").isNull() & (F.col("indexed") == 0), "empty").when(F.col("least").isNull(), "no vectors").when(F.col("least") != F.col("most"), "different counts")
        .when(F.col("least") != F.col("indexed"), "count mismatch").otherwise("consistent")
    )
    return joined.select("shard", "indexed", "least", "most", outcome.alias("outcome"))


def embedded_pairs(index: DataFrame, active_only: bool = True) -> DataFrame:
    rows = index.join(index.agg(F.max("shard").alias("shard")), "shard", "left_semi") if active_only else index
    return rows.select(*KEYS).distinct()


def verify_hashes(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors whose hash differs from the stored one: (KEYS, model, stored, found)."""
    stored = index.select(*KEYS, "model", F.col("hash").alias("stored"))
    return vectors.select(*KEYS, "model", vector_hash("embedding").alias("found")).join(stored, [*KEYS, "model"]).filter("found <> stored")
