"""Tables bucketed by listing, so that merges and work lists find their rows together without a shuffle.

Bucketed by listing_id alone, a table serves joins on the listing and on (listing, image) alike. Spark by itself
asks for buckets of all join keys, lest few listings hold most rows; a listing has tens of images at most, so
that buckets are as even by listing as by image.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from catalog_lake.session import new_path

KEY = ("listing_id",)
SUBSET_OF_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write_bucketed(df: DataFrame, name: str, buckets: int, keys: Sequence[str] = KEY, path: str | None = None) -> DataFrame:
    """Write ``df`` as the catalogue's table ``name``, a file for each bucket, and read it.

    Rows are dealt to as many tasks as buckets first, as otherwise every task writes a file of every bucket. Tables that are
    joined need the same number of buckets: let it follow the largest one's bytes.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").mode("overwrite").option("path", path or new_path(df.sparkSession, name)).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


@contextmanager
def joined_by_bucket(spark: SparkSession):
    """Plans that are made inside may join on more keys than the tables are bucketed by, and keep small sides from being broadcast instead.

    A plan is made by its first action: run that inside.
    """
    kept = {k: spark.conf.get(k) for k in (SUBSET_OF_KEYS, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set(SUBSET_OF_KEYS, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
