"""Structured Streaming jobs: staleness gate, image upsert, review dedup, periodic reconcile."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalog_lake.operators.images import reconcile_downloads
from catalog_lake.operators.merge import DEFAULT_WATERMARK, STALE_SECONDS, append_reviews, upsert_images
from catalog_lake.sources.versions import VersionedTable


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State with an initial table needs Spark's RocksDB store; it holds state on the executors' disks, not in their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class LastSeen(StatefulProcessor):
    """One number per key, seeded from a stored table: a batch's rows of a key are passed to ``step`` in order with the last number.

    ``step`` gives the rows to emit and the new number. NULL seeds are ``unset``.
    """

    def __init__(self, column: str, order: Sequence[str], step: Callable[[pd.DataFrame, int | None], tuple[pd.DataFrame, int | None]], unset: int) -> None:
        self.column, self.order, self.step, self.unset = column, list(order), step, unset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last bigint")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        stored = initialState[self.column].iloc[0]
        self.last.update((self.unset if pd.isna(stored) else int(stored),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        out, now = self.step(pd.concat(list(rows)).sort_values(self.order), last)
        if now is not None and now != last:
            self.last.update((now,))
        yield out

    def close(self) -> None:
        pass


def seeded(stream: DataFrame, key: str, schema: str, processor: LastSeen, stored: DataFrame | None) -> DataFrame:
    """``processor`` over the stream by key; stored has the key and the processor's column, a row for each key at most. Rows without a key have no state and are left out."""
    keep_state_in_rocksdb(stream.sparkSession)
    seeds = None if stored is None else stored.filter(F.col(key).isNotNull()).groupBy(key)
    return stream.filter(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(processor, schema, "append", "none", seeds)


def stream_staleness(incoming: DataFrame, max_age: int = STALE_SECONDS, listings_static: DataFrame | None = None) -> DataFrame:
    """(listing_id, ord, snapshot_ts, class) with the last taken snapshot of each listing as state.

    incoming has listing_id, ord, snapshot_ts; listings_static, the store that the stream goes on from, listing_id and
    last_dynamic_ts (NULL: 0), so that a stored listing is update or skip from its first row on. The store is read
    once, when the stream first starts; after that the state is its own. One number per listing is kept and never expires, since a
    listing may come back at any time. A listing's rows within a micro-batch are taken in order of time, then ord.
    """

    def gate(rows: pd.DataFrame, last: int | None) -> tuple[pd.DataFrame, int | None]:
        classes = []
        for now in rows["snapshot_ts"].tolist():
            kind = "new" if last is None else "update" if now - last > max_age else "skip"
            last = last if kind == "skip" else now
            classes.append(kind)
        return rows[["listing_id", "ord", "snapshot_ts"]].assign(**{"class": classes}), last

    stored = None if listings_static is None else listings_static.select("listing_id", "last_dynamic_ts")
    return seeded(incoming.select("listing_id", "ord", "snapshot_ts"), "listing_id", "listing_id bigint, ord bigint, snapshot_ts bigint, class string", LastSeen("last_dynamic_ts", ("snapshot_ts", "ord"), gate, 0), stored)


def merge_batches(stream: DataFrame, table: VersionedTable, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, once: bool = True, every: str = "120 seconds"):
    """Start a query that merges each micro-batch into the parts of the table that it touches; the epoch is the version."""

    def apply(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            table.merge(batch, merge, epoch)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stream_upsert_images(stream: DataFrame, table: VersionedTable, checkpoint: str, **trigger):
    return merge_batches(stream, table, upsert_images, checkpoint, **trigger)


def stream_append_reviews(stream: DataFrame, table: VersionedTable, checkpoint: str, **trigger):
    """Exact dedup on the review key against everything stored."""
    return merge_batches(stream, table, append_reviews, checkpoint, **trigger)


def stream_recent_reviews(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Dedup with bounded state: duplicates within the watermark go, later ones are dropped as late."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("create_timestamp")).withWatermark("event_time", late)
    return timed.dropna(subset=["shop_id", "listing_id", "create_timestamp"]).dropDuplicatesWithinWatermark(["shop_id", "listing_id", "create_timestamp"])


#: Buckets that the shops of a stream are dealt to; a stream's state is kept by bucket, so that it can't go on with another number.
BUCKETS = 2048
TIMED = ("listing_id", "create_timestamp", "ord")


class NewestTimes(StatefulProcessor):
    """The newest time of each shop of a bucket, as two arrays, seeded from a stored table.

    One call and one state row for a bucket in place of one for each shop. A batch's rows of a shop are kept up to the first
    that isn't newer than the shop's time before the batch.
    """

    def __init__(self, default: int) -> None:
        self.default = default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "shops binary, times binary")

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        stored = self.newest.get() if self.newest.exists() else (b"", b"")
        return np.frombuffer(stored[0], np.int64), np.frombuffer(stored[1], np.int64)

    def _add(self, shops: np.ndarray, times: np.ndarray) -> None:
        """Replace or add times; shops are kept sorted."""
        known, before = self._known()
        stays = ~np.isin(known, shops)
        shops, times = np.concatenate((known[stays], shops)), np.concatenate((before[stays], times))
        order = np.argsort(shops)
        self.newest.update((shops[order].tobytes(), times[order].tobytes()))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._add(initialState["shop_id"].to_numpy(np.int64), initialState["last_ts"].to_numpy(np.int64))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["shop_id", "no_ord", "ord"], kind="stable")
        shop, created = frame["shop_id"].to_numpy(np.int64), frame["create_timestamp"].to_numpy(np.int64)
        first = np.flatnonzero(np.concatenate(([True], shop[1:] != shop[:-1])))
        known, times = self._known()
        last = np.full(len(first), self.default, np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, shop[first]), len(known) - 1)
            last = np.where(known[place] == shop[first], times[place], last)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(shop))))
        older = created <= last[of]
        upto = np.cumsum(older)
        kept = upto == (upto - older)[first][of]  # none of the shop's rows up to this one is older
        now = np.maximum.reduceat(np.where(kept, created, last[of]), first)
        if (changed := now > last).any():
            self._add(shop[first][changed], now[changed])
        yield frame.loc[kept, ["shop_id", *TIMED, *(f"no_{c}" for c in TIMED)]]

    def close(self) -> None:
        pass


def stream_after_watermark(stream: DataFrame, watermarks: DataFrame | None = None, default: int = DEFAULT_WATERMARK) -> DataFrame:
    """Reviews newer than all of their shop's earlier micro-batches, with the shop's newest time as state.

    watermarks, what was fetched before the stream began, has shop_id and last_ts, a row for each shop at most; other shops
    begin with ``default``. Rows without a shop have no state and are left out.
    """
    keep_state_in_rocksdb(stream.sparkSession)
    shop = F.col("shop_id").cast("bigint")
    bucket = F.pmod(F.xxhash64(shop), F.lit(BUCKETS)).cast("int").alias("bucket")
    # NULLs as flags, or one would make numbers of the whole bucket inexact
    number = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in TIMED]
    rows = stream.filter("shop_id is not null").select(bucket, shop.alias("shop_id"), *number, *(F.col(c).isNull().alias(f"no_{c}") for c in TIMED))
    stored = None if watermarks is None else watermarks.filter("shop_id is not null").select(bucket, shop.alias("shop_id"), F.coalesce(F.col("last_ts").cast("bigint"), F.lit(default)).alias("last_ts")).groupBy("bucket")
    schema = ", ".join(f"{c} bigint" for c in ("shop_id", *TIMED)) + "".join(f", no_{c} boolean" for c in TIMED)
    kept = rows.groupBy("bucket").transformWithStateInPandas(NewestTimes(default), schema, "append", "none", stored)
    return kept.select("shop_id", *(F.when(~F.col(f"no_{c}"), F.col(c)).alias(c) for c in TIMED))


def stream_reconcile(files: DataFrame, table: VersionedTable, checkpoint: str, **trigger):
    """Reconcile the status table with each micro-batch of file listings (listing_id, image_id, ext, size)."""
    return merge_batches(files, table, lambda status, batch: reconcile_downloads(status, batch).drop("action"), checkpoint, **trigger)


def progress(query) -> dict:
    """Rows and batches of a finished query."""
    recent = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    return {"batches": len(recent), "rows": sum(p.get("numInputRows", 0) for p in recent)}
