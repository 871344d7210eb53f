"""Streaming jobs give the batch result, in one file or many."""

import pytest
from pyspark.sql import functions as F

from catalog_lake.operators import merge
from catalog_lake.sources.versions import VersionedTable
from catalog_lake.streaming import jobs
from tests.conftest import rows


def landed(spark, df, path, files):
    """The rows in order of ord, in so many files that are written one after another and read one a micro-batch."""
    n = df.count()
    ordered = df.orderBy("ord").collect()
    for k in range(files):
        part = ordered[k * n // files : (k + 1) * n // files]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path)


@pytest.mark.parametrize("files", [1, 4])
def test_staleness(spark, tmp_path, files):
    day = 86_400
    data = [(i, 1 + i % 3, 10**9 + i * day) for i in range(24)]
    stream = landed(spark, spark.createDataFrame(data, "ord bigint, listing_id bigint, snapshot_ts bigint"), str(tmp_path / "in"), files)
    q = jobs.stream_staleness(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = []
    for listing in (1, 2, 3):
        last = None
        for o, lid, ts in data:
            if lid == listing:
                kind = "new" if last is None else "update" if ts - last > 432_000 else "skip"
                last = ts if kind != "skip" else last
                want.append((listing, o, kind))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "listing_id", "ord", "class") == sorted(want, key=repr)


@pytest.mark.parametrize("files", [1, 3])
def test_upsert_and_review_dedup(spark, tmp_path, files):
    images = spark.createDataFrame([(i % 7, 1, i % 2, None if i % 3 else f"u{i}", i) for i in range(30)], "listing_id bigint, image_id bigint, is_primary int, url string, ord bigint")
    schema = "listing_id bigint, image_id bigint, is_primary int, url string, download_done int"
    table = VersionedTable(spark, str(tmp_path / "status"), schema)
    jobs.stream_upsert_images(landed(spark, images, str(tmp_path / "in"), files), table, str(tmp_path / "c1")).awaitTermination(120)
    assert rows(table.read()) == rows(merge.upsert_images(spark.createDataFrame([], schema), images))
    reviews = spark.createDataFrame([(1, i % 5, 100 + i % 10, i) for i in range(40)], "shop_id bigint, listing_id bigint, create_timestamp bigint, ord bigint")
    kept = VersionedTable(spark, str(tmp_path / "reviews"), "shop_id bigint, listing_id bigint, create_timestamp bigint")
    jobs.stream_append_reviews(landed(spark, reviews, str(tmp_path / "in2"), files), kept, str(tmp_path / "c2")).awaitTermination(120)
    assert rows(kept.read()) == rows(reviews.select("shop_id", "listing_id", "create_timestamp").distinct())


def test_reconcile_and_watermarks(spark, tmp_path):
    schema = "listing_id bigint, image_id bigint, is_primary int, url string, download_done int"
    table = VersionedTable(spark, str(tmp_path / "status"), schema)
    table.write(spark.createDataFrame([(1, 1, 1, "u", 1), (2, 1, 1, "u", 0)], schema), -1)
    files = spark.createDataFrame([(1, 1, "jpg", 5000, 0)], "listing_id bigint, image_id bigint, ext string, size bigint, ord bigint")
    jobs.stream_reconcile(landed(spark, files, str(tmp_path / "in"), 1), table, str(tmp_path / "c")).awaitTermination(120)
    assert rows(table.read(), "listing_id", "download_done") == [(1, 2), (2, 1)]
    reviews = spark.createDataFrame([(1, 5, 10**9, 0), (1, 5, 10**9, 1), (1, 6, 10**9 + 5, 2)], "shop_id bigint, listing_id bigint, create_timestamp bigint, ord bigint")
    out = jobs.stream_recent_reviews(landed(spark, reviews, str(tmp_path / "in3"), 1))
    q = out.select("listing_id").writeStream.format("memory").queryName("recent").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("recent")) == [(5,), (6,)]
    newer = jobs.stream_after_watermark(landed(spark, reviews, str(tmp_path / "in4"), 1))
    q = newer.writeStream.format("memory").queryName("newer").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("newer").filter(F.col("create_timestamp") >= 10**9).count() == 3 and jobs.progress(q)["batches"] >= 1


def test_merges_rewrite_the_parts_that_they_touch(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k bigint, v bigint", ("k",), 8)
    assert table.read().count() == 0 and table.merge(spark.createDataFrame([], "k bigint, v bigint"), lambda old, new: new) == []
    replace = lambda old, new: new.unionByName(old.join(new.select("k"), "k", "left_anti"))
    assert table.merge(spark.range(100).selectExpr("id as k", "0L as v"), replace) == list(range(8))
    one = spark.createDataFrame([(5, 1)], "k bigint, v bigint")
    parts = table.merge(one, replace)
    assert len(parts) == 1 and table.versions()[1] == parts and len(table.versions()[0]) == 8
    assert rows(table.read()) == sorted([(k, int(k == 5)) for k in range(100)], key=repr)
    assert rows(table.read(before=1)) == sorted([(k, 0) for k in range(100)], key=repr)
    table.merge(one.withColumn("v", one.v + 8), replace, version=1)  # a repeated batch writes its version again
    assert rows(table.read().filter("k = 5")) == [(5, 9)]
    for v in (2, 3):
        table.merge(one.withColumn("v", one.v * 0 + v), replace)
    assert set(table.versions()) == {0, 2, 3} and len(table.versions()[0]) == 7
    assert table.read().count() == 100 and rows(table.read().filter("k = 5")) == [(5, 3)]
    with pytest.raises(ValueError, match="keys"):
        VersionedTable(spark, str(tmp_path / "u"), "k bigint", parts=2)


def test_deletions_hold(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k bigint, v bigint", ("k",), 2)
    data = spark.range(8).selectExpr("id as k", "id * 2 as v")
    table.write(data, 0)
    assert table.delete(data.filter("k < 7")) == [0, 1] and rows(table.read()) == [(7, 14)]
    table.delete(data)
    assert table.read().count() == 0 and set(table.versions()) == {1, 2}
    table.merge(data.filter("k = 3"), lambda old, new: old.unionByName(new))
    assert rows(table.read()) == [(3, 6)]
    one = VersionedTable(spark, str(tmp_path / "one"), "k bigint, v bigint")
    one.write(data, 0)
    one.merge(data, lambda old, new: old.filter("k < 0"))
    assert one.read().count() == 0


COLD = "listing_id bigint, image_id bigint, is_primary int, url string, download_done int"


def files_of(path, first):
    """Data files of parts from ``first`` on."""
    return sorted(p.relative_to(path).as_posix() for p in path.rglob("*.parquet") if int(p.parent.name.split("=")[1]) >= first)


def test_cold_rows_keep_their_files(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), COLD, ("listing_id", "image_id"), 4, cold="download_done >= 3")
    stored = [(i, 1, 1, None if i % 5 == 0 else f"u{i}", i % 6 - 1) for i in range(120)]
    table.write(spark.createDataFrame(stored, COLD), 0)
    want, before = {r[:2]: r for r in stored}, files_of(tmp_path / "t", 4)
    assert len(before) == 4
    # hot rows only: reconcile, in every part
    files = spark.createDataFrame([(i, 1, "jpg", 5000) for i in range(120)], "listing_id bigint, image_id bigint, ext string, size bigint")
    table.merge(files, lambda status, batch: jobs.reconcile_downloads(status, batch).drop("action"))
    want |= {k: (*r[:4], 2) for k, r in want.items() if r[4] == 1 or r[4] == 0 and r[3]}
    assert files_of(tmp_path / "t", 4) == before and rows(table.read()) == sorted(want.values(), key=repr)
    # rows that become cold are appended
    tarred = spark.createDataFrame([k for k, r in want.items() if r[4] == 2][:10], "listing_id bigint, image_id bigint")
    table.merge(tarred, lambda status, keys: merge.set_status(status, keys, 3, only_from=2))
    want |= {(r.listing_id, r.image_id): (*want[r.listing_id, r.image_id][:4], 3) for r in tarred.collect()}
    after = files_of(tmp_path / "t", 4)
    assert set(before) < set(after) and rows(table.read()) == sorted(want.values(), key=repr)
    # an upsert that changes one cold row rewrites its part, one that changes none rewrites nothing
    cold = next(k for k, r in want.items() if r[4] == 4 and r[3])
    same = spark.createDataFrame([(*cold, 1, "x", 0)], "listing_id bigint, image_id bigint, is_primary int, url string, ord bigint")
    table.merge(same, merge.upsert_images)
    assert files_of(tmp_path / "t", 4) == after and rows(table.read()) == sorted(want.values(), key=repr)
    table.merge(same.withColumn("is_primary", F.lit(0)), merge.upsert_images)
    want[cold] = (*cold, 0, *want[cold][3:])
    assert rows(table.read()) == sorted(want.values(), key=repr)
    assert len({p.split("=")[2].split("/")[0] for p in set(files_of(tmp_path / "t", 4)) - set(after)}) == 1
    # a cold row that goes, and one that becomes hot again
    table.delete(spark.createDataFrame([cold], "listing_id bigint, image_id bigint"))
    del want[cold]
    back = next(k for k, r in want.items() if r[4] == 4)
    table.merge(spark.createDataFrame([back], "listing_id bigint, image_id bigint"), lambda status, keys: merge.set_status(status, keys, 0))
    want[back] = (*want[back][:4], 0)
    assert rows(table.read()) == sorted(want.values(), key=repr)
    table.compact()
    table.compact()
    assert rows(table.read()) == sorted(want.values(), key=repr) and len(files_of(tmp_path / "t", 4)) == 8


def test_streams_go_on_from_stored_state(spark, tmp_path):
    day = 86_400
    stored = spark.createDataFrame([(1, 10 * day), (2, 19 * day), (3, None), (None, 5)], "listing_id bigint, last_dynamic_ts bigint")
    data = [(o, lid, 20 * day + o) for o, lid in enumerate((1, 2, 3, 4, 1, None))] + [(9, 2, 25 * day), (10, 4, 30 * day)]
    frame = spark.createDataFrame(data, "ord bigint, listing_id bigint, snapshot_ts bigint")
    out, progress = str(tmp_path / "out"), str(tmp_path / "c")

    def run(stream, seeds):
        writer = jobs.stream_staleness(stream, listings_static=seeds).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination(180)

    run(landed(spark, frame, str(tmp_path / "in"), 4), stored)
    want = [(0, 1, "update"), (1, 2, "skip"), (2, 3, "update"), (3, 4, "new"), (4, 1, "skip"), (9, 2, "update"), (10, 4, "update")]
    assert rows(spark.read.parquet(out), "ord", "listing_id", "class") == sorted(want, key=repr)
    # begun again it goes on from its own state, not from the store
    late = spark.createDataFrame([(20, 1, 22 * day), (21, 5, 22 * day)], frame.schema)
    run(landed(spark, late, str(tmp_path / "in"), 1), stored)
    assert rows(spark.read.parquet(out).filter("ord >= 20"), "ord", "listing_id", "class") == [(20, 1, "skip"), (21, 5, "new")]


def test_reviews_after_stored_watermarks(spark, tmp_path):
    reviews = spark.createDataFrame([(1, 5, 10**9, 0), (2, 5, 10**9, 1), (3, 5, 10**9, 2), (1, 6, 10**9 + 5, 3), (2, 6, 10**9 + 9, 4)], "shop_id bigint, listing_id bigint, create_timestamp bigint, ord bigint")
    marks = spark.createDataFrame([(1, 10**9), (2, 10**9 - 1), (3, None)], "shop_id bigint, last_ts bigint")
    q = jobs.stream_after_watermark(landed(spark, reviews, str(tmp_path / "in"), 1), marks).writeStream.format("memory").queryName("after_stored").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert rows(spark.table("after_stored"), "shop_id", "ord") == [(2, 1), (2, 4), (3, 2)]


@pytest.mark.parametrize("files", [1, 3])
def test_watermarks_of_many_shops_are_kept_by_bucket(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(jobs, "BUCKETS", 3)
    big = 1 << 60
    data = [(o % 40 if o % 97 else None, None if o % 13 == 0 else big + o, None if o % 11 == 0 else 5000 + (o * 37) % 900 * (o % 7 > 0), big + o) for o in range(600)]
    schema = "shop_id bigint, listing_id bigint, create_timestamp bigint, ord bigint"
    marks = {k: None if k % 8 == 1 else 5000 + k for k in range(0, 50) if k % 4}
    stream = landed(spark, spark.createDataFrame(data, schema), str(tmp_path / "in"), files)
    stored = spark.createDataFrame(list(marks.items()), "shop_id bigint, last_ts bigint")
    kept = jobs.stream_after_watermark(stream, stored, default=4000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    q = kept.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    last, want = {k: 4000 if v is None else v for k, v in marks.items()}, []
    for k in range(files):
        newest, stopped = dict(last), set()
        for row in data[k * 600 // files : (k + 1) * 600 // files]:
            shop, _, created, _ = row
            if shop is not None and shop not in stopped:
                if (created or 0) > last.get(shop, 4000):
                    want.append(row)
                    newest[shop] = max(newest.get(shop, 4000), created)
                else:
                    stopped.add(shop)
        last = newest
    assert rows(spark.read.schema(schema).parquet(str(tmp_path / "out"))) == sorted(want, key=repr) and len(want) > 50
    assert jobs.progress(q)["batches"] >= files and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
