"""Large JSON files in splits, listings as data sources."""

import json

import pytest

from catalog_lake.operators import images, merge, vectors, worklists
from catalog_lake.sources import readers
from catalog_lake.sources.buckets import joined_by_bucket, write_bucketed
from tests.conftest import rows


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content)
    return str(folder)


def splits(spark, path, separator):
    return readers.cut_text(spark, path, separator, recursive=True).select("file", "block").distinct().count()


@pytest.mark.parametrize("indent", [None, 1])
def test_one_index_file_in_several_tasks(spark, tmp_path, small_splits, indent):
    entries = {n: [[i, i * 7 % 100, i, *([f"{i:032x}", f"{i * 3:032x}"] if i % 4 else [])][: 2 if i % 9 == 0 else 5] for i in range(n)] for n in (900, 1)}
    folder = tmp_path / "index"
    put(folder, "image_index_3.json", json.dumps(entries[900], indent=indent))
    put(folder, "image_index_4.json", json.dumps(entries[1], indent=indent))
    put(folder, "image_index_5.json", "[]")
    put(folder, "image_index_6.json", "")
    put(folder, "image_index_7.json", "".join(json.dumps(e) + "\n" for e in entries[900][:300]))
    assert splits(spark, str(folder), "]") > 10
    want = [(shard, k, shard * 1000 + k, e[0], e[1], e[3:]) for shard, found in ((3, entries[900]), (4, entries[1]), (7, entries[900][:300])) for k, e in enumerate(found)]
    assert rows(readers.read_image_index(spark, str(folder), 1000)) == sorted(want, key=repr)


@pytest.mark.parametrize("indent", [None, 2])
def test_one_offset_index_in_several_tasks(spark, tmp_path, small_splits, indent):
    tars = {f"tar_{t}.tar": {f"{t}_{m}.jpg": m * 1024 for m in range(m)} for t, m in enumerate((300, 0, 1, 200, 3))} | {'odd "name".tar': {'a "b" \\ {c}.jpg': 5}}
    content = {"version": 3, "tars": tars, "reverse": {m: [t, o] for t, ms in tars.items() for m, o in ms.items()}, "count": 7}
    folder = put(tmp_path / "tars", "tar_index.json", json.dumps(content, indent=indent))
    put(tmp_path / "tars", "other.json", json.dumps({"tars": {"x": {"y": 1}}}))
    put(tmp_path / "tars", "none.json", json.dumps({"tars": {}, "reverse": {}}))
    assert splits(spark, folder, ",") > 5
    assert rows(readers.read_offset_index(spark, folder)) == sorted([(t, m, o) for t, ms in [*tars.items(), ("x", {"y": 1})] for m, o in ms.items()], key=repr)


def test_separators_in_names_are_an_error(spark, tmp_path):
    folder = put(tmp_path / "bad", "tar_index.json", json.dumps({"tars": {"t": {"a,b": 1}}}))
    with pytest.raises(Exception, match="separator"):
        readers.read_offset_index(spark, folder).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_one_metadata_file_in_several_tasks(spark, tmp_path, small_splits, indent):
    errors = ["not found", 'a, "12": {b}, ]', 'quote " and , comma', "trailing \\ backslash", "", "}", '"5": 6']
    content = {}
    for i in range(400):
        images = [{"image_id": i * 10 + k, "hex": f"h,{k}", "suffix": "}", "is_primary": k == 0} for k in range(i % 4)]
        content[str(i)] = [{"shop_id": i % 7, "when_made": "2010_2019, or so", "price": i / 4, "images": images}, errors[i % 7], i * 11][i % 3]
    content["1000"] = {"shop_id": 1, "price": 1.5}
    folder = put(tmp_path / "meta", "a.json", json.dumps(content, indent=indent))
    put(tmp_path / "meta", "b.json", json.dumps({"2000": 5}))
    put(tmp_path / "meta", "c.json", "{}")
    assert splits(spark, folder, ",") > 5
    found = {r.listing_id: r for r in readers.read_legacy_metadata(spark, folder).collect()}
    assert len(found) == 402 and found[2000].image_id == 5 and found[1000].price == 1.5
    for k, v in content.items():
        r = found[int(k)]
        if isinstance(v, dict):
            assert (r.error, r.shop_id, r.when_made, r.price) == (None, v["shop_id"], v.get("when_made"), v["price"])
            assert [i.image_id for i in r.images or []] == [i["image_id"] for i in v.get("images", [])] and all(i.suffix == "}" for i in r.images or [])
        else:
            assert (r.error, r.image_id, r.shop_id) == ((v, None, None) if isinstance(v, str) else (None, v, None))


def write(folder, name, size):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(bytes(size))


@pytest.mark.parametrize("slices", [1, 3])
def test_listings_of_folders(spark, tmp_path, slices, monkeypatch):
    root = tmp_path / "images"
    want = [("top_1.txt", None, 7), ("0_0.dl", 0, 0)]
    write(root, "top_1.txt", 7)
    write(root, "0_0.dl", 0)
    for i in range(40):
        write(root / str(i % 4) / ("deep" if i % 3 else ""), f"{i}_{i + 1}.jpg", i)
        want.append((f"{i}_{i + 1}.jpg", i, i))
    listed = readers.read_file_inventory(spark, str(root), slices=slices)
    assert listed.rdd.getNumPartitions() == 5 * slices and rows(listed, "name", "listing_id", "size") == sorted(want, key=repr)
    assert readers.read_file_inventory(spark, f"file://{root}/2", slices=slices).count() == 10
    assert readers.read_file_inventory(spark, str(root / "none")).count() == 0


def test_differences_of_listings(spark, tmp_path):
    root = tmp_path / "images"

    def difference():
        found = []
        stream = readers.stream_file_inventory(spark, str(tmp_path / "listings"), str(root), slices=2)
        writer = stream.writeStream.foreachBatch(lambda batch, epoch: found.extend(rows(batch, "change", "name", "listing_id", "size"))).option("checkpointLocation", str(tmp_path / "progress"))
        writer.trigger(availableNow=True).start().awaitTermination(120)
        return sorted(found, key=repr)

    write(root / "a", "1_1.jpg", 10)
    write(root / "a", "2_1.dl", 0)
    write(root, "3_1.jpg", 5)
    assert difference() == sorted([("added", "1_1.jpg", 1, 10), ("added", "2_1.dl", 2, 0), ("added", "3_1.jpg", 3, 5)], key=repr)
    assert difference() == []
    write(root / "a", "1_1.jpg", 20)
    (root / "a" / "2_1.dl").unlink()
    write(root / "b", "4_1.jpg", 1)
    assert difference() == sorted([("changed", "1_1.jpg", 1, 20), ("gone", "2_1.dl", 2, 0), ("added", "4_1.jpg", 4, 1)], key=repr)
    (root / "b" / "4_1.jpg").unlink()
    (root / "b").rmdir()
    assert difference() == [("gone", "4_1.jpg", 4, 1)] and difference() == []
    kept = [p for p in (tmp_path / "listings").rglob("*.parquet")]
    assert kept and len({p.name for p in kept}) <= 2


def test_a_repeated_batch_gives_the_rows_of_its_listing(tmp_path):
    from catalog_lake.sources.inventory import InventoryStreamReader

    write(tmp_path / "images", "1_1.jpg", 1)
    reader = InventoryStreamReader([str(tmp_path / "images")], 1, str(tmp_path / "listings"))

    def found(start, end):
        return sorted(r for p in reader.partitions({"at": start}, {"at": end}) for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True))

    first = found(0, 1)
    write(tmp_path / "images", "2_1.jpg", 1)
    assert found(0, 1) == first == [("added", "1_1.jpg", 1)] and found(1, 2) == [("added", "2_1.jpg", 1)]


def test_bucketed_tables_are_not_shuffled(spark, tmp_path):
    status = spark.createDataFrame([(i // 3, i % 3, 1, f"u{i}" if i % 4 else None, i % 6 - 1) for i in range(300)], "listing_id bigint, image_id bigint, is_primary int, url string, download_done int")
    files = spark.createDataFrame([(i // 3, i % 3, "jpg", i * 20) for i in range(0, 300, 2)], "listing_id bigint, image_id bigint, ext string, size bigint")
    incoming = spark.createDataFrame([(i // 3, i % 3, i % 2, f"n{i}", i) for i in range(150, 400)], "listing_id bigint, image_id bigint, is_primary int, url string, ord bigint")
    index = status.filter("image_id = 0").select("listing_id", "image_id")
    s, f, x = (write_bucketed(df, f"bucketed_{name}", 6, path=str(tmp_path / name)) for df, name in ((status, "status"), (files, "files"), (index, "index")))
    exchanges = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in line]
    claimed = lambda df: df.filter("listing_id % 7 = 0")
    with joined_by_bucket(spark):
        for got, want in (
            (images.reconcile_downloads(s, f), images.reconcile_downloads(status, files)),
            (worklists.embed_candidates(s, x, f, claimed(s)), worklists.embed_candidates(status, index, files, claimed(status))),
            (vectors.dedup_new(s, x), vectors.dedup_new(status, index)),
        ):
            assert exchanges(got) == [] and rows(got) == rows(want)
        merged = merge.upsert_images(s, incoming)
        assert all("listing_id" in e and "SelectedBucketsCount" not in e for e in exchanges(merged)) and len(exchanges(merged)) <= 2
        assert rows(merged) == rows(merge.upsert_images(status, incoming))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
