"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from catalog_lake.operators import archive
from catalog_lake.plans import ORACLES, QUERIES
from catalog_lake.plans.fixtures import BASE

SMALL = "/root/testdata/sf0.001"
#: Queries that pack tars, read them and delete them, some at a time.
IN_ROUNDS = ("i4_i5_pack_scan_tars", "i6_check_tars", "i12_read_members", "s5_read_file_inventory")
#: One or two of each family; the whole set runs in the driver's comparison.
CHOSEN = ("g7_incomplete_rows", "g11_check_shard_rows", "g12_embedded_rows", "j7_row_consistency", "a7_drop_imageless_pages", "a9_ingest_report", "c5_embed_report", "d2_rebuild_report", "k2_stream_upsert_stored", "s2_versioned_deletion", "a6_image_rows", "b2_staleness_gate", "b5_upsert_images", "c2_shops_for_reviews", "d1_reconcile_downloads", "e3_to_image_status", "f5_bucket_counts", "g9_append_to_shards", "h5_consensus", "i3_member_offsets", "j5_compare_inventories")


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = tables(SMALL)
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted((tuple("" if x is None or x is pd.NA or x != x else str(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)))
    norm = lambda rs: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rs]
    assert norm(plain(got)) == norm(plain(want))


TABLES = "/root/testdata/sf0.01"
#: Classes that a query's rule tells apart; each must occur in the given tables.
CLASSES = {
    "b2_staleness_gate": ("class", {"new", "update", "skip"}), "a9_ingest_stats": ("class", {"new", "update", "skip"}), "k1_stream_staleness": ("class", {"new", "update", "skip"}), "k1_stream_staleness_stored": ("class", {"new", "update", "skip"}),
    "b6_fill_missing_urls": ("repaired", {True, False}), "d1_reconcile_downloads": ("action", {"downloaded", "dead", "reconciled", "marker_created", None}), "d2_rebuild_status": ("embed_clip", {0, 1}), "d6_rename_plan": ("class", {"renamed", "already_new", "missing", "no_images"}),
    "e1_nest_images": ("outcome", {"skipped", "converted"}), "e2_flag_first_image": ("outcome", {"no_images", "already", "updated"}), "e3_to_image_status": ("to_download", {0, 1}), "f5_bucket_counts": ("at_cap", {True, False}), "g11_check_shard_rows": ("outcome", {"consistent", "count mismatch", "different counts", "different rows", "no vectors"}), "i6_check_tars": ("outcome", {"valid", "wrong_count", "corrupt"}), "i10_locate_in_tars": ("found", {True, False}),
}


def tables(folder):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def test_every_query_has_rows_and_every_class_occurs():
    con = tables(TABLES)
    empty = [name for name, sql in ORACLES.items() if not con.sql(f"select count(*) from ({sql})").fetchall()[0][0]]
    assert empty == []
    for name, (column, classes) in CLASSES.items():
        assert {r[0] for r in con.sql(f'select distinct "{column}" from ({ORACLES[name]})').fetchall()} == classes, name
    count = lambda sql: con.sql(f"select count(*) from ({sql})").fetchall()[0][0]
    assert 0 < count(ORACLES["a7_drop_imageless_pages"]) < count("from part")
    assert 0 < count(ORACLES["i2_ready_batches"]) < count(f"select * from ({ORACLES['i1_tar_batches']}) where batch % 10 >= 2") / 100
    ready, missing = con.sql(ORACLES["c5_embed_report"]).fetchall()[0]
    assert ready and missing
    assert count(f"select * from ({ORACLES['d2_rebuild_status']}) where downloaded = 1 and listing_id % 6 = 0")  # on disk only


def test_ready_batches_follow_the_whole_inventories(spark, tmp_path):
    con = tables(SMALL)
    batches = con.sql(f"select count(*) // 100 from ({ORACLES['i1_tar_batches']}) where batch % 10 >= 2").fetchall()[0][0]
    want = con.sql(f"select shard, batch, tar_name from ({ORACLES['i2_ready_batches']})").fetchall()
    got = QUERIES["i2_ready_batches"](spark, SMALL).select("shard", "batch", "tar_name").collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(want) < batches
    # with a file on disk for every image all batches are ready
    con.execute(f"copy (select * replace (l_suppkey - l_suppkey % 3 + 1 as l_suppkey) from lineitem) to '{tmp_path}/lineitem.parquet'")
    assert QUERIES["i2_ready_batches"](spark, str(tmp_path)).count() == batches


@pytest.mark.parametrize("name", IN_ROUNDS)
def test_tars_of_a_round_alone_lie_on_disk(spark, monkeypatch, name):
    left = lambda: set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*.tar"))
    before, delete, rounds = left(), archive._delete, []

    def counted(session, path):
        if "/round-" in path:
            rounds.append(sum(p.stat().st_size for p in left() - before))
        delete(session, path)

    monkeypatch.setattr(archive, "ROUND_BYTES", 1 << 20)
    monkeypatch.setattr(archive, "_delete", counted)
    test_query_equals_sql(spark, name)
    assert len(rounds) > 1 and 0 < max(rounds) < sum(rounds) and left() == before


def test_text_embeddings_are_of_every_image(spark):
    pairs = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    assert QUERIES["g4_embed_text"](spark, SMALL).count() == pairs


def test_names_are_consistent():
    assert set(ORACLES) <= set(QUERIES)


def test_the_rest_works_without_the_training_data_folders(tmp_path):
    root = Path(__file__).parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q))"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / "copy" / name).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": f"{tmp_path / 'copy'}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0 and int(done.stdout) == len(QUERIES), done.stderr
