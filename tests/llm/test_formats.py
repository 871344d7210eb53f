"""WARC packages and chat formatting; the pipeline; the queries over small tables."""

import hashlib
import io
import random
import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from catalog_lake.llm import chat, entries, warc
from tests.conftest import rows

PAGES = "page_id bigint, url string, html string"


def test_pages_come_back_from_packages(spark):
    big, small = "x" * 1000, "y" * 999
    pages = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "u", small), (5, "u", small), (6, "v\r\nw", None), (7, "", "é" * 600), (None, "n", big), (8, "s", "z" * 5000)]
    found = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(pages, PAGES)).collect()}
    assert len(found) == len(pages)
    for page_id, _, html in pages:
        raw = (html or "").encode()
        assert (found[page_id]["payload_bytes"], found[page_id]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {p: (found[p]["record_type"], found[p]["refers_to"]) for p in found} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), None: ("revisit", 3), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None),
    }
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_packages_are_valid_zip_files_and_small_ones_are_read():
    sink = io.BytesIO()
    writer = warc.PackageWriter(sink)
    records = [warc.warc_record(i, "u", b"payload%d" % i, hashlib.sha1(b"payload%d" % i).hexdigest(), None, False) for i in range(5)]
    for i, r in enumerate(records):
        writer.add(str(i), r)
    writer.close()
    with zipfile.ZipFile(sink) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
    raw, asked = sink.getvalue(), []
    read = lambda offset, n: (asked.append(n), raw[offset : offset + n])[1]
    reader = warc.PackageReader(read, len(raw))
    assert [k for k, _, _ in reader.index()] == ["0", "1", "2", "3", "4"]
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr(warc.DATA, b"data")
        z.writestr("deflated", b"d" * 99, zipfile.ZIP_DEFLATED)
        z.writestr(warc.INDEX, '0 {"offset": 0, "length": 4}\n')
    raw = plain.getvalue()
    reader = warc.PackageReader(lambda o, n: raw[o : o + n], len(raw))
    assert reader.index() == [("0", 0, 4)] and raw[reader.start(warc.DATA) :][:4] == b"data" and "deflated" not in reader.members
    with pytest.raises(ValueError, match="no end of central directory"):
        warc.PackageReader(lambda o, n: b"x" * n, 100)


def test_packages_are_closed_by_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(60)], PAGES).coalesce(1)
    manifest = warc.write_packages(warc.classify_payloads(pages), f"file://{tmp_path}/w", package_bytes=4000)
    assert manifest.count() > 3 and manifest.groupBy().sum("records").first()[0] == 60
    assert warc.read_packages(manifest, f"file://{tmp_path}/w", payload=True).filter("length(payload) = payload_bytes").count() == 60


def test_packages_of_lost_attempts_are_not_read(spark, tmp_path):
    """An attempt that cut other packages and then got lost leaves its files; the manifest names those of the attempt that counts."""
    pages = spark.createDataFrame([(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(60)], PAGES)
    folder = f"file://{tmp_path}/w"
    warc.write_packages(warc.classify_payloads(pages.orderBy(F.desc("page_id")).coalesce(1)), folder, package_bytes=3000)
    (tmp_path / "w" / "manifest").rename(tmp_path / "lost")
    manifest = warc.write_packages(warc.classify_payloads(pages.coalesce(1)), folder, package_bytes=8000)
    assert len(list((tmp_path / "w" / "packages").glob("*.wacz"))) > manifest.count()
    assert rows(warc.read_packages(manifest, folder), "page_id") == sorted([(i,) for i in range(60)], key=repr)


TURNS = "conv_id bigint, turn int, role string, text string, prompt string, __k int"


def brute_pairs(listed):
    """conv_id and the rendered pair, by the definition; each row without an id is a conversation of its own."""
    out = []
    for conv, said in [(conv, [r for r in listed if r[0] == conv]) for conv in {r[0] for r in listed} - {None}] + [(None, [r]) for r in listed if r[0] is None]:
        chosen = [(role or "", text or "") for _, role, text in sorted(((t is not None, t or 0), r or "", x or "") for _, t, r, x, *_ in said)]
        replies = [i for i, t in enumerate(chosen) if t[0] == "assistant"]
        rejected = list(chosen)
        if replies:
            k = (conv or 0) % chat.REDUCE * chat.SPREAD % len(replies)
            rejected[replies[k]] = ("assistant", chosen[replies[k - 1]][1] if k else "")
        n = 0
        while n < len(chosen) and chosen[n] == rejected[n]:
            n += 1
        render = lambda ts: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in ts)
        bodies = lambda ts: [x + "<|im_end|>" for r, x in ts if r == "assistant"]
        out.append((conv, n, render(chosen[:n]), render(chosen[n:]), bodies(chosen[n:]), render(rejected[n:]), bodies(rejected[n:])))
    return sorted(out, key=repr)


def test_preference_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    listed = [(c, t, rng.choice(("user", "assistant", "assistant", None, "system")), rng.choice(("hi", "é", None, "", f"reply {t}", "x" * 50_000)), "extra", 5) for c in [*range(40), None, -7, 2**63 - 1] for t in range(rng.randint(1, 7))]
    listed += [(3, None, "user", "null turn", None, None), (3, 0, "assistant", "tie", None, None), (3, 0, "assistant", "tie", None, None)]
    cut = lambda text, mask: [text[a:b] for a, b in (map(int, m.split("-")) for m in mask.split(",") if m)]
    listed += [(None, t, role, text, None, None) for t in range(3) for role, text in (("assistant", "no id"), ("assistant", ""), ("user", "no id"), (None, None))] + [(None, 0, "assistant", "no id", None, None)]
    pairs = chat.format_pairs(chat.pair_with_repeats(spark.createDataFrame(listed, TURNS)), "conv_id")
    found = sorted(((r["conv_id"], r["n_prompt_turns"], r["prompt"], r["chosen"], cut(r["chosen"], r["chosen_mask"]), r["rejected"], cut(r["rejected"], r["rejected_mask"])) for r in pairs.collect()), key=repr)
    assert found == brute_pairs(listed) and len({n for _, n, *_ in found}) > 3 and max(len(f[4]) for f in found) > 2
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pylist([{"conv_id": c, "turn": t, "role": r, "text": x} for c, t, r, x, *_ in listed], pa.schema([("conv_id", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string())])))
    assert sorted(con.sql(f"select {', '.join(pairs.columns)} from ({chat.ORACLE})").fetchall(), key=repr) == rows(pairs)
    assert chat.format_pairs(chat.pair_with_repeats(spark.createDataFrame([], TURNS)), "conv_id").count() == 0


def test_masks_of_longer_completions(spark):
    pair = spark.createDataFrame([(1, [(0, "user", "u")], [(0, "user", "v"), (1, "assistant", "xy"), (2, "user", "z"), (3, "assistant", "")])], "id int, chosen_turns array<struct<turn:int,role:string,text:string>>, rejected_turns array<struct<turn:int,role:string,text:string>>")
    r = chat.format_pairs(pair, "id").first()
    spans = [tuple(map(int, s.split("-"))) for s in r["rejected_mask"].split(",")]
    assert r["n_prompt_turns"] == 0 and r["chosen_mask"] == "" and [r["rejected"][a:b] for a, b in spans] == ["xy<|im_end|>", "<|im_end|>"]


def test_the_pipeline_runs_stage_by_stage(spark, tmp_path):
    good = "the people of the town went to the market and it was a fine day for all that came with their goods and stories from afar"
    text = lambda k: " ".join(f"{w}{(i * 7 + k * 13) % 97 if i % 3 == 0 else ''}" for i, w in enumerate((good + " " + good + " " + good).split()))
    listed = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(30)] + [(100, text(3), "en", "s0", 1), (101, "too short", "en", "s0", 1), (102, None, None, None, None), (103, text(50) + " token=abcdefgh1234", None, None, None)]
    docs = spark.createDataFrame(listed, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "secret_scans", "mixing", "byte_bpe"]
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert {r[0] for r in rows(kept, "doc_id")} == {*range(30), 100, 103}
    unique = corpus_pipeline.near_duplicate_stage(spark, kept, str(tmp_path))
    assert {r[0] for r in rows(unique, "doc_id")} == {*range(30), 103}
    clean = corpus_pipeline.secret_stage(spark, unique, str(tmp_path))
    assert clean.columns == docs.columns and "[SECRET]" in clean.filter("doc_id = 103").first()["text"]
    mixed = corpus_pipeline.mixing_stage(spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() > 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.filter("n_tokens = 0").count() == 0
    nothing = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        nothing_left = stage(spark, nothing, str(tmp_path))
        assert nothing_left.count() == 0


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert {q.split("_")[0] for q in entries.queries()} == {f"op{n}" for n in range(1, 11)} and set(entries.queries()) <= names and "pipeline" in names
