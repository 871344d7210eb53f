"""Archives: batches of images, member offsets, tar files written, scanned, checked and read by offset."""

from __future__ import annotations

import tarfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catalog_lake.functions.columns import tar_size
from catalog_lake.numbering import number_rows
from catalog_lake.operators.merge import set_status
from catalog_lake.session import new_path

TAR_ROWS, SHARD_ROWS = 10_000, 500_000
#: Bytes of content, and rows, that a task gathers before it gives them on.
PIECE_BYTES, PIECE_ROWS = 16 << 20, 10_000
#: Bytes of tars that lie on disk at a time, for each task that can run at once.
ROUND_BYTES = 160 << 20
BLOCK, RECORD = tarfile.BLOCKSIZE, tarfile.RECORDSIZE
ZEROS = bytes(BLOCK)
#: The header of an empty member without a name, as tarfile writes it. Other plain files differ in name, size and checksum.
PLAIN = np.frombuffer(tarfile.TarInfo().tobuf(tarfile.USTAR_FORMAT), np.uint8)
NAME, SIZE, CHECKSUM = slice(0, 100), slice(124, 135), slice(148, 156)
KEYS = ["listing_id", "image_id"]


def tar_batches(index: DataFrame, size: int = TAR_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """index plus batch and tar_name for rows of full batches; the remainder of a shard has none."""
    per_shard = shard_rows // size
    batch = F.expr(f"shard * {per_shard} + shard_row div {size}")
    full = F.count(F.lit(1)).over(W.partitionBy("shard", "batch")) == size
    return index.withColumn("batch", batch).withColumn("__full", full).filter("__full").drop("__full").withColumn("tar_name", F.format_string("imageall_%05d.tar", F.col("batch")))


def ready_batches(batches: DataFrame, existing_tars: DataFrame, files: DataFrame) -> DataFrame:
    """(shard, batch, tar_name): per shard from the first missing tar on, while all files of the batch are there."""
    there = files.select(*KEYS).distinct().withColumn("__there", F.lit(True))
    checked = batches.join(there, KEYS, "left").groupBy("shard", "batch", "tar_name").agg(F.bool_and(F.coalesce("__there", F.lit(False))).alias("__all"))
    joined = checked.join(existing_tars.select("tar_name", F.lit(True).alias("__exists")), "tar_name", "left")
    order = W.partitionBy("shard").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)  # one row per batch
    begun = F.max(F.col("__exists").isNull()).over(order)
    stopped = F.max(F.col("__begun") & ~F.col("__all")).over(order)
    return joined.withColumn("__begun", begun).withColumn("__stopped", stopped).filter("__begun and not __stopped").select("shard", "batch", "tar_name")


def member_offsets(members: DataFrame) -> DataFrame:
    """members (tar_name, pos, size) plus offset: where the member's header begins."""
    before = W.partitionBy("tar_name").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return members.withColumn("offset", F.coalesce(F.sum(tar_size(F.col("size"))).over(before), F.lit(0)).cast("bigint"))


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")


def _by_tar(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple]]]:
    """(tar_name, its rows) of batches in which a tar's rows lie together; one batch is held at a time."""
    streamed = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(streamed, key=itemgetter(0))


def _sums(blocks: np.ndarray) -> np.ndarray:
    """Checksums of header blocks: their bytes' sum, with spaces in the checksum's place."""
    return blocks.sum(axis=1, dtype=np.int64) - blocks[:, CHECKSUM].sum(axis=1, dtype=np.int64) + 8 * 32


def tar_headers(members: Sequence[str], sizes: np.ndarray) -> bytes:
    """The header blocks of plain files one after another, as tarfile writes them."""
    names = [m.encode("utf-8", "surrogateescape") for m in members]
    blocks = np.tile(PLAIN, (len(names), 1))
    blocks[:, NAME] = np.array(names, "S100").view(np.uint8).reshape(-1, 100)
    blocks[:, SIZE] = (sizes[:, None] >> np.arange(30, -1, -3) & 7) + ord("0")
    blocks[:, CHECKSUM.start : CHECKSUM.start + 6] = (_sums(blocks)[:, None] >> np.arange(15, -1, -3) & 7) + ord("0")
    for k in [k for k, name in enumerate(names) if len(name) > 100 or sizes[k] >= 1 << 33]:
        info = tarfile.TarInfo(members[k])
        info.size = int(sizes[k])
        blocks[k] = np.frombuffer(info.tobuf(tarfile.USTAR_FORMAT), np.uint8)
    return blocks.tobytes()


def plain_header(block: bytes) -> tuple[str, int] | None:
    """(member, size) of a plain file's header; None for all others, such as links and names in several blocks."""
    name = block[NAME].split(b"\0", 1)[0]
    if len(block) < BLOCK or block[156] not in b"0\0" or block[345] or name.endswith(b"/"):
        return None
    try:
        return name.decode("utf-8", "surrogateescape"), int(block[124:136].rstrip(b"\0 ") or b"0", 8)
    except ValueError:
        return None


def sums_hold(blocks: list[bytes]) -> bool:
    """Whether all headers have their checksums."""
    try:
        stated = [int(b[CHECKSUM].split(b"\0", 1)[0].strip() or b"0", 8) for b in blocks]
    except ValueError:
        return False
    return not blocks or bool((_sums(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, BLOCK)) == stated).all())


def list_tar(source: pa.NativeFile) -> list[tuple[str, int, int]]:
    """(member, offset, size) of an open tar. tarfile reads those that have other members than plain files, or faults."""
    found, blocks, offset = [], [], 0
    while (block := source.read_at(BLOCK, offset)) != ZEROS:
        if (plain := plain_header(block)) is None:
            break
        found.append((plain[0], offset, plain[1]))
        blocks.append(block)
        offset += BLOCK + -(-plain[1] // BLOCK) * BLOCK
    else:
        if sums_hold(blocks):
            return found
    source.seek(0)
    with tarfile.open(fileobj=source, mode="r:") as tar:
        return [(m.name, m.offset, m.size) for m in tar]


def pack_tars(members: DataFrame, folder: str, content: Column | str = "content") -> DataFrame:
    """Write one tar per tar_name from (tar_name, pos, member) and ``content``; (tar_name, members, bytes).

    Tars are dealt to tasks and their members streamed in order of pos, so that a task holds one Arrow batch
    (bounded by bytes, ``spark.sql.execution.arrow.maxBytesPerBatch``), not a tar. A NULL content is empty; a content
    that is an expression of other columns is evaluated in the task that writes it, and isn't shuffled.
    A tar is written under another name first, so that a task that runs again replaces it whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        name, sink, temporary, count, size, done = None, None, None, 0, 0, []

        def finish() -> None:
            end = -(-(size + 2 * BLOCK) // RECORD) * RECORD
            sink.write(bytes(end - size))
            sink.close()
            fs.move(temporary, f"{base}/{name}")
            done.append((name, count, end))

        try:
            for batch in batches:
                names, contents = batch.column(0).to_pylist(), [c or b"" for c in batch.column(2).to_pylist()]
                headers = tar_headers(batch.column(1).to_pylist(), np.fromiter(map(len, contents), np.int64, len(contents)))
                first = 0
                for tar, rows in groupby(names):
                    if tar != name or sink is None:
                        if sink is not None:
                            finish()
                        name, temporary, count, size = tar, f"{base}/{tar}.{uuid.uuid4().hex}.tmp", 0, 0
                        sink = fs.open_output_stream(temporary)
                    last = first + sum(1 for _ in rows)
                    piece = b"".join(p for k in range(first, last) for p in (headers[k * BLOCK : (k + 1) * BLOCK], contents[k], ZEROS[: -len(contents[k]) % BLOCK]))
                    sink.write(piece)
                    count, size, first = count + last - first, size + len(piece), last
                if len(done) >= PIECE_ROWS:
                    yield _columns(done, PACKED)
                    done = []
            if sink is not None:
                finish()
                sink = None
        finally:
            if sink is not None:
                sink.close()
        if done:
            yield _columns(done, PACKED)

    body = F.col(content) if isinstance(content, str) else content
    ordered = members.repartition("tar_name").sortWithinPartitions("tar_name", "pos").select("tar_name", "member", body.alias("content"))
    return ordered.mapInArrow(run, "tar_name string, members bigint, bytes bigint")


PACKED = pa.schema([("tar_name", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())])
SCANNED = pa.schema([("tar_name", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
READ = pa.schema([("tar_name", pa.string()), ("member", pa.string()), ("content", pa.binary())])


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def scan_tars(tars: DataFrame, folder: str) -> DataFrame:
    """(tar_name, member, offset, size) of existing tars, reading headers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        rows = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as source:
                    rows += [(name, *m) for m in list_tar(source)]
                if len(rows) >= PIECE_ROWS:
                    yield _columns(rows, SCANNED)
                    rows = []
        if rows:
            yield _columns(rows, SCANNED)

    # names are few bytes: without a number of tasks they would be gathered in one
    tasks = 2 * tars.sparkSession.sparkContext.defaultParallelism
    names = tars.select("tar_name").repartition(tasks, "tar_name").distinct()
    return names.mapInArrow(run, "tar_name string, member string, offset bigint, size bigint")


def read_members(index_rows: DataFrame, folder: str) -> DataFrame:
    """(tar_name, member, content) by offset; content is NULL where another member is at the offset.

    A tar is read by one task, in order of offset, and rows are given on in pieces of about PIECE_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        out, blocks, held = [], [], 0

        def piece() -> pa.RecordBatch:
            if not sums_hold(blocks):
                for block in blocks:
                    tarfile.TarInfo.frombuf(block, "utf-8", "strict")  # tells the fault
            return _columns(out, READ)

        for name, rows in _by_tar(batches):
            with fs.open_input_file(f"{base}/{name}") as source:
                for _, member, offset in rows:
                    block = source.read_at(BLOCK, offset)
                    if (plain := plain_header(block)) is None:
                        info = tarfile.TarInfo.frombuf(block, "utf-8", "strict")
                        plain = info.name, info.size
                    blocks.append(block)
                    out.append((name, member, source.read_at(plain[1], offset + BLOCK) if plain[0] == member else None))
                    held += plain[1]
                    if held >= PIECE_BYTES or len(out) >= PIECE_ROWS:
                        yield piece()
                        out, blocks, held = [], [], 0
        if out:
            yield piece()

    ordered = index_rows.select("tar_name", "member", "offset").repartition("tar_name").sortWithinPartitions("tar_name", "offset")
    return ordered.mapInArrow(run, "tar_name string, member string, content binary")


def in_rounds(members: DataFrame, use: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``use(members, folder)`` over all tars of members (tar_name, size), some tars at a time.

    For work that needs its tars only until its own rows are there. ``use`` is called with all members of a share of the
    tars and a folder of its own; its rows are stored, and the folder is deleted with all in it. A round has about ROUND_BYTES of
    tars for each task that can run at once, or one tar, whatever the table's size.
    """
    spark = members.sparkSession
    stored, dealt, out = new_path(spark, "members"), new_path(spark, "rounds"), new_path(spark, "results")
    members.write.parquet(stored)
    numbered = spark.read.schema(members.schema).parquet(stored)
    total = int(numbered.agg(F.sum(tar_size(F.col("size")))).first()[0] or 0)
    rounds = max(1, -(-total // (ROUND_BYTES * spark.sparkContext.defaultParallelism)))
    numbered = numbered.withColumn("__round", F.pmod(F.xxhash64("tar_name"), F.lit(rounds)).cast("int"))
    numbered.repartition("__round").write.partitionBy("__round").parquet(dealt)
    _delete(spark, stored)
    shares = spark.read.schema(numbered.schema).parquet(dealt) if total else spark.createDataFrame([], numbered.schema)
    for k in range(rounds):
        folder = new_path(spark, "round")
        try:
            found = use(shares.filter(F.col("__round") == k).drop("__round"), folder)
            found.write.mode("append").parquet(out)
        finally:
            _delete(spark, folder)
    _delete(spark, dealt)
    return spark.read.schema(found.schema).parquet(out)


def _delete(spark, path: str) -> None:
    """Delete a folder that this module made."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def check_tars(scanned: DataFrame, sources: DataFrame, folder: str, expected: int = TAR_ROWS, sample: int = 50) -> DataFrame:
    """(tar_name, members, corrupt, outcome): member count, and MD5 of a seeded sample against the sources (member, content)."""
    place = F.row_number().over(W.partitionBy("tar_name").orderBy(F.xxhash64("member", F.lit(1)), "member"))
    chosen = scanned.withColumn("__k", place).filter(F.col("__k") <= sample)
    inside = read_members(chosen, folder).select("tar_name", "member", F.md5("content").alias("__in"))
    compared = inside.join(sources.select("member", F.md5("content").alias("__out")), "member", "left")
    corrupt = compared.groupBy("tar_name").agg(F.count_if(~F.col("__in").eqNullSafe(F.col("__out"))).alias("corrupt"))
    counts = scanned.groupBy("tar_name").agg(F.count(F.lit(1)).alias("members")).join(corrupt, "tar_name", "left").withColumn("corrupt", F.coalesce("corrupt", F.lit(0)))
    return counts.withColumn("outcome", F.when(F.col("members") != expected, "wrong_count").when(F.col("corrupt") > 0, "corrupt").otherwise("valid"))


def mark_tarred(image_status: DataFrame, batches: DataFrame, done: DataFrame) -> DataFrame:
    """Images of finished batches go from 2 to 3."""
    return set_status(image_status, batches.join(done.select("tar_name"), "tar_name", "left_semi"), 3, only_from=2)


def finalize_shards(image_status: DataFrame, index: DataFrame, batches: DataFrame, done: DataFrame, shard_rows: int = SHARD_ROWS, size: int = TAR_ROWS) -> DataFrame:
    """Images of full shards that have all their tars go to 4 and lose their url."""
    full = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == shard_rows)
    tars = batches.select("shard", "tar_name").distinct().join(done.select("tar_name").distinct(), "tar_name").groupBy("shard").agg(F.count(F.lit(1)).alias("t")).filter(F.col("t") == shard_rows // size)
    return set_status(image_status, index.join(full.join(tars, "shard"), "shard", "left_semi"), 4, clear_url=True)


def primary_map(image_status: DataFrame) -> DataFrame:
    return image_status.filter("is_primary = 1").groupBy("listing_id").agg(F.max("image_id").alias("image_id"))


def new_primaries(primaries: DataFrame, primary_index: DataFrame, full: bool = False) -> DataFrame:
    """Listings not yet in the primary index; a changed primary of a known listing isn't taken up unless ``full``."""
    return primaries if full else primaries.join(primary_index.select("listing_id"), "listing_id", "left_anti")


def locate_in_tars(primaries: DataFrame, tar_index: DataFrame) -> DataFrame:
    """primaries with tar_name and offset, and found."""
    return primaries.join(tar_index.select(*KEYS, "tar_name", "offset"), KEYS, "left").withColumn("found", F.col("tar_name").isNotNull())


def primary_batches(new: DataFrame, existing: DataFrame, size: int = TAR_ROWS) -> DataFrame:
    """(listing_id, member, pos, tar_name): names in string order, in chunks of ``size``, numbered after the highest existing tar."""
    last = existing.agg(F.coalesce(F.max(F.regexp_extract("tar_name", r"(\d+)", 1).cast("bigint")) + 1, F.lit(0))).first()[0]
    named = new.select("listing_id", F.concat(F.col("listing_id").cast("string"), F.lit(".jpg")).alias("member"))
    numbered = number_rows(named, [F.col("member")], "__n")
    return numbered.select("listing_id", "member", F.expr(f"__n % {size}").alias("pos"), F.format_string("primary_%05d.tar", F.expr(f"__n div {size} + {last}")).alias("tar_name"))
