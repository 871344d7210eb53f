"""WARC records in ZIP packages, read by range.

A package is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, in which every
record is a gzip member of its own, and ``indexes/index.cdxj``, one line per record with its offset and
length in the archive member. The reader parses the end record, the ZIP64 records and the central
directory, finds where the stored members begin, reads the index and then fetches single records by
byte range; nothing is extracted.

Payloads of at least ``REVISIT_BYTES`` that repeat are written once, in full, for the largest page_id;
the others are revisit records that name it. Packages are written by tasks straight into the shared
folder. A package's name has its attempt's own part, and only packages that the manifest names are read:
an attempt that failed or was overtaken leaves files that nothing reads, even if it cut packages elsewhere.

Defined cases: a NULL html is an empty payload; a NULL url writes no target; a row with a NULL page_id is
written and read back as NULL and is never referred to; repeated rows (same page_id and payload) are all
response; an empty table gives an empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from catalog_lake.session import new_path

REVISIT_BYTES = 1000
#: A package is closed when it holds this much, so that packages make even tasks for the reader.
PACKAGE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ID_PREFIX = "urn:x-page:"
ZIP32_MOST = 0xFFFFFFFF


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as the session names it, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ---- records


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; ``digest`` is the payload's SHA-1 in hex, written in base 32 as is usual."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record read back; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda field: int(x) if (x := fields.get(field, "").strip("<>").removeprefix(ID_PREFIX)) else None
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload, "url": fields.get("WARC-Target-URI")}


# ---- ZIP packages


class PackageWriter:
    """Writes a ZIP package front to back; the archive member's size is patched in by ZIP64 fields at the end."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.members, self.index = sink, 0, [], []
        self.data_size, self.data_crc = 0, 0
        # sizes follow in a data descriptor (flag bit 3), as the sink can't be written backwards
        self.data_start = self._local_header(DATA, streamed=True)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def _local_header(self, name: str, crc: int = 0, size: int = 0, streamed: bool = False) -> int:
        self.members.append([name, self.at, crc, size, streamed])
        sizes = (0, 0, 0) if streamed else (crc, size, size)
        self._put(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45 if streamed else 20, 8 if streamed else 0, 0, 0, 0x5821, *sizes, len(name), 20 if streamed else 0) + name.encode() + (struct.pack("<HHQQ", 1, 16, 0, 0) if streamed else b""))
        return self.at

    def add(self, key: str, record: bytes) -> None:
        packed = gzip.compress(record, compresslevel=4, mtime=0)
        self.index.append(f"{key} {json.dumps({'offset': self.data_size, 'length': len(packed)})}\n")
        self._put(packed)
        self.data_size, self.data_crc = self.data_size + len(packed), zlib.crc32(packed, self.data_crc)

    def close(self) -> None:
        self.members[0][2:4] = [self.data_crc, self.data_size]
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.data_crc, self.data_size, self.data_size))
        lines = "".join(self.index).encode()
        self._local_header(INDEX, zlib.crc32(lines), len(lines))
        self._put(lines)
        start = self.at
        for name, at, crc, size, streamed in self.members:  # ZIP64 fields for every member: valid at any size
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 8 if streamed else 0, 0, 0, 0x5821, crc, ZIP32_MOST, ZIP32_MOST, len(name), len(extra), 0, 0, 0, 0, ZIP32_MOST) + name.encode() + extra)
        end, n = self.at, len(self.members)
        self._put(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, end - start, start))
        self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, ZIP32_MOST, ZIP32_MOST, 0))


class PackageReader:
    """Members of a ZIP package by byte range. ``read(offset, length)`` fetches a range of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read, self.size = read, size
        self.members = self._directory()

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Name -> (offset of the local header, size) of stored members."""
        tail_at = max(0, self.size - 65_557 - 20)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<10xHII", tail, at)
        if count == 0xFFFF or ZIP32_MOST in (length, start):
            mark, _, where, _ = struct.unpack_from("<4sIQI", tail, at - 20)
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, _, _, _, _, _, _, count, length, start = struct.unpack("<4sQ2H2I4Q", self.read(where, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
        entries, members, at = self.read(start, length), {}, 0
        for _ in range(count):
            mark, method, packed, plain, n, m, k, local = struct.unpack_from("<4s6xH8xIIHHH8xI", entries, at)
            if mark != b"PK\x01\x02":
                raise ValueError("bad central directory entry")
            name, extra = entries[at + 46 : at + 46 + n].decode(), entries[at + 46 + n : at + 46 + n + m]
            while len(extra) >= 4:
                tag, width = struct.unpack_from("<HH", extra)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                    plain, packed, local = (next(wide) if x == ZIP32_MOST else x for x in (plain, packed, local))
                extra = extra[4 + width :]
            if method == 0:
                members[name] = (local, packed)
            at += 46 + n + m + k
        return members

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        local, _ = self.members[name]
        mark, n, m = struct.unpack("<4s22xHH", self.read(local, 30))
        if mark != b"PK\x03\x04":
            raise ValueError("bad local header")
        return local + 30 + n + m

    def index(self) -> list[tuple[str, int, int]]:
        """(key, offset, length) of the records."""
        lines = self.read(self.start(INDEX), self.members[INDEX][1]).decode().splitlines()
        split = (line.split(" ", 1) for line in lines)
        return [(key, (x := json.loads(rest))["offset"], x["length"]) for key, rest in split]


# ---- Spark jobs


def classify_payloads(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (NULL: response).

    Digests meet in a narrow aggregate; only digests that repeat are joined back, and Spark splits a
    digest that holds many rows, so no task gathers a group.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    repeated = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1 and __first is not null").drop("__n")
    joined = rows.join(repeated, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first"))).drop("__first")


def write_packages(classified: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages; (package, records, bytes) rows of the manifest, kept as Parquet beside them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = open_store(folder)
        done, open_now = [], None

        def finish() -> None:
            writer, sink, name = open_now
            writer.close()
            sink.close()
            done.append((name, len(writer.index), writer.at))

        for batch in batches:
            for row in batch.to_pylist():
                if open_now is None:
                    name = f"part-{part:06d}-{len(done):05d}-{attempt}.wacz"
                    fs.create_dir(f"{base}/packages", recursive=True)
                    sink = fs.open_output_stream(f"{base}/packages/{name}")
                    open_now = PackageWriter(sink), sink, name
                revisit = row["refers_to"] is not None
                open_now[0].add(str(row["page_id"]), warc_record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"], revisit))
                if open_now[0].at >= package_bytes:
                    finish()
                    open_now = None
        if open_now is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["package", "records", "bytes"])

    wide = classified.select("page_id", "url", "payload", "payload_digest", "refers_to")
    wide.mapInArrow(write, "package string, records bigint, bytes bigint").write.parquet(f"{folder}/manifest")
    return classified.sparkSession.read.parquet(f"{folder}/manifest")


def read_packages(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Every record of the packages, fetched by range: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_store(folder)
        for frame in frames:
            for name in frame["package"]:
                with fs.open_input_file(f"{base}/packages/{name}") as source:
                    reader = PackageReader(lambda offset, length, f=source: f.read_at(length, offset), source.size())
                    start, entries = reader.start(DATA), reader.index()
                    for i in range(0, len(entries), 256):
                        rows = [parse_record(gzip.decompress(source.read_at(length, start + offset))) for _, offset, length in entries[i : i + 256]]
                        out = pd.DataFrame(rows, columns=names)
                        for c in ("page_id", "payload_bytes", "refers_to"):
                            out[c] = pd.array([r[c] for r in rows], dtype="Int64")
                        yield out

    packages = manifest.select("package").repartition(max(1, manifest.count()), "package")
    return packages.mapInPandas(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as packages in the shared folder and read the records back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(classify_payloads(pages), folder), folder)


#: DuckDB SQL for the query over pages.
ORACLE = f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload) as n, sha1(payload) as digest from p),
r as (select page_id, n, digest, max(page_id) over (partition by n, digest) as last from q)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when n >= {REVISIT_BYTES} and last > page_id then 'revisit' else 'response' end as record_type,
  case when n >= {REVISIT_BYTES} and last > page_id then last end as refers_to
from r"""
