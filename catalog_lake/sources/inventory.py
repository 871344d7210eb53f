"""Folders of files as a data source: listings in batch, differences between listings as a stream.

The driver names the folders' direct subfolders only. A task walks one of them, or the files that lie directly
in a folder, and takes the names that fall to its slice, page by page. On local disks entries come one by one,
elsewhere a directory at a time. Contents aren't read, and empty files are listed, too.

As a stream, an offset is the time of a listing. A task stores what its part looked like then, below
``snapshots`` in a folder that all tasks share, and gives what differs from the listing before: files that were ``added``,
``changed`` (in size or time) or are ``gone``. A batch that is run again finds its listings stored and gives the same
rows. Once a batch is done, listings before its end are deleted.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Entries that are given on at a time.
PAGE_ROWS = 50_000
LISTED = "name string, size bigint, mtime timestamp"
DIFFERENCE = f"change string, {LISTED}"
FIELDS = [("name", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))]


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """(name, path, is a folder, size, time in microseconds) of a folder's direct entries; none if there is no such folder."""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            found = os.scandir(folder)
        except FileNotFoundError:
            return
        with found:
            for e in found:
                try:
                    stat = e.stat()
                except FileNotFoundError:  # gone meanwhile
                    continue
                yield e.name, e.path, e.is_dir(), stat.st_size, stat.st_mtime_ns // 1000
    else:
        for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            yield f.base_name, f.path, f.type == pafs.FileType.Directory, f.size or 0, (f.mtime_ns or 0) // 1000


class Part(InputPartition):
    """A folder's files (deep: with all below it) whose names fall to a slice; a stream's also has the times of two listings."""

    def __init__(self, folder: str, deep: bool, number: int, slices: int, start: int = 0, end: int = 0) -> None:
        self.folder, self.deep, self.number, self.slices, self.start, self.end = folder, deep, number, slices, start, end

    def key(self) -> str:
        return quote(json.dumps([self.folder, self.deep, self.number, self.slices]), safe="")

    def files(self) -> Iterator[tuple[str, str, int, int]]:
        """(path below the folder, name, size, time)."""
        fs, base = store_of(self.folder)
        folders = [base.rstrip("/")]
        while folders:
            for name, path, is_folder, size, stamp in entries(fs, folders.pop()):
                if is_folder:
                    folders += [path] * self.deep
                elif self.slices == 1 or zlib.crc32(name.encode()) % self.slices == self.number:
                    yield path[len(base.rstrip("/")) :], name, size, stamp


def parts_of(folders: list[str], slices: int) -> list[Part]:
    out = []
    for folder in folders:
        fs, base = store_of(folder)
        scheme = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
        below = sorted(path for _, path, is_folder, _, _ in entries(fs, base) if is_folder)
        out += [Part(f, deep, k, slices) for f, deep in [(folder, False), *((scheme + path, True) for path in below)] for k in range(slices)]
    return out


def pages(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == PAGE_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])


class InventoryReader(DataSourceReader):
    def __init__(self, folders: list[str], slices: int) -> None:
        self.folders, self.slices = folders, slices

    def partitions(self) -> list[Part]:
        return parts_of(self.folders, self.slices)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return pages(((name, size, stamp) for _, name, size, stamp in partition.files()), FIELDS)


class InventoryStreamReader(DataSourceStreamReader):
    def __init__(self, folders: list[str], slices: int, snapshots: str) -> None:
        self.folders, self.slices, self.snapshots = folders, slices, snapshots

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": time.time_ns() // 1_000_000}

    def _stored(self) -> tuple[pafs.FileSystem, str, list[str]]:
        fs, base = store_of(self.snapshots)
        return fs, base, [name for name, _, is_folder, _, _ in entries(fs, base) if is_folder]

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """The parts that are there, and those that were at an earlier listing."""
        if start["at"] == end["at"]:
            return []
        found = {p.key(): p for p in parts_of(self.folders, self.slices)}
        found |= {key: Part(*json.loads(unquote(key))) for key in self._stored()[2] if key not in found}
        for p in found.values():
            p.start, p.end = start["at"], end["at"]
        return list(found.values())

    def _listing(self, part: Part, at: int, make: bool) -> dict[str, tuple[str, int, int]]:
        """Path -> (name, size, time) of the listing stored under a time; made now if there is none and it shall be."""
        fs, base = store_of(self.snapshots)
        path = f"{base}/{part.key()}/{at}.parquet"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            if not make:
                return {}
            listed = {p: rest for p, *rest in part.files()}
            columns = zip(*((p, *rest) for p, rest in listed.items()), strict=True) if listed else ([], [], [], [])
            table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "name", "size", "stamp"])
            fs.create_dir(f"{base}/{part.key()}", recursive=True)
            temporary = f"{path}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as sink:
                pq.write_table(table, sink)
            fs.move(temporary, path)
        with fs.open_input_file(path) as source:
            columns = pq.read_table(source).to_pydict()
        return {p: rest for p, *rest in zip(*columns.values(), strict=True)}

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        before = self._listing(partition, partition.start, make=False)
        now = self._listing(partition, partition.end, make=True)
        differs = ((("changed" if path in before else "added"), *rest) for path, rest in now.items() if before.get(path) != rest)
        gone = (("gone", *rest) for path, rest in before.items() if path not in now)
        return pages((row for rows in (differs, gone) for row in rows), [("change", pa.string()), *FIELDS])

    def commit(self, end: dict) -> None:
        fs, base, keys = self._stored()
        for key in keys:
            for name, path, _, _, _ in list(entries(fs, f"{base}/{key}")):
                if name.split(".")[0].isdigit() and int(name.split(".")[0]) < end["at"]:
                    fs.delete_file(path)


class FileInventory(DataSource):
    """Options: folders (a JSON array), slices (tasks for each subfolder, 1), snapshots (streams only: where listings are kept)."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return DIFFERENCE if "snapshots" in self.options else LISTED

    def _common(self) -> tuple[list[str], int]:
        return json.loads(self.options["folders"]), int(self.options.get("slices", 1))

    def reader(self, schema) -> InventoryReader:
        return InventoryReader(*self._common())

    def streamReader(self, schema) -> InventoryStreamReader:  # noqa: N802
        return InventoryStreamReader(*self._common(), self.options["snapshots"])


def inventory(spark: SparkSession, folders: list[str], slices: int, snapshots: str | None = None):
    """The data source over folders; with ``snapshots`` a stream."""
    spark.dataSource.register(FileInventory)
    reader = (spark.read if snapshots is None else spark.readStream).format("file_inventory").option("folders", json.dumps(folders)).option("slices", slices)
    return (reader if snapshots is None else reader.option("snapshots", snapshots)).load()
