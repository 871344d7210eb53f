"""Suffix-array dedup: byte strings that also start in an earlier document are removed.

Every byte that lies under a WINDOW-byte string which also starts in a document with a smaller doc_id is
removed; the first document keeps its copy. Exact, over whole texts, in three shuffles of packed rows:

1. Anchors. A window's anchor is its KGRAM-byte string of least hash, so equal windows have equal
   anchors at equal places. Each group of documents sends its distinct anchor hashes (40 bits, a filter
   only) to hash buckets; a bucket answers which of them other groups have too.
2. Segments. Around each shared anchor a group cuts the segment under the windows whose anchor it is.
   Equal segments of a group are sent once, with their least doc_id, so that a passage or a group of
   copies that very many documents share stays at one row a group. In a bucket the suffixes of all
   segments are sorted, the common prefixes of neighbours are computed, and the previous and next smaller
   documents in that order, with the least common prefix on the way to them, give each suffix's longest
   previous factor. A factor of WINDOW bytes or more means that its window has an earlier document.
3. The groups get the answers back, lay them over their documents and remove what is covered.

A group's documents meet in one task (about GROUP_BYTES of text); buckets are as many as groups, so tasks
keep their size as the corpus grows. The shuffle of the texts is made once and used in each step.

Defined cases: a NULL text is empty; texts of under WINDOW bytes lose nothing; a NULL doc_id counts as
larger than every other, and NULLs don't remove each other's bytes, nor do rows of the same doc_id; very
long texts are scanned whole, one to a scan if they exceed SCAN_BYTES; other columns of the input, whatever
their names, are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalog_lake.llm.common import groups_for
from catalog_lake.llm.jaccard import group_bounds, mixed

WINDOW, KGRAM = 50, 20
#: Windows that hold a given k-gram; bytes of a segment: from the first of them to the end of the last.
REACH = WINDOW - KGRAM + 1
SEGMENT = WINDOW + REACH - 1
GROUP_BYTES = 8 << 20
#: Bytes that are scanned at a time.
SCAN_BYTES = 1 << 20
NO_DOC = np.iinfo(np.int64).max


class Documents:
    """A group's documents as one run of bytes: ids, begin and end of each, in order of (doc_id, text)."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = table.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
        self.table = table
        self.ids = table.column("doc_id").fill_null(NO_DOC).to_numpy()
        _, offsets, data = text.buffers()
        wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
        ends = np.frombuffer(offsets, dtype=wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        self.raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, dtype=np.uint8)
        self.begin, self.end = ends[:-1] - ends[0], ends[1:] - ends[0]

    def scans(self) -> Iterator[tuple[int, int]]:
        """Runs of documents of about SCAN_BYTES together."""
        first = 0
        for k in range(len(self.ids)):
            if k > first and self.end[k] - self.begin[first] > SCAN_BYTES:
                yield first, k
                first = k
        if first < len(self.ids):
            yield first, len(self.ids)


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f over every run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x, span = f(x[:-span], x[span:]), span * 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def kgram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the KGRAM bytes from each place; put together from hashes of 16 and 4 bytes."""
    factor = 0xD6E8FEB86659FD93
    runs, span, x = {}, 1, raw.astype(np.uint64) + np.uint64(1)
    while span < 16:
        x = mixed(x[:-span] * np.uint64(factor) + x[span:]) if span == 4 else x[:-span] * np.uint64(factor) + x[span:]
        span, factor = span * 2, factor * factor % (1 << 64)
        runs[span] = x
    rest = KGRAM - 16
    return mixed(runs[16][: len(raw) - KGRAM + 1] * np.uint64(factor) + runs[rest][16 : len(raw) - rest + 1])


def anchors(docs: Documents) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By scan: places in the group's bytes, their hashes, numbers of their documents, and the first and last window start of each."""
    for a, b in docs.scans():
        base = docs.begin[a]
        raw = docs.raw[base : docs.end[b - 1]]
        if len(raw) < WINDOW:
            continue
        hashes = kgram_hashes(raw)
        doc = np.repeat(np.arange(a, b), docs.end[a:b] - docs.begin[a:b])
        starts = len(raw) - WINDOW + 1
        whole = doc[:starts] == doc[WINDOW - 1 :]  # windows within one document
        least = np.where(whole, sliding(np.minimum, hashes, REACH), np.uint64(0))
        padded = np.concatenate((np.zeros(REACH - 1, dtype=np.uint64), least, np.zeros(REACH - 1, dtype=np.uint64)))
        places = np.flatnonzero(sliding(np.maximum, padded, REACH)[: len(hashes)] == hashes)
        if not len(places):
            continue
        near = padded[places[:, None] + np.arange(REACH)] == hashes[places][:, None]  # column s: window start place - (REACH - 1) + s
        first, last = near.argmax(axis=1), REACH - 1 - near[:, ::-1].argmax(axis=1)
        yield places + base, hashes[places], doc[places], first.astype(np.uint8), last.astype(np.uint8)


def packed(values: np.ndarray) -> bytes:
    """Integers below 2**40 in five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def split_hash(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 40-bit remainder of anchor hashes."""
    return (hashes % np.uint64(buckets)).astype(np.int64), hashes >> np.uint64(24)


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Parts of columns that are sorted by bucket."""
    bounds = group_bounds(bucket)
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(bucket[x]), [c[x:y] for c in columns]


def all_anchors(docs: Documents) -> list[np.ndarray]:
    """Places, hashes, document numbers, first and last window starts of the whole group."""
    found = list(anchors(docs))
    kinds = (np.int64, np.uint64, np.int64, np.uint8, np.uint8)
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, dtype=k) for k in kinds]


def send_anchors(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes = [np.unique(h) for _, h, _, _, _ in anchors(Documents(table))]
        every = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, dtype=np.uint64)
        bucket, rest = split_hash(every, buckets)
        order = np.lexsort((rest, bucket))
        rows = [(b, key[0].as_py(), packed(v)) for b, (v,) in by_bucket(bucket[order], rest[order])]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)] if rows else [pa.array([], k) for k in (pa.int32(), pa.int32(), pa.binary())], names=["bucket", "grp", "anchors"])

    return run


def answer_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """For each group, its anchors that another group has too."""
    groups, lists = table.column("grp").to_pylist(), [unpacked(x) for x in table.column("anchors").to_pylist()]
    every = np.sort(np.concatenate(lists))
    many = np.unique(every[1:][every[1:] == every[:-1]])
    rows = [(key[0].as_py(), g, packed(v[np.isin(v, many, assume_unique=True)])) for g, v in zip(groups, lists, strict=True)]
    rows = [r for r in rows if r[2]]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "grp": pa.array([r[1] for r in rows], pa.int32()), "anchors": pa.array([r[2] for r in rows], pa.binary())})


class Segments:
    """A group's segments around shared anchors: distinct rows by bucket, and which occurrence is which row.

    A row is SEGMENT bytes, zero outside the windows, then the first and last window start.
    """

    def __init__(self, docs: Documents, answers: list[tuple[int, bytes]], buckets: int) -> None:
        places, hashes, doc, first, last = all_anchors(docs)
        order = np.lexsort((doc, hashes))
        h, d = hashes[order], docs.ids[doc[order]]
        inner = (h[1:] == h[:-1]) & (d[1:] != d[:-1])  # in two documents of this group
        known = np.unique(h[1:][inner])
        bucket, rest = split_hash(hashes, buckets)
        shared = np.isin(hashes, known)
        sent = [(np.uint64(b) << np.uint64(40)) | unpacked(v) for b, v in answers]
        if sent:
            shared |= np.isin((bucket.astype(np.uint64) << np.uint64(40)) | rest, np.concatenate(sent))
        places, bucket, self.doc, first, last = places[shared], bucket[shared], doc[shared], first[shared].astype(np.int64), last[shared].astype(np.int64)
        self.base = places - (REACH - 1)
        column = np.arange(SEGMENT)
        inside = (column >= first[:, None]) & (column < (last + WINDOW)[:, None])
        rows = np.zeros((len(places), SEGMENT + 2), dtype=np.uint8)
        if len(places):
            rows[:, :SEGMENT] = np.where(inside, docs.raw[np.clip(self.base[:, None] + column, 0, len(docs.raw) - 1)], 0)
        rows[:, SEGMENT], rows[:, SEGMENT + 1] = first, last
        keyed = np.concatenate((bucket.astype(">i4").view(np.uint8).reshape(-1, 4), rows), axis=1)
        distinct, self.row = np.unique(np.ascontiguousarray(keyed).view(f"V{SEGMENT + 6}").ravel(), return_inverse=True)
        distinct = distinct.view(np.uint8).reshape(-1, SEGMENT + 6)
        self.bucket, self.rows = distinct[:, :4].copy().view(">i4").ravel().astype(np.int64), distinct[:, 4:]
        self.least = np.full(len(distinct), NO_DOC)
        np.minimum.at(self.least, self.row, docs.ids[self.doc])


def send_segments(buckets: int):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Segments(Documents(table), list(zip(answers.column("bucket").to_pylist(), answers.column("anchors").to_pylist(), strict=True)), buckets)
        rows = [(b, key[0].as_py(), r.tobytes(), d.astype("<i8").tobytes()) for b, (r, d) in by_bucket(own.bucket, own.rows, own.least)]
        names, kinds = ("bucket", "grp", "segments", "least"), (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return run


def smaller_neighbour(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest place before it with a smaller value, or -1, and the least of ``common`` on the way.

    ``common[k]`` belongs to the step from k to k - 1. By jumps along the answers of others.
    """
    found, least = np.arange(len(values)) - 1, common.copy()
    open_now = np.flatnonzero((found >= 0) & (values[found] >= values))
    while len(open_now):
        at = found[open_now]
        least[open_now] = np.minimum(least[open_now], least[at])
        found[open_now] = found[at]
        at = found[open_now]
        open_now = open_now[(at >= 0) & (values[at] >= values[open_now])]
    return found, least


def previous_factors(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, longest previous factor) of the suffixes of segments that begin a window.

    The suffixes of all segments, each to its segment's end, are put into order; ``common`` has the common
    prefix of neighbours. A suffix's longest match with a suffix of a smaller document is with the nearest
    of those before or after it in that order, and as long as the least common prefix on the way.
    """
    lo, hi = rows[:, SEGMENT].astype(np.int64), rows[:, SEGMENT + 1].astype(np.int64)
    sizes = hi - lo + 1
    row = np.repeat(np.arange(len(rows)), sizes)
    start = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[row]
    length = (hi + WINDOW)[row] - start
    padded = np.concatenate((rows[:, :SEGMENT], np.zeros((len(rows), SEGMENT), dtype=np.uint8)), axis=1)  # zeros after the end
    suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, SEGMENT, axis=1)[row, start])
    order = np.argsort(suffix.view(f"V{SEGMENT}").ravel(), kind="stable")
    ends, common = length[order], np.empty(max(len(order) - 1, 0), dtype=np.int64)
    for a in range(0, len(common), 1 << 16):  # neighbours by parts, so that one matrix of suffixes is held
        b = min(a + (1 << 16), len(common))
        ranked = suffix[order[a : b + 1]]
        differ = ranked[1:] != ranked[:-1]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), SEGMENT)
    del suffix
    common = np.minimum(common, np.minimum(ends[1:], ends[:-1]))
    values = doc[row[order]]
    before, with_before = smaller_neighbour(values, np.append(0, common))
    after, with_after = smaller_neighbour(values[::-1], np.append(0, common[::-1]))
    longest = np.maximum(np.where(before >= 0, with_before, 0), np.where(after >= 0, with_after, 0)[::-1])
    factor = np.empty(len(row), dtype=np.int64)
    factor[order] = longest
    return row, start, factor


def answer_segments(key: tuple, table: pa.Table) -> pa.Table:
    """For each group, runs of window starts: numbers of runs by row, starts, and the document from which on an occurrence has an earlier one.

    Where the factor of the row's least document is a full window, every occurrence has an earlier
    document; elsewhere those of larger documents than the least have.
    """
    groups, given = table.column("grp").to_pylist(), [np.frombuffer(x, dtype=np.uint8).reshape(-1, SEGMENT + 2) for x in table.column("segments").to_pylist()]
    least = np.concatenate([np.frombuffer(x, dtype="<i8") for x in table.column("least").to_pylist()])
    rows = np.ascontiguousarray(np.concatenate(given)).view(f"V{SEGMENT + 2}").ravel()
    distinct, place = np.unique(rows, return_inverse=True)
    lowest = np.full(len(distinct), NO_DOC)
    np.minimum.at(lowest, place, least)
    row, start, factor = previous_factors(distinct.view(np.uint8).reshape(-1, SEGMENT + 2), lowest)
    first = np.where(factor >= WINDOW, np.iinfo(np.int64).min, lowest[row])
    bounds = group_bounds(row, first)[:-1]
    run_row, run_start, run_doc = row[bounds], start[bounds], first[bounds]
    counts = np.bincount(run_row, minlength=len(distinct))
    begins = np.cumsum(counts) - counts
    out, at = [], 0
    for g, part in zip(groups, given, strict=True):
        mine = place[at : at + len(part)]
        at += len(part)
        n = counts[mine]
        chosen = np.repeat(begins[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((key[0].as_py(), g, n.astype(np.uint8).tobytes(), run_start[chosen].astype(np.uint8).tobytes(), run_doc[chosen].astype("<i8").tobytes()))
    return pa.table({"bucket": pa.array([r[0] for r in out], pa.int32()), "grp": pa.array([r[1] for r in out], pa.int32()), **{n: pa.array([r[i] for r in out], pa.binary()) for i, n in ((2, "anchors"), (3, "starts"), (4, "first"))}})


def covered_bytes(docs: Documents, own: Segments, answers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which of the group's bytes lie under a window with an earlier document."""
    counts, starts, first = np.zeros(len(own.rows), dtype=np.int64), [], []
    for b, (at,) in by_bucket(own.bucket, np.arange(len(own.bucket))):
        n, s, d = answers[b]
        counts[at] = n
        starts.append(s), first.append(d)
    depth = np.zeros(len(docs.raw) + 1, dtype=np.int32)
    if starts:
        starts, first = np.concatenate(starts).astype(np.int64), np.concatenate(first)
        row = np.repeat(np.arange(len(counts)), counts)
        ends = np.where(np.append(row[1:] != row[:-1], True), own.rows[row, SEGMENT + 1].astype(np.int64) + 1, np.append(starts[1:], 0))  # of the window starts
        begins = np.cumsum(counts) - counts
        n = counts[own.row]  # every occurrence takes the runs of its row
        chosen = np.repeat(begins[own.row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc, base = np.repeat(own.doc, n), np.repeat(own.base, n)
        hit = first[chosen] < docs.ids[doc]
        np.add.at(depth, (base + starts[chosen])[hit], 1)
        np.add.at(depth, (base + ends[chosen] - 1 + WINDOW)[hit], -1)
    return np.cumsum(depth[:-1]) > 0


def remove_covered(buckets: int, keep_text: bool = False):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        docs = Documents(table)
        listed = answers.to_pylist()
        own = Segments(docs, [(r["bucket"], r["anchors"]) for r in listed if r["starts"] is None], buckets)
        found = {r["bucket"]: (np.frombuffer(r["anchors"], dtype=np.uint8), np.frombuffer(r["starts"], dtype=np.uint8), np.frombuffer(r["first"], dtype="<i8")) for r in listed if r["starts"] is not None}
        gone = covered_bytes(docs, own, found)
        rows, kept = [], []
        for a, b in zip(docs.begin.tolist(), docs.end.tolist(), strict=True):
            cut = gone[a:b]
            left = docs.raw[a:b][~cut].tobytes()
            spans = int(np.count_nonzero(np.diff(np.concatenate(([0], cut.astype(np.int8)))) == 1))
            rows.append((b - a, int(cut.sum()), spans, hashlib.sha256(left).hexdigest()))
            kept.append(left)
        out = {"doc_id": docs.table.column("doc_id")} | {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())))}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))

    return run


def deal_rows(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text and grp, by id and text: rows of one id needn't meet, so an id of very many texts is spread."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))


def dedup_documents(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes, which may begin or end within a character)."""
    groups = groups_for(docs, "text", GROUP_BYTES)
    rows = deal_rows(docs, groups).groupBy("grp")
    answer = "bucket int, grp int, anchors binary"
    shared = rows.applyInArrow(send_anchors(groups), answer).groupBy("bucket").applyInArrow(answer_anchors, answer)
    segments = rows.cogroup(shared.groupBy("grp")).applyInArrow(send_segments(groups), "bucket int, grp int, segments binary, least binary")
    first = segments.groupBy("bucket").applyInArrow(answer_segments, answer + ", starts binary, first binary")
    none = F.lit(None).cast("binary")
    answers = shared.withColumns({"starts": none, "first": none}).unionByName(first)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return rows.cogroup(answers.groupBy("grp")).applyInArrow(remove_covered(groups, keep_text), schema)
