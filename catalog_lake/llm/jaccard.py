"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Every text becomes its set of 64-bit hashes of five-word shingles (fewer words: one shingle), and a
   signature: TREES sequences of DEPTH MinHashes. Rows whose words are the same sequence are copies: they
   collapse to one node by a combining aggregate, whatever their doc_ids. A node's shingles are made from
   one text, that of its least doc_id, however often that row is repeated.
2. A tree's trie holds the nodes by their sequences: a trie's node at depth d is a prefix of d MinHashes,
   and its members are the rows of one (tree, prefix), sorted. Matching starts at full depth. Pairs that
   meet there are verified exactly; each verified similarity s tells how probable it was to meet by then
   (1 - (1 - s^d)^TREES), so that the links found give an unbiased estimate of those missed. While the
   estimated recall is under the target, the prefixes are shortened by one level and only prefixes with
   two or more different children are matched again. At the depth where pairs of exactly the threshold
   meet with the target recall the estimate can't fall short, so that shortening ends there at the latest.
3. A prefix that more than BLOCK nodes share is cut into blocks; nodes go to each pair of blocks, so that
   no task holds an unbounded group and no pair is lost.
4. A pair is verified where it meets first (deepest prefix, then least tree) only. Rows without a pair of
   their own ship nothing; for the rest, shingle sets are compared exactly inside the task. Pairs aren't
   rows: a task returns each node's number of links and its root in the task's links.
5. Roots are joined up by connected components; every document gets its class and number of links.
6. Where classes alone are asked for (``drop_near_duplicates``), pairs whose nodes are in one class already
   aren't compared, whether or not they are similar, so that a large group of near copies isn't sent to all
   pairs of its blocks: each block is compared within itself first; then the nodes outside of a prefix's
   largest class visit the other blocks. A prefix of n nodes, k of them outside, makes about n + k * blocks
   rows. As pairs are left out, there is no estimate of recall: prefixes are shortened to the last depth.

Defined cases: texts without words (NULL, blank) have no links, each is its own class; a NULL doc_id has
a NULL class and no links; every other row of the same or similar words counts as a link, whether or not
it repeats a doc_id; texts of one doc_id that differ are compared each for itself; very long texts are
hashed whole, by parts; other columns of the input, whatever their names, are not touched; an empty table
gives an empty result. Results don't depend on row order or partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalog_lake.llm.common import groups_for
from catalog_lake.llm.graph import components
from catalog_lake.session import materialise

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 5
RECALL = 0.999999
#: Nodes of one block of a prefix; two blocks are compared in one task.
BLOCK = 512
SEED = 11

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fixed value: an odd multiplier whose powers are the coefficients of a word's hash.
BASE = 0x9E3779B97F4A7C15


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of ``threshold`` meets in some tree with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64 to the powers 0 to n - 1."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers; tables of the common lengths are kept."""
    return _powers(1 << 18 if n <= 1 << 18 else n)


@lru_cache(maxsize=4)
def hash_factors(trees: int, depth: int) -> np.ndarray:
    """Odd multipliers of the MinHash functions, one for each tree and level."""
    drawn = np.random.default_rng(SEED).integers(0, 1 << 63, size=(trees, depth), dtype=np.uint64)
    return drawn * np.uint64(2) + np.uint64(1)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the maximal runs of bytes outside 0x20 and 0x09-0x0D, in order."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(raw))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Ascending distinct hashes of the text's word n-grams; of all its words if there are fewer; none without words."""
    w = word_hashes(np.frombuffer(text.encode(), dtype=np.uint8))
    if not len(w):
        return w
    n = min(n, len(w))
    total = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mixed(total * np.uint64(3) + w[k : len(w) - n + 1 + k])
    return np.unique(total)


def signature(shingles: np.ndarray, depth: int = DEPTH, trees: int = TREES) -> np.ndarray:
    """The upper halves of ``depth`` MinHashes for each tree, tree by tree."""
    factors = hash_factors(trees, depth).reshape(-1, 1)
    least = np.full(trees * depth, MASK)
    for first in range(0, len(shingles), 4096):  # long texts by parts
        np.minimum(least, (shingles[None, first : first + 4096] * factors).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def text_key() -> Column:
    return F.unhex(F.md5("text"))


def signatures(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, text_key (16 bytes, of the text), words_key (16 bytes, of the sequence of words; NULL without words), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, made = [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text or "")
                keys.append(hashlib.blake2b(b" ".join(text.encode().split()), digest_size=16).digest() if len(found) else None)
                made.append(signature(found, depth) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(made, pa.list_(pa.int32()))], ["doc_id", "text_key", "words_key", "signature"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", text_key().alias("text_key")).mapInArrow(run, "doc_id bigint, text_key binary, words_key binary, signature array<int>")


def prefixes(depth: int, full: int = DEPTH, trees: int = TREES) -> Column:
    """The prefix of ``depth`` MinHashes in each tree, as a 64-bit hash."""
    return F.expr(f"transform(sequence(0, {trees - 1}), t -> xxhash64(t, slice(signature, t * {full} + 1, {depth})))")


def met_before(depth: int, full: int = DEPTH, trees: int = TREES) -> Column:
    """Per tree, 32 bits of what two rows of ``tree`` share if they met before: prefixes of ``depth`` in lower trees, of ``depth`` + 1 in the others (nothing at full depth)."""
    short = "cast(shiftright(shorter[t], 32) as int)"
    long = f"cast(shiftright(xxhash64(t, slice(signature, t * {full} + 1, {depth + 1})), 32) as int)" if depth < full else "cast(null as int)"
    return F.expr(f"filter(transform(sequence(0, {trees - 1}), t -> if(t < tree, {short}, {long})), x -> x is not null)")


def shared_prefixes(nodes: DataFrame, depth: int, full: int = DEPTH) -> DataFrame:
    """Rows (tree, prefix, node, n): the nodes of the prefixes that hold pairs which didn't meet at greater depth in this tree, and their number."""
    if depth < full:
        both = F.arrays_zip(prefixes(depth, full).alias("prefix"), prefixes(depth + 1, full).alias("child"))
        rows = nodes.select("node", F.posexplode(both).alias("tree", "x")).select("node", "tree", "x.prefix", "x.child")
        shared = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("first"), F.max("child").alias("last")).filter("first <> last").drop("first", "last")
        rows = rows.drop("child")
    else:
        rows = nodes.select("node", F.posexplode(prefixes(depth, full)).alias("tree", "prefix"))
        shared = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(shared.hint("merge"), ["tree", "prefix"])


def in_blocks(met: DataFrame, block: int) -> DataFrame:
    return met.withColumn("blocks", F.expr(f"(n + {block - 1}) div {block}")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")))


def prefix_members(nodes: DataFrame, depth: int, full: int = DEPTH, block: int | None = None) -> DataFrame:
    """Rows (tree, prefix, i, j, own, node, doc, copies, before): the nodes of each pair of blocks (i <= j) of the shared prefixes."""
    met = in_blocks(shared_prefixes(nodes, depth, full), block or BLOCK)
    met = met.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    met = met.select("tree", "prefix", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    known = nodes.select("node", "doc", "copies", "signature", prefixes(depth, full).alias("shorter"))
    joined = met.join(known.hint("merge"), "node")
    return joined.select("tree", "prefix", "i", "j", "own", "node", "doc", "copies", met_before(depth, full).alias("before"))


def class_members(met: DataFrame, nodes: DataFrame, depth: int, full: int = DEPTH) -> DataFrame:
    """Shared prefixes' rows with what comparisons need of the nodes, ``label`` (the least node of the class so far) included."""
    known = nodes.select("node", "doc", "copies", "label", "signature", prefixes(depth, full).alias("shorter"))
    return met.join(known.hint("merge"), "node").withColumn("before", met_before(depth, full)).drop("signature", "shorter")


def resident_members(members: DataFrame, block: int | None = None) -> DataFrame:
    """Each block of a prefix by itself, as i = j."""
    rows = in_blocks(members, block or BLOCK)
    return rows.withColumn("i", F.col("own")).withColumn("j", F.col("own")).withColumn("core", F.lit(False))


def visiting_members(members: DataFrame, block: int | None = None) -> DataFrame:
    """The blocks i of a prefix with the nodes of other blocks that visit them: those outside of the prefix's largest class (not ``core``), in parts j = -1, -2, …"""
    block = block or BLOCK
    sizes = members.groupBy("tree", "prefix", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("tree", "prefix").agg(F.max(F.struct("size", "label")).alias("most"), F.sum("size").alias("total"))
    largest = largest.select("tree", "prefix", F.col("most.label").alias("largest"), F.expr(f"(total - most.size + {block - 1}) div {block}").alias("parts")).filter("parts > 0")
    rows = in_blocks(members, block).join(largest.hint("merge"), ["tree", "prefix"]).withColumn("core", F.expr("label = largest"))
    residents = rows.withColumn("i", F.col("own")).withColumn("j", F.explode(F.expr("sequence(-parts, -1L)")))
    visitors = rows.filter("not core").withColumn("i", F.explode(F.expr("sequence(0L, blocks - 1)"))).filter("i <> own")
    return residents.unionByName(visitors.withColumn("j", -1 - F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.col("parts"))))


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns, and the number of rows."""
    change = np.zeros(len(columns[0]), dtype=bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), len(change))


def fresh_pairs(before: np.ndarray, own: np.ndarray, across: bool) -> np.ndarray:
    """Upper matrix of the pairs of a prefix's rows that haven't met before; of different blocks only if ``across``."""
    met = own[:, None] == own[None, :] if across else np.zeros((len(own), len(own)), dtype=bool)
    for column in before.T:
        met |= column[:, None] == column[None, :]
    return np.triu(~met, 1)


def visits(own: np.ndarray, block: int, core: np.ndarray) -> np.ndarray:
    """Matrix of the pairs of a block's node and a visitor; of two nodes that visit each other's block the one of the lower block counts."""
    here = own == block
    pairs = here[:, None] & ~here[None, :] & (core[:, None] | (own[None, :] < block))
    return pairs | pairs.T


def sorted_table(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by([(c, "ascending") for c in ("tree", "prefix", "i", "j", "node")]).combine_chunks()
    return table, group_bounds(*(table.column(c).to_numpy() for c in ("tree", "prefix", "i", "j")))


def by_prefix(table: pa.Table, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Begin, end and fresh pairs of each pair of blocks of a sorted table."""
    lists = table.column("before").combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    label, core = (table.column(c).to_numpy() if c in table.column_names else None for c in ("label", "core"))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        fresh = fresh_pairs(flat[ends[a] : ends[b]].reshape(b - a, -1), own[a:b], i[a] != j[a])
        if label is not None:
            fresh &= label[a:b, None] != label[None, a:b]
        if j[a] < 0:
            fresh &= visits(own[a:b], i[a], core[a:b])
        yield a, b, fresh


def with_work(key: tuple, table: pa.Table) -> pa.Table:
    """The rows that have a pair of their own."""
    del key
    table, bounds = sorted_table(table)
    keep = np.zeros(len(table), dtype=bool)
    for a, b, fresh in by_prefix(table, bounds):
        keep[a:b] = fresh.any(axis=0) | fresh.any(axis=1)
    return table.filter(pa.array(keep)).cast(pa.schema([f if f.name != "before" else pa.field("before", pa.list_(pa.int32())) for f in table.schema]))


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a[k] and b[k]."""
    out = np.zeros(len(a), dtype=np.int64)
    sizes = np.array([len(s) for s in sets])
    cost = np.cumsum(sizes[a] + sizes[b])
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + 2_000_000)))
        pair = np.arange(first, last)
        used, place = np.unique(np.concatenate((a[first:last], b[first:last])), return_inverse=True)
        codes = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)[1]
        ends = np.cumsum(sizes[used])
        starts = ends - sizes[used]
        chosen = np.concatenate([np.arange(starts[p], ends[p]) for p in place])
        tagged = np.repeat(np.tile(pair - first, 2), sizes[used][place]) << 32 | codes[chosen]
        tagged.sort()
        out[first:last] = np.bincount((tagged[1:] >> 32)[tagged[1:] == tagged[:-1]], minlength=last - first)
        first = last
    return out


def shared_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all of a block's sets, by products of incidence matrices a few columns at a time."""
    n, sizes = len(sets), [len(s) for s in sets]
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    rows, codes = rows[counts[codes] > 1], codes[counts[codes] > 1]
    _, codes = np.unique(codes, return_inverse=True)
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    total, width = np.zeros((n, n), dtype=np.float32), 4096
    for first in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        lo, hi = np.searchsorted(codes, (first, first + width))
        part = np.zeros((n, width), dtype=np.float32)
        part[rows[lo:hi], codes[lo:hi] - first] = 1
        total += part @ part.T
    return total


def linked(table: pa.Table, bounds: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of a sorted table's pairs that reach the threshold, and their similarity; each pair of nodes once."""
    sets = [np.frombuffer(s, dtype="<u8") for s in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    few: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b, fresh in by_prefix(table, bounds):
        x, y = np.nonzero(fresh)
        small, large = np.minimum(sizes[a + x], sizes[a + y]), np.maximum(sizes[a + x], sizes[a + y])
        possible = small >= threshold * large - 1e-9
        x, y = x[possible], y[possible]
        if len(x) <= 8 * (b - a):  # pair by pair costs less than all pairs at once
            few.append((x + a, y + a))
            continue
        both = shared_matrix(sets[a:b])[x, y]
        whole = sizes[a + x] + sizes[a + y] - both
        hit = both >= threshold * whole - 1e-9
        yield a + x[hit], a + y[hit], both[hit] / whole[hit]
    if few:
        x, y = (np.concatenate(s) for s in zip(*few, strict=True))
        both = shared_counts(sets, x, y)
        whole = sizes[x] + sizes[y] - both
        hit = both >= threshold * whole - 1e-9
        yield x[hit], y[hit], both[hit] / whole[hit]


def missed_share(similarity: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """For each link found by matching to ``depth``, how many of its similarity are missed, on average."""
    missed = (1 - similarity**depth) ** trees
    return missed / (1 - missed)


def count_links(threshold: float, full: int = DEPTH):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        del key
        table, bounds = sorted_table(table)
        node, doc = table.column("node").to_numpy(), table.column("doc").to_numpy()
        order = np.lexsort((node, doc))
        change = np.append(False, node[order][1:] != node[order][:-1])
        place = np.empty(len(node), dtype=np.int64)
        place[order] = np.cumsum(change)  # number of the row's node, by (doc, node)
        n = int(place.max()) + 1 if len(place) else 0
        nodes, docs, copies = (np.zeros(n, dtype=np.int64) for _ in range(3))
        nodes[place], docs[place], copies[place] = node, doc, table.column("copies").to_numpy()
        links, root, missed = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros((n, full))
        pairs = np.zeros(n, dtype=np.int64)

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for x, y, s in linked(table, bounds, threshold):
            x, y = place[x], place[y]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            np.add.at(pairs, x, 1)
            for d in range(full):
                np.add.at(missed[:, d], x, missed_share(s, d + 1))
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                p, q = find(a), find(b)
                if p != q:
                    root[max(p, q)] = min(p, q)
        hit = np.flatnonzero(links)
        roots = np.array([find(k) for k in hit.tolist()], dtype=np.int64)
        columns = {"node": nodes[hit], "doc": docs[hit], "root": nodes[roots], "root_doc": docs[roots], "links": links[hit], "pairs": pairs[hit]}
        return pa.table(columns | {"missed": pa.array(list(missed[hit]), pa.list_(pa.float64()))})

    return run


MEMBER = "tree int, prefix bigint, i bigint, j bigint, own bigint, node bigint, doc bigint, copies bigint, before array<int>"


class Comparison:
    """Exact comparison of rows of members: (node, doc, root, root_doc, links, pairs, missed) of every task that found links."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, threshold: float, schema: str = MEMBER) -> None:
        self.nodes, self.threshold, self.schema = nodes, threshold, schema
        self.groups = 4 * max(groups_for(docs, "text"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), text_key().alias("text_key"), "text")

    def __call__(self, members: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("tree", "prefix", "i", "j"), F.lit(self.groups)).cast("int")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [shingle_set(t or "").astype("<u8").tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], ["node", "shingles"])

        order = [x.split()[0] for x in self.schema.split(", ")]
        work = materialise(members.select(*order).groupBy(part.alias("part")).applyInArrow(with_work, self.schema), "members")
        needed = self.nodes.select("node", "doc", "text_key").join(work.select("node").distinct().hint("merge"), "node", "left_semi")
        # a row that is repeated is sent once: the semi-join comes before the aggregate
        some = self.texts.join(needed.select("doc", "text_key").hint("merge"), ["doc", "text_key"], "left_semi")
        once = some.groupBy("doc", "text_key").agg(F.min("text").alias("text")).join(needed.hint("merge"), ["doc", "text_key"]).select("node", "text")
        shipped = work.join(once.mapInArrow(sets, "node bigint, shingles binary").hint("merge"), "node").withColumn("part", part)
        result = "node bigint, doc bigint, root bigint, root_doc bigint, links bigint, pairs bigint, missed array<double>"
        return materialise(shipped.groupBy("part").applyInArrow(count_links(self.threshold), result), "links")


def forest_links(docs: DataFrame, nodes: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """(node, doc, root, root_doc, links) of every comparison that found links: from full depth up, until the estimated recall is the target."""
    compared = Comparison(docs, nodes, threshold)
    found: DataFrame | None = None
    for depth in range(DEPTH, 0, -1):
        level = compared(prefix_members(nodes, depth))
        found = level if found is None else found.unionByName(level)
        sums = [F.sum("pairs").alias("pairs"), *(F.sum(F.element_at("missed", d)).alias(f"m{d}") for d in range(1, depth + 1))]
        seen = found.agg(*sums).first()
        enough = bool(seen["pairs"]) and seen[f"m{depth}"] <= (1 - recall) * (seen["pairs"] + seen[f"m{depth}"])
        if enough or depth == prefix_depth(threshold, TREES, DEPTH, recall):
            break
    return found


def class_links(docs: DataFrame, nodes: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """As forest_links, to the last depth, without the links between nodes whose class is known by others."""
    compared = Comparison(docs, nodes, threshold, f"{MEMBER}, label bigint, core boolean")
    labelled, found = nodes.withColumn("label", F.col("node")), None
    for depth in range(DEPTH, prefix_depth(threshold, TREES, DEPTH, recall) - 1, -1):
        met = materialise(shared_prefixes(nodes, depth), "prefixes")
        level = compared(resident_members(class_members(met, labelled, depth)))
        found = level if found is None else found.unionByName(level)
        large = met.filter(F.col("n") > BLOCK)
        if not large.isEmpty():
            labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "label")
            labelled = nodes.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
            members = materialise(class_members(large, labelled, depth), "large")
            found = found.unionByName(compared(visiting_members(members)))
    return found


def forest_classes(docs: DataFrame, threshold: float, found_by=forest_links) -> tuple[DataFrame, DataFrame]:
    """(signatures of every row; one row per node: words_key, node, doc and text_key of its least row, copies, links (of those that ``found_by`` counts), root, class)."""
    sigs = materialise(signatures(docs), "signatures")
    known = sigs.filter("doc_id is not null and words_key is not null")
    nodes = known.groupBy("words_key").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    nodes = nodes.select("words_key", F.monotonically_increasing_id().alias("node"), F.col("least.doc_id").alias("doc"), "least.text_key", "copies", "signature")
    nodes = materialise(nodes, "nodes")
    found = found_by(docs, nodes, threshold)
    classes = components(found.select(F.struct("doc", "node").alias("a"), F.struct(F.col("root_doc").alias("doc"), F.col("root").alias("node")).alias("b")))
    classes = classes.select(F.col("node.node").alias("node"), F.col("component.node").alias("root"), F.col("component.doc").alias("class"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    return sigs, nodes.drop("signature").join(counts, "node", "left").join(classes, "node", "left")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and n_links (other documents of at least the threshold) for every row."""
    sigs, nodes = forest_classes(docs, threshold)
    facts = nodes.select("words_key", F.coalesce("class", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = sigs.select("doc_id", "words_key").join(facts.hint("merge"), "words_key", "left")
    there = F.col("doc_id").isNotNull()
    return joined.select("doc_id", F.when(there, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(there, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that of the least doc_id, and of the least text hash among texts of that id.

    Rows that repeat a doc_id and its text are one document, of which any one row stays: they meet within
    their tasks first, so that a row that repeats very often isn't shuffled whole. Texts without words are
    each their own class. Rows without a doc_id all stay.
    """
    sigs, nodes = forest_classes(docs, threshold, class_links)
    first = nodes.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc", "text_key")).alias("least")).select("least.*")
    blank = sigs.filter("doc_id is not null and words_key is null").select(F.col("doc_id").alias("doc"), "text_key").distinct()
    kept = first.unionByName(blank).select(F.col("doc").alias("__doc"), F.coalesce("text_key", F.lit(b"")).alias("__key"))
    rows = docs.filter("doc_id is not null").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("doc_id").cast("bigint").alias("__doc"), F.coalesce(text_key(), F.lit(b"")).alias("__key"))
    unique = rows.dropDuplicates(["__doc", "__key"]).join(kept.hint("merge"), ["__doc", "__key"], "left_semi")
    return unique.select("__row.*").unionByName(docs.filter("doc_id is null"))
