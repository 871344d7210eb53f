"""Hard negatives: for anchors and their nearest rows of the same label, rows of other labels just below in score.

Scores are inner products of vectors of integers (components times SCALE, rounded down), so that they are exact.

1. Anchors are clustered by direction: centres are fitted on SAMPLE_ANCHORS anchors at most, every anchor goes to
   its nearest centre, and a cluster is cut into packs of PACK_ROWS anchors.
2. Candidates, all rows, are dealt to blocks of BLOCK_ROWS by their position, whatever their values, and stored.
3. Every anchor meets every block: anchors, a hundredth of the rows, are what is shipped, sorted by cluster behind the
   block's candidates, so that a task holds one block and one pack at a time. For each cluster it sorts its block once by
   the angular upper bound of a candidate for any member: with t the cluster's largest angle to its centre
   and c the candidate's, norm * cos(max(0, c - t)), times the anchor's norm. All members walk that list
   together, some hundred candidates at a step; a member stops when the bound of what follows is below what
   could still change its result, and so each list gives its exact part of the answer.
4. The walk is done twice. The first finds the best rows of the same label; the parts of all blocks meet in a
   ranked merge. The second, knowing the positives' scores, finds the first rows of other labels in each
   positive's window of scores; it stops at the lowest window's end at the latest.

Order: higher scores first, then smaller vec_id, NULL last. Defined cases: rows with a NULL label, a NULL vector or a NULL
or non-finite component take no part, nor do rows whose squared norm would pass 2**62, as scores are 64-bit integers;
vectors of different length aren't compared; an empty or zero vector has score 0 with all others. Repeated rows are
candidates each; an anchor that repeats in all of vec_id, label and vector is one anchor, and its repeats are its other
rows. A NULL vec_id is no anchor. An anchor without positives, a positive without negatives give no row. An
empty table gives an empty result. Other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catalog_lake.session import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Negatives score between these percentages of their positive's score.
LOW_PERCENT, HIGH_PERCENT = 80, 100
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
#: Centres are fitted on so many anchors at most, the first by a hash; every anchor is then assigned.
SAMPLE_ANCHORS = 4096
#: Centres: one for so many sampled anchors.
ANCHORS_PER_CENTRE = 64
ROUNDS = 8
PACK_ROWS, BLOCK_ROWS = 256, 8192
#: Candidates of a list taken at a step.
STEP = 1024
SEED = 13
#: Added to cosines in bounds: arc cosines near 1 are good to some 1e-8.
SLACK = 1e-6
NO_ID = np.iinfo(np.int64).max


# ---- rows


def shifted_label(label: Column, vec_id: Column) -> Column:
    """The label after the dealt shift: rows of every SHIFT_EVERY-th vec_id get the next one."""
    return F.when(vec_id % SHIFT_EVERY == 0, (label + 1) % LABELS).otherwise(label).cast("bigint")


def integer_rows(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label, vector (integers): the rows that take part, stored."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2)))
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound).filter(squares < 2.0**62)
    label, vec_id = F.col("label").cast("bigint"), F.col("vec_id").cast("bigint")
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"), label.alias("label"), whole.alias("vector")), "vectors")


# ---- clusters of anchors


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and norms."""
    plain = vectors.astype(np.float64)
    norms = np.sqrt((plain**2).sum(axis=1))
    return plain / np.where(norms == 0, 1, norms)[:, None], norms


def fit_centres(units: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spread starts."""
    centres = units[np.linspace(0, len(units) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        owner = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, units)
        moved, norms = directions(sums)
        centres = np.where(norms[:, None] > 0, moved, centres)
    return centres


def stacked(vectors: list, width: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in vectors], dtype=np.int64).reshape(len(vectors), width)


def sample_centres(anchors: DataFrame) -> dict[int, np.ndarray]:
    """Centres for each length of vector, fitted on SAMPLE_ANCHORS anchors at most."""
    sample = anchors.orderBy(F.xxhash64("vec_id", "label", "vector"), "row").limit(SAMPLE_ANCHORS).select("vector").toPandas()["vector"]
    centres = {}
    for width in sorted({len(v) for v in sample}):
        units, _ = directions(stacked([v for v in sample if len(v) == width], width))
        centres[width] = fit_centres(units, math.ceil(len(units) / ANCHORS_PER_CENTRE))
    return centres


def clustered(anchors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``anchors`` plus width, cluster, pack and widest (the cluster's largest angle to its centre), stored. A width without centres is one cluster."""

    @F.pandas_udf("struct<cluster: bigint, angle: double>")
    def nearest(vector: pd.Series) -> pd.DataFrame:
        widths = vector.map(len)
        out = pd.DataFrame({"cluster": np.zeros(len(vector), dtype=np.int64), "angle": np.full(len(vector), np.pi / 2)})
        for width in set(widths) & set(centres):
            at = np.flatnonzero(widths == width)
            near = directions(stacked(list(vector.iloc[at]), width))[0] @ centres[width].T
            out.iloc[at, 0] = near.argmax(axis=1)
            out.iloc[at, 1] = np.arccos(np.clip(near.max(axis=1), -1, 1))
        return out

    placed = materialise(anchors.withColumn("width", F.size("vector")).withColumn("c", nearest("vector")).select(*anchors.columns, "width", "c.*"), "anchors")
    sizes = placed.groupBy("width", "cluster").agg(F.count(F.lit(1)).alias("__rows"), F.max("angle").alias("widest"))
    pack = F.pmod(F.xxhash64("row"), F.ceil(F.col("__rows") / PACK_ROWS)).cast("int")
    # a row for each centre, or length of vector that the sample lacks
    return materialise(placed.join(sizes, ["width", "cluster"]).withColumn("pack", pack).drop("__rows", "angle"), "anchors")


# ---- lists


class Block:
    """Candidates of one width, read once; ``by_rank`` leads from a rank to a candidate."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.units, self.norms = directions(vectors)
        # ties in score go by vec_id, so its rank counts down: the larger is the earlier
        self.by_rank = np.argsort(ids, kind="stable")[::-1]
        self.rank = np.empty(len(ids), dtype=np.int64)
        self.rank[self.by_rank] = np.arange(len(ids))
        self.bits = max(1, len(ids).bit_length())
        self.lists: dict[int, SharedList] = {}

    def shared(self, cluster: int, centre: np.ndarray, widest: float) -> SharedList:
        if cluster not in self.lists:
            self.lists = {cluster: SharedList(self, centre, widest)}  # clusters come sorted: the last one's list is enough
        return self.lists[cluster]


class SharedList:
    """A block's candidates in the order of a cluster's upper bound."""

    def __init__(self, block: Block, centre: np.ndarray, widest: float) -> None:
        angle = np.arccos(np.clip(block.units @ centre, -1, 1))
        bound = block.norms * np.minimum(1, np.cos(np.clip(angle - widest, 0, np.pi)) + SLACK)
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]
        self.vectors, self.floats = block.vectors[self.order], block.vectors[self.order].astype(np.float64)
        self.labels, self.rows, self.rank = block.labels[self.order], block.rows[self.order], block.rank[self.order]


class Pack:
    """Anchors of one cluster."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.labels, self.vectors = rows, labels, vectors
        self.norms = directions(vectors)[1]


def keys_of(pack: Pack, members: np.ndarray, listed: SharedList, at: slice, block: Block) -> np.ndarray:
    """A key for each (anchor, candidate): score, then rank. Exact: floating point where products fit 52 bits, else integers, of Python where keys pass 64 bits."""
    largest = float(pack.norms[members].max(initial=0)) * float(block.norms.max(initial=0))
    if largest < 2.0**52:
        score = (pack.vectors[members].astype(np.float64) @ listed.floats[at].T).astype(np.int64)
    else:
        score = pack.vectors[members] @ listed.vectors[at].T
    if largest >= 2.0 ** (62 - block.bits):
        score = score.astype(object)
    return score * (1 << block.bits) + listed.rank[at]


def merged(best: np.ndarray, keys: np.ndarray, ok: np.ndarray, none: int) -> np.ndarray:
    """The largest k of ``best`` (rows of k keys, falling) and the keys that are ``ok``."""
    k = best.shape[-1]
    new = np.where(ok, keys, none)
    if new.shape[-1] > k:
        new = np.partition(new, new.shape[-1] - k, axis=-1)[..., -k:] if new.dtype != object else np.sort(new, axis=-1)[..., -k:]
    return np.sort(np.concatenate([best, new], axis=-1), axis=-1)[..., ::-1][..., :k]


def walk_list(pack: Pack, block: Block, listed: SharedList, windows: np.ndarray | None, k: int) -> tuple[np.ndarray, int, int]:
    """For each anchor its best k keys of this list, and how many (anchor, candidate) pairs were scored.

    Without windows: among other rows of the same label, one set for each anchor. With windows, an (anchors, w, 2)
    array of least and greatest scores (least above greatest: none): among rows of other labels, a set for each window.
    """
    n, sets = len(pack.rows), 1 if windows is None else windows.shape[1]
    big = float(pack.norms.max(initial=0)) * float(block.norms.max(initial=0)) >= 2.0 ** (62 - block.bits)
    none = -(1 << 90) if big else np.iinfo(np.int64).min
    best = np.full((n, sets, k), none, dtype=object if big else np.int64)
    active, scored = np.arange(n), 0
    for low in range(0, len(listed.bound), STEP):
        # nothing that follows scores above this
        most = listed.bound[low] * pack.norms[active] * (1 + SLACK) + SLACK
        last = np.where(best[active, :, -1] == none, -np.inf, (best[active, :, -1] >> block.bits).astype(np.float64))
        open_ = most[:, None] >= last
        if windows is not None:
            open_ &= (windows[active, :, 0] <= windows[active, :, 1]) & (most[:, None] >= windows[active, :, 0].astype(np.float64))
        active = active[open_.any(axis=1)]
        if not len(active):
            break
        at = slice(low, low + STEP)
        keys = keys_of(pack, active, listed, at, block)
        scored += keys.size
        same = listed.labels[at][None, :] == pack.labels[active][:, None]
        if windows is None:
            best[active, 0] = merged(best[active, 0], keys, same & (listed.rows[at][None, :] != pack.rows[active][:, None]), none)
        else:
            score = keys >> block.bits
            for i in range(sets):
                fits = ~same & (score >= windows[active, i, 0][:, None]) & (score <= windows[active, i, 1][:, None])
                touched = np.flatnonzero(fits.any(axis=1))
                if len(touched):
                    best[active[touched], i] = merged(best[active[touched], i], keys[touched], fits[touched], none)
    return best, none, scored


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole runs of equal keys of sorted rows."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        for part in np.split(np.arange(len(frame)), np.flatnonzero(new)[1:]):  # the first row is always new
            if not len(part):
                continue
            piece = frame.iloc[part]
            if held and tuple(held[0][keys].iloc[0]) != tuple(piece[keys].iloc[0]):
                yield tuple(held[0][keys].iloc[0]), pd.concat(held)
                held = []
            held.append(piece)
    if held:
        yield tuple(held[0][keys].iloc[0]), pd.concat(held)


def meet(candidates: DataFrame, anchors: DataFrame, centres: dict[int, np.ndarray], windowed: bool, k: int) -> DataFrame:
    """anchor_row, place (of the window), score, vec_id, row: each list's first k for each anchor, or each of its windows; scored, the pairs that were."""
    blocks = max(1, math.ceil(candidates.count() / BLOCK_ROWS))
    # row is a number of its own for every row, so that blocks are even whatever repeats
    left = candidates.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.size("vector").alias("width"), F.lit(-1).cast("bigint").alias("cluster"), F.lit(0).alias("pack"), F.lit(0.0).alias("widest"), "row", "vec_id", "label", "vector", F.lit(None).cast("array<bigint>").alias("windows"))
    windows = F.col("windows") if windowed else F.lit(None).cast("array<bigint>").alias("windows")
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "width", "cluster", "pack", "widest", "row", "vec_id", "label", "vector", windows)
    order = ["block", "width", "kind", "cluster", "pack"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, where = None, None
        for (number, width, kind, cluster, _), rows in _runs(frames, order):
            vectors = stacked(rows["vector"].to_list(), width)
            if kind == 0:
                ids = np.array([NO_ID if pd.isna(v) else v for v in rows["vec_id"]], dtype=np.int64)
                block, where = Block(rows["row"].to_numpy(), ids, rows["label"].to_numpy(), vectors), (number, width)
                continue
            if where != (number, width):  # no candidates of that width here
                continue
            pack = Pack(rows["row"].to_numpy(), rows["label"].to_numpy(), vectors)
            centre = centres[width][cluster] if width in centres else np.zeros(width)
            spans = None
            if windowed:
                most = max(len(w) for w in rows["windows"])
                spans = np.array([[*((-(-LOW_PERCENT * int(p) // 100), HIGH_PERCENT * int(p) // 100) for p in w), *[(1, 0)] * (most - len(w))] for w in rows["windows"]], dtype=np.int64)
            best, none, scored = walk_list(pack, block, block.shared(cluster, centre, rows["widest"].iloc[0]), spans, k)
            a, place, slot = np.nonzero(best != none)
            key = best[a, place, slot]
            at = block.by_rank[(key & ((1 << block.bits) - 1)).astype(np.int64)]
            ids = pd.Series(block.ids[at]).astype("Int64").mask(block.ids[at] == NO_ID)
            yield pd.DataFrame({"anchor_row": pack.rows[a], "place": place.astype(np.int32), "score": (key >> block.bits).astype(np.int64), "vec_id": ids, "row": block.rows[at], "scored": np.where(np.arange(len(a)) == 0, scored, 0)})

    dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions(*order)
    return dealt.mapInPandas(run, "anchor_row bigint, place int, score bigint, vec_id bigint, row bigint, scored bigint")


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key, with rank. Spark keeps k of each key in every task before it shuffles."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors, a part of them: row, vec_id, label, vector (integers), as ``integer_rows`` gives them.
    """
    once = anchors.groupBy("vec_id", "label", "vector").agg(F.min("row").alias("row"))
    centres = sample_centres(once)
    placed = clustered(once.select("row", "vec_id", "label", "vector"), centres)
    near = materialise(first_of(meet(rows, placed, centres, False, positives), ["anchor_row"], positives), "positives")
    pairs = near.select(F.col("anchor_row").alias("row"), (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # k positives of an anchor at most
    scores = pairs.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("windows"))
    found = first_of(meet(rows, placed.join(scores, "row"), centres, True, negatives), ["anchor_row", "place"], negatives)
    named = found.select(F.col("anchor_row").alias("row"), "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = placed.select("row", F.col("vec_id").alias("anchor_id"))
    return named.join(pairs, ["row", "place"]).join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mining_report(embeddings: DataFrame) -> DataFrame:
    rows = integer_rows(embeddings.withColumn("label", shifted_label(F.col("label"), F.col("vec_id"))))
    return mine(rows, rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0))


#: DuckDB SQL for the query over embeddings.
ORACLE = f"""
with r as (select row_number() over () as row, vec_id, cast(case when vec_id % {SHIFT_EVERY} = 0 then (label + 1) % {LABELS} else label end as bigint) as label,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.row as anchor, a.vec_id as anchor_id, b.row, b.vec_id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from r a join r b on a.row <> b.row and len(a.v) = len(b.v) where a.vec_id % {ANCHOR_EVERY} = 0),
p as (select * from (select *, row_number() over (partition by anchor order by score desc, vec_id, row) as k from s where same) where k <= {POSITIVES}),
n as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor, p.k order by s.score desc, s.vec_id, s.row) as rank
  from p join s on s.anchor = p.anchor and not s.same and {LOW_PERCENT} * p.score <= 100 * s.score and 100 * s.score <= {HIGH_PERCENT} * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
