"""Mixing sources to target weights, by fixed-length blocks and index permutations.

1. Each source's documents are laid end to end; its word stream is cut into blocks of BLOCK_WORDS words.
   Offsets are two-level running sums over (source, hash bucket), so no task holds a whole source.
2. Targets: ``epochs`` times all words, shared by weight, none above ``most`` times its source; what a
   capped source can't take is shared again among the rest.
3. A source's target gives block slots: whole passes over its blocks, then some of them, the last of which
   is cut to the words that are still missing. The output shards' source counts are multinomial
   draws conditioned on those totals (``draw_counts``): the slots of all sources are dealt to the shards'
   places through one pseudorandom permutation, and a shard's count of a source is how many it was dealt.
   Unconditioned draws would leave sources off their targets by sampling noise and capped ones above
   their caps.
4. Slot j of a source maps to block ``permutation(j mod blocks)`` of the source's own permutation; each pass
   over the source permutes anew.
5. Slots are joined to blocks by (source, index).

Permutations are swap-or-not shuffles: every round pairs x with K - x and swaps by a hash bit, a
bijection for any length. Everything is column expressions: no user functions, nothing collected, no
broadcast. Keys of every exchange are spread within a source, so a source may hold most of the rows, and
NULL ids are spread by their texts. The windows over the plan have one row per source, in one task: that
suits thousands of sources, not one for each site of a crawl.

Defined cases: a NULL text has size 0; NULL source is a source of its own, last; documents without words
are taken 0 times; repeated rows are mixed as separate documents, each with a place of its own; rows that
tie in doc_id and text are alike and may swap places; very long texts span many blocks; a source shorter
than a block is one short block; other
columns of the input, whatever their names, are carried or not touched; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catalog_lake.llm.common import words
from catalog_lake.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 1.5
MOST = 2.0
#: Words in a block.
BLOCK_WORDS = 128
#: Blocks in an output shard.
SHARD_BLOCKS = 4096
ROUNDS = 24
SEED = 20_240_501
#: Documents per bucket of the running sums, about.
BUCKET_ROWS = 1024


def permuted(x: str, n: str, salt: str, inverse: bool = False) -> Column:
    """Pseudorandom bijection of [0, n): column expressions x and n, and a salt that picks the bijection."""
    rounds = f"reverse(sequence(1, {ROUNDS}))" if inverse else f"sequence(1, {ROUNDS})"
    partner = f"pmod(pmod(xxhash64({SEED}, {salt}, r), {n}) - v, {n})"
    return F.expr(
        f"aggregate({rounds}, cast({x} as bigint), (v, r) -> if(pmod(xxhash64({SEED}, {salt}, r, greatest(v, {partner})), 2L) = 1L, {partner}, v))"
    )


def source_key(source: Column) -> Column:
    """A join key without NULLs: empty for the NULL source, else the source after a mark."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """(skey, source_size) plus target: weights repeat over the sources in code point order, NULL last.

    A source is capped iff its cap per weight lies under the level that the uncapped ones reach; with the
    sources in order of that ratio, the level after k capped ones is (all - caps of k) / (weights of the rest).
    The windows run over one row per source.
    """
    by_name = W.orderBy(F.col("skey") == "", "skey")
    listed = sizes.withColumn("__weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    listed = listed.withColumn("__cap", F.lit(float(most)) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    by_ratio = W.orderBy("__ratio", "skey")
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.lit(float(epochs)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(rest)
    listed = listed.withColumn("__level", level).withColumn("__final", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level"))).over(everything)["__level"])
    return listed.withColumn("target", F.least("__cap", F.coalesce(F.col("__final") * F.col("__weight"), F.col("__cap")))).select("skey", "source_size", "target")


def lay_out(docs: DataFrame, buckets: int, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in the source's stream, one row per source with its block plan).

    ``docs`` has doc_id, source, size and mark, a hash of the text. Places: skey, start (first word of the
    stream), source_size, target, block_words, blocks, slots.
    """
    bucketed = docs.withColumn("skey", source_key(F.col("source"))).drop("source").withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)).cast("int"))
    groups = bucketed.groupBy("skey", "__bucket").agg(F.sum("size").alias("__group_size"))
    sizes = groups.groupBy("skey").agg(F.sum("__group_size").alias("source_size"))
    plan = source_targets(sizes, weights, epochs, most).withColumn("block_words", F.lit(block_words).cast("bigint")).withColumn("blocks", F.expr("(source_size + block_words - 1) div block_words"))
    wanted = F.least(F.round("target"), F.lit(float(most)) * F.col("source_size")).cast("bigint")
    plan = plan.withColumn("__wanted", F.when(F.col("source_size") > 0, wanted).otherwise(0)).withColumn("__rest", F.expr("if(source_size > 0, pmod(__wanted, source_size), 0L)"))
    plan = plan.withColumn("slots", F.expr("if(source_size > 0, __wanted div source_size, 0L) * blocks + (__rest + block_words - 1) div block_words"))
    # words of the last slot: what the full blocks before it in its pass leave
    plan = plan.withColumn("last_words", F.expr("if(__rest > 0, pmod(__rest - 1, block_words) + 1, block_words)")).drop("__wanted", "__rest")
    by_name = W.orderBy(F.col("skey") == "", "skey").rowsBetween(W.unboundedPreceding, -1)
    plan = plan.withColumn("first_slot", F.coalesce(F.sum("slots").over(by_name), F.lit(0)).cast("bigint")).withColumn("all_slots", F.sum("slots").over(W.partitionBy()))
    # running sums over a source's buckets: as many rows as buckets, whatever the number of documents
    before = W.partitionBy("skey").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.withColumn("__offset", F.coalesce(F.sum("__group_size").over(before), F.lit(0))).drop("__group_size")
    offsets = offsets.join(plan.drop("first_slot", "all_slots", "last_words"), "skey")
    within = W.partitionBy("skey", "__bucket").orderBy("doc_id", "mark").rowsBetween(W.unboundedPreceding, -1)
    placed = bucketed.withColumn("__local", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets.hint("merge"), ["skey", "__bucket"])
    return placed.withColumn("start", (F.col("__offset") + F.col("__local")).cast("bigint")).drop("__bucket", "__local", "__offset"), plan


def draw_slots(plan: DataFrame, tasks: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """One row per slot of the mix: skey, pass, block, the words it takes of the block at most, and where it goes: shard, position.

    Slots are made from runs of 1024, spread over ``tasks`` tasks before they are expanded: a run is a few
    bytes, so that Spark would otherwise put all of them into one task.
    """
    runs = plan.filter("slots > 0").select("skey", "slots", "blocks", "block_words", "last_words", "first_slot", "all_slots", F.explode(F.expr("sequence(0L, (slots - 1) div 1024)")).alias("run"))
    runs = runs.repartition(tasks, "skey", "run")
    slots = runs.withColumn("j", F.explode(F.expr("sequence(run * 1024, least(slots, (run + 1) * 1024) - 1)")))
    slots = slots.withColumn("pass", F.expr("j div blocks")).withColumn("most_words", F.expr("if(j = slots - 1, last_words, block_words)"))
    block = permuted("pmod(j, blocks)", "blocks", "skey, pass")
    place = permuted("first_slot + j", "all_slots", "-1", inverse=True)
    placed = slots.select("skey", "pass", block.alias("block"), "most_words", place.alias("__place"))
    return placed.withColumns({"shard": F.expr(f"__place div {shard_blocks}"), "position": F.expr(f"pmod(__place, {shard_blocks})")}).drop("__place")


def draw_counts(plan: DataFrame, tasks: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, skey, n): how many blocks of each source every output shard takes."""
    return draw_slots(plan, tasks, shard_blocks).groupBy("shard", "skey").agg(F.count(F.lit(1)).alias("n"))


def pieces(placed: DataFrame) -> DataFrame:
    """One row for each part of a document that lies in one block: block, in_block (its place there), from_word, n_piece (words)."""
    spread = placed.filter("size > 0").withColumn("block", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")))
    begin = F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    return spread.withColumn("from_word", begin - F.col("start")).withColumn("n_piece", end - begin).withColumn("in_block", begin - F.col("block") * F.col("block_words"))


def words_taken(most: str) -> Column:
    """Words of a piece that lie in the first ``most`` words of its block."""
    return F.greatest(F.lit(0), F.least(F.col("n_piece"), F.col(most) - F.col("in_block")))


def bucket_count(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // BUCKET_ROWS))


def slot_tasks(docs: DataFrame, buckets: int) -> int:
    return max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard for each document of (doc_id, source, size, mark)."""
    buckets = bucket_count(docs)
    placed, plan = lay_out(docs, buckets, **settings)
    uses = draw_slots(plan, slot_tasks(docs, buckets)).groupBy("skey", "block", "most_words").agg(F.count(F.lit(1)).alias("uses"), F.min("shard").alias("shard"))
    # sizes before an explode say nothing here: without the hint Spark may take the uses for small and broadcast them
    joined = pieces(placed).join(uses.hint("merge"), ["skey", "block"], "left")
    key = ("skey", "start", "doc_id", "size", "source_size", "target")  # documents with words differ in start within a source
    some = joined.groupBy(*key).agg(F.sum(F.coalesce(F.col("uses") * words_taken("most_words"), F.lit(0))).cast("bigint").alias("taken"), F.min("shard").alias("first_shard"))
    none = placed.filter("size = 0").select(*key, F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("bigint").alias("first_shard"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mix_documents(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The mix as documents: for each pass over a source, what the mix takes of each document.

    A document of which all blocks are taken keeps its text; of others the words of the blocks taken are
    kept, space-joined, in order. Columns are those of ``docs`` (n_chars follows the text).
    """
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col("doc_id"), F.col("source"), F.size(words(F.col(f"`{text}`"))).cast("bigint").alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    buckets = bucket_count(docs)
    placed, plan = lay_out(rows, buckets, **settings)
    uses = draw_slots(plan, slot_tasks(docs, buckets)).select("skey", "block", "pass", "most_words")
    taken = pieces(placed.drop("__row")).join(uses.hint("merge"), ["skey", "block"]).withColumn("n_piece", words_taken("most_words")).filter("n_piece > 0")
    parts = taken.groupBy("skey", "start", "pass").agg(F.sum("n_piece").alias("__words"), F.sort_array(F.collect_list(F.struct("from_word", "n_piece"))).alias("__parts"))
    joined = parts.join(placed.filter("size > 0").select("skey", "start", "size", "__row").hint("merge"), ["skey", "start"])
    joined = joined.withColumn("__list", F.when(F.col("__words") < F.col("size"), words(F.col(f"__row.`{text}`"))))
    kept = F.when(F.col("__list").isNull(), F.col(f"__row.`{text}`")).otherwise(F.expr("array_join(flatten(transform(__parts, p -> slice(__list, int(p.from_word) + 1, int(p.n_piece)))), ' ')"))
    joined = joined.withColumn("__text", kept)
    fields = {text: F.col("__text")} | ({"n_chars": F.length("__text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in columns else {})
    return joined.select(*(fields.get(c, F.col(f"__row.`{c}`")).alias(c) for c in columns))


def mix_report(docs: DataFrame) -> DataFrame:
    """The report over documents; the words of each text are counted once, into a narrow stage."""
    return taken_words(materialise(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("mark")), "sizes"))
