"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space, and always the
least hash, so that no text with words has an empty sketch. Sketches of parts merge into the sketch of
the whole: union them (the least hash stays the least; hashes above the fraction other than it go).
Because the fraction is fixed, sketches of very unequal documents stay comparable: the share of the
small one's hashes that the large one has estimates containment, and the shared part of the union
estimates likeness (Jaccard).

Only column expressions. Defined cases: a text of fewer than five words has one
shingle, all its words; a text without words (NULL, blank) has an empty sketch, and two empty sketches
have likeness 1, one empty and one not 0; repeated words and rows change nothing; very long texts are
sketched whole. In the report documents are in descending order of doc_id, NULL ids last; rows of one id
follow by the hash of their texts, then by the texts, and are spread over ranges of that hash where the id
is frequent, so that neither NULL nor any other id fills one task. Ids may be as wide as bigint allows;
other columns of the input, whatever their names, are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catalog_lake.llm.common import groups_for, words

SHINGLE_WORDS = 5
#: One of so many hashes is kept, on average.
SCALE = 4
#: Percentile segments of doc_id, and first rows of ranges (24 bytes each) that are broadcast at most; more are joined by a shuffle.
SEGMENTS = 256
BROADCAST_ROWS = 3_000_000


def with_sketch(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` plus the sketch of ``text``; hashes are computed once."""
    limit = -(1 << 63) + (1 << 64) // SCALE
    shingle = ", ".join(f"get(__words, i + {k})" for k in range(SHINGLE_WORDS))
    kept = F.array_append(F.filter("__hashes", lambda h: h < F.lit(limit)), F.array_min("__hashes"))
    return (
        df.withColumn("__words", words(text))
        .withColumn("__hashes", F.expr(f"transform(sequence(0, greatest(size(__words) - {SHINGLE_WORDS}, 0)), i -> xxhash64({shingle}))"))
        .withColumn(name, F.when(F.size("__words") > 0, F.sort_array(F.array_distinct(kept))).otherwise(F.array().cast("array<bigint>")))
        .drop("__words", "__hashes")
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared part of the union of two sketches."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(part: Column, whole: Column) -> Column:
    """Share of the part's hashes that the whole has; 1 for an empty part."""
    return F.when(F.size(part) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def merged(sketches: Column, scale: int = SCALE) -> Column:
    """Sketch of the whole from an array of its parts' sketches."""
    limit = -(1 << 63) + (1 << 64) // scale
    every = F.flatten(sketches)
    return F.sort_array(F.array_distinct(F.filter(every, lambda h: (h < F.lit(limit)) | (h == F.array_min(every)))))


def printed(hashes: Column) -> Column:
    """A sketch as text: hashes in hex, comma-joined."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def doc_ranges(docs: DataFrame, ranges: int) -> Column:
    """Number of the range that a row lies in, ascending as doc_id descends and, within a frequent id, as __hash ascends.

    At most SEGMENTS segments of about equally many rows, by approximate percentiles, each cut into ranges
    of equal width. An id that bounds a segment may be frequent: it has a place of its own, which is cut by
    __hash, like the last place, that of NULL ids.
    """
    segments = min(ranges, SEGMENTS)
    each = -(-ranges // segments)
    row = docs.agg(F.percentile_approx("doc_id", [i / segments for i in range(segments + 1)], 20_000).alias("b"), F.avg(F.col("doc_id").isNull().cast("double")).alias("nulls")).first()
    found = row["b"] or [0]
    edges = sorted(set(found), reverse=True)  # at most SEGMENTS + 1 numbers
    # parts of a place by its share of the rows: about twice as many ranges as asked for, whatever the ids
    parts = F.array(*(F.lit(-(-ranges * found.count(e) // segments)) for e in edges))
    null_parts = int(ranges * (row["nulls"] or 0)) + 1
    cut = F.array(*(F.lit(int(e)).cast("bigint") for e in edges))
    segment = F.least(F.size(F.filter(cut, lambda e: e > F.col("doc_id"))), F.lit(len(edges)))
    high, low, at = (c.cast("double") for c in (F.get(cut, segment - 1), F.get(cut, segment), F.col("doc_id")))
    inner = F.coalesce(F.floor((high - at) * F.lit(float(each)) / F.nullif(high - low, F.lit(0.0))), F.lit(0))
    inner = F.greatest(F.lit(0), F.least(inner, F.lit(each)))
    edge = F.array_contains(cut, F.col("doc_id"))
    place = segment.cast("bigint") * (each + 2) + F.when(edge, F.lit(each + 1)).otherwise(inner)
    place = F.when(F.col("doc_id").isNull(), F.lit((len(edges) + 1) * (each + 2)).cast("bigint")).otherwise(place)
    most = F.when(F.col("doc_id").isNull(), F.lit(null_parts)).when(edge, F.get(parts, (F.array_position(cut, F.col("doc_id")) - 1).cast("int"))).otherwise(F.lit(1))
    part = F.least(F.floor((F.col("__hash") / F.lit(2.0**64) + F.lit(0.5)) * most), most - 1)
    return place * (2 * ranges + 2) + part.cast("bigint")


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (doc_id, text; no NULL text) plus fp and next: struct (text, fp) of the next row in descending doc_id, of the first row after the last.

    Rows are dealt once, to ranges in that order; within a range the next row is a window's lead. Every
    range also gets a copy of the first row of the range after it, behind its own rows, for its last row.
    """
    dealt = docs.withColumn("__hash", F.xxhash64("text"))
    dealt = dealt.withColumn("__range", doc_ranges(dealt, ranges))
    heads = dealt.groupBy("__range").agg(F.max("doc_id").alias("__head"))
    order = W.orderBy(F.col("__range").desc())  # one row per range
    heads = heads.withColumn("__into", F.coalesce(F.lag("__range", -1).over(order), F.max("__range").over(W.partitionBy())))
    if 3 * ranges + 3 * SEGMENTS <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    # a combining aggregate: of the rows of a range's first id, one a task is sent
    first = dealt.join(heads, (dealt["__range"] == heads["__range"]) & dealt["doc_id"].eqNullSafe(heads["__head"]))
    copies = first.groupBy("__into").agg(F.min(F.struct("__hash", "text")).alias("__first"))
    copies = copies.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("__first.text").alias("text"), F.col("__first.__hash").alias("__hash"), F.col("__into").alias("__range"))
    rows = dealt.withColumn("__copy", F.lit(False)).unionByName(copies.withColumn("__copy", F.lit(True)))
    rows = with_sketch(rows, F.col("text"), "fp")
    window = W.partitionBy("__range").orderBy("__copy", F.col("doc_id").desc_nulls_last(), "__hash", "text")
    return rows.withColumn("next", F.lead(F.struct("text", "fp")).over(window)).filter("not __copy").drop("__copy", "__range", "__hash")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends in the first code points of the next document in place of its own last third.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    led = with_next(rows, groups_for(rows, "text"))
    n = F.length("text")
    led = led.withColumn("n_chars", n.cast("bigint")).withColumn("__cut", F.floor(F.col("n_chars") / 3).cast("int"))
    led = led.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - __cut)"), F.expr("substring(next.text, 1, __cut)")))
    led = led.select("doc_id", "n_chars", "edited", "fp", F.col("next.fp").alias("next_fp"))
    return with_sketch(led, F.col("edited"), "edited_fp").select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        printed(F.col("fp")).alias("fingerprint"),
        printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        containment(F.col("fp"), F.col("next_fp")).alias("contained_in_next"),
    )
