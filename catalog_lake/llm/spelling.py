"""Spelling variants: words one error apart, found by a bit-sliced position index.

1. ``word_counts`` counts the words of all texts in a combining aggregate.
2. ``leaves`` deals the vocabulary: of two words one error apart, the shorter with a letters, either the first
   a // 2 letters or the last a - a // 2 are the same. So each word goes to the groups of its halves, as the shorter
   and as the longer one. A group over LEAF_WORDS is halved again in what isn't shared yet, until it is small or
   a single letter is left, so that no group grows with the vocabulary.
3. ``neighbours`` builds the index in tasks: for each (position, letter) a bitset over a group's words, 64 to a
   machine word. A word walks over its letters with four sets of the group's words: those without an error so
   far, and those with one letter replaced, inserted (their letters come one position later) or left out (one
   earlier). Each step is a few bitwise operations for 64 words of the index at once, and numpy takes all words of
   many groups in a step. The sets' counts and first members are what leaves the task: pairs are never rows.
4. Bits stand in the order of n descending, then of the word, so that the first bit of a set is the best one.
   Counts and best ones of a word's groups meet in a combining aggregate.
5. ``roots`` follows forms by pointer doubling; n at least doubles with each form, so that few rounds end it.

A pair that shares both halves is in two groups; the second one counts words only which differ within the first half
(those without an error at its end are left out there).

Defined cases: NULL texts have no words; a NULL doc_id is the empty string in the crc; only A-Z is lower-cased, so that
À and à are different letters; words of any length are indexed; repeated rows count as often as they are there; ties in n go to
the word that is least in code-point order; an empty table gives an empty result; other columns of the input,
whatever their names, are not touched. Results don't depend on row order or partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalog_lake.session import materialise

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A run is damaged where this divides its crc.
DAMAGE = 97
#: Groups of more words are halved again.
LEAF_WORDS = 4096
#: Rows of groups that a task takes, about.
TASK_ROWS = 60_000
#: Lanes (words of the vocabulary times machine words of their group) and index cells in a numpy step.
STEP_LANES, STEP_CELLS = 1 << 20, 1 << 22
#: Letters of words.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters, some with a code point left out as the crc of their doc_id says."""
    # shorter runs can't become words: leaving out only shortens
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{letters},}}"), F.lit(0))).alias("run"))
    low = runs.select("d", F.translate("run", UPPER, LOWER).alias("w"))
    marked = low.select("w", F.crc32(F.encode(F.concat("d", F.lit(":"), "w"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.char_length("w")).cast("int")
    word = F.when(F.col("h") % DAMAGE == 0, F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))).otherwise(F.col("w"))
    words = marked.select(word.alias("word")).filter(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


# ---- groups


def _leaf(a: Column, p: Column, s: Column, tail: Column) -> Column:
    """A group: the shorter length a, the first p and last s letters that its words share, and whether the first part's pairs were counted elsewhere."""
    word = F.col("word")
    name = F.concat_ws("|", a, p, s, tail.cast("int"), F.substr(word, F.lit(1), p), F.substr(word, F.char_length(word) - s + 1))
    return F.struct(name.alias("leaf"), a.cast("int").alias("a"), p.cast("int").alias("p"), s.cast("int").alias("s"), tail.alias("tail"))


def _halves(a: Column, p: Column, s: Column, tail: Column) -> Column:
    """The two groups that a group's words go to: by the first half of what they don't share, or by the last."""
    left = a - p - s
    half = F.floor(left / 2).cast("int")
    return F.array(_leaf(a, p + half, s, tail), _leaf(a, p, s + left - half, F.lit(True)))


def leaves(words: DataFrame, letters: int = LEAST_LETTERS, most: int = LEAF_WORDS) -> DataFrame:
    """leaf, r (letters of the shorter words that aren't shared), tail, part (those letters), word, n."""
    length = F.char_length("word")
    lengths = F.filter(F.array(length, length - 1), lambda a: a >= letters)
    zero = F.lit(0)
    dealt = words.withColumn("a0", F.explode(lengths)).withColumn("g", F.explode(_halves(F.col("a0"), zero, zero, F.lit(False)))).select("word", "n", "g.*")
    dealt, done = materialise(dealt, "leaves"), []
    while True:
        # groups that can be halved are few: one for every ``most`` rows at most
        large = dealt.filter(F.col("a") - F.col("p") - F.col("s") > 1).groupBy("leaf").agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > most).select("leaf")
        large = materialise(large, "large-leaves")
        if large.isEmpty():
            break
        done.append(dealt.join(large, "leaf", "left_anti"))
        again = dealt.join(large, "leaf").withColumn("g", F.explode(_halves(F.col("a"), F.col("p"), F.col("s"), F.col("tail"))))
        dealt = materialise(again.select("word", "n", "g.*"), "leaves")
    for other in done:
        dealt = dealt.unionByName(other)
    part = F.substr("word", F.col("p") + 1, F.char_length("word") - F.col("p") - F.col("s"))
    return dealt.select("leaf", (F.col("a") - F.col("p") - F.col("s")).alias("r"), "tail", part.alias("part"), "word", "n")


# ---- the index


def _letters(parts: list[str], width: int) -> np.ndarray:
    """Code points, a row for each part, 0 behind its end."""
    return np.array(parts, dtype=f"U{width}").view(np.uint32).reshape(len(parts), width)


def walk(x: np.ndarray, lengths: np.ndarray, first_lane: np.ndarray, tail: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours within groups of words that are r or r + 1 letters long.

    x holds the letters (rows: words, sorted by group), lengths 0 for r and 1 for r + 1 letters, first_lane the row at
    which each row's group begins, tail whether the group leaves out pairs that share r letters. For each word: how
    many neighbours it has, and the row of the first one (-1: none).
    """
    n = len(x)
    sizes = np.bincount(first_lane, minlength=n)[first_lane]
    starts = np.flatnonzero(first_lane == np.arange(n))
    machine_words = (sizes[starts] + 63) // 64
    word_base = np.zeros(n, dtype=np.int64)
    word_base[starts] = np.concatenate(([0], np.cumsum(machine_words)[:-1]))
    place = np.arange(n) - first_lane
    slot, bit = word_base[first_lane] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64)
    alphabet, coded = np.unique(x, return_inverse=True)
    coded, total, size = coded.reshape(x.shape), int(machine_words.sum()), len(alphabet)
    index = np.zeros((r + 1, size, total), dtype=np.uint64)  # by position and letter: a bit for each word
    for i in range(r + 1):
        np.bitwise_or.at(index[i], (coded[:, i], slot), bit)
    by_length = np.zeros((2, total), dtype=np.uint64)
    np.bitwise_or.at(by_length, (lengths, slot), bit)

    found, best = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    lanes_of = (sizes + 63) // 64
    ends = np.cumsum(lanes_of)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + STEP_LANES, side="right")))
        who = np.repeat(np.arange(low, high), lanes_of[low:high])  # the walking word of each lane
        begins = np.concatenate(([0], np.cumsum(lanes_of[low:high])[:-1]))
        at = word_base[first_lane[who]] + np.arange(len(who)) - begins[who - low]  # its machine word of the index
        clean = by_length[0][at] | by_length[1][at]
        replaced = np.zeros(len(who), dtype=np.uint64)
        inserted, dropped = replaced.copy(), replaced.copy()
        for i in range(r):
            letter = coded[who, i]
            here = index[i, letter, at]
            before = index[i - 1, letter, at] if i else np.zeros_like(here)
            clean, replaced, inserted, dropped = clean & here, (replaced & here) | (clean & ~here), (inserted | clean) & index[i + 1, letter, at], (dropped & before) | clean
        dropped = (dropped & index[r - 1, coded[who, r], at]) | clean  # the last letter of the longer words
        shorter = (replaced & by_length[0][at]) | ((inserted | clean) & by_length[1][at])
        near = np.where(lengths[who] == 1, dropped & by_length[0][at], shorter)  # two longer words meet in a group of their own length
        near &= ~np.where(tail[who], clean, np.uint64(0))
        found[low:high] = np.add.reduceat(np.bitwise_count(near).astype(np.int64), begins)
        hit = np.flatnonzero(near)
        if len(hit):
            owner, first = np.unique(who[hit], return_index=True)
            lane = hit[first]
            lowest = near[lane] & (~near[lane] + np.uint64(1))
            best[owner] = first_lane[owner] + 64 * (lane - begins[owner - low]) + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
        low = high
    return found, best


def _batch_neighbours(batch: pa.Table) -> Iterator[pa.RecordBatch]:
    """word, n_near, form, form_n of whole groups, sorted by group, n descending and word."""
    leaf, r, tail = batch["leaf"].combine_chunks(), batch["r"].to_numpy(), batch["tail"].to_numpy(zero_copy_only=False)
    codes = leaf.dictionary_encode().indices.to_numpy()
    begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    group = np.cumsum(np.concatenate(([0], codes[1:] != codes[:-1])))
    sizes = np.diff(np.concatenate((begins, [len(codes)])))
    words, parts, n = batch["word"].to_pylist(), batch["part"].to_pylist(), batch["n"].to_numpy()
    for width in np.unique(r):
        groups = np.flatnonzero((r[begins] == width) & (sizes > 1))
        cells = np.cumsum(((sizes[groups] + 63) // 64) * (int(width) + 1) * 96)  # 90 letters at most, and 0
        for chunk in np.split(groups, np.searchsorted(cells, np.arange(STEP_CELLS, cells[-1], STEP_CELLS))) if len(groups) else []:
            if not len(chunk):
                continue
            rows = np.flatnonzero(np.isin(group, chunk))
            x = _letters([parts[i] for i in rows], int(width) + 1)
            first = np.flatnonzero(np.concatenate(([True], group[rows][1:] != group[rows][:-1])))
            first_lane = np.repeat(first, np.diff(np.concatenate((first, [len(rows)]))))
            count, best = walk(x, np.array([len(parts[i]) - width for i in rows]), first_lane, tail[rows], int(width))
            hit = np.flatnonzero(count)
            forms = rows[best[hit]]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in rows[hit]], pa.string()), pa.array(count[hit]), pa.array([words[i] for i in forms], pa.string()), pa.array(n[forms])], ["word", "n_near", "form", "form_n"])


def _sorted_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups come sorted; they are taken some tens of thousands of rows at a time, cut between groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_ROWS // 2:
            whole = pa.Table.from_batches(held)
            leaf = whole["leaf"]
            last, at = leaf[-1].as_py(), whole.num_rows - 1
            while at and leaf[at - 1].as_py() == last:
                at -= 1
            if at:
                yield from _batch_neighbours(whole.slice(0, at))
            held = whole.slice(at).combine_chunks().to_batches()
    if held:
        yield from _batch_neighbours(pa.Table.from_batches(held))


def neighbours(words: DataFrame, letters: int = LEAST_LETTERS, most: int = LEAF_WORDS) -> DataFrame:
    """word, n_near, form, form_n for the words that have a near one: how many, and the most frequent (ties: the least)."""
    dealt = materialise(leaves(words, letters, most), "leaves")
    parts = max(1, math.ceil(dealt.count() / TASK_ROWS))
    sorted_groups = dealt.repartition(parts, "leaf").sortWithinPartitions("leaf", F.desc("n"), "word")
    found = sorted_groups.mapInArrow(_sorted_neighbours, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


# ---- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form or NULL, and more) plus root: the last of the word's forms, the word itself if it has none.

    Chains may not turn back: here n grows along them. Each round doubles the steps done and writes its rows.
    """
    state = materialise(forms.withColumn("root", F.coalesce("form", "word")), "roots")
    while True:
        onward = state.filter(F.col("root") != F.col("word")).select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = materialise(state.join(onward, "root", "left").withColumn("__moved", F.col("__next").isNotNull()).withColumn("root", F.coalesce("__next", "root")).drop("__next"), "roots")
        state = moved.drop("__moved")
        if moved.filter("__moved").isEmpty():
            return state


def group_variants(words: DataFrame, letters: int = LEAST_LETTERS, ratio: int = 2, most: int = LEAF_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary of distinct words: a word's form is its most frequent near word if that is ``ratio`` times as frequent."""
    words = materialise(words.select("word", "n"), "words")
    near = neighbours(words, letters, most).withColumnRenamed("form", "__form").withColumnRenamed("form_n", "__form_n")
    joined = words.join(near, "word", "left")
    taken = F.col("__form_n") >= ratio * F.col("n")
    forms = joined.select("word", F.when(taken, F.col("__form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, F.col("__form_n")).alias("form_n"))
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    return group_variants(word_counts(docs))


#: DuckDB SQL for the query over documents. DuckDB has no crc32: its table is eight steps for each byte value, applied byte by byte.
ORACLE = f"""
with recursive bits(b, k, c) as (select b, 0, b from range(256) t(b) union all select b, k + 1, case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by b) as t from bits where k = 8),
runs as (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents),
low as (select d, translate(run, '{UPPER}', '{LOWER}') as w, count(*) as n from runs where length(run) >= {LEAST_LETTERS} group by 1, 2),
marked as (select w, n, xor(list_reduce(list_transform(range(1, strlen(d || ':' || w) + 1), lambda i: cast(('0x' || substr(hex(encode(d || ':' || w)), cast(2 * i - 1 as int), 2)) as bigint)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) as h from low, crc),
spoilt as (select case when h % {DAMAGE} = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end as word, n from marked),
words as (select word, cast(sum(n) as bigint) as n from spoilt where length(word) >= {LEAST_LETTERS} group by 1 having sum(n) >= {LEAST_COUNT}),
cut as (select word, n, i, word[:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (select a.word, b.word as near, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select cut.word, w.word, w.n from cut join words w on w.word = cut.rest
  union select w.word, cut.word, cut.n from cut join words w on w.word = cut.rest),
best as (select word, count(*) as n_near, max(n) as form_n from pairs group by 1),
named as (select best.word, n_near, form_n, min(near) as form from best join pairs on pairs.word = best.word and pairs.n = form_n group by 1, 2, 3),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * w.n then form end as form, case when form_n >= 2 * w.n then form_n end as form_n from words w left join named on named.word = w.word),
chain as (select word, word as root from forms union all select chain.word, f.form from chain join forms f on f.word = chain.root where f.form is not null),
ends as (select chain.word, chain.root from chain join forms f on f.word = chain.root and f.form is null)
select forms.word, form, root, n, cast(n_near as bigint) as n_near, form_n from forms join ends on ends.word = forms.word"""
