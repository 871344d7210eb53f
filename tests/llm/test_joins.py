"""Suffix dedup, Jaccard classes, components, mixing, sharding: against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from catalog_lake.llm import graph, jaccard, mixing, sharding, suffix_dedup
from tests.conftest import rows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=120, seed=2):
    """Documents with copies, near copies, shared passages, short and empty ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(30))
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            text = rng.choice(out)[1]
        elif kind == 2 and out:
            w = (rng.choice(out)[1] or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(word() for _ in range(20)) + " " + passage + "é " + " ".join(word() for _ in range(20))
        else:
            text = " ".join(word() for _ in range(rng.choice((0, 1, 3, 40, 90))))
        out.append((i, text, rng.choice(("en", "de", None)), rng.choice(("a", "a", "a", "b", "c", None)), len(text)))
    out[5] = (5, None, None, "a", None)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


# ---- suffix dedup


def brute_removed(listed):
    """(n_bytes, n_removed, n_spans, kept) by the definition."""
    seen, out = set(), {}
    for d, text in sorted((d, t or "") for d, t, *_ in listed):
        raw = text.encode()
        own = {raw[i : i + 50] for i in range(len(raw) - 49)}
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 49):
            if raw[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen |= own
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone]) if raw else b""
        out[d] = len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("group_bytes", [1 << 20, 900])
def test_suffix_dedup_equals_brute_force(docs, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_documents(docs).collect()}
    assert found == brute_removed(corpus())


def test_suffix_dedup_of_runs_and_overlaps(spark):
    texts = [(1, "a" * 300), (2, "b" + "a" * 120 + "c"), (3, "a" * 49), (4, "a" * 49 + "b"), (5, "xy" * 60), (6, "yx" * 60), (7, "\x00" * 80), (8, "\x00" * 60), (9, "é" * 30), (10, "zé" + "é" * 29)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert found == brute_removed(texts)


def test_suffix_dedup_deals_texts_of_one_id(spark, monkeypatch):
    """Different texts of one id (or of none) lie in many groups; only those of smaller ids remove bytes."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 500)
    passage = "a passage of more than fifty bytes which every one of them holds. "
    rows_ = [(i, f"{n} {passage}{n}") for i in (7, None) for n in range(100)] + [(3, passage)]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string")
    found = rows(suffix_dedup.dedup_documents(df), "doc_id", "n_removed")
    length = len(passage)
    assert found.count((3, 0)) == 1 and found.count((7, length)) == 100 and sum(d is None and n >= length for d, n in found) == 100
    groups = suffix_dedup.deal_rows(df, 50).groupBy("grp").count()
    assert groups.count() > 30 and groups.agg({"count": "max"}).first()[0] < 20


def test_suffix_dedup_edge_cases(spark):
    assert suffix_dedup.dedup_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    long = "".join(random.Random(1).choices("abcdefghij ", k=200_000))
    rows_ = [(None, long), (None, long), (1, long), (1, long), (2, None)]
    found = rows(suffix_dedup.dedup_documents(spark.createDataFrame(rows_, "doc_id bigint, text string")), "doc_id", "n_removed")
    assert found == sorted([(None, 200_000), (None, 200_000), (1, 0), (1, 0), (2, 0)], key=repr)


def test_previous_smaller_and_the_least_on_the_way():
    rng = np.random.default_rng(0)
    for _ in range(50):
        v, common = rng.integers(0, 9, size=40), rng.integers(0, 99, size=40)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(40)]
        found, least = suffix_dedup.smaller_neighbour(v, common)
        assert found.tolist() == want and all(least[i] == min(common[j + 1 : i + 1]) for i, j in enumerate(want) if j >= 0)


def test_longest_previous_factors_equal_brute_force():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 3):
        rows_, docs_ = [], rng.integers(0, 6, size=25)
        whole = rng.integers(97, 97 + letters, size=400).astype(np.uint8)
        for _ in docs_:
            lo = rng.integers(0, 30)
            hi = rng.integers(lo, 30)
            at = rng.integers(0, 400 - 80)
            segment = np.zeros(suffix_dedup.SEGMENT + 2, dtype=np.uint8)
            segment[lo : hi + 50] = whole[at + lo : at + hi + 50]
            segment[suffix_dedup.SEGMENT :] = lo, hi
            rows_.append(segment)
        row, start, factor = suffix_dedup.previous_factors(np.stack(rows_), docs_)
        suffix = [bytes(rows_[r][s : rows_[r][-1] + 50]) for r, s in zip(row, start, strict=True)]
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [max((shared(a, b) for r, b in zip(row, suffix, strict=True) if docs_[r] < docs_[q]), default=0) for q, a in zip(row, suffix, strict=True)]
        assert factor.tolist() == want


# ---- Jaccard


def brute_classes(listed, threshold=0.8):
    sets = {}
    for d, t, *_ in listed:
        w = (t or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent, links = {d: d for d in sets}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


@pytest.mark.parametrize("block", [512, 4])
def test_classes_equal_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert found == brute_classes(corpus())


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for d in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.random()}"
        texts.append((d, " ".join(w)))
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert found == brute_classes(texts)


def test_jaccard_edge_cases(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    listed = [(None, "a b"), (1, None), (2, ""), (3, "a b"), (4, "a  b"), (4, "a  b"), (5, "word " * 30_000)]
    found = rows(jaccard.jaccard_classes(spark.createDataFrame(listed, "doc_id bigint, text string")))
    assert (None, None, 0) in found and (1, 1, 0) in found and (2, 2, 0) in found and (5, 5, 0) in found
    assert found.count((4, 3, 2)) == 2 and (3, 3, 2) in found


def test_repeated_rows_with_a_near_copy(spark):
    base = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    found = rows(jaccard.jaccard_classes(spark.createDataFrame([(1, text), (1, text), (2, near)], "doc_id bigint, text string")))
    assert found == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    listed = [(1, text)] * 40 + [(1, other), (2, near), (3, other + " x")]
    found = rows(jaccard.jaccard_classes(spark.createDataFrame(listed, "doc_id bigint, text string").repartition(5)))
    assert found == sorted([(1, 1, 40)] * 40 + [(1, 1, 1), (2, 1, 40), (3, 1, 1)], key=repr)


def test_texts_of_one_id_are_nodes_of_their_own(spark):
    a, b = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    text = lambda w: " ".join(w)
    listed = [(1, text(a), "n"), (1, text(b), "n"), (2, text([*a[:-1], "x"]), "n"), (3, text([*b[:-1], "x"]), "n"), (4, text(a), "n")]
    found = rows(jaccard.jaccard_classes(spark.createDataFrame(listed, "doc_id bigint, text string, node string")))
    assert found == [(1, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 1, 2)]


def test_near_copies_ship_where_they_are_verified_only(spark):
    base = [f"w{i}" for i in range(400)]
    near = [(d, " ".join([*base[:-1], f"x{d}"])) for d in range(200)]
    docs = spark.createDataFrame(near, "doc_id bigint, text string")
    nodes = jaccard.signatures(docs).selectExpr("doc_id as node", "doc_id as doc", "1L as copies", "signature")
    members = jaccard.prefix_members(nodes, jaccard.DEPTH)
    kept = members.groupBy("tree").applyInArrow(jaccard.with_work, members.schema)
    assert members.count() > 15 * 200 and kept.count() < 4 * 200


def test_missed_links_are_estimated_from_those_found():
    assert abs(jaccard.missed_share(np.array([0.8]), 5)[0] - (1 - 0.8**5) ** 20 / (1 - (1 - 0.8**5) ** 20)) < 1e-15
    assert jaccard.missed_share(np.array([1.0]), 5)[0] == 0


def test_the_target_recall_sets_the_depth():
    assert jaccard.prefix_depth(0.8, 20, 5, 0.999999) == 3
    assert jaccard.prefix_depth(0.8, 1, 8, 0.999999) == 1


def test_near_duplicates_keep_the_least_id_and_all_columns(spark):
    listed = [(3, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "other text here and more", None, None, None)]
    kept = jaccard.drop_near_duplicates(spark.createDataFrame(listed, SCHEMA))
    assert rows(kept, "doc_id") == [(1,), (2,)] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_row_of_each_class_stays_when_ids_repeat(spark):
    words = [f"w{i}" for i in range(60)]
    a, near, b = " ".join(words), " ".join([*words[:59], "z"]), " ".join(f"v{i}" for i in range(60))
    listed = [(0, b), (1, a), (1, a), (1, b + "  "), (1, near), (2, a), (2, "own"), (None, a), (None, a), (3, ""), (3, ""), (3, None), (4, None)]
    kept = jaccard.drop_near_duplicates(spark.createDataFrame([(*r, "x") for r in listed], "doc_id bigint, text string, __key string"))
    least = min((a, near), key=lambda t: hashlib.md5(t.encode()).digest())
    assert rows(kept) == sorted([(d, t, "x") for d, t in [(0, b), (1, least), (2, "own"), (None, a), (None, a), (3, ""), (3, None), (4, None)]], key=repr)


def test_near_duplicates_of_a_large_group_are_not_sent_to_all_pairs_of_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for d in range(240):  # most are near each other; some share prefixes with them, but are near few or none
        w = list(base)
        for _ in range(rng.randint(0, 2) if d % 8 else rng.randint(4, 14)):
            w[rng.randrange(120)] = f"x{rng.random()}"
        texts.append((d, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    sent, write = [], jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, kind: sent.append((kind, out := write(df, kind))) or out)
    kept = {r["doc_id"] for r in jaccard.drop_near_duplicates(docs).collect()}
    assert kept == {c for c, _ in brute_classes(texts).values()} and 5 < len(kept) < 60
    # all pairs of 30 blocks would be 30 rows of each text in one tree alone
    assert sum(df.count() for kind, df in sent if kind == "members") < 30 * len(texts)


def test_visitors_meet_every_node_of_other_blocks_once():
    own, core = np.array([0, 0, 0, 1, 2]), np.array([True, False, True, False, False])
    met = np.zeros((5, 5), dtype=int)
    for block in range(3):
        there = np.flatnonzero((own == block) | ~core)
        met[np.ix_(there, there)] += jaccard.visits(own[there], block, core[there])
    assert (met == (own[:, None] != own[None, :])).all()


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    found = dict(rows(graph.components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert {found[i] for i in range(100, 141)} == {100} and {found[i] for i in range(7, 30)} == {7} and {found[i] for i in (50, 51, 52)} == {50} and 60 not in found


# ---- mixing


def water_fill(sizes, weights=(5, 2, 1), epochs=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        rest = [s for s in names if s not in capped]
        left = epochs * sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_meets_its_targets(spark, docs):
    listed = corpus(600, seed=9)
    df = spark.createDataFrame(listed, SCHEMA)
    found = mixing.mix_report(df).collect()
    again = mixing.mix_report(df.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    source = {d: s for d, _, _, s, _ in listed}
    sizes = collections.Counter()
    for d, t, _, s, _ in listed:
        sizes[s] += len((t or "").split())
    want, taken = water_fill(dict(sizes)), collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(found) == len(listed)
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(0.03 * target, 60), (s, taken[s], target)


def swap_or_not(x, n, *salt, inverse=False):
    """The permutation by its definition, with the hash that the engine's expressions use."""

    def hashed(*values):
        h = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if v is not None and isinstance(v, Long) else 4, "little", signed=True)
            h = xxhash.xxh64(raw, seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    for r in sorted(range(1, mixing.ROUNDS + 1), reverse=inverse):
        partner = (hashed(mixing.SEED, *salt, r) % n - x) % n
        if hashed(mixing.SEED, *salt, r, Long(max(x, partner))) % 2:
            x = partner
    return x


class Long(int):
    """An integer of eight bytes."""


def test_taken_words_equal_brute_force(spark):
    """Every slot of the plan is mapped by hand; the documents' words in the blocks drawn are counted."""
    listed = [(d, t, lang, s, n) for d, t, lang, s, n in corpus(150, seed=12)]
    df = spark.createDataFrame(listed, SCHEMA).selectExpr("doc_id", "source", "size(filter(split(coalesce(text, ''), ' '), w -> w <> '')) as size", "xxhash64(text) as mark").withColumn("size", F.col("size").cast("bigint"))
    placed, plan = mixing.lay_out(df, 3, block_words=16)
    places, sources = placed.collect(), {r["skey"]: r for r in plan.collect()}
    streams = collections.Counter()
    for r in sorted(places, key=lambda r: r["start"]):
        assert r["start"] == streams[r["skey"]] or not r["size"]
        streams[r["skey"]] += r["size"]
    assert all(r["blocks"] == -(-streams[key] // 16) for key, r in sources.items())
    assert mixing.bucket_count(df) == 1
    found = {r["doc_id"]: r["taken"] for r in mixing.taken_words(df, block_words=16).collect()}
    placed, _ = mixing.lay_out(df, 1, block_words=16)
    streams = collections.defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: r["start"]):
        streams[r["skey"]] += [r["doc_id"]] * r["size"]
    taken = collections.Counter({d: 0 for d, *_ in listed})
    for key, r in sources.items():
        for j in range(r["slots"]):
            block = swap_or_not(j % r["blocks"], r["blocks"], key, Long(j // r["blocks"]))
            taken.update(streams[key][block * 16 : block * 16 + 16][: 16 if j < r["slots"] - 1 else r["last_words"]])
    assert found == dict(taken)
    counts = mixing.draw_counts(plan, 4, shard_blocks=20).collect()
    by_source, by_shard = collections.Counter(), collections.Counter()
    for r in counts:
        by_source[r["skey"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert by_source == {k: r["slots"] for k, r in sources.items() if r["slots"]} and sorted(by_shard.values())[1:] == [20] * (len(by_shard) - 1)


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).selectExpr("id as x", f"cast({n} as bigint) as n")
        there = df.select("x", "n", mixing.permuted("x", "n", "5").alias("y"))
        back = there.select("x", "y", mixing.permuted("y", "n", "5", inverse=True).alias("z")).collect()
        assert sorted(r["y"] for r in back) == list(range(n)) and all(r["z"] == r["x"] for r in back)


def test_mixing_edge_cases(spark):
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", 1), (None, "a b", None, "a", 3), (None, "a b", None, "a", 3)], SCHEMA)
    found = mixing.mix_report(blank).collect()
    assert len(found) == 4 and sum(r["taken"] for r in found) == 6
    assert mixing.mix_documents(blank).columns == blank.columns


def test_mixed_documents_hold_the_words_taken(spark):
    listed = corpus(300, seed=5)
    df = spark.createDataFrame(listed, SCHEMA)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(df).collect()}
    words = collections.Counter()
    for r in mixing.mix_documents(df).collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    assert all(words[d] == n for d, n in taken.items())


# ---- sharding


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        side = np.arange(1 << bits)
        points = np.stack(np.meshgrid(*[side] * dims), axis=-1).reshape(-1, dims)
        index = sharding.hilbert_index(points, bits)
        assert sorted(index.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_slots_gapless(spark, docs):
    listed = corpus()
    found = sharding.shard_documents(docs).collect()
    assert sorted(r["doc_id"] for r in found) == [d for d, *_ in listed]
    shards = collections.defaultdict(list)
    text = {d: (t or "").encode() for d, t, *_ in listed}
    for r in found:
        shards[r["shard"]].append(r["slot"])
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None
    assert set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_sharding_edge_cases(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(1, "a", "en", "s", 1)] * 50 + [(None, None, None, None, None)], SCHEMA)
    found = sharding.shard_documents(same).collect()
    assert len(found) == 51 and len({(r["shard"], r["slot"]) for r in found}) == 51


def test_written_shards_hold_their_rows_in_order(spark, docs, tmp_path):
    placed = sharding.shard_documents(docs, shards=3)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "doc_id", "shard", "slot") == rows(placed, "doc_id", "shard", "slot")


def test_shards_are_runs_of_the_sorted_curve(spark):
    """Against brute force: rows sorted by curve place and tie, cut into even runs."""
    rng = random.Random(6)
    listed = [(rng.choice((None, i, i)), "x" * rng.randint(0, 400), rng.choice(("de", "en", "es", "fr")), rng.choice((*"abcde", None)), 1, rng.randint(0, 9)) for i in range(700)]
    df = spark.createDataFrame(listed, SCHEMA + ", curve int")
    found = sharding.shard_documents(df).collect()
    order = sorted(found, key=lambda r: (r["curve"], r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]))
    total = len(order)
    want = [(i * 24 // total, i - -(-(i * 24 // total) * total // 24)) for i in range(total)]
    assert [(r["shard"], r["slot"]) for r in order] == want


def test_every_dimension_prunes_shards(spark):
    rng = random.Random(7)
    listed = [(i, "x" * rng.randint(0, 400), rng.choices(("de", "en", "es", "fr"), (3, 4, 2, 1))[0], rng.choice("abcdefgh"), 1) for i in range(4000)]
    found = sharding.shard_documents(spark.createDataFrame(listed, SCHEMA)).collect()
    touched = collections.defaultdict(set)
    for r in found:
        _, text, lang, source, _ = listed[r["doc_id"]]
        for key in (("lang", lang), ("source", source), ("size", len(text) // 50)):
            touched[key].add(r["shard"])
    mean = lambda kind: np.mean([len(s) for (k, _), s in touched.items() if k == kind])
    assert mean("lang") <= 12 and mean("source") <= 12 and mean("size") <= 14, (mean("lang"), mean("source"), mean("size"))


def test_addresses_prune_as_short_names_do(spark):
    rng = random.Random(8)
    listed = [(i, "x" * rng.randint(0, 400), rng.choice(("de", "en", "es", "fr")), rng.randrange(20), 1) for i in range(4000)]
    touched = {}
    for stem in ("s", "https://site.example.org/feed/"):
        docs = spark.createDataFrame([(*r[:3], f"{stem}{r[3]:02}", r[4]) for r in listed], SCHEMA)
        found = collections.defaultdict(set)
        for r in sharding.shard_documents(docs).collect():
            found[listed[r["doc_id"]][3]].add(r["shard"])
        touched[stem] = found
    short, long = touched.values()
    assert long == short and np.mean([len(s) for s in long.values()]) <= 10 and max(map(len, long.values())) <= 12


def test_levels_are_exact_shares(spark):
    rng = random.Random(9)
    values = {"s": [None, "", "a", "https://a", "https://b", "é", "z"], "d": [None, -1.5, 0.25, 0.5, 2.0], "n": [None, *range(300)]}
    data = [(rng.choice(values["s"]), rng.choice(values["d"]), rng.choice(values["n"])) for _ in range(1200)]
    df = spark.createDataFrame(data, "s string, d double, n bigint")
    for i, c in enumerate("sdn"):
        key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
        column = sorted((r[i] for r in data), key=key)
        want = {v: min((2 * column.index(v) + column.count(v)) * 64 // 2400, 63) for v in set(column)}
        assert dict(map(tuple, sharding.value_levels(df, c, 1200, 6).collect())) == want
