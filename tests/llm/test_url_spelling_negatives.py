"""URL rules, spelling variants and hard negatives against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_lake.llm import hard_negatives, spelling, url_filters
from tests.conftest import rows

CLASHING = ("key", "host", "path", "row", "word", "n", "cluster", "block", "kind", "pack")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


# ---- urls


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


@pytest.mark.parametrize("seed", [1, 2])
def test_url_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    label, segment = lambda: rng.choice(["a", "b", "org", "é", ""]), lambda: rng.choice(["x", "xy", "z", "", "é"])
    host = lambda most: ".".join(label() for _ in range(rng.randint(1, most)))
    path = lambda most: "".join("/" + segment() for _ in range(rng.randint(0, most)))
    rules = sorted({(host(3), path(3), rng.choice(["allow", "block"])) for _ in range(80)})
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice([str.upper, str])(host(5))}{path(5)}{rng.choice(['', '?q=/x', '#top', '?a#b', '#b?a'])}" for _ in range(1500)]
    urls += [None, "", "no scheme", "http:/one", "x://a://org/x", "://", "http://org" + "/x" * 20_000, "http://" + "a." * 5_000 + "org/xyz", urls[0], urls[0]]
    table = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"))
    listed = url_filters.RuleList(url_filters.rule_frame(spark, [*rules, rules[0]]))
    want = sorted(((i, *judged(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert rows(url_filters.judge_urls(table, listed)) == want
    kept = url_filters.filter_urls(table, listed)
    assert kept.columns == table.columns and sorted(r.page_id for r in kept.collect()) == [w[0] for w in sorted(want, key=lambda w: w[0]) if w[4] == "allow"]


def test_two_expressions_under_one_short_prefix_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "PREFIX_HEX", 1)  # sixteen keys for all expressions
    rules = [(f"h{i}", f"/{j}", "block" if (i + j) % 2 else "allow") for i in range(8) for j in range(8)]
    urls = [f"http://s.h{i}/{j}" for i in range(10) for j in range(10)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    assert rows(url_filters.judge_urls(table, url_filters.RuleList(url_filters.rule_frame(spark, rules)))) == sorted(((i, *judged(u, rules)) for i, u in enumerate(urls)), key=repr)


def test_urls_of_empty_tables_lists_and_rows_that_repeat(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filters.judge_urls(none, url_filters.RuleList(url_filters.rule_frame(spark))).count() == 0
    table = spark.createDataFrame([(1, "http://org/")] * 3 + [(None, "http://org/")], none.schema)
    empty = url_filters.RuleList(spark.createDataFrame([], "host string, path string, action string"))
    assert rows(url_filters.judge_urls(table, empty, "block")) == sorted([(1, "org", "/", None, "block")] * 3 + [(None, "org", "/", None, "block")], key=repr)
    with pytest.raises(ValueError):
        url_filters.RuleList(url_filters.rule_frame(spark, [("org", "/", "maybe")]))


# ---- spelling


def variants(counts):
    letters = sorted({c for w in counts for c in w})

    def near(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return [x for x in out - {w} if x in counts]

    forms = {}
    for w, n in counts.items():
        found = near(w)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        forms[w] = (best if best is not None and counts[best] >= 2 * n else None, len(found))
    out = []
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        out.append((w, form, root, counts[w], n_near, counts[form] if form else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "most"), [(1, 4096), (2, 16), (3, 1)])
def test_variants_equal_brute_force(spark, seed, most):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abÀz"[: rng.randint(2, 4)]) for _ in range(rng.randint(5, 9))) for _ in range(900)} | {"long" * 300, "long" * 300 + "x", "long" * 150 + "y" + "long" * 150}
    counts = {w: rng.choice([3, 3, 6, 12, 12, 50]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert rows(spelling.group_variants(table, most=most)) == variants(counts)


def test_groups_are_halved_until_they_are_small(spark):
    words = [(f"aaaa{x}{y}{z}bbbb", 3) for x in "abcdefgh" for y in "abcdefgh" for z in "abcdefgh"]
    table = spark.createDataFrame(words, "word string, n bigint")
    sizes = {most: max(r[0] for r in spelling.leaves(table, most=most).filter("r > 1").groupBy("leaf").count().select("count").collect()) for most in (4096, 16)}
    assert sizes[4096] == 64 and sizes[16] <= 16


def test_words_of_texts(spark):
    rng = random.Random(5)
    vocabulary = ["Größe", "größe", "GROSSE", "Straße", "strasse", "abcde", "Abcde", "abcdé", "ÀÉÎÕÜ", "word×s", "tokenize", "tokenise"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(80)] + [(None, "tokenize null-id " * 5), (7, None), (8, ""), (9, "abcd " * 50), (10, "tokenize\u0130tokenise " * 4), (3, "tokenize"), (3, "tokenize")]
    counts = {}
    for i, text in docs:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "\u00c0" <= c <= "\u00ff":
                run += c
            elif run:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
                low = low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low
                counts[low] = counts.get(low, 0) + 1
                run = ""
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    table = clashing(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert rows(spelling.spelling_report(table)) == variants(want)
    assert spelling.spelling_report(table.limit(0)).count() == 0


def test_chains_of_forms_lead_to_their_root(spark):
    chain = [("a" * i, 3 * 2 ** (i - 5)) for i in range(5, 40)]
    assert {r.root for r in spelling.group_variants(spark.createDataFrame(chain, "word string, n bigint")).collect()} == {"a" * 39}


# ---- hard negatives


def mined(table):
    kept = []
    for vec_id, vector, label in table:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        ints = [int(np.floor(256 * float(np.float32(x)))) for x in vector]
        kept.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, ints))
    out, done = [], set()
    for a, (anchor, label, u) in enumerate(kept):
        if anchor is None or anchor % 100 or (anchor, label, tuple(u)) in done:
            continue
        done.add((anchor, label, tuple(u)))
        scored = sorted(((-sum(x * y for x, y in zip(u, v, strict=True)), i is None, i or 0, other == label) for b, (i, other, v) in enumerate(kept) if b != a and len(v) == len(u)))
        for p in [s for s in scored if s[3]][:5]:
            fits = [s for s in scored if not s[3] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(anchor, None if p[1] else p[2], k + 1, None if s[1] else s[2], -p[0], -s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize(("seed", "block", "step", "pack"), [(1, 8192, 1024, 256), (3, 64, 8, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, block, step, pack):
    for name, value in (("BLOCK_ROWS", block), ("STEP", step), ("PACK_ROWS", pack), ("ANCHORS_PER_CENTRE", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    table = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(6)] + rng.normal(size=8) * 0.3], int(rng.integers(10))) for i in rng.permutation(1500)]
    table += [table[5]] * 40 + [(t[0], t[1], 3) for t in table if t[0] == 300] * 3  # copies, repeats of an anchor
    table += [(100, [0.0] * 8, 1), (200, [], 2), (201, [], 3), (203, [], 2), (400, [0.5] * 3, 4), (401, [0.5] * 3, 4), (402, [0.45] * 3, 5)]
    table += [(9001, None, 1), (9002, [1.0] * 8, None), (9003, [float("nan")] * 8, 1), (9004, [float("inf")] * 8, 1), (9005, [None] * 8, 1), (None, centres[0].tolist(), 1), (None, centres[1].tolist(), 2)]
    frame = clashing(spark.createDataFrame(table, SCHEMA).repartition(5))
    want = mined(table)
    assert len(want) > 100 and rows(hard_negatives.mining_report(frame)) == want


def test_scores_beyond_floating_point(spark):
    table = [(i, [float(2**22 - i % 3), float(2**21 + i % 5), float(i)], i % 4) for i in range(0, 600, 5)]
    assert rows(hard_negatives.mining_report(spark.createDataFrame(table, SCHEMA))) == mined(table)
    huge = spark.createDataFrame([(100, [3e38, 3e38], 1), (101, [3e38, 3e38], 1), (102, [3e38, 3e38], 2)], SCHEMA)
    assert hard_negatives.mining_report(huge).count() == 0 and hard_negatives.mining_report(huge.limit(0)).count() == 0


def test_lists_end_before_all_is_scored():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, size=(4000, 16))
    vectors[:200] += 60
    block = hard_negatives.Block(np.arange(4000), np.arange(4000), np.arange(4000) % 2, vectors)
    pack = hard_negatives.Pack(np.arange(20), np.arange(20) % 2, vectors[:20])
    units, _ = hard_negatives.directions(vectors[:20])
    centre = hard_negatives.fit_centres(units, 1)[0]
    widest = float(np.arccos(np.clip(units @ centre, -1, 1)).max())
    best, _, scored = hard_negatives.walk_list(pack, block, block.shared(0, centre, widest), None, 5)
    assert scored <= 20 * hard_negatives.STEP < 20 * 4000
    exact = vectors[:20] @ vectors.T
    for a in range(20):
        others = sorted((-int(exact[a, b]), b) for b in range(4000) if b != a and b % 2 == a % 2)[:5]
        assert [(-int(k >> block.bits), int(block.by_rank[k & ((1 << block.bits) - 1)])) for k in best[a, 0]] == others
