"""The whole pipeline against a brute-force version that shares only the trained model and the fixed values."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from catalog_lake.llm import bpe, mixing, quality, secrets
from tests.llm.test_joins import SCHEMA, Long, brute_classes, swap_or_not, water_fill
from tests.llm.test_text_operators import brute_base, brute_model_spans, brute_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=90):
    rng = random.Random(21)
    names = ["".join(rng.choices("bdfgklmnprst", k=3)) + "".join(rng.choices("aeiou", k=2)) for _ in range(300)]
    word = lambda: rng.choice(("the", "of", "and")) if rng.random() < 0.15 else rng.choice(names)
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 12)))
    listed = []
    for i in range(n):
        text = "\n".join(sentence() + rng.choice((".", "", ".", ".", "", "...")) for _ in range(rng.choice((6, 12, 30))))
        kind = i % 9
        if kind == 1:
            text = listed[-1][1]
        elif kind == 2:
            text = listed[-2][1] + " and more" if listed[-2][1] else text
        elif kind == 3:
            text += f" token={secrets.random_strings(1, i)[0]} password: 'hunter2hunter2' " + "0123456789abcdef" * 2 + " AKIA" + "Z9" * 9
        elif kind == 4:
            text += "\n" + secrets.random_strings(1, 500 + i)[0] + " é"
        elif kind == 5:
            text = rng.choice(("too short", text.replace(" ", " # | ") if i % 2 else "a b c " * 40, None, "", "\n".join("- " + x for x in text.split("\n")), text.replace("\n", "...\n")))
        listed.append((i, text, "en", rng.choice(("a", "a", "a", "b", "é", None)), None if text is None else len(text)))
    listed.append((n, " ".join(word() for _ in range(3_000)), None, "b", 1))
    listed.append((None, " ".join(word() for _ in range(70)), None, "a", 1))
    return listed


def brute_kept(text):
    n, chars, symbols, dups, repeated = brute_quality(text)
    if n < 50 or 2 * repeated > n or n > 100_000:
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    bullets = sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines)
    dots = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    stops = sum(w.lower() in quality.STOP_WORDS for w in WORD.findall(text))
    share = len(lines)
    return 3 <= chars / n <= 10 and symbols / n <= 0.1 and stops / n >= 0.02 and bullets / share <= 0.9 and dots / share <= 0.3 and dups / share <= 0.5


def brute_redacted(text, ratios):
    base = brute_base(text)
    out, at = "", 0
    for start, end, _ in sorted(base + brute_model_spans(text, base, ratios)):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def brute_mix(docs):
    """(doc_id, text) rows of the mix: every slot of every source, block by block."""
    sizes, streams = collections.Counter(), collections.defaultdict(list)
    mark = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    for d, t, s in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1]))):
        sizes[s] += len(WORD.findall(t))
        streams[s].append((d, t, sizes[s]))
    out, block = [], mixing.BLOCK_WORDS
    for s, target in water_fill(dict(sizes)).items():
        size, wanted = sizes[s], min(int(target + 0.5), 2 * sizes[s])
        blocks, rest = -(-size // block), wanted % size
        slots = wanted // size * blocks + -(-rest // block)
        for turn in range(-(-slots // blocks)):
            taken = set()
            for j in range(turn * blocks, min(slots, (turn + 1) * blocks)):
                at = swap_or_not(j % blocks, blocks, "" if s is None else "=" + s, Long(turn)) * block
                most = (rest - 1) % block + 1 if rest and j == slots - 1 else block
                taken |= set(range(at, min(at + most, size)))
            for d, t, end in streams[s]:
                w = WORD.findall(t)
                kept = [x for k, x in enumerate(w, end - len(w)) if k in taken]
                if kept:
                    out.append((d, t if len(kept) == len(w) else " ".join(kept)))
    return out


@pytest.mark.parametrize("repeats", [1, 2])
def test_the_pipeline_equals_brute_force(spark, tmp_path, repeats):
    listed = corpus()
    if repeats == 2:  # rows that repeat a NULL id and texts that repeat under other ids
        listed += [(None, listed[-2][1], "en", "a", 1), (500, listed[0][1], "de", None, 1)]
    docs = spark.createDataFrame(listed, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    good = [r for r in listed if brute_kept(r[1])]
    assert {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()} == {r[0] for r in good}
    classes = brute_classes([r for r in good if r[0] is not None])
    unique = [r for r in good if r[0] is None or classes[r[0]][0] == r[0]]
    assert 30 < len(unique) < len(good) < len(listed)
    ratios = secrets.train(spark.createDataFrame(unique, SCHEMA))
    clean = [(d, brute_redacted(t, ratios), s) for d, t, _, s, _ in unique]
    assert sum(a[1] != b[1] for a, b in zip(unique, clean, strict=True)) >= 8
    mixed = brute_mix(clean)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = [(d, t, own.encode_ordinary(t)) for d, t in mixed]
    want = [(d, len(i), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in i)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t, i in ids]
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)


def test_stages_take_extra_columns_of_clashing_names(spark, tmp_path):
    names = "node words_key __row size skey block start kept n_words text_key signature spans mark".split()
    listed = [r for r in corpus(30) if r[1]]
    wide = spark.createDataFrame([(*r, *names) for r in listed], f"{SCHEMA}, " + ", ".join(f"{n} string" for n in names))
    plain = spark.createDataFrame(listed, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, wide, str(tmp_path))
        assert given.columns == wide.columns, name
        key = ("doc_id", "text", "source")
        assert collections.Counter(map(tuple, given.select(*key).collect())) == collections.Counter(map(tuple, stage(spark, plain, str(tmp_path)).select(*key).collect())), name
        assert all(r[n] == n for r in given.select(*names).collect() for n in names), name
    last = corpus_pipeline.STAGES[-1][1]
    assert collections.Counter(map(tuple, last(spark, wide, "").collect())) == collections.Counter(map(tuple, last(spark, plain, "").collect()))
