"""Fingerprints, secrets, quality rules, BPE: hand-written rows, edge cases and brute force."""

import base64
import hashlib
import importlib
import random
import re
import string
import time
import uuid

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from catalog_lake.llm import bpe, fingerprints, quality, secrets

LONG = " ".join(f"w{i % 700}" for i in range(20_000))
TEXTS = [
    (1, "the cat sat on the mat and the dog lay by the door of the old house"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, "one"), (7, "one"),
    (None, "a null id"), (8, "Zürich straße 日本語 " * 40), (9, "x" * 3000), (7, "one"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "extra", 1) for d, t in TEXTS], "doc_id bigint, text string, n_words string, extra int")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# ---- fingerprints


def test_fingerprints_follow_the_next_document(spark):
    texts = {i: " ".join(random.Random(i).choices(string.ascii_lowercase, k=60 + i)) for i in range(40)}
    texts[11] = texts[12]
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_report(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        cut, after = len(texts[d]) // 3, texts[order[(i + 1) % len(order)]]
        edited = texts[d][: len(texts[d]) - cut] + after[:cut]
        assert found[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[d]["n_chars"] == len(texts[d])
        assert 0 <= found[d]["near_edited"] <= 1
    assert found[11]["fingerprint"] == found[12]["fingerprint"] and found[12]["near_next"] == 1


def text_hash(*parts):
    """The engine's 64-bit hash of strings, signed."""
    h = 42
    for part in parts:
        h = xxhash.xxh64(part.encode(), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_sketch(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = {text_hash(*w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return sorted({h for h in hashes if h < -(1 << 63) + (1 << 64) // fingerprints.SCALE} | ({min(hashes)} if hashes else set()))


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(("the", "é", "cat", "x1", "日本", "ran"))
    listed = [(d, " ".join(word() for _ in range(rng.choice((0, 1, 4, 5, 30, 200))))) for d in [*range(60), -(2**63), 2**63 - 1, 0, 5, 5, 5, None, None, None]]
    listed += [(7, "many rows of one id " * 3)] * 40 + [(9, None)]
    order = sorted(((d, t or "") for d, t in listed), key=lambda r: (r[0] is None, -(r[0] or 0), text_hash(r[1])))
    want = []
    for i, (d, t) in enumerate(order):
        after, cut = order[(i + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = map(brute_sketch, (t, edited, after))
        like = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / len(set(x) | set(y))
        shown = lambda x: ",".join(f"{h % (1 << 64):016x}" for h in x)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), like(a, b), like(a, c)))
    df = spark.createDataFrame([(d, t, 1, "e") for d, t in listed], "doc_id bigint, text string, fp int, next string")
    report = fingerprints.fingerprint_report(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted(map(tuple, report.collect()), key=repr) == sorted(want, key=repr)


def test_frequent_ids_are_spread_over_ranges(spark):
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate([None] * 500 + [5] * 500 + list(range(300)))], "doc_id bigint, text string").withColumn("__hash", F.xxhash64("text"))
    sizes = [r["count"] for r in docs.groupBy(fingerprints.doc_ranges(docs, 16).alias("r")).count().collect()]
    assert max(sizes) < 2 * 1300 / 16  # about twice an even share at most


def test_fingerprints_over_many_ranges_and_null_ids(spark):
    rows = [(d, f"text number {d} " * 9) for d in [*range(0, 400, 3), *range(100_000, 100_050)]] + [(None, "b"), (None, "a")]
    led = fingerprints.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), 7)
    found = [(r["doc_id"], r["text"], r["next"]["text"]) for r in led.collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), text_hash(r[1])))
    assert sorted(found, key=repr) == sorted(((*order[i], order[(i + 1) % len(order)][1]) for i in range(len(order))), key=repr)


def test_fingerprint_edge_cases(spark, docs):
    assert fingerprints.fingerprint_report(empty(spark)).count() == 0
    found = fingerprints.fingerprint_report(docs).collect()
    assert len(found) == len(TEXTS)
    assert all(r["fingerprint"] == "" for r in found if r["n_chars"] in (0, 3) and r["doc_id"] in (2, 3, 4))
    one = fingerprints.fingerprint_report(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")).first()
    assert one["near_next"] == 1


def test_sketches_merge_and_estimate_containment(spark):
    whole = " ".join(str(i) for i in range(4000))
    part = " ".join(str(i) for i in range(1000))
    rest = " ".join(str(i) for i in range(996, 4000))
    df = spark.createDataFrame([(whole, part, rest)], "whole string, part string, rest string")
    for c in ("whole", "part", "rest"):
        df = fingerprints.with_sketch(df, F.col(c), f"{c}_fp")
    r = df.select("whole_fp", fingerprints.merged(F.array("part_fp", "rest_fp")).alias("m"), fingerprints.containment(F.col("part_fp"), F.col("whole_fp")).alias("c"), fingerprints.likeness(F.col("part_fp"), F.col("whole_fp")).alias("l")).first()
    assert r["whole_fp"] == r["m"] and r["c"] == 1 and abs(r["l"] - 0.25) < 0.08


# ---- secrets


def brute_base(text):
    """The base patterns, by trying every place."""
    found = []
    kinds = (("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24))
    for kind, form, flags, good in kinds:
        at, pattern = 0, re.compile(form, flags)
        while at <= len(text):
            m = pattern.match(text, at)
            if m and m.end() > at:
                if good(m):
                    found.append((m.start(), m.end(), kind))
                at = m.end()
            else:
                at += 1
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_base_spans_equal_brute_force():
    rng = random.Random(5)
    parts = ["password", "TOKEN", "secret", "api_key", "apikey", "=", ": ", "\"", "'", "abc", "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", " ", "\n", "é", "token=secret=abcdef", "ſecret=abcdefgh", "x1-y2_z3"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert secrets.base_spans(text) == brute_base(text), text


def test_model_separates_random_strings_from_identifiers_held_out(spark):
    ordinary = "the quick brown fox jumps over lazy dogs while several connection managers configure database handlers and update customer records every morning".split()
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).sample(ordinary, 15)) + f" token={secrets.random_strings(1, 900 + i)[0]}") for i in range(200)], "doc_id bigint, text string")
    table = secrets.train(docs)
    rng = random.Random(99)
    held_out = [s for s in secrets.random_strings(400, seed=1234) if len(s) >= 20]
    names = ["_".join(rng.sample(ordinary, 3)) for _ in range(200)] + ["".join(w.capitalize() for w in rng.sample(ordinary, 3)) for _ in range(200)]
    caught = np.mean([secrets.score(s, table) >= secrets.THRESHOLD for s in held_out])
    false = np.mean([secrets.score(s, table) >= secrets.THRESHOLD for s in names])
    assert caught > 0.9 and false < 0.02


NAMED = "argparse asyncio calendar collections configparser csv ctypes datetime decimal email.message http.client http.server imaplib inspect json locale logging.handlers mailbox multiprocessing os pathlib pickle platform selectors shutil socket socketserver sqlite3 ssl string subprocess tarfile tempfile threading tokenize traceback types typing unittest.mock urllib.parse urllib.request weakref zipfile".split()
KEYS = {
    "base64": lambda d: base64.b64encode(d).decode(), "urlsafe": lambda d: base64.urlsafe_b64encode(d).decode(), "base32": lambda d: base64.b32encode(d).decode(),
    "hex": lambda d: d.hex().upper(), "base36": lambda d: np.base_repr(int.from_bytes(d, "big"), 36).lower(), "uuid": lambda d: str(uuid.UUID(bytes=d[:16], version=4)),
}


@pytest.mark.parametrize("length", [16, 24, 40])
def test_model_on_names_of_another_vocabulary_and_keys_of_other_generators(spark, length):
    """Trained on the documents as in production; names of the standard library that share no word with them, keys made from digests."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = secrets.train(docs)
    known = {w.lower() for r in docs.select("text").collect() for w in re.findall("[A-Za-z]+", r["text"] or "")}
    modules = [importlib.import_module(m) for m in NAMED]
    names = {n for m in modules for o in (m, *(v for v in vars(m).values() if isinstance(v, type))) for n in dir(o)}
    names = sorted(n for n in names if re.fullmatch(r"\w{16,}", n, re.ASCII) and not {w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", n)} & known)
    flagged = [n for n in names if secrets.model_spans(n, [], table)]
    assert len(names) > 500 and len(flagged) < 0.1 * len(names), (len(flagged), len(names))
    for kind, form in KEYS.items():
        keys = [form(hashlib.sha512(f"{kind}{i}".encode()).digest())[:length] for i in range(300)]
        assert np.mean([bool(secrets.model_spans(k, [], table)) for k in keys]) >= 0.95, kind


def test_keys_outside_the_base_patterns_get_spans_in_a_table(spark):
    """Keys that no base pattern matches, planted in every second document and thus in the sample, come out as markov spans; other rows stay clean."""
    texts = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    keys = {d: base64.b64encode(hashlib.sha512(f"planted{d}".encode()).digest()).decode()[:32].replace("/", "x") for d, _ in texts if d % 2}
    rows = [(d, f"{t} {keys[d]}" if d in keys else t) for d, t in texts]
    found = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    length = {d: len(t) for d, t in rows}
    caught = [f"markov:{length[d] - 32}:{length[d]}" in found[d]["spans"].split(",") for d in keys]
    assert np.mean(caught) >= 0.98, (sum(caught), len(caught))
    assert all(found[d]["n_markov"] == 0 for d, _ in rows if d not in keys)


def test_secret_edge_cases(spark, docs):
    assert secrets.scan_secrets(empty(spark)).count() == 0
    found = secrets.scan_secrets(docs).collect()
    assert len(found) == len(TEXTS)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == nothing for r in found)
    text = 'é password="hunter2hunter2" and ' + "0123456789abcdef" * 2
    r = secrets.scan_secrets(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")).filter("doc_id = 1").first()
    assert r["spans"] == "assign:2:26,hex:32:64" and (r["n_assign"], r["n_hex"]) == (1, 1)


def brute_model_spans(text, spans, ratios):
    return [(m.start(), m.end(), "markov") for m in secrets.TOKEN.finditer(text) if not any(s < m.end() and e > m.start() for s, e, _ in spans)
            and sum((any(c.isdigit() for c in m[0]), any(c.islower() for c in m[0]), any(c.isupper() for c in m[0]))) >= 2 and secrets.score(m[0], ratios) >= secrets.THRESHOLD]


def test_model_spans_equal_brute_force_and_long_texts_are_quick():
    rng = random.Random(11)
    strings = secrets.random_strings(300, seed=2)
    names = [f"read_{a}_{b}_handler" for a in ("user", "block", "index") for b in ("table", "shard", "lease")]
    ratios = secrets.log_ratio(secrets.transitions(secrets.random_strings()), secrets.transitions(names * 50))
    found = 0
    for _ in range(60):
        text = " ".join(rng.choice((rng.choice(strings), rng.choice(names), "token=" + rng.choice(strings), "deadbeef" * 4, "AKIA" + "A1" * 9, "word")) for _ in range(rng.randint(0, 40)))
        base = secrets.base_spans(text)
        spans = secrets.model_spans(text, base, ratios)
        assert spans == brute_model_spans(text, base, ratios)
        found += len(spans)
    assert found > 20
    long = " ".join([*strings * 20, *("token=" + s for s in strings * 60)])
    began = time.perf_counter()
    assert len(secrets.scan(long, ratios)[0]) >= 60 * 300
    assert time.perf_counter() - began < 5


def test_redaction_leaves_clean_rows_alone(spark):
    docs = spark.createDataFrame([(1, "clean text", 10), (2, "token=abcdefgh end", 18), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs).collect()}
    assert found == {1: ("clean text", 10), 2: ("[SECRET] end", 12), 3: (None, None)}


# ---- quality rules


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, g in enumerate(windows) if windows.count(g) >= 2 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a ", "b ", "c\n", "dé ", "\t", "#", "x|y ", "\n", "\x0b"], k=rng.randint(0, 120))) for _ in range(150)] + [None, ""]
    found = quality.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(texts[r["doc_id"]])


def test_quality_edge_cases(spark, docs):
    assert quality.quality_report(empty(spark)).count() == 0
    found = quality.quality_report(docs.select("doc_id", "text")).collect()
    assert len(found) == len(TEXTS) and not any(r["kept"] for r in found if r["n_words"] < 50)
    assert all(r["base_failed"] for r in found if r["text"] is None)
    good = "the people of the town went to the market and it was a fine day for all that came with their goods " * 3
    clean = spark.createDataFrame([(1, " ".join(f"{w}{i}" if i % 3 else w for i, w in enumerate(good.split())), "x", 5)], "doc_id bigint, text string, __row string, n_words int")
    kept = quality.filter_quality(clean)
    assert kept.columns == clean.columns and kept.count() == 1 and kept.first()["n_words"] == 5


def test_rules_are_data(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id bigint, text string")
    kept = quality.measures(df).filter(quality.verdict([("few", "n_words", None, 3)]))
    assert [r["doc_id"] for r in kept.collect()] == [1]


# ---- BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_encoding_equals_the_tokenizer_library(coder):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "a" * 997 + "b" * 70, "=-" * 500, "日本語" * 80, "<|endoftext|>", "I'll 123 ١٢٣\r\n", "\x00\x01", *("".join(rng.choices("abcdefgh", k=n)) for n in (63, 64, 65, 66, 2000, 20_000))] + ["=" * 30_000, "ab" * 9000]
    texts += ["".join(rng.choices("abct hein\n.,é", k=rng.randint(1, 300))) for _ in range(100)]
    ids = coder.encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids] == [own.encode_ordinary(t) for t in texts]
    assert [x.decode() for x in coder.decode(ids)] == texts


def test_many_words_of_one_length_fit_the_memory(coder):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = [" ".join(word(n) for _ in range(k)) for n, k in ((300, 1600), (600, 200), (bpe.LIST_BYTES - 2, 3), (bpe.LIST_BYTES - 1, 3), (bpe.LIST_BYTES, 3))]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in coder.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_lists_and_rows_contract_alike(coder):
    rng = random.Random(3)
    words = [bytes(rng.choices(letters, k=rng.randint(2, 90))) for letters in (b"ab", b"the in", b"=-", bytes(range(256))) for _ in range(100)] + [b"a" * n for n in (2, 3, 64, 511, 512)]
    assert coder._contract(words) == coder._contract_long(words)


def test_ordinary_words_cost_less_than_rows_of_tokens(coder):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("etaoinshrdlu", k=rng.randint(5, 14))) for _ in range(30_000)})
    begin = time.process_time()
    coder.encode([" ".join(words)])
    middle = time.process_time()
    for part in bpe.runs_of(list(map(len, words)), 100_000):
        coder._contract_long([w.encode() for w in words[part]])
    assert middle - begin < 0.75 * (time.process_time() - middle)


def test_bpe_edge_cases(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert bpe.code_documents(empty(spark), path, pattern).count() == 0
    found = bpe.code_documents(docs, path, pattern, ids=True).collect()
    assert sorted((r["decoded_sha256"] for r in found)) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS)
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)


def test_the_word_cache_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    for k in range(20):
        coder.encode([" ".join(f"zq{k}x{i}" for i in range(8))])
    assert len(coder.young) + len(coder.old) < 200


def test_fingerprints_of_null_ids_alone(spark):
    led = fingerprints.with_next(spark.createDataFrame([(None, "b"), (None, "a")], "doc_id bigint, text string"), 3)
    assert sorted((r["text"], r["next"]["text"]) for r in led.collect()) == [("a", "b"), ("b", "a")]
