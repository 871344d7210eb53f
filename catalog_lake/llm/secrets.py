"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Base spans (leftmost, non-overlapping per kind; matches that are too short are dropped):
``assign`` a keyword, a separator and a value of 6 or more characters; ``access`` AKIA and capitals or
digits, 20 or more; ``hex`` runs of 24 or more lower-case hex digits. Spans are of the whole match, in
code points, end exclusive.

The method adds ``markov`` spans: tokens of 16 or more key characters, outside base spans, that a
first-order model of random strings explains better than a model of ordinary identifiers, by
``THRESHOLD`` nats a character or more. Both models are trained from labelled samples: random strings
are the values of base matches in a bounded sample of documents plus seeded random strings over common
alphabets; ordinary identifiers are the words of the sampled documents outside candidate tokens, also joined by case and
underscores. The sample is the SAMPLE_DOCS documents with the least hash, whatever the table's size; rows
that repeat count once.

Scanning is one pass over whole texts, without shuffle, in time that grows with the text's length alone.
Defined cases: a NULL text is empty and has no spans; very long texts are scanned whole; NULL and repeated
ids are scanned row by row; a table without secrets trains on the random strings alone; other columns of
the input, whatever their names, are not touched; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Documents that the models are trained on, at most.
SAMPLE_DOCS = 2000
#: Seeded random strings for the model of random strings.
SAMPLE_RANDOM = 4000
#: Log-likelihood ratio a character that a token must reach.
THRESHOLD = 0.9
LEAST_LENGTH = 16
SEED = 7

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Classes of characters by code; every other character is one more class, and the token's ends another.
CODES = np.full(128, len(ALPHABET), dtype=np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
STATES = len(ALPHABET) + 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def codes(token: str) -> np.ndarray:
    """Character classes; a line feed is the end state."""
    raw = np.frombuffer(f"\n{token}\n".encode("latin-1", "replace"), dtype=np.uint8)
    return np.where(raw == 10, STATES - 1, CODES[np.minimum(raw, 127)])


def transitions(tokens: Iterable[str]) -> np.ndarray:
    """How often each class follows each other one in tokens without line feeds."""
    c = codes("\n".join(tokens))
    return np.bincount(c[:-1] * STATES + c[1:], minlength=STATES * STATES).reshape(STATES, STATES).astype(float)


def log_ratio(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> np.ndarray:
    """log P(next | this) under random strings less that under ordinary identifiers, smoothed by one half."""
    logs = [np.log((c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * STATES)) for c in (random_counts, ordinary_counts)]
    return logs[0] - logs[1]


def random_strings(n: int = SAMPLE_RANDOM, seed: int = SEED) -> list[str]:
    """Seeded strings over the alphabets that keys are usually drawn from."""
    rng = random.Random(seed)
    alphabets = (ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_", "0123456789abcdef", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62])
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 48))) for _ in range(n)]


def candidate(token: str) -> bool:
    """A digit with a letter, or both cases: other tokens are passed over."""
    return any(c.isdigit() for c in token) + any(c.islower() for c in token) + any(c.isupper() for c in token) >= 2


def ordinary_identifiers(text: str, spans: list[tuple[int, int, str]]) -> Iterator[str]:
    """Words outside the spans, and the names that joining them makes.

    Candidates have no label: a key that no base pattern matches must not count as ordinary, so they are left out.
    """
    at, rest = 0, []
    for start, end, _ in spans:
        rest.append(text[at:start])
        at = max(at, end)
    plain = TOKEN.sub(lambda m: " " if candidate(m.group()) else m.group(), " ".join([*rest, text[at:]]))
    found = re.findall(r"[A-Za-z]+(?:[_/-][A-Za-z0-9]+)*", plain)
    yield from found
    for a, b, c in zip(found[::9], found[1::9], found[2::9]):
        yield f"{a}_{b}_{c}"
        yield a.lower() + b.capitalize() + c.capitalize()
        yield f"{a.lower()}-{b.lower()}-{len(c)}"


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """The table of log ratios from a bounded sample of (doc_id, text); counting runs in tasks.

    The sample's bound is the sample_docs-th least hash, so that no task receives the texts of others.
    """
    hashed = docs.select("doc_id", "text").withColumn("__hash", F.xxhash64("doc_id", "text", F.lit(SEED)))
    bound = hashed.select("__hash").distinct().orderBy("__hash").limit(sample_docs).agg(F.max("__hash")).first()[0]
    sample = hashed.filter(F.col("__hash") <= F.lit(bound if bound is not None else 0)).dropDuplicates(["__hash"]).select("text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"].fillna(""):
                spans = base_spans(text)
                values = [m.group(1) if (m := ASSIGN.fullmatch(text, s, e)) else text[s:e] for s, e, _ in spans]
                for label, counts in ((1, transitions(values)), (0, transitions(ordinary_identifiers(text, spans)))):
                    a, b = np.nonzero(counts)
                    yield pd.DataFrame({"label": label, "a": a, "b": b, "n": counts[a, b].astype(np.int64)})

    tables = np.zeros((2, STATES, STATES))
    for r in sample.mapInPandas(count, "label int, a int, b int, n bigint").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():  # 2 x STATES x STATES rows at most
        tables[r["label"], r["a"], r["b"]] = r["n"]
    return log_ratio(tables[1] + transitions(random_strings()), tables[0])


def score(token: str, ratios: np.ndarray) -> float:
    c = codes(token)
    return float(ratios[c[:-1], c[1:]].sum() / len(token))


def model_spans(text: str, spans: list[tuple[int, int, str]], ratios: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Tokens outside ``spans`` that look random. Tokens without a letter and a digit or both cases are passed over."""
    found, at, reach = [], 0, 0  # reach: the furthest end of the spans that start before the token's end
    for m in TOKEN.finditer(text):
        token = m.group()
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach > m.start():
            continue
        if candidate(token) and score(token, ratios) >= threshold:
            found.append((m.start(), m.end(), "markov"))
    return found


def scan(text: str | None, ratios: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text."""
    base = base_spans(text or "")
    more = model_spans(text or "", base, ratios)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, ratios: np.ndarray | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans of every whole text."""
    table = train(docs) if ratios is None else ratios

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base, every = scan(text, table)
                kinds = [s[2] for s in every]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", ratios: np.ndarray | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); n_chars follows the text if there is such a column."""
    table = train(docs.select("doc_id", F.col(f"`{text}`").alias("text"))) if ratios is None else ratios

    @F.pandas_udf("string")
    def cleaned(column: pd.Series) -> pd.Series:
        def one(value: str | None) -> str | None:
            if value is None:
                return None
            spans = scan(value, table)[1]
            if not spans:
                return value
            parts, at = [], 0
            for start, end, _ in spans:
                if start >= at:
                    parts += [value[at:start], mark]
                at = max(at, end)
            return "".join([*parts, value[at:]])

        return column.map(one, na_action=None)

    out = docs.withColumn(text, cleaned(F.col(f"`{text}`")))
    return out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
