"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside Spark partitions.

Encoding: every match of the split pattern is a word. A recursive query contracts the leftmost pair of
least rank of each word that the worker hasn't met, until no word has a pair left. A word of up to
LIST_BYTES is one row, with the list of its tokens and that of the ranks of their pairs; a step replaces
two tokens by one and looks up its pairs with its two neighbours. A longer word is token-position rows, one
per byte, each with the rank of its pair with the next row; only the contracted row and the one before it
join the merge table again, and where the least pair occurs again in a word, the step contracts the further
occurrences, too, left to right, as long as contracting one by one would choose them next: up to the first
whose product makes a pair of lower rank with a neighbour. Both give the same ids: lists cost less for
ordinary words, rows for long ones that repeat. Words that are tokens themselves need no merges. Encoded
words are kept in a cache of bounded size, and a document's ids are its words' ids in order.

Decoding: token-position rows of the documents of a window join the vocabulary; an aggregation in order
of position puts each document's pieces together.

Scale: a map over partitions, no shuffle; the merge table depends on the vocabulary alone and is built
once per Python worker from the rank file. Windows are cut at WINDOW_CHARS characters, so that memory
follows the longest text, not the partition; DuckDB gets MEMORY, or a fixed multiple of a longer word or
text, and no folder to spill to. Defined cases: a NULL text is empty and has no tokens; rows that repeat,
and NULL ids, are encoded each for itself; empty tables give empty results; other columns are not touched;
special tokens are ordinary text; very long texts are windows of their own. Text whose UTF-8 form isn't
reproducible (lone surrogates) can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Characters of text whose unseen words are encoded together.
WINDOW_CHARS = 2_000_000
#: Bytes of unseen words in one recursive query, and tokens in one decoding query; one word or text at least.
QUERY_BYTES = 500_000
#: Longest word that is a row with lists, and bytes of longer words in one query of rows; one word at least.
LIST_BYTES, ROW_BYTES = 512, 100_000
#: Words in each of the cache's two generations.
CACHE_WORDS = 150_000
#: DuckDB's memory in MB; a longer word or text than QUERY_BYTES raises it in proportion.
MEMORY = 96

#: The rank of a pair that isn't in the merge table.
NO_PAIR = 2147483647
#: Rows of t: word, its tokens, the rank of each one's pair with the next (NO_PAIR for the last), the least rank.
ENCODE_LISTS = f"""
with recursive t(w, ids, ranks, least) as (
  select w, ids, ranks, list_min(ranks) from start_words
  union all (
  select w, ids, ranks, list_min(ranks) from (
    select w, ids[1:p - 1] || [least] || ids[p + 2:] as ids,
      case when p > 1 then ranks[1:p - 2] || [coalesce(a.m, {NO_PAIR})] else ranks[1:0] end || [coalesce(b.m, {NO_PAIR})] || ranks[p + 2:] as ranks
    from (select *, list_position(ranks, least) as p from t where least < {NO_PAIR}) as x
    left join merges as a on a.pair = (ids[p - 1]::bigint << 32) | least left join merges as b on b.pair = (least::bigint << 32) | ids[p + 2])))
select w, ids from t where least = {NO_PAIR}"""

#: Rows of t: word, place, place and token of the next row, rank of the pair of the two. A word without a pair is done.
ENCODE = """
with recursive t(w, i, nxt, tok, ntok, m, done) as (
  select w, i, nxt, tok, ntok, m, false from start_rows left join merges on pair = (tok::bigint << 32) | ntok
  union all (
  with least as (
    select w, min((m::bigint << 32) | i) as key, arg_min(nxt, (m::bigint << 32) | i) as second, max(((2147483647 - m)::bigint << 32) | i) & 4294967295 as final
    from t where m is not null and not done group by w),
  u as materialized (
    select l.w, (l.key & 4294967295)::int as i, (l.key >> 32)::int as best, l.second, q.nxt as after, q.ntok as after_tok, l.key & 4294967295 <> l.final as again
    from t as q join least as l on q.i = l.second),
  once as (
    select t.w, t.i, t.m, u.w is null as done, coalesce(t.i = u.i or t.nxt = u.i, false) as changed,
      case when t.i = u.i then u.after else t.nxt end as nxt,
      case when t.i = u.i then u.best else t.tok end as tok,
      case when t.i = u.i then u.after_tok when t.nxt = u.i then u.best else t.ntok end as ntok
    from t left join u on u.w = t.w where not t.done and (u.w is null or (not u.again and t.i <> u.second))),
  words as materialized (select t.w, t.i, t.nxt, t.tok, t.ntok, t.m, v.best from t join (select w, best from u where again) as v on v.w = t.w where not t.done),
  hits as (select *, coalesce(lag(nxt) over (partition by w order by i) = i, false) as follows from words where m = best),
  runs as (select *, max(case when not follows then i end) over (partition by w order by i) as head from hits),
  turns as (select *, row_number() over (partition by w, head order by i) as turn from runs),
  around as (
    select x.w, x.i, x.nxt, x.best, q.nxt as after, q.ntok as after_tok, case when coalesce(lag(q.nxt) over (partition by x.w order by x.i) = x.i, false) then x.best else p.tok end as before_tok
    from turns as x join words as q on q.i = x.nxt left join words as p on p.nxt = x.i where x.turn % 2 = 1),
  beside as materialized (select *, unnest([(before_tok::bigint << 32) | best, (best::bigint << 32) | after_tok]) as pair from around),
  stops as (select w, min(i) as stop from merges join beside using (pair) where m < best group by w),
  taken as materialized (select distinct w, i, nxt, best, after, after_tok from beside left join stops using (w) where i <= coalesce(stop, i)),
  several as (
    select x.w, x.i, x.m, false as done, a.i is not null or n.i is not null as changed,
      case when a.i is not null then a.after else x.nxt end as nxt, coalesce(a.best, x.tok) as tok,
      case when f.i is not null or n.i is not null then x.best when a.i is not null then a.after_tok else x.ntok end as ntok
    from words as x left join taken as a on a.i = x.i left join taken as n on n.i = x.nxt and a.i is null left join taken as f on f.i = a.after left join taken as g on g.nxt = x.i
    where g.i is null),
  s as (select * from once union all by name select * from several)
  select s.w, s.i, s.nxt, s.tok, s.ntok, case when s.changed then merges.m else s.m end, s.done
  from s left join merges on merges.pair = case when s.changed then (s.tok::bigint << 32) | s.ntok end
  )
)
select w, list(tok order by i) as ids from t where done group by w"""

#: One thread aggregates rows in the order in which they come.
DECODE = "select doc, string_agg(piece, '') as text from (select doc, piece from tokens join vocab using (id) order by doc, pos) group by doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base 64 of a token's bytes and its rank, by line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(ranks: dict[bytes, int]) -> pa.Table:
    """All pairs of tokens whose bytes together are a token: left id in the high half of ``pair``, and the rank ``m``."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a), right.append(b), merged.append(rank)
    pair = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64)
    return pa.table({"pair": pair, "m": np.array(merged, dtype=np.int32)})


class Coder:
    """Encoder and decoder of one rank file and split pattern, on a DuckDB connection of its own."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.ids = {token: np.uint32(rank).tobytes() for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), NO_PAIR) for b in range(256)] for a in range(256)], dtype=np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        self.con.execute("set disabled_optimizers = 'join_order,build_side_probe_side'")  # tables of a step are built on, not the merge table
        # bytes are carried as the code points of the same number
        vocab = pa.table({"id": np.array(list(ranks.values()), dtype=np.int32), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        for name, table in (("merges", merge_pairs(ranks)), ("vocab", vocab)):
            self.con.register("given", table)
            self.con.execute(f"create table {name} as select * from given")
            self.con.unregister("given")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _room_for(self, rows: int) -> None:
        self.con.execute(f"set memory_limit = '{max(MEMORY, MEMORY * 4 * rows // QUERY_BYTES)}MB'")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word of up to LIST_BYTES as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw, ends = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(lengths)
        ranks = np.full(len(raw), NO_PAIR, dtype=np.int32)
        ranks[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        ranks[ends - 1] = NO_PAIR
        offsets = pa.array(np.append(0, ends).astype(np.int32))
        lists = {name: pa.ListArray.from_arrays(offsets, pa.array(values)) for name, values in (("ids", self.byte_ids[raw]), ("ranks", ranks))}
        return self._run(ENCODE_LISTS, "start_words", pa.table({"w": np.arange(len(words), dtype=np.int32)} | lists), len(words))

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        last = np.zeros(int(lengths.sum()), dtype=bool)
        self._room_for(len(last) if len(words) == 1 else 0)
        last[np.cumsum(lengths) - 1] = True
        places = np.arange(len(last), dtype=np.int32)  # over all words
        tokens = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        following = {"nxt": pa.array(places + 1, mask=last), "ntok": pa.array(np.roll(tokens, -1), mask=last)}
        start = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "i": places, "tok": tokens} | following)
        return self._run(ENCODE, "start_rows", start, len(words))

    def _run(self, query: str, name: str, start: pa.Table, n: int) -> list[bytes]:
        self.con.register(name, start)
        found = self.con.sql(query).to_arrow_table().combine_chunks()
        self.con.unregister(name)
        lists = found.column("ids").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        out: list[bytes] = [b""] * n
        for w, a, b in zip(found.column("w").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            out[w] = flat[a:b].tobytes()
        return out

    def _learn(self, words: set[str]) -> None:
        """Put the ids of all ``words`` into the young generation."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        unseen: tuple[list[str], list[str]] = [], []
        raws: tuple[list[bytes], list[bytes]] = [], []
        for word in words.difference(self.young):
            raw = word.encode()
            known = self.old.get(word) or self.ids.get(raw)
            if known is not None:
                self.young[word] = known
            else:
                long = len(raw) > LIST_BYTES
                unseen[long].append(word), raws[long].append(raw)
        for long, contract, most in ((False, self._contract, QUERY_BYTES), (True, self._contract_long, ROW_BYTES)):
            for part in runs_of(list(map(len, raws[long])), most):
                self.young.update(zip(unseen[long][part], contract(raws[long][part]), strict=True))

    def encode(self, texts: Iterator[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.split(text) for text in texts]
        self._learn(set().union(*split))
        return [b"".join(map(self.young.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes]) -> Iterator[bytes]:
        """Bytes of each list of ids."""
        for part in runs_of([len(x) // 4 for x in ids], QUERY_BYTES):
            yield from self._decode(ids[part])

    def _decode(self, ids: list[bytes]) -> list[bytes]:
        lengths = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = pa.table(
            {
                "doc": np.repeat(np.arange(len(ids), dtype=np.int32), lengths),
                "pos": (np.arange(len(starts)) - starts).astype(np.int32),
                "id": np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32),
            }
        )
        self._room_for(len(rows) if len(ids) == 1 else 0)
        self.con.register("tokens", rows)
        found = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("tokens")
        out = [b""] * len(ids)
        for doc, text in zip(found.column("doc").to_pylist(), found.column("text").to_pylist(), strict=True):
            out[doc] = text.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One coder per Python worker: the merge table is built once, the cache lasts over its tasks."""
    return Coder(path, pattern)


def runs_of(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of items of at most ``most`` together, one item at least."""
    begin, total = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def code_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (and its ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for part in runs_of(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), WINDOW_CHARS):
                n = part.stop - part.start
                encoded = own.encode(t or "" for t in texts.slice(part.start, n).to_pylist())
                columns = [
                    batch.column("doc_id").slice(part.start, n),
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(encoded)], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in encoded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
