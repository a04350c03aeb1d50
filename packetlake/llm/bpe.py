"""Byte-level BPE by DuckDB recursive queries in each partition, and decoding by ordered aggregation.

A text is cut into units (at single spaces, see `tokens`), and each unit that a worker has not met yet into the
vocabulary's pieces. The new pieces become token-position rows of a DuckDB table; each round of a recursive query joins
neighbouring rows with the merge table and contracts every piece's leftmost pair of smallest rank, until no piece has
one. The units' ids are then decoded by another query: ids joined with the vocabulary, bytes aggregated in order. A
text's ids and decoded bytes are those of its units in a row. A worker keeps what it has coded in a bounded cache.

Edge cases: null and empty texts have no tokens; a piece of any length is encoded whole; special tokens' strings are
ordinary text; repeated rows agree; an empty table gives an empty result; extra columns are ignored.
"""

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from . import tokens
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces for one recursive query, and their bytes at most (a longer piece goes alone).
SLICE, SLICE_BYTES = 20_000, 300_000
#: Bytes of texts whose units are looked up together; units and pieces kept by a worker, and their bytes at most.
GROUP, CACHE, LONG = 2 << 20, 400_000, 64


@functools.cache
def _ranks(vocabulary: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _connection(vocabulary: str):
    """A DuckDB of this worker with the merge table (left id, right id, rank of the merged token) and the tokens' bytes."""
    import duckdb

    ranks = _ranks(vocabulary)
    rows = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": "false"})
    l, r, m = zip(*rows)
    con.register("_m", pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "m": pa.array(m, pa.int64())}))
    con.register("_v", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
    con.execute("create table merges as select l::bigint << 32 | r as pair, m from _m")
    con.execute("create table vocabulary as select * from _v")
    return con


#: A row is a token: its word, its place, the next token's place and id, and the rank of its pair with that (null: no pair).
ENCODE = """
with recursive step as (
  select w, pos, id, nxt, nid, (g.m << 32) | pos as rank, 0 as round from start left join merges g on g.pair = (id::bigint << 32 | nid)
  union all
  select w, pos, id, nxt, nid, (g.m << 32) | pos as rank, round
  from (
    select s.w, s.pos, s.round + 1 as round,
      case when s.pos = b.p then b.made else s.id end as id,
      case when s.pos = b.p then b.nxt2 else s.nxt end as nxt,
      case when s.pos = b.p then b.nid2 when s.nxt = b.p then b.made else s.nid end as nid
    from step s join (
      select m.w, m.p, m.made, m.q, x.nxt as nxt2, x.nid as nid2
      from (
        select w, (min(rank) & 4294967295)::int as p, (min(rank) >> 32)::int as made, arg_min(nxt, rank) as q
        from step where rank is not null group by w
      ) m join step x on x.w = m.w and x.pos = m.q
    ) b on b.w = s.w
    where s.pos <> b.q
  ) left join merges g on g.pair = (id::bigint << 32 | nid)
), ended as (
  select s.w, s.pos, s.id from step s join (select w, max(round) as round from step group by w) l on l.w = s.w and l.round = s.round
)
select w, string_agg(id::varchar, ' ' order by pos) as ids from ended group by w
"""

DECODE = """
select w, string_agg(hex, '' order by k) as hex
from (select w, unnest(ids)::int as id, generate_subscripts(ids, 1) as k from (select w, string_split(ids, ' ') as ids from coded where ids <> ''))
join vocabulary using (id) group by w
"""


def encode_pieces(pieces: list[bytes], vocabulary: str = VOCABULARY) -> list[bytes]:
    """The ids of each piece, decimal and joined by one space."""
    ranks, con, out = _ranks(vocabulary), _connection(vocabulary), [b""] * len(pieces)
    single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
    todo = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))  # pieces of like length end in like rounds
    at = 0
    while at < len(todo):
        end, size = at, 0
        while end < len(todo) and end - at < SLICE and (end == at or size + len(pieces[todo[end]]) <= SLICE_BYTES):
            size += len(pieces[todo[end]])
            end += 1
        part = [pieces[k] for k in todo[at:end]]
        raw = np.frombuffer(b"".join(part), np.uint8)
        size = np.array([len(x) for x in part])
        w = np.repeat(np.arange(len(part), dtype=np.int32), size)
        pos = (np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        ids = single[raw]
        nid = pa.array(np.append(ids[1:], 0).astype(np.int32), mask=pos + 1 == size[w])
        con.register("start", pa.table({"w": w, "pos": pos, "id": ids, "nxt": pos + 1, "nid": nid}))
        coded = con.sql(ENCODE).to_arrow_table()
        con.unregister("start")
        for k, text in zip(coded.column("w").to_pylist(), coded.column("ids").to_pylist()):
            out[todo[at + k]] = text.encode()
        at = end
    return out


def decode_ids(ids: list[str], vocabulary: str = VOCABULARY) -> list[bytes]:
    """The bytes of each text of decimal ids joined by one space."""
    con = _connection(vocabulary)
    con.register("coded", pa.table({"w": pa.array(range(len(ids)), pa.int32()), "ids": pa.array(ids, pa.string())}))
    found = con.sql(DECODE).to_arrow_table()
    con.unregister("coded")
    out = [b""] * len(ids)
    for k, h in zip(found.column("w").to_pylist(), found.column("hex").to_pylist()):
        out[k] = bytes.fromhex(h)
    return out


class Kept:
    """A bounded dictionary in two generations: what was not asked for during a whole generation is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Coder:
    """Ids and decoded bytes of units, each by its bytes' hash: (ids with a space before each, how many, bytes)."""

    def __init__(self, vocabulary: str):
        self.vocabulary, self.units, self.pieces = vocabulary, Kept(CACHE), Kept(CACHE)

    def values(self, keys: list[int], unit, whole: np.ndarray) -> list[tuple[bytes, int, bytes]]:
        """unit(k): the bytes of the k-th unit; whole[k]: it is one piece."""
        out = [self.units.get(k) for k in keys]
        new = [k for k, v in enumerate(out) if v is None]
        if not new:
            return out
        raw = [unit(k) for k in new]
        todo, ids, cut = [], {}, {}
        for k, r in zip(new, raw):
            if whole[k]:
                todo.append(r)
            else:
                cut[r] = [p.encode() for p in tokens.pieces(r.decode())]
                for p in cut[r]:
                    if p not in ids and (v := self.pieces.get(p)) is None:
                        ids[p] = None
                        todo.append(p)
                    elif p not in ids:
                        ids[p] = v
        for p, v in zip(todo, encode_pieces(todo, self.vocabulary)):
            ids[p] = v
        for c in cut.values():
            for p in c:
                if len(p) <= LONG:
                    self.pieces.put(p, ids[p])
        coded = [b" ".join([ids[p] for p in cut[r]]) if r in cut else ids[r] for r in raw]
        decoded = decode_ids([c.decode() for c in coded], self.vocabulary)
        for k, r, c, d in zip(new, raw, coded, decoded):
            out[k] = (b" " + c, c.count(b" ") + 1, d)
            if len(r) <= LONG:
                self.units.put(keys[k], out[k])
        return out


@functools.cache
def _coder(vocabulary: str) -> Coder:
    return Coder(vocabulary)


def _gather(values: list[bytes], which: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The values of `which` in a row, and where those of each slice of bounds begin."""
    size = np.array([len(v) for v in values], np.int64)
    first = (np.cumsum(size) - size)[which]
    size = size[which]
    at = np.concatenate([[0], np.cumsum(size)])
    blob = np.frombuffer(b"".join(values), np.uint8)
    return blob[np.repeat(first - at[:-1], size) + np.arange(at[-1])].tobytes(), at[bounds]


def coded(data: np.ndarray, offsets: np.ndarray, vocabulary: str = VOCABULARY):
    """(number of tokens, ids, decoded bytes) of each document; ids are decimal and joined by one space."""
    starts, whole, bounds = tokens.unit_starts(data, offsets)
    ends = np.append(starts[1:], len(data))
    h = tv.word_hashes(data, starts, ends)
    h = tv.mix(h + (ends - starts).astype(np.uint64), 9) ^ whole.astype(np.uint64)
    kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    values = _coder(vocabulary).values(kinds.tolist(), lambda k: raw[starts[first[k]] : ends[first[k]]], whole[first])
    count = np.concatenate([[0], np.cumsum(np.array([v[1] for v in values], np.int64)[which])])
    ids, i = _gather([v[0] for v in values], which, bounds)
    text, t = _gather([v[2] for v in values], which, bounds)
    for d in range(len(offsets) - 1):
        yield int(count[bounds[d + 1]] - count[bounds[d]]), ids[i[d] + 1 : i[d + 1]], text[t[d] : t[d + 1]]


def _encoded(docs: DataFrame, vocabulary: str, digest, schema: str, kind) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for i, j, data, off in tv.documents(b.column(1), GROUP):
                n, one, two = zip(*((n, *digest(ids, raw)) for n, ids, raw in coded(data, off, vocabulary)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, kind)], names=["doc_id", "n_tokens", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_tokens long, {schema}")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space), decoded (bytes, from the ids) of each text."""
    return _encoded(docs, vocabulary, lambda ids, raw: (ids.decode(), raw), "ids string, decoded binary", pa.binary())


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and decoded (bytes) of rows doc_id, ids (decimal, joined by one space); no ids are no bytes."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(decode_ids(texts, vocabulary), pa.binary())], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    def digest(ids, raw):
        return hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()

    return _encoded(table(spark, sf_dir, "documents"), VOCABULARY, digest, "ids_sha256 string, decoded_sha256 string", pa.string())
