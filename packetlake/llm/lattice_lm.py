"""Document probabilities over the lattice of all segmentations into the pieces of an existing vocabulary.

A text is its words, each with a space mark before it, then an end. The pieces are those of a sentencepiece file (and the
256 single bytes, so that every text has a segmentation); its scores are the prior of their weights: log probabilities
as they are, or, where the file holds merge ranks, Zipf's law over the ranks. One expectation step over all training
words, each with its count, makes the weights: expected piece counts under the prior, with PRIOR more in the prior's
proportions; the vocabulary itself is never changed. The probability of a word is the sum over all paths of its lattice,
by a forward recursion in log space; no piece goes over a space mark, so a text's probability is the product of its words'
and the end's.

Each task cuts a few MB of text into words and keeps, for each such chunk, its different words with their training
counts, and for each document its words as places in that list. Counts are added up by word over all chunks; each
different word's lattice is walked once for the expectation and once for its probability; both go back to the chunks,
where the documents are scored. What is gathered is bounded by a chunk (CHUNK bytes, or one longer document).

Edge cases: null and empty texts are an end alone; rows without doc_id are no held-out rows; equal rows count as often as
they stand there; without training rows all counts are 0 and the weights are the prior; an empty table gives an empty
result; other columns are ignored; texts are never cut.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import crc_of_id, forget, saved, table

VOCABULARY = "piece_bpe_32k.model"
PRIOR, FOLDS, CHUNK, WORDS = 32_000.0, 10, 14 << 20, 20_000
#: Bytes of a chunk whose words are cut and numbered at a time.
PIECE = 1 << 20
MARK = "▁".encode()


@functools.cache
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and their prior probabilities; the last one, of no bytes, is the end of a text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k) or "▁" in piece[1:]):
            found[piece.encode()] = sp.get_score(k)
    scores = np.array(list(found.values()))
    ranks = bool((scores <= 0).all() and (scores == np.round(scores)).all())
    low = scores.min() - 1
    single = [bytes([b]) for b in range(256) if bytes([b]) not in found]
    pieces, scores = [*found, *single, b""], np.append(scores, np.full(len(single) + 1, low))
    weights = 1 / (1 - scores) if ranks else np.exp(scores - scores.max())
    return pieces, weights / weights.sum()


def trie(pieces: list[bytes]):
    """Sorted keys (node * 256 + byte), the node each leads to, and the piece that ends at each node (-1: none)."""
    steps, ends = {}, [-1]
    for k, piece in enumerate(pieces[:-1]):
        node = 0
        for byte in piece:
            node = steps.setdefault(node << 8 | byte, len(ends))
            if node == len(ends):
                ends.append(-1)
        ends[node] = k
    keys = np.array(sorted(steps), np.int64)
    return keys, np.array([steps[k] for k in keys.tolist()], np.int32), np.array(ends, np.int32)


def arcs(data: np.ndarray, offsets: np.ndarray, tree):
    """Place, length and piece of each arc of the lattices of words given as bytes."""
    keys, to, ends = tree
    stop = np.repeat(offsets[1:], np.diff(offsets))
    at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
    places, lengths, kinds = [], [], []
    while len(at):
        inside = at + depth < stop[at]
        at, node = at[inside], node[inside]
        key = node << 8 | data[at + depth]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[k] == key
        at, node, depth = at[hit], to[k[hit]].astype(np.int64), depth + 1
        full = ends[node] >= 0
        places.append(at[full])
        lengths.append(np.full(int(full.sum()), depth))
        kinds.append(ends[node[full]])
    return np.concatenate(places), np.concatenate(lengths), np.concatenate(kinds)


def _sums(start: np.ndarray, a: np.ndarray, b: np.ndarray, level: np.ndarray, w: np.ndarray, nodes: int) -> np.ndarray:
    """Log of the summed weight of all paths from the nodes `start` to each node; arcs a -> b of weight w, b at its word's level."""
    total = np.full(nodes, -np.inf)
    total[start] = 0
    order = np.lexsort((b, level))
    a, b, level, w = a[order], b[order], level[order], w[order]
    new = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.append(True, level[new][1:] != level[new][:-1])) if len(new) else np.zeros(0, np.int64)
    for s, e in zip(cut, np.append(cut[1:], len(new))):
        first, last = new[s], new[e] if e < len(new) else len(b)
        total[b[new[s:e]]] = np.logaddexp.reduceat(total[a[first:last]] + w[first:last], new[s:e] - first)
    return total


def lattices(words: pa.Array, tree, logp: np.ndarray, counts: np.ndarray | None = None):
    """Log probability of each word; with counts, also the expected number of each piece in that many of them."""
    data, offsets = tv.buffers(words)
    size = np.diff(offsets) + len(MARK)
    off = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(off[-1], np.uint8)
    is_mark = np.zeros(off[-1], bool)
    for k, byte in enumerate(MARK):
        marked[off[:-1] + k] = byte
        is_mark[off[:-1] + k] = True
    marked[~is_mark] = data
    place, length, kind = arcs(marked, off, tree)
    word = np.repeat(np.arange(len(size)), size)[place]
    a = place + word
    local = place - off[word]
    first, last, nodes = off[:-1] + np.arange(len(size)), off[1:] + np.arange(len(size)), int(off[-1]) + len(size)
    ahead = _sums(first, a, a + length, local + length, logp[kind], nodes)
    if counts is None:
        return ahead[last]
    back = _sums(last, a + length, a, size[word] - local, logp[kind], nodes)
    share = np.exp(ahead[a] + logp[kind] + back[a + length] - ahead[last][word])
    return ahead[last], np.bincount(kind, share * counts[word], minlength=len(logp))


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: chunk, word, place, train (a chunk's different words); chunk, doc_id, held_out, places, times (its documents)."""
    schema = pa.schema([("chunk", pa.int64()), ("word", pa.string()), ("place", pa.int32()), ("train", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def gathered(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > CHUNK - (3 << 20):
                whole, held, size = pa.concat_batches(held), [], 0
                yield whole
        if held:
            yield pa.concat_batches(held)

    def words(data, off):
        """The numbers of the words of each piece of a chunk, its first and last document, where each document's words begin, and the words that have these numbers."""
        bounds, cut = [], []
        for p, q in tv.chunks(off, PIECE):
            low = tv.LOWER[data[off[p] : off[q]]]
            starts, ends, woff = tv.word_bounds(low, off[p : q + 1] - off[p])
            size = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            cut.append(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(size), pa.py_buffer(low[~tv.SPACE[low]])).dictionary_encode())
            bounds.append((p, q, woff))
        cut = pa.chunked_array(cut).unify_dictionaries().chunks
        return [(x.indices.to_numpy(), *k) for x, k in zip(cut, bounds)], cut[0].dictionary

    def run(batches):
        no, task = 0, TaskContext.get().partitionId() << 32
        for b in gathered(batches):
            for i, j, data, off in tv.documents(b.column(2), CHUNK):
                pieces, known = words(data, off)
                held, n, chunk = b.column(1)[i:j].to_numpy(zero_copy_only=False), len(known), task + no
                train = np.zeros(n, np.int64)
                no += 1
                for ids, p, q, woff in pieces:
                    doc = np.repeat(np.arange(q - p), np.diff(woff))
                    np.add.at(train, ids[~held[p:q][doc]], 1)
                    code, times = np.unique(doc << 32 | ids, return_counts=True)
                    bounds = pa.array(np.searchsorted(code >> 32, np.arange(q - p + 1)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (code & 0xFFFFFFFF, times)]
                    cols = [pa.array(np.full(q - p, chunk)), *(pa.nulls(q - p, f.type) for f in list(schema)[1:4]), b.column(0)[i + p : i + q], b.column(1)[i + p : i + q], *lists]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
                for s in range(0, n, 100_000):
                    e = min(n, s + 100_000)
                    cols = [pa.array(np.full(e - s, chunk)), known[s:e].cast(pa.string()), pa.array(np.arange(s, e, dtype=np.int32)), pa.array(train[s:e])]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(e - s, f.type) for f in list(schema)[4:])], schema=schema)

    held = F.coalesce(crc_of_id() % FOLDS == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held, F.coalesce("text", F.lit("")))
    return rows.mapInArrow(run, "chunk long, word string, place int, train long, doc_id long, held_out boolean, places array<int>, times array<int>")


def expected(words: DataFrame, tree, prior: np.ndarray) -> np.ndarray:
    """Expected count of each piece in all training words under the prior."""

    def run(batches):
        logp = np.log(prior)
        total = np.zeros(len(logp))
        for b in batches:
            for s in range(0, len(b), WORDS):
                total += lattices(b.column(0)[s : s + WORDS], tree.value, logp, b.column(1)[s : s + WORDS].to_numpy().astype(float))[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

    sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    out = np.zeros(len(prior))
    out[sums.column("piece").to_numpy()] = sums.column("n").to_numpy()
    return out


def probabilities(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    pieces, prior = vocabulary(path)
    sc = docs.sparkSession.sparkContext
    tree = sc.broadcast(trie(pieces))
    rows = saved(chunks(docs))
    own, texts = rows.where("word is not null").select("chunk", "word", "place", "train"), rows.where("word is null").select("chunk", "doc_id", "held_out", "places", "times")
    words = saved(own.groupBy("word").agg(F.sum("train").alias("c")))
    ends = texts.where("not held_out").count()
    spoken, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = spoken + ends, kinds + int(ends > 0)
    counts = expected(words, tree, prior) + PRIOR * prior
    counts[-1] += ends
    logp = sc.broadcast(np.log(counts / counts.sum()))

    def forward(batches):
        for b in batches:
            for s in range(0, len(b), WORDS):
                part = b.slice(s, WORDS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lattices(part.column(0), tree.value, logp.value))], names=["word", "c", "p"])

    known = saved(own.select("chunk", "word", "place").join(words.mapInArrow(forward, "word string, c long, p double"), "word").select("chunk", "place", "c", "p"))
    least = n + 0.1 * (v + 1)

    def scored(docs, values):
        order = np.argsort(values.column("place").to_numpy())
        c, p = values.column("c").to_numpy()[order], values.column("p").to_numpy()[order] / np.log(10)
        base = np.log10((c + 0.1) / least)
        places, times = (docs.column(x).combine_chunks() for x in ("places", "times"))
        at, off = places.flatten().to_numpy(), np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())])
        w = times.flatten().to_numpy().astype(np.int64)
        total = lambda x, last: tv.reduce_by(x, off) + last
        cols = [total(w, 1), total(w * (c[at] > 0), int(ends > 0)), np.full(len(off) - 1, n), total(w * base[at], np.log10((ends + 0.1) / least)), total(w * p[at], logp.value[-1] / np.log(10))]
        return pa.Table.from_arrays([docs.column("doc_id"), docs.column("held_out"), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = saved(out)
    forget(rows, words, known)
    return out


def op12_lattice_lm(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    import public_tokenizers

    return probabilities(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))
