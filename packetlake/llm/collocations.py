"""Phrase collocations from count streams in prefix and suffix order.

Counting: each task cuts a few MB of text at a time into n-grams and counts them exactly on word numbers of that piece
of text (sorts, no sets); the counts are added up by phrase. Orders build on each other: only pairs of words that are
frequent enough are sent, and only triples and quadruples of frequent pairs, because no phrase is more frequent than a
part of it. The test is a bit map of fixed size, which lets some infrequent ones pass (they go when their own count is
known), more of them in a larger corpus, and loses none.

Scoring: the frequent phrases of all orders are one stream. In prefix order each phrase comes after its beginnings, in
suffix order after its ends, so one walk over the sorted stream gives the counts of all first parts, and one over the
same stream in suffix order those of all rests, without a look-up. Phrases come in ranges; what a range needs of the ones
before it are their last phrases of one, two and three words, a row a range. A phrase is dropped for the longer phrases
that hold it: if one of those does, so does the part of it with one more word, which both walks see as an extension.

Edge cases: null texts are empty, null languages `und`; empty texts and texts without words count nothing; equal rows
count as often as they stand there; an empty table gives an empty result; other columns are ignored; texts are never
cut. Scores are exact decimals of 38 digits.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import postings
from . import textvec as tv
from .common import forget, saved, table

LEAST, COVERED, TOP, LONGEST = 30, 80, 2000, 4
SCALE = 2_000_000
#: Bytes of text that are counted together (a task needs 40 times as much); bits of a bit map of frequent phrases.
PIECE, BITS = 2 << 20, 1 << 26
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _words(data: np.ndarray, offsets: np.ndarray):
    """Start and end of each word, its document, and whether it goes on in the piece of the word before it."""
    inside = ~_GAP[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    goes_on = np.zeros(len(starts), bool)
    goes_on[1:] = (doc[1:] == doc[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return starts, ends, doc, goes_on


def _hash(parts: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    h = lang
    for p in parts:
        h = tv.mix(h * np.uint64(3) + p, 7)
    return h


def _lang_hashes(lang: pa.Array) -> np.ndarray:
    data, offsets = tv.buffers(lang)
    return tv.word_hashes(data, offsets[:-1], offsets[1:]) if len(lang) else np.zeros(0, np.uint64)


def _count(lang: pa.Array, data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], known):
    """(lang, phrase, n-grams' counts) of some documents. known: bit map of frequent phrases one word (or, for orders over 2, of two words) long."""
    data = tv.LOWER[data]
    starts, ends, doc, goes_on = _words(data, offsets)
    if not len(starts):
        return
    langs = pc.dictionary_encode(lang)
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs), pa.py_buffer(data[~_GAP[data]])).dictionary_encode()
    word = text.indices.to_numpy().astype(np.int64) + len(text.dictionary) * langs.indices.to_numpy()[doc].astype(np.int64)
    kinds, ids = np.unique(word, return_inverse=True)  # a word of a language
    spelled = text.dictionary.take(pa.array(kinds % len(text.dictionary)))
    tongue = langs.dictionary.take(pa.array(kinds // len(text.dictionary)))
    raw, off = tv.buffers(spelled)
    hashes, tongues = tv.word_hashes(raw, off[:-1], off[1:]), _lang_hashes(tongue)

    if orders == (1,):
        yield tongue, spelled, np.bincount(ids, minlength=len(kinds)), 1
        return
    pair_ok = goes_on.copy()
    if orders == (2,):
        frequent = postings.held(known, _hash([hashes], tongues).view(np.int64))[ids]
        pair_ok[1:] &= frequent[1:] & frequent[:-1]
    else:
        at = np.flatnonzero(goes_on)
        pair_ok[at] = postings.held(known, _hash([hashes[ids[at - 1]], hashes[ids[at]]], tongues[ids[at]]).view(np.int64))
    heads = ids.astype(np.int64)  # number of the phrase that ends at each word, one word shorter than the next
    ends_ok = np.ones(len(ids), bool)
    for n in range(2, max(orders) + 1):
        at = np.flatnonzero(pair_ok[1:] & ends_ok[:-1]) + 1
        codes, inverse, counts = np.unique(heads[at - 1] << 32 | ids[at], return_inverse=True, return_counts=True)
        if n in orders and len(codes):
            first = np.zeros(len(codes), np.int64)
            first[inverse] = at
            parts = [spelled.take(pa.array(ids[first - k])) for k in range(n - 1, -1, -1)]
            yield tongue.take(pa.array(ids[first])), pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type)), counts, n
        ends_ok = np.zeros(len(ids), bool)
        ends_ok[at] = True
        heads[at] = inverse


def ngrams(docs: DataFrame, orders: tuple[int, ...], known=None) -> DataFrame:
    """lang, phrase, k (words), f: exact counts of the phrases of these orders of which `known` (a broadcast bit map) may hold all parts."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])

    def counted(held):
        lang = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
        text = pa.chunked_array([b.column(1) for b in held]).combine_chunks()
        for i, j, data, off in tv.documents(text, PIECE):
            for tongue, phrase, f, k in _count(lang.slice(i, j - i), data, off, orders, known and known.value):
                for s in range(0, len(f), 100_000):
                    part = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays([tongue[part].cast(pa.string()), phrase[part].cast(pa.string()), pa.array(np.full(len(f[part]), k, np.int32)), pa.array(f[part].astype(np.int64))], schema=schema)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > PIECE:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def _bits(phrases: DataFrame):
    """A broadcast bit map of phrases of a language."""

    def run(batches):
        for b in batches:
            data, off = tv.buffers(b.column(1))
            starts, ends, woff = tv.word_bounds(data, off)
            words, k = tv.word_hashes(data, starts, ends), np.diff(woff)
            lang = _lang_hashes(b.column(0))
            h = np.zeros(len(k), np.uint64)
            for n in np.unique(k):
                at = np.flatnonzero(k == n)
                h[at] = _hash([words[woff[at] + q] for q in range(n)], lang[at])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return phrases.sparkSession.sparkContext.broadcast(postings.bit_map(phrases.select("lang", "phrase").mapInArrow(run, "h long"), "h", BITS))


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of 1 to 4 words that stand at least `least` times in a language; (lang, n), the words of each language."""
    often = F.col("f") >= least
    words = saved(ngrams(docs, (1,)))
    totals = saved(words.groupBy("lang").agg(F.sum("f").alias("n")))
    one = saved(words.where(often))
    forget(words)
    two = saved(ngrams(docs, (2,), _bits(one)).where(often))
    more = ngrams(docs, tuple(range(3, LONGEST + 1)), _bits(two)).where(often)
    out = saved(one.unionByName(two).unionByName(more).select("lang", F.split("phrase", " ").alias("words"), "f"))
    forget(one, two)
    return out, totals


def with_parts(stream: DataFrame, order: str, column: str) -> DataFrame:
    """Add `column`: the counts of the first 1, 2, ... words of the array `order`, by one walk over the stream in that order.

    The walk of a range knows only its own phrases; the counts of those that begin before it come from the last ones of
    each length in the ranges before.
    """
    names = [*stream.columns, column, "_range"]
    kinds = dict(stream.dtypes) | {column: "array<bigint>", "_range": "int"}

    def walk(batches):
        task, last, lang, counts = TaskContext.get().partitionId(), [], None, []
        for b in batches:
            out = []
            for tongue, words, f in zip(b.column("lang").to_pylist(), b.column(order).to_pylist(), b.column("f").to_pylist()):
                same = 0
                if tongue == lang:
                    for x, y in zip(words, last):
                        if x != y:
                            break
                        same += 1
                counts = counts[:same] + [None] * (len(words) - 1 - same)
                out.append(counts)
                last, lang, counts = words, tongue, [*counts, f]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64())), pa.array(np.full(len(out), task, np.int32))], names=names)

    parts = 2 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stream.repartitionByRange(parts, "lang", order).sortWithinPartitions("lang", order)
    out = saved(ranges.mapInArrow(walk, ", ".join(f"{n} {kinds[n]}" for n in names)))
    ends = [F.max(F.when(F.size(order) == k, F.struct("lang", order, "f"))).alias(f"e{k}") for k in range(1, LONGEST)]
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = out.groupBy("_range").agg(*ends).select("_range", F.array(*[F.max(f"e{k}").over(before)["f"] for k in range(1, LONGEST)]).alias("_carried"))  # a row a range
    return out.join(F.broadcast(carried), "_range").withColumn(column, F.transform(column, lambda x, i: F.coalesce(x, F.get("_carried", i)))).drop("_range", "_carried")


def scored(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    heads = with_parts(phrases, "words", "heads").withColumn("back", F.reverse("words"))
    both = saved(with_parts(heads, "back", "tails"))
    size, exact = F.size("words"), lambda c: c.cast("decimal(20,0)")
    covers = lambda part: exact(F.col("f")) * 100 >= exact(F.element_at(part, -1)) * covered
    longer = both.where(size > 2)
    gone = longer.where(covers("heads")).select("lang", F.slice("words", F.lit(1), size - 1).alias("words"))
    gone = gone.unionByName(longer.where(covers("tails")).select("lang", F.slice("words", F.lit(2), size - 1).alias("words")))
    left = both.where(size > 1).join(gone.hint("merge"), ["lang", "words"], "left_anti")

    def cut(head, i):
        rest = F.element_at("tails", size - 1 - i)
        score = F.call_function("div", exact(F.col("f")) * SCALE, exact(head) + exact(rest))
        return F.struct(score.alias("score"), i.alias("i"), head.alias("l"), rest.alias("r"))

    best = F.array_min(F.transform("heads", cut))
    return left.withColumn("best", best).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 4 words."""
    phrases, totals = frequent(docs, least)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = scored(phrases).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)  # so that a language's rows don't meet before they are few
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
