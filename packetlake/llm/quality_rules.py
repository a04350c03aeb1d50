"""Quality rules: repetition counts, and perplexity bands of a modified Kneser-Ney model counted by Spark.

The model is of n-grams of characters: those of ASCII are told apart, the others fall into 128 hashed kinds, so that the
letters of every script have their own statistics. Texts are dealt into two folds by their hash, and each is scored by
the model of its language that was counted on the other fold, so no text (nor a copy of it) is judged by itself.

The model holds every n-gram. What the texts of a fold ask for is in that fold's own counts, so Spark joins these with the
other fold's model, level by level, into a table of all answers. Those to n-grams that make up more than one in RARE of
the asking fold's are fewer than RARE a language and fold, and are broadcast as sorted arrays, for as many languages at a
time as fit MODEL_ROWS rows (further languages are scored in further passes); a text's other n-grams are joined with the
rest of the table.

Bands: per language, so many robust deviations (one for each side) around the median of the log-perplexity of the
documents that pass the base rules, wider for short texts. All documents count for it. A language of fewer than LEAST
such documents has no band of its own and takes that of all languages.

Edge cases: null and empty texts have no words and fail the base rules; a null language counts as the language "";
a language without text in the other fold is scored by the floor of an empty model; repeated rows are scored alike; extra
columns are ignored; an empty table gives an empty result.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .common import forget, saved, table

ORDER, BITS, BELOW, ABOVE = 5, 8, 10.0, 10.0
#: Kinds of characters: 0 is before the text, 1 to 127 are ASCII, the others hashed.
KINDS = 1 << BITS
RARE, MODEL_ROWS, LEAST = 1 << 22, 8_000_000, 50


def kinds_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each character, and where each document's characters begin."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    hashed = 128 + ((points * 0x9E3779B1 >> 12) & 127)
    return np.where(points < 128, np.maximum(points, 1), hashed), lead[offsets]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts for each document of a batch."""
    starts, ends, woff = tv.word_bounds(data, offsets)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    symbols = np.zeros(256, bool)
    symbols[[ord(x) for x in "#*$%&|<>"]] = True
    nsym = np.concatenate([[0], np.cumsum(symbols[data])])
    words = tv.word_hashes(data, starts, ends)
    chars = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
    n = len(offsets) - 1
    # lines: cut at \n and at document ends; a line's hash covers all its bytes
    cuts = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    first = first[first < len(data)]
    last = np.concatenate([first[1:], [len(data)]]) if len(first) else first
    ends_nl = data[last - 1] == 10 if len(first) else np.zeros(0, bool)
    stop = last - ends_nl
    line_doc = np.searchsorted(offsets, first, "right") - 1
    has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, first)
    h = tv.word_hashes(data, first, stop) + (stop - first).astype(np.uint64)
    h, line_doc = h[has_word], line_doc[has_word]
    order = np.lexsort((h, line_doc))
    same = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup_lines = np.bincount(line_doc[order][1:][same], minlength=n) if len(order) else np.zeros(n, int)
    # words in 8-word windows that occur twice or more
    win, at = tv.windows(words, woff, 8)
    doc = np.searchsorted(woff, at, "right") - 1
    order = np.lexsort((win, doc))
    same = (win[order][1:] == win[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(win), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 9, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    rep = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(words)] > 0)])
    return {"n_words": np.diff(woff), "word_chars": np.diff(chars[woff]), "n_symbols": np.diff(nsym[offsets]), "n_dup_lines": dup_lines, "n_repeat_words": np.diff(rep[woff])}


def ngram_keys(kinds: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each character, the packed kinds of the n-gram that ends there."""
    key = kinds.copy()
    at = np.arange(len(kinds)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        prev = np.zeros(len(kinds), np.int64)
        prev[k:] = kinds[:-k]
        prev[at < k] = 0
        key |= prev << (BITS * k)
    return key


def _added(parts):
    keys, n = (np.concatenate(x) for x in zip(*parts))
    k, inverse = np.unique(keys, return_inverse=True)
    return k, np.bincount(inverse, weights=n, minlength=len(k)).astype(np.int64)


def _folds(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, fold (of the text's hash) and own (a number of the language)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), F.xxhash64(lang).alias("own"))


def count_ngrams(folds: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(own, fold, key, n) for all n-grams of all texts: counted per task in sorted arrays of `most` keys or so, then added up by Spark."""

    def rows(held):
        for (own, fold), parts in held.items():
            k, n = _added(parts)
            for s in range(0, len(k), 50_000):
                m = len(k[s : s + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, own)), pa.array(np.full(m, fold, np.int32)), pa.array(k[s : s + m]), pa.array(n[s : s + m])], names=["own", "fold", "key", "n"])

    def count(batches):
        held: dict[tuple, list] = {}
        size = 0
        for b in batches:
            group = b.column(1).to_numpy() * 2 + b.column(2).to_numpy()  # wraps, and tells the same pairs apart
            for i, j, data, off in tv.documents(b.column(0)):
                kinds, at = kinds_of(data, off)
                keys, codes = ngram_keys(kinds, at), np.repeat(np.arange(i, j), np.diff(at))
                for g in np.unique(group[i:j]):
                    d = i + int(np.flatnonzero(group[i:j] == g)[0])
                    u, n = np.unique(keys[group[codes] == g], return_counts=True)
                    parts = held.setdefault((b.column(1)[d].as_py(), b.column(2)[d].as_py()), [])
                    parts.append((u, n))
                    size += len(u)
                    if len(parts) > 16:
                        before = sum(len(k) for k, _ in parts)
                        parts[:] = [_added(parts)]
                        size -= before - len(parts[0][0])
            if size > most:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    counted = folds.select("text", "own", "fold").mapInArrow(count, "own long, fold int, key long, n long")
    return counted.groupBy("own", "fold", "key").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER, rare: int | None = None) -> DataFrame:
    """(own, fold, level, key, probability, back-off weight) rows of the interpolated modified Kneser-Ney model.

    The highest level uses counts, the lower ones the number of different continuations to the left. Each level's three
    discounts come from its counts of counts. Everything is a group-by over the n-gram table. With `rare`, n-grams that make
    up less than one in so many are left to the lower orders; no query asks for that.
    """
    levels = []
    grams, model = counts, ["own", "fold"]
    for level in range(order, 0, -1):
        mask = (1 << (BITS * level)) - 1
        if level < order:
            grams = grams.groupBy(*model, F.col("key").bitwiseAND(mask).alias("key")).agg(F.count("*").alias("n"))
        g = grams.withColumn("ctx", F.shiftright("key", BITS))
        cc = g.groupBy(*model).agg(F.sum("n").alias("all"), *[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.expr("n1 / greatest(n1 + 2 * n2, 1)")
        discount = lambda i: F.greatest(F.lit(0.05), F.least(F.lit(float(i)) - 0.05, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))
        cc = cc.select(*model, "all", *[F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), discount(i)).otherwise(F.lit(0.5)).alias(f"d{i}") for i in (1, 2, 3)])
        g = g.join(cc, model)  # two rows a language
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        w = W.partitionBy(*model, "ctx")
        p = (F.col("n") - d) / F.sum("n").over(w)
        g = g.withColumn("p", F.when(F.col("n") * rare > F.col("all"), p) if rare else p).withColumn("bow", 1 - F.sum("p").over(w))
        levels.append(g.where("p is not null").select(*model, F.lit(level).cast("byte").alias("level"), "key", F.col("p").cast("float"), F.greatest("bow", F.lit(1e-6)).cast("float").alias("bow")))
    return functools.reduce(DataFrame.unionByName, levels)


def answers(counts: DataFrame, model: DataFrame, order: int = ORDER, rare: int = RARE) -> DataFrame:
    """(own, fold, key, often, logp): each n-gram of a fold's texts, whether it makes up more than one in `rare` there, and its log-probability by the other fold's model.

    An n-gram's probability is its own part and the back-off weight of its context times the probability of the n-gram
    without its first character. No key of these joins has more than KINDS rows.
    """
    model, names, below, held = model.withColumn("fold", 1 - F.col("fold")), ["own", "fold"], None, []
    for level in range(1, order + 1):
        ask = counts.select(*names, F.col("key").bitwiseAND((1 << (BITS * level)) - 1).alias("key"))
        mine = model.where(F.col("level") == level)
        weights = mine.groupBy(*names, F.shiftright("key", BITS).alias("ctx")).agg(F.max("bow").alias("bow"))
        rows = (ask.distinct() if level < order else ask).withColumn("ctx", F.shiftright("key", BITS))
        rows = rows.join(mine.select(*names, "key", "p"), [*names, "key"], "left").join(weights, [*names, "ctx"], "left")
        if level > 1:
            rows = rows.withColumn("short", F.col("key").bitwiseAND((1 << (BITS * (level - 1))) - 1)).join(below, [*names, "short"])
        lower = F.col("q") if level > 1 else F.lit(1 / KINDS)
        q = F.coalesce("p", F.lit(0.0)) + F.coalesce("bow", F.lit(1.0)) * lower
        below = rows.select(*names, F.col("key").alias("short"), q.cast("double").alias("q"))
        if level < order:
            held.append(saved(below))
            below = held[-1]
    total = counts.groupBy(*names).agg(F.sum("n").alias("all"))  # two rows a language
    often = counts.join(total, names).select(*names, F.col("key").alias("short"), (F.col("n") * rare > F.col("all")).alias("often"))
    out = saved(below.join(often, [*names, "short"]).select(*names, F.col("short").alias("key"), "often", F.log("q").cast("float").alias("logp")))
    forget(*held)
    return out


class Model:
    """A model in one place, for tests: sorted key arrays with probabilities for each language and fold; lower levels answer what a higher one lacks."""

    def __init__(self, table, order: int = ORDER):
        self.by = {}
        own, fold, level = (table.column(c).to_numpy() for c in ("own", "fold", "level"))
        keys, p, bow = (table.column(c).to_numpy() for c in ("key", "p", "bow"))
        by = np.lexsort((keys, level, fold, own))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(own[by]) != 0) | (np.diff(fold[by]) != 0) | (np.diff(level[by]) != 0)])) if len(by) else []
        for s, e in zip(first, np.append(first, len(by))[1:].astype(int)):
            at = by[s:e]
            name, n = (int(own[at[0]]), int(fold[at[0]])), int(level[at[0]])
            lower = self.by.get(name, _floor)
            k, q, b = keys[at], p[at].astype(float), bow[at].astype(float)
            ctx, one = np.unique(k >> BITS, return_index=True)
            q = (q + b * lower(k & ((1 << (BITS * (n - 1))) - 1))).astype(np.float32)
            self.by[name] = functools.partial(_probability, k, q, ctx, bow[at][one], lower, n)

    def log_probability(self, own: int, fold: int, keys: np.ndarray) -> np.ndarray:
        return np.log(self.by.get((own, fold), _floor)(keys))


def _floor(keys):
    return np.full(len(keys), 1 / KINDS)


def _probability(keys, p, ctx, bow, lower, level, ask):
    """ask: packed n-grams of any length; the last `level` characters count."""
    ask = ask & ((1 << (BITS * level)) - 1)
    i = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
    found = keys[i] == ask
    out = np.where(found, p[i], 0).astype(float)
    miss = np.flatnonzero(~found)
    if len(miss):
        c = ask[miss] >> BITS
        j = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
        weight = np.where(ctx[j] == c, bow[j], 1.0)
        out[miss] = weight * lower(ask[miss])
    return out


SCORED = "row long, doc_id long, lang string, own long, fold int, n_symbols_in long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, total double, keys array<long>, times array<int>"


def _scored(folds: DataFrame, often) -> DataFrame:
    """The base counts of each document, the sum of the log-probabilities of its n-grams in `often` (own, fold, key, logp), and its other n-grams with the number of times they occur."""
    shared = folds.sparkSession.sparkContext.broadcast(often)
    names = [x.split()[0] for x in SCORED.split(", ")]

    def score(batches):
        own, fold, key, logp = (shared.value.column(c).to_numpy() for c in ("own", "fold", "key", "logp"))
        by, held = np.lexsort((key, fold, own)), {}
        first = np.flatnonzero(np.concatenate([[True], (np.diff(own[by]) != 0) | (np.diff(fold[by]) != 0)])) if len(by) else []
        for s, e in zip(first, np.append(first, len(by))[1:].astype(int)):
            held[int(own[by[s]]), int(fold[by[s]])] = key[by[s:e]], logp[by[s:e]].astype(float)
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            own, fold = b.column(4).to_numpy(), b.column(3).to_numpy()
            for i, j, data, off in tv.documents(b.column(2)):
                c = base_counts(data, off)
                kinds, at = kinds_of(data, off)
                keys, logp = ngram_keys(kinds, at), np.zeros(len(kinds))
                doc, rest = np.repeat(np.arange(i, j), np.diff(at)), np.ones(len(kinds), bool)
                for name, f in {(int(x), int(y)) for x, y in zip(own[i:j], fold[i:j])}:
                    if (name, f) in held:
                        known, p = held[name, f]
                        mine = np.flatnonzero((own[doc] == name) & (fold[doc] == f))
                        u, inverse = np.unique(keys[mine], return_inverse=True)
                        k = np.minimum(np.searchsorted(known, u), len(known) - 1)
                        found = known[k] == u
                        logp[mine], rest[mine] = np.where(found, p[k], 0)[inverse], ~found[inverse]
                total, n = np.concatenate([[0], np.cumsum(logp)]), np.diff(at)
                d, u = doc[rest], keys[rest]
                order = np.lexsort((u, d))
                d, u = d[order], u[order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (u[1:] != u[:-1])])) if len(d) else np.zeros(0, np.int64)
                bounds = pa.array(np.searchsorted(d[new], np.arange(i, j + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(u[new]), pa.array(np.diff(np.append(new, len(d))).astype(np.int32)))]
                counts = (c[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
                plain = [b.column(0)[i:j], b.column(1)[i:j], b.column(4)[i:j], b.column(3)[i:j], pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), *plain, *(pa.array(x, pa.int64()) for x in counts), pa.array(np.diff(total[at])), *lists], names=names)
                row += j - i

    return folds.select("doc_id", "lang", "text", "fold", "own").mapInArrow(score, SCORED)


def _whole(parts: list[DataFrame], table: DataFrame) -> DataFrame:
    """The documents of all passes with log_perplexity (per character; null without text): the n-grams that no pass knew are joined with the table of answers."""
    docs = functools.reduce(DataFrame.unionByName, [p.withColumn("pass", F.lit(k)) for k, p in enumerate(parts)])
    rest = docs.where(F.size("keys") > 0).select("pass", "row", "own", "fold", F.explode(F.arrays_zip("keys", "times")).alias("x"))
    rest = rest.select("pass", "row", "own", "fold", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    rest = rest.join(table.where("not often").select("own", "fold", "key", "logp"), ["own", "fold", "key"])
    rest = rest.groupBy("pass", "row").agg(F.sum(F.col("times") * F.col("logp").cast("double")).alias("rest"))
    mean = -(F.col("total") + F.coalesce("rest", F.lit(0.0))) / F.col("n_symbols_in")
    joined = docs.drop("keys", "times").join(rest, ["pass", "row"], "left")
    return joined.withColumn("log_perplexity", F.when(F.col("n_symbols_in") > 0, mean)).drop("pass", "row", "own", "fold", "total", "rest")


def _groups(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Languages (name, rows of the model) in groups of at most `most` rows, a larger one alone."""
    out, room = [], 0
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if n > room:
            out.append([])
            room = most
        out[-1].append(name)
        room -= n
    return out


def quality_rules(docs: DataFrame, below: float = BELOW, above: float = ABOVE, most: int = MODEL_ROWS, rare: int = RARE) -> DataFrame:
    """doc_id, the base counts, log_perplexity, base_failed, kept."""
    folds = _folds(docs)
    counts = saved(count_ngrams(folds))
    model = saved(kneser_ney(counts))
    found = answers(counts, model, rare=rare)
    forget(counts, model)
    often = found.where("often").select("own", "fold", "key", "logp")
    sizes = [(r["own"], r["n"]) for r in often.groupBy("own").agg(F.count("*").alias("n")).collect()]  # one row a language
    groups = _groups(sizes, most) or [[]]
    parts = []
    for k, names in enumerate(groups):
        mine = folds.where(F.col("own").isin(names)) if k else folds.where(~F.col("own").isin([x for g in groups[1:] for x in g]))
        parts.append(saved(_scored(mine, often.where(F.col("own").isin(names)).toArrow())))  # at most `most` rows, or one language's
    scored = saved(_whole(parts, found))
    forget(found, *parts)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    # the spread of a mean falls with the length, so a short text's band is wider by the root of its length
    wide = F.greatest(F.lit(1.0), F.sqrt(F.lit(1000.0) / F.greatest("n_symbols_in", F.lit(1))))
    good = scored.where("not base_failed and log_perplexity is not null")
    middle = lambda x: F.percentile_approx(x, 0.5, F.lit(10_000))
    mid = good.cube("lang").agg(middle("log_perplexity").alias("mid"), F.count("*").alias("n"), F.grouping("lang").alias("g"))
    mid = saved(mid)  # a row a language, and one of all
    every = F.broadcast(mid.where("g = 1").select(F.col("mid").alias("mid_all")))
    off = (F.col("log_perplexity") - F.col("mid")) / wide
    away = good.join(F.broadcast(mid.where(f"g = 0 and n >= {LEAST}").select("lang", "mid")), "lang", "left").join(every).withColumn("mid", F.coalesce("mid", "mid_all"))
    sides = away.cube("lang").agg(middle(F.when(off < 0, -off)).alias("low"), middle(F.when(off > 0, off)).alias("high"), F.grouping("lang").alias("g"))
    sides = saved(sides)
    band = mid.where(f"g = 0 and n >= {LEAST}").join(sides.where("g = 0"), "lang").select("lang", "mid", "low", "high")
    rest = mid.where("g = 1").select(F.col("mid").alias("mid_all")).join(sides.where("g = 1").select(F.col("low").alias("low_all"), F.col("high").alias("high_all")))
    joined = scored.join(F.broadcast(band), "lang", "left").join(F.broadcast(rest), how="left")  # a row a language; one row
    low, high = (F.greatest(F.coalesce(F.col(x), F.col(x + "_all"), F.lit(0.0)), F.lit(0.004)) for x in ("low", "high"))
    mid = F.coalesce("mid", "mid_all")
    inside = F.col("log_perplexity").between(mid - below * low * wide, mid + above * high * wide)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lang")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
